"""Column expressions shared by the plans. Everything here is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIVERED = "delivered"
CANCELED = "canceled"
UNKNOWN_CATEGORY = "unknown"


def is_delivered() -> Column:
    return F.col("order_status") == DELIVERED


def line_value() -> Column:
    """What the buyer paid for one item line; NULL when either part is NULL."""
    return F.col("price") + F.col("freight_value")


def ratio(total: Column, count: Column) -> Column:
    """A mean from its parts, as double; NULL instead of a division by zero.

    Kept apart from ``avg`` so that partial sums from several shuffle levels combine
    exactly: the decimal sum is exact and is rounded once, by the final division.
    """
    return F.try_divide(total.cast("double"), count.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))


def days_between(earlier: Column, later: Column) -> Column:
    """Calendar-day boundaries crossed (23:00 to 01:00 is one day)."""
    return F.datediff(later, earlier).cast("long")


def month_start(moment: Column) -> Column:
    """First instant of the month; goes through DATE so no time zone is involved."""
    return F.trunc(moment.cast("date"), "month").cast("timestamp_ntz")


def shortened(text: Column, length: int) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def fixed(value: Column, decimals: int) -> Column:
    """Half-even text with a fixed number of decimals and no thousands separator."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("R$"), F.format_number(amount, 0))


def millions_text(amount: Column) -> Column:
    return F.concat(F.lit("R$"), fixed(amount.cast("double") / F.lit(1e6), 2), F.lit("M"))


def percent_text(value: Column, decimals: int) -> Column:
    return F.concat(fixed(value, decimals), F.lit("%"))


def score_text(score: Column) -> Column:
    return F.coalesce(fixed(score, 2), F.lit("-"))
