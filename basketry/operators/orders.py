"""Order-level building blocks.

Item lines and reviews are always reduced to one row per order before they meet another
table. The reduction combines on the map side, so an order that holds a large part of all
lines reaches the shuffle as one row per task, and joins on ``order_id`` are between
unique keys: nothing fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import is_delivered, line_value
from basketry.schema import Tables

PERSON = "customer_unique_id"
PURCHASED = "order_purchase_timestamp"


def reduced_lines(t: Tables) -> DataFrame:
    """Delivered lines as one row per (order, seller, product), which every report can start from.

    The result may stand for ``order_items`` in a set of tables; see ``plans.dashboard``.
    """
    delivered = t["orders"].where(is_delivered()).select("order_id")
    items = t["order_items"]
    return (
        items.join(delivered, "order_id", "left_semi")
        .groupBy("order_id", "seller_id", "product_id")
        .agg(price_total(items).alias("price_sum"), *_value_measures(items))
        .withColumnsRenamed({"order_value": "value_sum", "lines": "line_count"})
    )


def is_reduced(items: DataFrame) -> bool:
    return "line_count" in items.columns


def price_total(items: DataFrame) -> Column:
    return F.sum("price_sum" if is_reduced(items) else "price")


def line_total(items: DataFrame) -> Column:
    return F.sum("line_count") if is_reduced(items) else F.count(F.lit(1))


def lacks_value(items: DataFrame) -> Column:
    """Whether a row of ``items`` stands for a line without a value."""
    if is_reduced(items):
        return F.col("valued_lines") < F.col("line_count")
    return F.col("price").isNull() | F.col("freight_value").isNull()


def _value_measures(items: DataFrame) -> list[Column]:
    value, valued = (
        (F.sum("value_sum"), F.sum("valued_lines"))
        if is_reduced(items)
        else (F.sum(line_value()), F.count(line_value()))
    )
    return [value.alias("order_value"), valued.alias("valued_lines"), line_total(items).alias("lines")]


def order_values(items: DataFrame) -> DataFrame:
    """Per order: value, lines that carry a value, all lines."""
    return items.groupBy("order_id").agg(*_value_measures(items))


def order_contents(items: DataFrame, masks: DataFrame, lanes: list[str]) -> DataFrame:
    """``order_values`` and the order's categories as bits.

    ``masks`` has the category bit of each product (see ``operators.dictionary``). Products are
    joined without a forced broadcast; a hot product is split by AQE.
    """
    return (
        items.join(masks, "product_id", "left")
        .groupBy("order_id")
        .agg(*_value_measures(items), *[F.bit_or(lane).alias(lane) for lane in lanes])
    )


def review_totals(reviews: DataFrame) -> DataFrame:
    """Per order: reviews, scored reviews, score sum, reviews scored two or less."""
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count("review_score").alias("scored_reviews"),
        F.sum("review_score").alias("score_sum"),
        F.count_if(F.col("review_score") <= 2).alias("negative_reviews"),
    )


def delivered_orders(orders: DataFrame) -> DataFrame:
    return orders.where(is_delivered()).select("order_id", "customer_id", PURCHASED)


def delivered_baskets(t: Tables) -> DataFrame:
    """Delivered orders that have items, with their values."""
    return order_values(t["order_items"]).join(delivered_orders(t["orders"]), "order_id")


def with_person(df: DataFrame, t: Tables, *extra: str) -> DataFrame:
    """Attach the person behind ``customer_id``.

    ``customers`` grows with the orders, so no broadcast is forced: Spark broadcasts it
    only under its size threshold and AQE splits a hot ``customer_id`` otherwise.
    """
    return df.join(t["customers"].select("customer_id", PERSON, *extra), "customer_id")


def sums(*names: str) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def spend_per_customer_id(t: Tables) -> DataFrame:
    """Delivered spend per ``customer_id``: collapses a hot id before the person join."""
    return delivered_baskets(t).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        *sums("order_value", "valued_lines"),
        F.min(PURCHASED).alias("first_purchase"),
        F.max(PURCHASED).alias("last_purchase"),
    )


def spend_per_person(t: Tables) -> DataFrame:
    """Delivered spend per person; ``order_id`` is unique, so counts need no DISTINCT."""
    return with_person(spend_per_customer_id(t), t).groupBy(PERSON).agg(
        *sums("order_count", "order_value", "valued_lines"),
        F.min("first_purchase").alias("first_purchase"),
        F.max("last_purchase").alias("last_purchase"),
    )


def reference_date(orders: DataFrame) -> DataFrame:
    """One row: the latest purchase over all orders, whatever their status."""
    return orders.agg(F.max(PURCHASED).alias("reference_date"))
