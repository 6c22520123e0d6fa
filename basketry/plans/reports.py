"""Business reports: months, states, reviews, payments, sellers, categories, KPIs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import (
    UNKNOWN_CATEGORY,
    fixed,
    is_delivered,
    millions_text,
    money_text,
    month_start,
    percent,
    percent_text,
    ratio,
    score_text,
    shortened,
)
from basketry.operators.orders import (
    PERSON,
    PURCHASED,
    delivered_baskets,
    delivered_orders,
    line_total,
    order_values,
    price_total,
    review_totals,
    sums,
    with_person,
)
from basketry.plans.segments import CHURN_DAYS, churn_rate
from basketry.schema import MONEY_TOTAL, Tables


def monthly_timeline(t: Tables, years: Sequence[int] | None = None) -> DataFrame:
    """Item lines and revenue of delivered orders per month; no years means all years."""
    return _months(t, years).orderBy(F.col("month").asc_nulls_last())


def _months(t: Tables, years: Sequence[int] | None = None) -> DataFrame:
    purchased = F.col(PURCHASED)
    chosen = t | {"orders": t["orders"].where(in_years(purchased, years))} if years else t
    return (
        delivered_baskets(chosen)
        .groupBy(F.year(purchased).cast("long").alias("year"), month_start(purchased).alias("month"))
        .agg(
            F.sum("lines").alias("item_line_count"),
            F.sum("order_value").cast(MONEY_TOTAL).alias("revenue"),
        )
    )


def in_years(moment: Column, years: Sequence[int]) -> Column:
    """Whether ``moment`` lies in one of the years, as ranges that reach the scan."""
    ranges = [
        (moment >= F.expr(f"TIMESTAMP_NTZ '{y:04d}-01-01'"))
        & (moment < F.expr(f"TIMESTAMP_NTZ '{y + 1:04d}-01-01'"))
        for y in years
    ]
    return reduce(or_, ranges)


def active_years(t: Tables) -> DataFrame:
    """The years of the timeline, ascending."""
    items = t["order_items"].select("order_id")
    sold = delivered_orders(t["orders"]).join(items, "order_id", "left_semi")
    years = sold.select(F.year(PURCHASED).cast("long").alias("year")).distinct()
    return years.orderBy(F.col("year").asc_nulls_last())


def by_state(t: Tables, n: int | None = None) -> DataFrame:
    """Persons and mean line value per state, most persons first.

    A person seen in two states counts in both.
    """
    per_customer_id = (
        delivered_baskets(t).groupBy("customer_id").agg(*sums("order_value", "valued_lines"))
    )
    per_person = (
        with_person(per_customer_id, t, "customer_state")
        .groupBy("customer_state", PERSON)
        .agg(*sums("order_value", "valued_lines"))
    )
    states = (
        per_person.groupBy("customer_state")
        .agg(F.count(F.lit(1)).alias("customer_count"), *sums("order_value", "valued_lines"))
        .select(
            "customer_state",
            "customer_count",
            ratio(F.col("order_value"), F.col("valued_lines")).alias("avg_item_value"),
        )
    )
    ordered = states.orderBy(F.col("customer_count").desc(), F.col("customer_state").asc_nulls_last())
    return ordered if n is None else ordered.limit(n)


def share_of_total(count: str) -> Column:
    """Share in percent of each row of an already grouped, small frame."""
    return percent(F.col(count), F.sum(count).over(Window.partitionBy()))


def _score_counts(t: Tables) -> DataFrame:
    scored = t["order_reviews"].where(F.col("review_score").isNotNull())
    return scored.groupBy("review_score").agg(F.count(F.lit(1)).alias("review_count"))


def review_scores(t: Tables) -> DataFrame:
    """Reviews per score with their share."""
    counts = _score_counts(t)
    return counts.withColumn("share_pct", share_of_total("review_count")).orderBy("review_score")


def mean_review(t: Tables) -> DataFrame:
    """One row: the mean score, weighted by the histogram."""
    weighted = F.sum(F.col("review_score") * F.col("review_count"))
    return _score_counts(t).agg(
        ratio(weighted, F.sum("review_count")).alias("mean_score"),
    )


def payment_types(t: Tables) -> DataFrame:
    """Payments, amount and share of payments per type, most used first."""
    counts = (
        t["order_payments"]
        .groupBy("payment_type")
        .agg(
            F.count(F.lit(1)).alias("payment_count"),
            F.sum("payment_value").cast(MONEY_TOTAL).alias("total_value"),
        )
    )
    return counts.withColumn("share_pct", share_of_total("payment_count")).orderBy(
        F.col("payment_count").desc(), F.col("payment_type").asc_nulls_last()
    )


def payment_share(t: Tables, kind: str = "credit_card") -> DataFrame:
    """One row: the share in percent of one payment type."""
    share = percent(F.count_if(F.col("payment_type") == kind), F.count(F.lit(1)))
    return (
        t["order_payments"]
        .agg(share.alias("share_pct"))
        .select(F.lit(kind).alias("payment_type"), "share_pct")
        .withColumn("share_text", percent_text(F.col("share_pct"), 0))
    )


def _seller_totals(t: Tables) -> DataFrame:
    """Orders, revenue and mean score per seller over delivered lines.

    Every line counts once per review of its order (once without one). Both sides are
    reduced to one row per order first and the repetition becomes a factor, so lines times
    reviews of an order are never written out.
    """
    items = t["order_items"]
    per_order = items.groupBy("order_id", "seller_id").agg(
        price_total(items).alias("price_sum"), line_total(items).alias("lines")
    )
    joined = (
        t["orders"]
        .where(is_delivered())
        .select("order_id")
        .join(review_totals(t["order_reviews"]), "order_id", "left")
        .join(per_order, "order_id")
    )
    repeats = F.coalesce(F.col("reviews"), F.lit(1))
    per_seller = joined.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum(F.col("price_sum") * repeats).cast(MONEY_TOTAL).alias("revenue"),
        F.sum(F.col("score_sum") * F.col("lines")).alias("score_sum"),
        F.sum(F.col("scored_reviews") * F.col("lines")).alias("scores"),
    )
    return per_seller.join(t["sellers"].select("seller_id", "seller_state"), "seller_id").select(
        "seller_id",
        "seller_state",
        "order_count",
        "revenue",
        ratio(F.col("score_sum"), F.col("scores")).alias("avg_review_score"),
    )


def _best_first() -> list[Column]:
    return [F.col("revenue").desc_nulls_last(), F.col("seller_id")]


def top_sellers(t: Tables, n: int = 10) -> DataFrame:
    """The ``n`` sellers with the highest revenue."""
    return _seller_totals(t).orderBy(*_best_first()).limit(n)


def seller_table(t: Tables, n: int = 8) -> DataFrame:
    """The first ``n`` sellers as displayed."""
    return top_sellers(t, n).select(
        F.row_number().over(Window.orderBy(*_best_first())),
        shortened(F.col("seller_id"), 10),
        "seller_state",
        "order_count",
        money_text(F.col("revenue")),
        score_text(F.col("avg_review_score")),
    ).toDF("position", "seller", "state", "orders", "revenue", "score")


def top_categories(t: Tables, n: int = 15) -> DataFrame:
    """The ``n`` categories in most delivered orders, by translated name.

    Delivered lines are reduced to (order, product) before the product join and to
    (order, category) after it, which makes the distinct order count a plain count.
    """
    names = t["product_category_translation"]
    label = F.coalesce(
        "product_category_name_english", "product_category_name", F.lit(UNKNOWN_CATEGORY)
    )
    labels = (
        t["products"]
        .select("product_id", "product_category_name")
        .join(names, "product_category_name", "left")
        .select("product_id", label.alias("category"))
    )
    delivered = t["orders"].where(is_delivered()).select("order_id")
    # Delivered lines only, and one row per product of an order, before the products are read.
    items = t["order_items"]
    per_product = (
        items.join(delivered, "order_id", "left_semi")
        .groupBy("order_id", "product_id")
        .agg(price_total(items).alias("revenue"))
    )
    return (
        per_product.join(labels, "product_id")
        .groupBy("order_id", "category")
        .agg(F.sum("revenue").alias("revenue"))
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("revenue").cast(MONEY_TOTAL).alias("revenue"),
        )
        .orderBy(F.col("order_count").desc(), "category")
        .limit(n)
    )


def kpis(
    t: Tables,
    features: DataFrame,
    years: Sequence[int] | None = None,
    days: int = CHURN_DAYS,
) -> DataFrame:
    """One row: revenue and item lines (of the chosen years), persons, churn, mean score.

    The years narrow only the timeline figures.
    """
    totals = (
        _months(t, years)
        .agg(
            F.struct(
                # No month in the chosen years is a total of 0.
                F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY_TOTAL).alias("revenue"),
                F.coalesce(F.sum("item_line_count"), F.lit(0)).alias("item_line_count"),
            )
        )
        .scalar()
    )
    return churn_rate(features, days).select(
        totals["revenue"].alias("revenue"),
        "customer_count",
        totals["item_line_count"].alias("item_line_count"),
        "churn_pct",
        mean_review(t).scalar().alias("mean_score"),
    )


def kpi_labels(row: DataFrame) -> DataFrame:
    """The KPI row as displayed."""
    return row.select(
        millions_text(F.col("revenue")).alias("revenue"),
        F.format_number("customer_count", 0).alias("customers"),
        F.format_number("item_line_count", 0).alias("orders"),
        percent_text(F.col("churn_pct"), 1).alias("churn"),
        fixed(F.col("mean_score"), 2).alias("mean_score"),
    )


def order_ledger(t: Tables) -> DataFrame:
    """Every order with what its lines cost, what was paid, the difference, and its reviews.

    Four tables meet by ``order_id`` only; on bucketed tables there is no exchange.
    """
    paid = t["order_payments"].groupBy("order_id").agg(F.sum("payment_value").alias("paid_value"))
    return (
        t["orders"]
        .select("order_id", "order_status")
        .join(order_values(t["order_items"]).select("order_id", "order_value", "lines"), "order_id", "left")
        .join(paid, "order_id", "left")
        .join(review_totals(t["order_reviews"]), "order_id", "left")
        .select(
            "order_id",
            "order_status",
            F.coalesce("lines", F.lit(0)).alias("line_count"),
            F.col("order_value").cast(MONEY_TOTAL).alias("order_value"),
            F.col("paid_value").cast(MONEY_TOTAL).alias("paid_value"),
            (F.col("paid_value") - F.col("order_value")).cast(MONEY_TOTAL).alias("difference"),
            F.coalesce("reviews", F.lit(0)).alias("review_count"),
            ratio(F.col("score_sum"), F.col("scored_reviews")).alias("mean_score"),
        )
    )
