"""Table checks, the anomaly report and the cleaning rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import CANCELED, UNKNOWN_CATEGORY, is_delivered
from basketry.schema import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, Tables

# The anomalies of the source data and what is decided about them.
ANOMALIES: list[tuple[int, str, str]] = [
    (1, "delivered order without delivery date", "left NULL"),
    (2, "canceled order with delivery date", "date set to NULL"),
    (3, "product without category", "replaced by 'unknown'"),
    (4, "order without items", "excluded from the features"),
    (5, "order without payment", "kept, reported only"),
]


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_counts(t: Tables) -> DataFrame:
    """Rows per table."""
    return _stack(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in t.items()
        ]
    )


def pk_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or contain NULL, with their row counts."""
    has_null = reduce(Column.__or__, [F.col(key).isNull() for key in keys])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.where((F.col("row_count") > 1) | has_null)


def pk_report(t: Tables) -> DataFrame:
    """Violating keys and their rows for every declared primary key."""
    return _stack(
        [
            pk_violations(t[table], [key])
            .agg(
                F.count(F.lit(1)).alias("violating_keys"),
                F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
            )
            .select(
                F.lit(table).alias("table_name"),
                F.lit(key).alias("key_column"),
                "violating_keys",
                "row_count",
            )
            for table, key in PRIMARY_KEYS.items()
        ]
    )


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with NULL in any of ``columns``."""
    return df.where(reduce(Column.__or__, [F.col(name).isNull() for name in columns]))


def null_report(t: Tables) -> DataFrame:
    """Rows with a NULL in each column declared NOT NULL; one scan per table."""
    return _stack(
        [
            t[table]
            .agg(
                *[
                    F.struct(
                        F.lit(name).alias("column_name"),
                        F.count_if(F.col(name).isNull()).alias("null_count"),
                    ).alias(name)
                    for name in columns
                ]
            )
            .select(F.lit(table).alias("table_name"), F.inline(F.array(*columns)))
            for table, columns in NOT_NULL.items()
        ]
    )


def fk_orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Key values of ``child`` missing in ``parent``, with the rows that carry them.

    The child is counted per key first, so a frequent key is one row in the join; a NULL
    key refers to nothing and is no orphan.
    """
    used = child.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("row_count"))
    return used.join(parent.select(on), on, "left_anti")


def fk_report(t: Tables) -> DataFrame:
    """Orphaned keys and rows for every declared relation."""
    return _stack(
        [
            fk_orphans(t[relation.child], t[relation.parent], relation.key)
            .agg(
                F.count(F.lit(1)).alias("orphan_keys"),
                F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
            )
            .select(F.lit(relation.label).alias("relation"), "orphan_keys", "row_count")
            for relation in FOREIGN_KEYS
        ]
    )


def anomaly_counts(raw: Tables) -> DataFrame:
    """One row with a column per anomaly; ``raw`` are the tables before cleaning.

    The order checks share one pass over orders against the distinct order ids of items
    and payments.
    """

    def order_ids(table: str, flag: str) -> DataFrame:
        return raw[table].select("order_id").distinct().withColumn(flag, F.lit(True))

    has_date = F.col("order_delivered_customer_date").isNotNull()
    uncategorised = raw["products"].agg(F.count_if(F.col("product_category_name").isNull()))
    checked = (
        raw["orders"]
        .select("order_id", "order_status", "order_delivered_customer_date")
        .join(order_ids("order_items", "has_items"), "order_id", "left")
        .join(order_ids("order_payments", "has_payment"), "order_id", "left")
    )
    return checked.agg(
        F.count_if(is_delivered() & ~has_date).alias("anomaly_1"),
        F.count_if((F.col("order_status") == CANCELED) & has_date).alias("anomaly_2"),
        F.count_if(F.col("has_items").isNull()).alias("anomaly_4"),
        F.count_if(F.col("has_payment").isNull()).alias("anomaly_5"),
    ).withColumn("anomaly_3", uncategorised.scalar())


def anomaly_report(raw: Tables) -> DataFrame:
    """One row per anomaly: number, description, rows, decision."""
    rows = [
        F.struct(
            F.lit(number).alias("anomaly_id"),
            F.lit(text).alias("anomaly"),
            F.col(f"anomaly_{number}").alias("row_count"),
            F.lit(decision).alias("decision"),
        )
        for number, text, decision in ANOMALIES
    ]
    return anomaly_counts(raw).select(F.inline(F.array(*rows)))


def clean_orders(orders: DataFrame) -> DataFrame:
    """A canceled order has no delivery date; an order without status keeps its date."""
    canceled = F.coalesce(F.col("order_status") == CANCELED, F.lit(False))
    date = "order_delivered_customer_date"
    return orders.withColumn(date, F.when(~canceled, F.col(date)))


def clean_products(products: DataFrame) -> DataFrame:
    return products.fillna({"product_category_name": UNKNOWN_CATEGORY})


def clean(raw: Tables) -> Tables:
    """All tables with the cleaning rules applied."""
    return {
        **raw,
        "orders": clean_orders(raw["orders"]),
        "products": clean_products(raw["products"]),
    }
