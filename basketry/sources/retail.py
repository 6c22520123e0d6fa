"""The eight marketplace tables derived from a retail star schema (orders and line items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.schema import MONEY, SCHEMAS, Tables


def _shape(df: DataFrame, table: str, **columns: Column) -> DataFrame:
    """Declared columns of ``table`` in order; the ones not given are NULL."""
    return df.select(
        *[
            columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in SCHEMAS[table]
        ]
    )


def retail_tables(spark: SparkSession, directory: str) -> Tables:
    def source(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    c = F.col
    nation = source("nation")
    lines = source("lineitem")
    customers = source("customer").join(nation, c("c_nationkey") == c("n_nationkey"), "left")
    sellers = source("supplier").join(nation, c("s_nationkey") == c("n_nationkey"), "left")
    orders = source("orders")
    score = F.lit(1) + c("l_quantity").cast("int") % 5
    status = (
        F.when(c("o_orderstatus") == "F", "delivered")
        .when(c("o_orderstatus") == "P", "canceled")
        .when(c("o_orderstatus") == "O", "shipped")
    )
    return {
        # Every tenth person owns two customer ids.
        "customers": _shape(
            customers,
            "customers",
            customer_id=c("c_custkey"),
            customer_unique_id=F.when(c("c_custkey") % 10 == 1, c("c_custkey") - 1).otherwise(
                c("c_custkey")
            ),
            customer_state=c("n_name"),
        ),
        "orders": _shape(
            orders,
            "orders",
            order_id=c("o_orderkey"),
            customer_id=c("o_custkey"),
            order_status=status,
            order_purchase_timestamp=c("o_orderdate"),
            order_delivered_customer_date=F.when(
                c("o_orderkey") % 10 != 0, c("o_orderdate") + F.expr("INTERVAL 7 DAYS")
            ),
        ),
        "order_items": _shape(
            lines,
            "order_items",
            order_id=c("l_orderkey"),
            order_item_id=c("l_linenumber"),
            product_id=c("l_partkey"),
            seller_id=c("l_suppkey"),
            price=c("l_extendedprice").cast(MONEY),
            freight_value=c("l_quantity").cast(MONEY),
        ),
        # A few payments have lost their order, so a few orders have no payment.
        "order_payments": _shape(
            orders,
            "order_payments",
            order_id=F.when(c("o_orderkey") % 1000 != 7, c("o_orderkey")),
            payment_sequential=F.lit(1),
            payment_type=c("o_orderpriority"),
            payment_installments=F.lit(1),
            payment_value=c("o_totalprice").cast(MONEY),
        ),
        "order_reviews": _shape(
            lines,
            "order_reviews",
            review_id=F.concat_ws("-", "l_orderkey", "l_linenumber"),
            order_id=c("l_orderkey"),
            review_score=F.when(c("l_discount") != 0, score),
        ),
        "products": _shape(
            source("part"),
            "products",
            product_id=c("p_partkey"),
            product_category_name=F.when(c("p_size") != 50, c("p_size")),
        ),
        "sellers": _shape(
            sellers, "sellers", seller_id=c("s_suppkey"), seller_state=c("n_name")
        ),
        "product_category_translation": _shape(
            nation,
            "product_category_translation",
            product_category_name=c("n_nationkey"),
            product_category_name_english=c("n_name"),
        ),
    }
