"""Every query by name, on tables derived from the retail star schema, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from basketry import oracle
from basketry.functions.columns import UNKNOWN_CATEGORY
from basketry.plans import dashboard, features, preview, quality, reports, segments
from basketry.schema import NOT_NULL, SCHEMAS, Tables
from basketry.sources import files
from basketry.sources.retail import retail_tables

Query = Callable[[SparkSession, str], DataFrame]

# The retail prices are larger than marketplace ones; with this value threshold all six
# segments occur.
HIGH_VALUE = 150000
YEARS = [1996, 1998]
PAYMENT_KIND = "1-URGENT"
BUCKETS = 8
# Customers whose orders the layout is asked for.
CUSTOMERS = ["1", "7", "8", "100", "101"]
# A sample smaller than the table, and years without a single order.
SAMPLE, NO_YEARS = 25, [1900]


def _segmented(t: Tables) -> DataFrame:
    return segments.rfm_segment(features.customer_features(t), value=HIGH_VALUE)


def _base(t: Tables) -> DataFrame:
    """Reports on recency, orders and value need no more than this part of the feature view."""
    return segments.rfm_segment(features.rfm_base(t), value=HIGH_VALUE)


def _published(t: Tables) -> DataFrame:
    features.register_feature_view(t)
    return t["orders"].sparkSession.table(features.VIEW_NAME)


def _bucketed(t: Tables) -> Tables:
    """The tables after a trip through the bucketed layout."""
    spark = t["orders"].sparkSession
    folder = files.work_folder(spark, "buckets")
    buckets = files.bucket_count(t, least=BUCKETS)
    return files.write_order_buckets(t, folder, buckets, f"shop_{folder.rpartition('-')[2]}")


def _looked_up(t: Tables) -> DataFrame:
    """Delivered orders of some customers, read through the layout by status and customer."""
    spark = t["orders"].sparkSession
    folder = files.work_folder(spark, "layout")
    files.write_layout(t["orders"], folder, BUCKETS)
    orders = spark.read.schema(SCHEMAS["orders"]).parquet(folder)
    wanted = (F.col("order_status") == "delivered") & F.col("customer_id").isin(CUSTOMERS)
    return orders.where(wanted).select("order_id", "customer_id", "order_status", "order_purchase_timestamp")


def _imported(t: Tables) -> Tables:
    """Orders, lines and reviews written as CSV, loaded through the gates, published and read back."""
    spark = t["orders"].sparkSession
    folder = files.work_folder(spark, "import")
    paths = {}
    for name in ("orders", "order_items", "order_reviews"):
        paths[name] = f"{folder}/csv/{name}"
        t[name].write.csv(paths[name], header=True, escape='"')
    return files.import_csv(spark, paths, f"{folder}/tables")


def _rejected(t: Tables) -> DataFrame:
    """What the gates say of a load with persons missing and a sixth of the orders twice."""
    spark = t["orders"].sparkSession
    person = F.when(F.col("customer_id").cast("long") % 7 != 0, F.col("customer_unique_id"))
    broken = {
        "customers": t["customers"].withColumn("customer_unique_id", person),
        "orders": t["orders"].unionAll(t["orders"].where(F.col("order_id").cast("long") % 6 == 0)),
        "sellers": t["sellers"],
    }
    try:
        files.write_tables(broken, files.work_folder(spark, "rejected"), enforce=True)
        found = []
    except files.LoadError as error:
        found = [tuple(v) for v in error.violations]
    return spark.createDataFrame(found, "table string, column string, problem string, row_count long")


def _refreshed(name: str) -> Callable[[Tables], DataFrame]:
    """One frame of a dashboard refresh, on lines stored once for all frames of a session."""

    def frame(t: Tables) -> DataFrame:
        shared = dashboard.shared_lines(t, _dashboard_folder(t["orders"].sparkSession))
        return _FRAMES[name](shared)

    return frame


def _dashboard_folder(spark: SparkSession) -> str:
    """A folder for the session's refreshes, so that they find each other's lines."""
    key = "basketry.dashboard.dir"
    folder = spark.conf.get(key, None) or files.work_folder(spark, "dashboard")
    spark.conf.set(key, folder)
    return folder


_FRAMES: dict[str, Callable[[Tables], DataFrame]] = {
    "dashboard_features": features.customer_features,
    "dashboard_timeline": reports.monthly_timeline,
    "dashboard_states": reports.by_state,
    "dashboard_sellers": reports.top_sellers,
    "dashboard_categories": reports.top_categories,
    "dashboard_kpis": lambda t: reports.kpis(t, features.rfm_base(t)),
}

_ON_CLEAN: dict[str, Callable[[Tables], DataFrame]] = {
    "basic_features": features.basic_features,
    "basic_features_preview": features.basic_features_preview,
    "basket_changes": features.basket_changes,
    "customer_rank": features.customer_rank,
    "rfm_base": features.rfm_base,
    "basket_trend": features.basket_trend,
    "satisfaction": features.satisfaction,
    "diversity": features.diversity,
    "customer_features": features.customer_features,
    "customer_features_published": _published,
    "customer_features_first10": preview.customer_features_first,
    "order_ledger": lambda t: reports.order_ledger(_bucketed(t)),
    "orders_lookup": _looked_up,
    "monthly_timeline": reports.monthly_timeline,
    "monthly_timeline_years": lambda t: reports.monthly_timeline(t, YEARS),
    "active_years": reports.active_years,
    "by_state": reports.by_state,
    "by_state_top": lambda t: reports.by_state(t, 10),
    "review_scores": reports.review_scores,
    "mean_review": reports.mean_review,
    "payment_types": reports.payment_types,
    "payment_share": lambda t: reports.payment_share(t, PAYMENT_KIND),
    "top_sellers": reports.top_sellers,
    "seller_table": reports.seller_table,
    "top_categories": reports.top_categories,
    "top_categories_shown": lambda t: reports.top_categories(t, 12),
    "rfm_segment": _segmented,
    "segment_actions": lambda t: segments.segment_actions(_base(t)),
    "churn_flag": lambda t: segments.churn_flag(features.customer_features(t)),
    "churn_rate": lambda t: segments.churn_rate(features.rfm_base(t)),
    "top_customers": lambda t: segments.top_customers(_base(t)),
    "rfm_sample": lambda t: segments.rfm_sample(_base(t)),
    "rfm_sample_small": lambda t: segments.rfm_sample(_base(t), n=SAMPLE),
    "kpis": lambda t: reports.kpis(t, features.rfm_base(t)),
    "kpis_years": lambda t: reports.kpis(t, features.rfm_base(t), YEARS, 360),
    "kpis_no_month": lambda t: reports.kpis(t, features.rfm_base(t), NO_YEARS),
    "kpi_labels": lambda t: reports.kpi_labels(reports.kpis(t, features.rfm_base(t))),
}

_ON_RAW: dict[str, Callable[[Tables], DataFrame]] = {
    "table_counts": quality.table_counts,
    "pk_violations": quality.pk_report,
    "pk_violations_lines": lambda t: quality.pk_violations(
        t["order_items"], ["order_id", "order_item_id"]
    ),
    "null_violations": quality.null_report,
    "null_violations_products": lambda t: quality.null_violations(
        t["products"], ["product_category_name"]
    ).select("product_id"),
    "fk_orphans": quality.fk_report,
    "fk_orphans_categories": lambda t: quality.fk_orphans(
        t["products"], t["product_category_translation"], "product_category_name"
    ),
    "anomaly_report": quality.anomaly_report,
    "imported_orders": lambda t: _imported(t)["orders"].select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date"
    ),
    "imported_lines": lambda t: _imported(t)["order_items"].select(
        "order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"
    ),
    "load_rejections": _rejected,
    "clean_orders": lambda t: quality.clean_orders(t["orders"]).select(
        "order_id", "order_status", "order_delivered_customer_date"
    ),
    "clean_products": lambda t: quality.clean_products(t["products"]).select(
        "product_id", "product_category_name"
    ),
}


_ON_CLEAN |= {name: _refreshed(name) for name in _FRAMES}


def comparable(df: DataFrame) -> DataFrame:
    """Decimal columns as double, the form both engines hand to a client alike."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, DecimalType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def queries() -> dict[str, Query]:
    def on_clean(plan: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, path: comparable(plan(quality.clean(retail_tables(spark, path))))

    def on_raw(plan: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, path: comparable(plan(retail_tables(spark, path)))

    return {name: on_clean(plan) for name, plan in _ON_CLEAN.items()} | {
        name: on_raw(plan) for name, plan in _ON_RAW.items()
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements(
        not_null=NOT_NULL,
        high_value=HIGH_VALUE,
        years=YEARS,
        no_years=NO_YEARS,
        sample=SAMPLE,
        view_columns=features.VIEW_COLUMNS,
        payment_kind=PAYMENT_KIND,
        unknown=UNKNOWN_CATEGORY,
        actions=segments.SEGMENT_ACTIONS,
        anomalies=quality.ANOMALIES,
        customers=CUSTOMERS,
    )
