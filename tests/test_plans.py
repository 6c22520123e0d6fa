"""What the physical plans must and must not contain."""

from __future__ import annotations

import re
import uuid

import pytest
from pyspark.sql import functions as F

from basketry import registry
from basketry.operators.orders import with_person
from basketry.plans import features, preview, quality, reports, segments
from basketry.sources import files
from basketry.sources.files import load_tables, write_order_buckets, write_tables
from fixtures import item, order, payment, review, shop, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    directory = str(tmp_path_factory.mktemp("tables"))
    write_tables(quality.clean(shop(spark)), directory)
    return load_tables(spark, directory)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_and_no_cross_product(spark, name):
    text = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_status_filter_and_columns_reach_the_scan(stored):
    text = plan(reports.monthly_timeline(stored))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(order_status,delivered\)", text)
    orders = re.search(r"FileScan parquet \[order_id#\d+,order_status#\d+,order_purchase_t", text)
    assert orders, text
    assert "ReadSchema: struct<order_id:string,price:decimal(10,2),freight_value:decimal(10,2)>" in text


def test_top_k_is_not_a_full_sort(stored):
    segmented = segments.rfm_segment(features.customer_features(stored))
    for df in (
        reports.top_sellers(stored),
        reports.top_categories(stored),
        segments.rfm_sample(segmented),
        segmented.transform(segments.top_customers),
    ):
        assert "TakeOrderedAndProject" in plan(df)


@pytest.fixture(scope="module")
def valued(spark, tmp_path_factory):
    """The shop without the line that lacks a value."""
    directory = str(tmp_path_factory.mktemp("valued"))
    t = quality.clean(shop(spark))
    write_tables(t | {"order_items": t["order_items"].where("freight_value is not null")}, directory)
    return load_tables(spark, directory)


def test_feature_view_reads_each_table_once(valued, no_broadcast):
    text = plan(features.customer_features(valued))
    scans = re.findall(r"Location: InMemoryFileIndex.*?/(\w+)\]", text)
    # orders twice: the second scan is the one-column maximum for the reference date
    assert sorted(scans) == [
        "customers", "order_items", "order_reviews", "orders", "orders", "products",
    ]
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    keys = sorted(re.sub(r"#\d+", "", e) for e in exchanges)
    assert keys == [
        "customer_id",
        "customer_id",
        "customer_unique_id",
        "order_id",
        "order_id",
        "order_id",
        "product_id",
        "product_id",
    ]


def test_feature_view_needs_no_order_of_rows_and_no_sets(valued):
    text = plan(features.customer_features(valued))
    for node in ("Window", "ObjectHashAggregate", "Generate", "collect_set", "rangepartitioning"):
        assert node not in text


def test_first_rows_read_only_their_keys(valued, monkeypatch):
    """Every lookup has its keys pushed into the scan; the view itself reads nothing and needs no exchange."""
    asked = []
    real = preview._rows
    monkeypatch.setattr(preview, "_rows", lambda df, most: (asked.append(df), real(df, most))[1])
    df = preview.customer_features_first(valued, 2)
    scans = {}
    for lookup in asked:
        table, pushed = re.search(r"/(\w+)\], PartitionFilters: \[\], PushedFilters: \[([^\n]*?)\], ReadSchema", plan(lookup)).groups()
        scans[table] = pushed
    keys = {"orders": "customer_id", "order_items": "order_id", "order_reviews": "order_id", "products": "product_id"}
    assert set(scans) == set(keys)
    for table, key in keys.items():
        assert f"In({key}, [" in scans[table], scans
    assert "FileScan" not in plan(df) and "Exchange" not in plan(df)
    assert [r.customer_unique_id for r in df.collect()] == ["ana", "bob"]


def test_order_joins_on_buckets_need_no_exchange(valued, spark, tmp_path, no_broadcast):
    bucketed = write_order_buckets(valued, str(tmp_path / "buckets"), 4, f"t{uuid.uuid4().hex}")
    df = reports.order_ledger(bucketed)
    assert "Exchange" in plan(reports.order_ledger(valued))
    assert "Exchange" not in plan(df) and plan(df).count("Join") == 3
    assert sorted(map(str, df.collect())) == sorted(map(str, reports.order_ledger(valued).collect()))


def test_buckets_follow_the_rows(spark, no_broadcast, monkeypatch):
    """The registered ledger has more tasks, not larger ones, when the tables have more rows."""
    monkeypatch.setattr(files, "BUCKET_ROWS", 3, raising=False)
    ids = [f"o{i}" for i in range(20)]
    t = tables(
        spark,
        orders=[order(i, "c1", "2018-01-01 10:00:00") for i in [*ids, "o0"]],
        order_items=[item(i, n, 1) for n, i in enumerate([*ids, *ids, "lost"])],
        order_payments=[payment(i, "card", 5) for i in [*ids, "lost", "lost"]],
        order_reviews=[review(i, 4) for i in ids],
    )
    bucketed = registry._bucketed(t)
    df = reports.order_ledger(bucketed)
    assert df.rdd.getNumPartitions() == 14
    assert "Exchange" not in plan(df)
    assert sorted(map(str, df.collect())) == sorted(map(str, reports.order_ledger(t).collect()))
    for name in files.ORDER_TABLES:
        assert sorted(map(str, bucketed[name].collect())) == sorted(map(str, t[name].collect()))
    monkeypatch.setattr(files, "BUCKET_ROWS", 100, raising=False)
    assert reports.order_ledger(registry._bucketed(t)).rdd.getNumPartitions() == registry.BUCKETS


def test_rank_computes_the_totals_once(stored, no_broadcast):
    df = features.customer_rank(stored)
    done = df._jdf.queryExecution()
    df.collect()
    final = done.executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 3
    assert final.count("ReusedExchange") >= 1


def test_no_window_over_a_whole_persons_orders(stored, no_broadcast):
    text = plan(features.basket_changes(stored))
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    assert not any(re.fullmatch(r"customer_unique_id#\d+", key) for key in keys)


def test_hot_customer_is_split_by_aqe(spark, no_broadcast):
    """A third of all orders belong to one customer id: the join must split it."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        n = 30000
        cid = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string")
        orders = spark.range(0, n, 1, 8).select(
            cid.alias("customer_id"),
            F.col("id").cast("string").alias("order_id"),
            F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("moment"),
        )
        customers = spark.range(n).select(
            F.col("id").cast("string").alias("customer_id"),
            F.col("id").cast("string").alias("customer_unique_id"),
        )
        joined = with_person(orders, {"customers": customers})
        counts = joined.groupBy("customer_unique_id", F.col("moment").cast("date")).count()
        assert counts.agg(F.sum("count")).collect()[0][0] == n
        done = counts._jdf.queryExecution()
        counts.count()
        counts.collect()
        assert "skew=true" in done.executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
