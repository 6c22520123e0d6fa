from __future__ import annotations

import pytest

from basketry.plans import quality
from fixtures import by_key, frame, order, product, shop


@pytest.fixture(scope="module")
def raw(spark):
    return shop(spark)


def test_counts(raw):
    rows = {r.table_name: r.row_count for r in quality.table_counts(raw).collect()}
    assert rows["orders"] == 9 and rows["order_items"] == 10 and len(rows) == 8


def test_pk_violations_report_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    rows = {r.k: r.row_count for r in quality.pk_violations(df, ["k"]).collect()}
    assert rows == {"a": 2, None: 1}


def test_pk_report_is_clean(raw):
    assert all(r.violating_keys == 0 for r in quality.pk_report(raw).collect())


def test_null_checks(spark, raw):
    df = spark.createDataFrame([("a", None), (None, "x"), ("b", "y")], "p string, q string")
    assert quality.null_violations(df, ["p", "q"]).count() == 2
    rows = quality.null_report(raw).collect()
    assert ("customers", "customer_unique_id", 0) in [tuple(r) for r in rows]


def test_orphans(raw):
    rows = quality.fk_orphans(raw["order_items"], raw["products"], "product_id").collect()
    assert [tuple(r) for r in rows] == [("missing", 1)]
    report = by_key(quality.fk_report(raw), "relation")
    assert len(report) == 7
    assert report["order_items.product_id -> products"].orphan_keys == 1
    # The NULL category is no orphan, the untranslated one is.
    assert report["products.product_category_name -> product_category_translation"].row_count == 1


def test_anomalies(raw):
    rows = [(r.anomaly_id, r.row_count) for r in quality.anomaly_report(raw).collect()]
    assert rows == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 6)]


def test_cleaning(spark):
    orders = frame(
        spark,
        "orders",
        order("a", "c", "2018-01-01", "canceled", "2018-01-02"),
        order("b", "c", "2018-01-01", None, "2018-01-02"),
        order("d", "c", "2018-01-01", "delivered", "2018-01-02"),
    )
    once = quality.clean_orders(orders)
    dates = {r.order_id: r.order_delivered_customer_date for r in once.collect()}
    assert dates["a"] is None and dates["b"] is not None and dates["d"] is not None
    assert sorted(map(str, quality.clean_orders(once).collect())) == sorted(map(str, once.collect()))
    assert once.schema.names == orders.schema.names
    products = frame(spark, "products", product("p", None), product("q", "x"))
    names = {r.product_id: r.product_category_name for r in quality.clean_products(products).collect()}
    assert names == {"p": "unknown", "q": "x"}


def test_no_anomaly_left_after_cleaning(raw):
    rows = by_key(quality.anomaly_report(quality.clean(raw)), "anomaly_id")
    assert rows[2].row_count == 0 and rows[3].row_count == 0
