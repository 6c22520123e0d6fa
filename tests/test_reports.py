from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketry.functions.columns import (
    fixed,
    millions_text,
    money_text,
    month_start,
    percent_text,
    score_text,
)
from basketry.plans import features, quality, reports
from fixtures import by_key, customer, item, order, payment, review, shop, tables


@pytest.fixture(scope="module")
def t(spark):
    return quality.clean(shop(spark))


def test_timeline_counts_item_lines(t):
    rows = reports.monthly_timeline(t).collect()
    assert [(r.year, r.month, r.item_line_count, r.revenue) for r in rows] == [
        (2018, datetime(2018, 1, 1), 4, Decimal("88.35")),
        (2018, datetime(2018, 2, 1), 3, Decimal("119.00")),
        (2018, datetime(2018, 3, 1), 1, Decimal("5.50")),
    ]


def test_no_chosen_year_means_all(spark):
    t = tables(
        spark,
        customers=[customer("c", "u")],
        orders=[order("a", "c", "2016-12-31 23:59:59"), order("b", "c", "2017-01-01")],
        order_items=[item("a", "1.00"), item("b", "2.00")],
    )
    assert reports.monthly_timeline(t, []).count() == 2
    assert [r.revenue for r in reports.monthly_timeline(t, [2017]).collect()] == [Decimal("2.00")]
    assert [r.year for r in reports.active_years(t).collect()] == [2016, 2017]


def test_month_start_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2018-10-31 23:30:00' as ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Sao_Paulo", "Pacific/Auckland"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert df.select(month_start(F.col("ts"))).collect()[0][0] == datetime(2018, 10, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_person_in_two_states_counts_in_both(t):
    rows = reports.by_state(t).collect()
    counts = [(r.customer_state, r.customer_count) for r in rows]
    assert counts == [("SP", 2), ("RJ", 1), (None, 1)]
    assert rows[1].avg_item_value == 55.0
    assert [r.customer_state for r in reports.by_state(t, 1).collect()] == ["SP"]


def test_review_scores(t):
    rows = reports.review_scores(t).collect()
    assert [(r.review_score, r.review_count, r.share_pct) for r in rows] == [
        (1, 1, 25.0),
        (2, 1, 25.0),
        (3, 1, 25.0),
        (5, 1, 25.0),
    ]
    assert reports.mean_review(t).collect()[0].mean_score == 11 / 4


def test_payments(t):
    rows = reports.payment_types(t).collect()
    assert [(r.payment_type, r.payment_count) for r in rows] == [
        ("credit_card", 2),
        ("boleto", 1),
        ("voucher", 1),
    ]
    assert rows[0].total_value == Decimal("75.00") and rows[0].share_pct == 50.0
    row = reports.payment_share(t).collect()[0]
    assert (row.share_pct, row.share_text) == (50.0, "50%")


def test_null_payment_type_stays_in_the_denominator(spark):
    t = tables(spark, order_payments=[payment("a", None), payment("b", "credit_card")])
    assert reports.payment_share(t).collect()[0].share_pct == 50.0


def test_empty_reports_are_null_not_errors(spark):
    t = tables(spark)
    assert reports.payment_share(t).collect()[0].share_pct is None
    assert reports.mean_review(t).collect()[0].mean_score is None


def test_sellers_repeat_lines_per_review(t):
    rows = by_key(reports.top_sellers(t), "seller_id")
    # o1 has two reviews: its two s1 lines count twice.
    assert rows["s1"].revenue == Decimal("2") * 30 + 50 + 5 + 7 + 8
    assert rows["s1"].order_count == 5
    assert rows["s1"].avg_review_score == (5 + 2) * 2 / 4
    assert rows["s2"].avg_review_score == (5 + 2 + 1) / 3
    assert rows["s2"].revenue == Decimal("106.66")


def test_sellers_equal_the_written_out_join(spark):
    items = [
        item(f"o{i % 7}", None if i % 11 == 0 else f"{i}.{i % 10}0", seller=f"s{i % 3}")
        for i in range(60)
    ]
    reviews = [review(f"o{i % 5}", None if i % 4 == 0 else i % 5 + 1) for i in range(23)]
    t = tables(
        spark,
        orders=[order(f"o{i}", "c", "2018-01-01") for i in range(7)],
        order_items=items,
        order_reviews=reviews,
        sellers=[{"seller_id": "s0"}, {"seller_id": "s1", "seller_state": "SP"}],
    )
    pairs = (
        t["order_items"]
        .join(t["orders"], "order_id")
        .join(t["sellers"], "seller_id")
        .join(t["order_reviews"].select("order_id", "review_score"), "order_id", "left")
    )
    expected = pairs.groupBy("seller_id", "seller_state").agg(
        F.countDistinct("order_id"), F.sum("price"), F.avg("review_score")
    )
    got = reports.top_sellers(t)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_seller_table(t):
    rows = reports.seller_table(t).collect()
    assert [tuple(r) for r in rows] == [
        (1, "s1...", "SP", 5, "R$130", "3.50"),
        (2, "s2...", "PR", 2, "R$107", "2.67"),
    ]


def test_texts(spark):
    df = spark.sql("select 1234567.5bd as m, cast(null as double) as s")
    assert tuple(df.select(money_text(F.col("m")), score_text(F.col("s"))).collect()[0]) == (
        "R$1,234,568",
        "-",
    )
    big = spark.sql("select 4321987654.3bd as m, 0.125d as x, 2.5d as y").select(
        millions_text(F.col("m")), fixed(F.col("x"), 2), percent_text(F.col("y"), 0)
    )
    assert tuple(big.collect()[0]) == (f"R${4321.9876543:.2f}M", f"{0.125:.2f}", f"{2.5:.0f}%")


def test_categories_use_translation_then_own_name_then_unknown(t):
    rows = by_key(reports.top_categories(t), "category")
    assert {k: (r.order_count, r.revenue) for k, r in rows.items()} == {
        "beauty": (3, Decimal("120.33")),
        "unknown": (2, Decimal("70.00")),
        "sem_nome": (1, Decimal("5.00")),
    }
    assert [r.category for r in reports.top_categories(t, 2).collect()] == ["beauty", "unknown"]


def test_raw_null_category_is_shown_as_unknown(spark):
    rows = by_key(reports.top_categories(shop(spark)), "category")
    assert rows["unknown"].order_count == 2


def test_kpis(t):
    view = features.customer_features(t)
    row = reports.kpis(t, view, days=20).collect()[0]
    assert row.asDict() == {
        "revenue": Decimal("212.85"),
        "customer_count": 3,
        "item_line_count": 8,
        "churn_pct": 100.0 * 1 / 3,
        "mean_score": 2.75,
    }
    # Years narrow the timeline figures only.
    narrowed = reports.kpis(t, view, years=[2016], days=20).collect()[0]
    assert (narrowed.revenue, narrowed.customer_count) == (Decimal("0.00"), 3)
    labels = reports.kpi_labels(reports.kpis(t, view, days=20)).collect()[0]
    assert tuple(labels) == ("R$0.00M", "3", "8", "33.3%", "2.75")


def test_revenue_agrees_between_reports_and_features(t):
    monthly = reports.monthly_timeline(t).agg(F.sum("revenue")).collect()[0][0]
    persons = features.rfm_base(t).agg(F.sum("total_value")).collect()[0][0]
    assert monthly == persons
