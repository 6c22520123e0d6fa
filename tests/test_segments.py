from __future__ import annotations

from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from basketry.plans import segments

SCHEMA = (
    "customer_unique_id string, order_count long, recency_days long, total_value decimal(38,2)"
)


def people(spark, rows):
    return spark.createDataFrame(
        [(p, o, r, None if v is None else Decimal(v)) for p, o, r, v in rows], SCHEMA
    )


def expected_segment(recency, orders, value):
    recent = recency is not None and recency < 90
    frequent = orders > 1
    valuable = value is not None and Decimal(value) > 200
    if recent:
        return {2: "Champion", 1: "Fidele", 0: "Nouveau"}[frequent + valuable]
    if frequent:
        return "En danger"
    return "Perdu" if recency is not None and recency > 300 else "A risque"


def test_boundary_grid(spark):
    grid = list(product([89, 90, 300, 301, None], [1, 2], ["200.00", "200.01", None]))
    rows = [(str(i), o, r, v) for i, (r, o, v) in enumerate(grid)]
    got = {r[0]: r.segment for r in segments.rfm_segment(people(spark, rows)).collect()}
    assert got == {str(i): expected_segment(r, o, v) for i, (r, o, v) in enumerate(grid)}
    assert set(got.values()) == {label for label, _, _ in segments.SEGMENT_ACTIONS}


def test_every_segment_has_an_action(spark):
    rows = [("a", 2, 1, "300.00"), ("b", 1, 301, "1.00")]
    got = segments.segment_actions(segments.rfm_segment(people(spark, rows))).collect()
    assert {(r.customer_unique_id, r.action) for r in got} == {
        ("a", "Fidéliser, programme VIP"),
        ("b", "Campagne win-back ou abandon"),
    }


def test_churn(spark):
    df = people(
        spark, [("a", 1, 180, "1"), ("b", 1, 181, "1"), ("c", 1, 365, "1"), ("d", 1, None, "1")]
    )
    row = segments.churn_rate(df).collect()[0]
    assert (row.customer_count, row.churned_count, row.churn_pct) == (4, 2, 50.0)
    assert segments.churn_rate(df, 360).collect()[0].churn_pct == 25.0
    flags = {r[0]: r.churned for r in segments.churn_flag(df).collect()}
    assert flags == {"a": False, "b": True, "c": True, "d": None}


def test_churn_of_nobody_is_null(spark):
    assert segments.churn_rate(people(spark, [])).collect()[0].churn_pct is None


def test_top_customers(spark):
    rows = [(f"customer-number-{i}", 1, 10, str(i % 3)) for i in range(9)]
    got = segments.top_customers(segments.rfm_segment(people(spark, rows)), 4).collect()
    assert [r.position for r in got] == [1, 2, 3, 4]
    assert [r.revenue for r in got] == [2, 2, 2, 1]
    assert got[0].customer == "customer-num..."


@pytest.mark.parametrize("n", [7, 5000])
def test_sample_is_exact_and_independent_of_partitioning(spark, n):
    rows = [(f"p{i}", 1, i, "1.00") for i in range(40)]
    df = segments.rfm_segment(people(spark, rows))
    first = segments.rfm_sample(df, n).collect()
    again = segments.rfm_sample(df.repartition(6, F.rand()), n).collect()
    assert len(first) == min(n, 40)
    assert sorted(first) == sorted(again)
    if n < 40:
        other = segments.rfm_sample(df, n, seed=1).collect()
        assert sorted(first) != sorted(other)
