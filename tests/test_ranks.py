from __future__ import annotations

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.ranks import with_rank

_amounts = st.one_of(
    st.none(),
    st.decimals(-(10**7), 10**12, places=2, allow_nan=False),
    st.sampled_from([Decimal("200.00"), Decimal("0.00"), Decimal("0.01")]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(_amounts, min_size=1, max_size=60))
def test_rank_equals_the_window(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v decimal(38,2)")
    expected = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())))
    got = with_rank(df, "v", "r").select("id", "v", F.col("r").cast("int"))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_totals_that_crowd_in_a_narrow_band(spark):
    """All values within 0.2 % of each other: ranges follow the values, wherever they lie."""
    df = spark.range(20000).select("id", (F.lit(1_000_000) + F.col("id") % 1999 / 100).cast("decimal(38,2)").alias("v"))
    got = with_rank(df, "v", "r")
    expected = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())))
    assert got.exceptAll(expected).count() == 0
    distinct = df.groupBy("v").count().repartitionByRange(8, F.col("v").desc())
    sizes = sorted(r["count"] for r in distinct.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_many_ties_and_no_window_over_all_rows(spark):
    df = spark.range(30000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 100)
        .otherwise(F.col("id") % 977)
        .cast("decimal(38,2)")
        .alias("v"),
    )
    got = with_rank(df, "v", "r")
    expected = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())))
    assert got.exceptAll(expected).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Nothing is gathered by a single-partition exchange; ranges are numbers, not values.
    assert "SinglePartition" not in plan and "rangepartitioning(_value" in plan
