"""Exact global RANK without moving all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


def with_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: RANK by ``value`` descending, NULLs last.

    Rows are first reduced to distinct values with counts, so many equal values cost one row.
    Spark's sampled splitters deal the distinct values into ranges of about equal size, wherever
    the values lie, and counts are summed inside each range. The first value of a range carries the
    range's total into one running sum over ranges, a row for each shuffle partition; its
    result is handed back to the range's other values. Everything comes from one evaluation of
    the ranges, so it does not matter that splitters are sampled.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    falling = F.col("_value").desc_nulls_last()
    counts = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    inside = Window.partitionBy(RANGE).orderBy(falling)
    whole = Window.partitionBy(RANGE)
    first = F.col("_position") == 1
    across = Window.partitionBy(first, F.when(~first, F.col(RANGE))).orderBy(RANGE, "_position")
    above = (Window.unboundedPreceding, -1)
    ranks = (
        counts.repartitionByRange(parts, falling)
        .withColumn(RANGE, F.spark_partition_id())
        .withColumns(
            {
                "_position": F.row_number().over(inside),
                "_higher": F.coalesce(F.sum("_rows").over(inside.rowsBetween(*above)), F.lit(0)),
                "_total": F.sum("_rows").over(whole),
            }
        )
        # Only the first values sum the totals of all ranges before theirs.
        .withColumn("_before", F.when(first, F.coalesce(F.sum("_total").over(across.rowsBetween(*above)), F.lit(0))))
        .select(
            "_value",
            (F.lit(1).cast("long") + F.max("_before").over(whole) + F.col("_higher")).alias(name),
        )
    )
    # One row per value on the right; AQE splits a value shared by very many rows.
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
