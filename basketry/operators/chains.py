"""Order-to-order changes per person, over sorted ranges with carried edges.

A window over one person would put every order of that person into one task. Here rows are
dealt into ranges of (person, time, id), so a person with a third of all orders, all of them on one
date and with ids that start alike, still spreads over a third of the ranges. LAG runs inside a range;
the one row it cannot see is the last of the person's preceding range, which is carried over:
only the first row of a person in a range looks for it, and a person has one such row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges for each shuffle partition. They are dealt to tasks by hash, so several small ones even out.
RANGES_PER_TASK = 4
RANGE = "_range"


def time_order(moment: str, tie: str) -> list[Column]:
    """Rows of a person in time order, those without a time last."""
    return [F.col(moment).asc_nulls_last(), F.col(tie).asc_nulls_last()]


def in_ranges(df: DataFrame, person: str, moment: str, tie: str) -> DataFrame:
    """``df`` with the number of its range; ranges follow each other in (person, time, id) order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_TASK
    ranges = df.repartitionByRange(parts, F.col(person).asc_nulls_first(), *time_order(moment, tie))
    return ranges.withColumn(RANGE, F.spark_partition_id())


def with_previous(df: DataFrame, person: str, moment: str, tie: str, value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the person's preceding row by (``moment``, ``tie``)."""
    inside = Window.partitionBy(person, RANGE).orderBy(*time_order(moment, tie))
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opens = F.col("_position") == 1
    # The first rows of a person form one short run; every other row stays with its range.
    across = Window.partitionBy(person, opens, F.when(~opens, F.col(RANGE))).orderBy(RANGE, "_position")
    return (
        in_ranges(df, person, moment, tie)
        .withColumns(
            {
                "_position": F.row_number().over(inside),
                "_inside": F.lag(value).over(inside),
                "_closing": F.last(value).over(whole),
            }
        )
        .withColumn("_carried", F.lag("_closing").over(across))
        .withColumn(name, F.when(opens, F.col("_carried")).otherwise(F.col("_inside")))
        .drop(RANGE, "_position", "_inside", "_closing", "_carried")
    )
