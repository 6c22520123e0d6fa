"""Sets of dictionary values as bits, so that sets merge like sums.

A value of a small dictionary gets a number, and a set of values one bit each in as many long
columns ("lanes") as are needed. Sets are then united by ``bit_or``, map-side and inside generated
code, and counted exactly by ``bit_count``; no array of names travels.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from basketry.functions.local import local_rows

BITS = 63  # the sign bit stays unused
MAX_LANES = 8


def codes(df: DataFrame, value: str) -> DataFrame | None:
    """(``value``, lane columns) of every distinct value, or None if they exceed ``MAX_LANES`` lanes.

    At most ``MAX_LANES * BITS`` values come to the driver, which also bounds what a join
    with the result may broadcast.
    """
    most = MAX_LANES * BITS
    found = df.select(value).where(F.col(value).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        return None
    bits = numbered(r[0] for r in found)
    return coded(df.sparkSession, bits.items(), df.schema[value])


def numbered(values: Iterable) -> dict[object, list[int]]:
    """Value -> its bit, as the numbers of all lanes."""
    names = sorted(set(values))
    width = max(1, -(-len(names) // BITS))
    return {name: [1 << i % BITS if i // BITS == lane else 0 for lane in range(width)] for i, name in enumerate(names)}


def coded(spark: SparkSession, bits: Iterable[tuple[object, list[int]]], key: StructField) -> DataFrame:
    """(``key``, lane columns) of keys with their bits."""
    rows = [(name, *lanes) for name, lanes in bits]
    width = len(rows[0]) - 1 if rows else 1
    lanes = [StructField(lane, LongType()) for lane in _lanes(width)]
    return local_rows(spark, rows, StructType([key, *lanes]))


def _lanes(width: int) -> list[str]:
    return [f"_lane{i}" for i in range(width)]


def lanes_of(coded: DataFrame) -> list[str]:
    return [c for c in coded.columns if c.startswith("_lane")]


def united(lanes: list[str]) -> list[Column]:
    return [F.bit_or(lane).alias(lane) for lane in lanes]


def size(lanes: list[str]) -> Column:
    """The number of values in a set; a set of nothing has 0."""
    counts = [F.coalesce(F.bit_count(F.col(lane)), F.lit(0)) for lane in lanes]
    return sum(counts[1:], counts[0]).cast("long")
