"""Tables, the shared work folder and a few column helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"
#: Rows of an Arrow batch while a table is stored: whole texts are long, and a Python worker
#: holds a batch several times over.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
REST = "__rest"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    A cluster names it in ``spark.checkpoint.dir``. Only a single-machine session may run
    without the setting; it gets a temporary folder of its own.
    """
    folder = spark.conf.get(SHARED_DIR, None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"{SHARED_DIR} must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketry-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which ends its lineage.

    The files outlive any executor. They stay until the owner of the shared folder clears it.
    """
    conf = df.sparkSession.conf
    folder, rows = new_folder(df.sparkSession, name), conf.get(_BATCH)
    try:
        conf.set(_BATCH, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
        df.write.parquet(folder)
    finally:
        conf.set(_BATCH, rows)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character keeps its value and its place."""
    return F.translate(text, UPPER, UPPER.lower())


def folded(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, so that none clashes with a new column."""
    others = [c for c in df.columns if c not in needed]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias(REST)] if others else []
    return df.select(*[F.col(f"`{c}`") for c in needed], *rest)


def unfolded(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that a table had before ``folded``, in their order."""
    beside = set(df.columns)
    inside = set(df.schema[REST].dataType.names) if REST in beside else set()
    return df.select(*[F.col(REST).getField(c).alias(c) if c in inside else F.col(f"`{c}`") for c in columns])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; a missing one is an error, extra ones are left out."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def ranked(df: DataFrame, group: str, *order: Column, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``, the row's place from 0 among the rows of its ``group``, and their number ``n``.

    No task needs a whole group: rows are sorted over ranges and stored with their place, and a
    place becomes a rank by the number of the group's rows in earlier ranges. Ties are broken by the row's place in the input, so equal rows spread over ranges too.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_at")]
    placed = (
        df.withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .drop("_at")
        .withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    )
    placed = stored(placed, name)
    every = Window.partitionBy("_group")
    earlier = every.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each group and range that has rows of it.
    shifts = (
        placed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_in"))
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
        .withColumns(
            {
                "n": F.sum("_rows").over(every),
                "_shift": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"),
            }
        )
    )
    # Small, and asked for by whoever asks for a rank, so worked out once.
    shifts = stored(shifts, f"{name}-shifts")
    joined = placed.join(shifts, same(group, "_group") & (F.col("_range") == F.col("_in")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_place") + F.col("_shift")).alias("rank"), "n")
