"""CSV input, gated and versioned Parquet tables, table layouts, views and reuse."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketry.schema import NOT_NULL, PRIMARY_KEYS, SCHEMAS, Tables
from basketry.sources import versions

TABLES_DIR_VARIABLE = "BASKETRY_TABLES"

# The only free-text columns, where line breaks inside quotes are expected.
FREE_TEXT_TABLES = frozenset({"order_reviews"})


def read_csv(
    spark: SparkSession, path: str, table: str, multiline: bool | None = None
) -> DataFrame:
    """Read one table from CSV (header, comma, doubled quotes) with its declared types.

    A field that does not fit its type fails the read. Spark parses only the columns a
    query needs, so the check is complete only when all columns are read, as
    ``import_csv`` does. A multi-line file cannot be split over tasks, so that mode is the
    default only for free text; a line break inside quotes elsewhere fails the read
    instead of shifting fields.
    """
    if multiline is None:
        multiline = table in FREE_TEXT_TABLES
    options = {
        "header": True,
        "sep": ",",
        "escape": '"',
        "mode": "FAILFAST",
        "multiLine": multiline,
    }
    return spark.read.schema(SCHEMAS[table]).options(**options).csv(path)


def read_csv_tables(spark: SparkSession, paths: dict[str, str]) -> Tables:
    return {table: read_csv(spark, path, table) for table, path in paths.items()}


class Violation(NamedTuple):
    """Rows of a load that break a constraint of their table."""

    table: str
    column: str
    problem: str
    row_count: int


class LoadError(ValueError):
    """A load that breaks declared constraints; nothing of it is published."""

    def __init__(self, violations: list[Violation]):
        self.violations = violations
        super().__init__("; ".join(f"{v.table}.{v.column}: {v.problem} in {v.row_count} rows" for v in violations))


def write_tables(tables: Tables, directory: str, enforce: bool = False) -> None:
    """Persist tables as Parquet under ``directory``, all of them or none.

    With ``enforce`` a load with NULLs in NOT NULL columns or repeated primary keys is refused.
    NULLs are counted while the rows are written; keys are counted on what was written.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    version = versions.new_version(directory)
    folders, violations = {}, []
    for name, df in tables.items():
        folders[name] = f"{version}/{name}"
        needed = NOT_NULL.get(name, []) if enforce else []
        if needed:
            seen = Observation()
            df = df.observe(seen, *[F.count_if(F.col(c).isNull()).alias(c) for c in needed])
        df.write.parquet(folders[name])
        if needed:
            nulls = seen.get
            violations += [Violation(name, c, "NULL", nulls[c]) for c in needed if nulls[c]]
        if enforce and name in PRIMARY_KEYS:
            violations += _repeated(spark, folders[name], name)
    if violations:
        raise LoadError(violations)
    versions.publish(spark, directory, folders)


def _repeated(spark: SparkSession, folder: str, table: str) -> list[Violation]:
    key = PRIMARY_KEYS[table]
    counts = spark.read.parquet(folder).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    rows = counts.agg(F.sum("count")).first()[0]
    return [Violation(table, key, "repeated key", rows)] if rows else []


def import_csv(spark: SparkSession, paths: dict[str, str], directory: str) -> Tables:
    """Load CSV files into ``directory``, checking every field, and return the stored tables.

    The load is refused as a whole, and the tables stored before stay current, if a field does
    not fit its type (the read fails) or a declared key or NOT NULL column is violated
    (``LoadError`` names tables, columns and counts).

    A path may be a file or a folder of files. Free text is parsed by one task per file, so
    a large reviews table should come as a folder of many; its rows are spread evenly
    before they are stored.
    """
    tables = {
        name: df.hint("rebalance") if name in FREE_TEXT_TABLES else df
        for name, df in read_csv_tables(spark, paths).items()
    }
    write_tables(tables, directory, enforce=True)
    return load_tables(spark, directory, paths)


def load_tables(
    spark: SparkSession, directory: str | None = None, names: Iterable[str] = SCHEMAS
) -> Tables:
    """Read the current tables; the folder defaults to ``$BASKETRY_TABLES`` or ``tables``.

    A table that was never published is looked for in a folder of its name.
    """
    directory = directory or os.environ.get(TABLES_DIR_VARIABLE, "tables")
    folders = versions.current(spark, directory)
    return {
        name: spark.read.schema(SCHEMAS[name]).parquet(folders.get(name, f"{directory}/{name}")) for name in names
    }


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, inside ``spark.checkpoint.dir``.

    Only a session on one machine may lack the setting; it gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="basketry-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The tables that join by order.
ORDER_TABLES = ("orders", "order_items", "order_payments", "order_reviews")
#: Mean rows of the largest of them in a bucket, at most.
BUCKET_ROWS = 500_000


def bucket_count(tables: Tables, least: int = 1) -> int:
    """As many buckets as keep ``BUCKET_ROWS`` rows of the largest order table in one, so that
    what a task holds does not grow with the tables."""
    rows = max(tables[name].count() for name in ORDER_TABLES)
    return max(least, -(-rows // BUCKET_ROWS))


def write_order_buckets(tables: Tables, directory: str, buckets: int, prefix: str) -> Tables:
    """Store the tables that join by order in equal hash buckets of ``order_id``, sorted.

    Joins and aggregations by order then need no exchange: a task reads the same bucket of
    each. Their number has to follow the rows (``bucket_count``): a task aggregates and joins a
    whole bucket. An order is never large (one row, its lines, payments and reviews), so buckets
    are even. The tables are registered as ``<prefix>_<table>`` and returned with the others unchanged.
    """
    out = dict(tables)
    for name in ORDER_TABLES:
        spark, table = tables[name].sparkSession, f"{prefix}_{name}"
        (
            # A bucket is written by one task, so it is one file.
            tables[name]
            .repartition(buckets, "order_id")
            .write.mode("overwrite")
            .bucketBy(buckets, "order_id")
            .sortBy("order_id")
            .option("path", f"{directory}/{name}")
            .saveAsTable(table)
        )
        out[name] = spark.table(table)
    return out


def write_layout(orders: DataFrame, directory: str, parts: int) -> None:
    """Store orders for lookups by status and customer.

    One folder per status prunes a status filter. Inside, files cover ranges of
    ``customer_id`` and are sorted by it, so the scan skips files and row groups by their
    minimum and maximum. ``order_id`` closes the range key: a customer with very many
    orders spreads over several files, which hash buckets would not allow.
    """
    keys = ["order_status", "customer_id", "order_id"]
    (
        orders.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .partitionBy("order_status")
        .parquet(directory)
    )


def register_views(tables: Tables) -> None:
    """Make tables, or any named frames, available to SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def keep(tables: Tables) -> Tables:
    """Mark tables for reuse over several reports; spills to disk, lost parts are re-read."""
    return {name: df.persist(StorageLevel.MEMORY_AND_DISK) for name, df in tables.items()}


def release(tables: Tables) -> None:
    for df in tables.values():
        df.unpersist()
