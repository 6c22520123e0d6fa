"""Ranges of (person, time, id): a hot date with ids that start alike is spread, and LAG stays exact."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators.chains import RANGE, in_ranges, with_previous
from basketry.schema import SCHEMAS
from basketry.sources.files import import_csv


def _orders(spark):
    """One person with 2,000 orders at one midnight, 700 without a time, 300 at any second."""
    draw = random.Random(7)
    start = datetime(2020, 5, 1)
    moments = [start] * 2000 + [None] * 700
    moments += [start + timedelta(seconds=draw.randrange(90000)) for _ in range(300)]
    rows = [
        ("hot" if i % 10 else "cold", at, hashlib.md5(str(i).encode()).hexdigest(), draw.randrange(99))
        for i, at in enumerate(moments)
    ]
    return spark.createDataFrame(rows, "person string, at timestamp, id string, value int").repartition(4)


def test_previous_equals_plain_lag(spark):
    orders = _orders(spark)
    by_time = Window.partitionBy("person").orderBy(F.col("at").asc_nulls_last(), "id")
    plain = orders.withColumn("before", F.lag("value").over(by_time))
    ours = with_previous(orders, "person", "at", "id", "value", "before")
    assert ours.columns == plain.columns
    assert ours.exceptAll(plain).isEmpty() and plain.exceptAll(ours).isEmpty()


def _hot_date(spark, n=6000):
    """A third of all orders are one person's, on one date, with ids that start alike."""
    person = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50))
    at = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 977 % 90000)
    return spark.range(n).select(
        person.alias("person"),
        F.timestamp_seconds(at).cast("timestamp_ntz").alias("at"),
        F.format_string("order-%09d", "id").alias("id"),
        (F.col("id") % 101).alias("value"),
    )


def test_previous_on_a_hot_date_equals_plain_lag(spark):
    orders = _hot_date(spark)
    by_time = Window.partitionBy("person").orderBy(F.col("at").asc_nulls_last(), "id")
    plain = orders.withColumn("before", F.lag("value").over(by_time))
    ours = with_previous(orders, "person", "at", "id", "value", "before")
    assert ours.exceptAll(plain).isEmpty() and plain.exceptAll(ours).isEmpty()


def test_no_task_holds_a_hot_date(spark):
    """Rows as the window's tasks get them: dealt by (person, range)."""
    ranged = in_ranges(_hot_date(spark, 60000), "person", "at", "id")
    tasks = ranged.repartition(8, "person", RANGE).groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in tasks.collect())
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_previous_where_nothing_has_a_time(spark):
    orders = _hot_date(spark, 900).withColumn("at", F.lit(None).cast("timestamp_ntz"))
    plain = orders.withColumn("before", F.lag("value").over(Window.partitionBy("person").orderBy("id")))
    ours = with_previous(orders, "person", "at", "id", "value", "before")
    assert ours.exceptAll(plain).isEmpty()


def test_previous_of_an_empty_table(spark):
    empty = _orders(spark).where("false")
    assert with_previous(empty, "person", "at", "id", "value", "before").isEmpty()


def test_reviews_from_a_folder_of_multi_line_files(spark, tmp_path):
    names = SCHEMAS["order_reviews"].fieldNames()
    text = next(n for n in names if n.endswith("message"))
    folder = tmp_path / "reviews"
    folder.mkdir()
    for part in range(3):
        values = {"review_id": f"r{part}", "order_id": f"o{part}", "review_score": "5"}
        line = ",".join(values.get(n, '"one\ntwo, ""three"""' if n == text else "") for n in names)
        (folder / f"{part}.csv").write_text(",".join(names) + "\n" + line + "\n")
    stored = import_csv(spark, {"order_reviews": str(folder)}, str(tmp_path / "out"))["order_reviews"]
    rows = stored.orderBy("review_id").collect()
    assert [r.order_id for r in rows] == ["o0", "o1", "o2"]
    assert {r[text] for r in rows} == {'one\ntwo, "three"'}
