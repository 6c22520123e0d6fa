from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketry.schema import SCHEMAS
from basketry.sources import versions
from basketry.sources.files import (
    TABLES_DIR_VARIABLE,
    LoadError,
    Violation,
    import_csv,
    keep,
    load_tables,
    read_csv,
    read_csv_tables,
    register_views,
    release,
    write_layout,
    write_tables,
)
from fixtures import shop


def write(tmp_path, name, text):
    path = tmp_path / f"{name}.csv"
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_byte_order_mark_and_crlf(spark, tmp_path):
    text = "﻿product_category_name,product_category_name_english\r\nmoveis,furniture\r\n"
    df = read_csv(spark, write(tmp_path, "c", text), "product_category_translation")
    assert [tuple(r) for r in df.collect()] == [("moveis", "furniture")]


def test_review_text_with_quotes_and_line_breaks(spark, tmp_path):
    header = ",".join(SCHEMAS["order_reviews"].names)
    text = (
        f"{header}\r\n"
        'r1,o1,5,,"line one\r\nsaid ""fine"", ok",2018-01-02 00:00:00,2018-01-03 10:20:30\r\n'
        'r2,o2,4,"",plain,2018-01-02 00:00:00,\r\n'
    )
    rows = read_csv(spark, write(tmp_path, "r", text), "order_reviews").collect()
    assert rows[0].review_comment_message.replace("\r\n", "\n") == 'line one\nsaid "fine", ok'
    assert rows[0].review_comment_title is None and rows[1].review_comment_title is None
    assert rows[0].review_answer_timestamp == datetime(2018, 1, 3, 10, 20, 30)
    assert rows[1].review_answer_timestamp is None


def test_types_and_leading_zeros(spark, tmp_path):
    sellers = write(tmp_path, "s", "seller_id,zip,city,state\ns1,01310,sao paulo,SP\n")
    items = write(
        tmp_path,
        "i",
        ",".join(SCHEMAS["order_items"].names) + "\no1,1,p1,s1,2018-01-01 10:00:00,58.90,13.29\n",
    )
    t = read_csv_tables(spark, {"sellers": sellers, "order_items": items})
    assert t["sellers"].collect()[0].seller_zip_code_prefix == "01310"
    line = t["order_items"].collect()[0]
    assert (line.price, line.freight_value) == (Decimal("58.90"), Decimal("13.29"))
    assert line.shipping_limit_date == datetime(2018, 1, 1, 10)


BAD_ITEMS = ",".join(SCHEMAS["order_items"].names) + "\no1,1,p1,s1,2018-01-01 10:00:00,abc,13.29\n"


def test_bad_number_fails_the_import(spark, tmp_path):
    path = write(tmp_path, "bad", BAD_ITEMS)
    with pytest.raises(Exception, match="(?i)malformed|abc"):
        read_csv(spark, path, "order_items").collect()
    with pytest.raises(Exception, match="(?i)malformed|abc"):
        import_csv(spark, {"order_items": path}, str(tmp_path / "db"))


def test_import_stores_what_it_reads(spark, tmp_path):
    path = write(tmp_path, "s", "seller_id,zip,city,state\ns1,01310,sao paulo,SP\n")
    stored = import_csv(spark, {"sellers": path}, str(tmp_path / "db"))
    assert [tuple(r) for r in stored["sellers"].collect()] == [("s1", "01310", "sao paulo", "SP")]


def test_line_break_outside_free_text_fails_unless_multiline(spark, tmp_path):
    text = 'seller_id,zip,city,state\ns1,01310,"sao\npaulo",SP\n'
    path = write(tmp_path, "m", text)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, path, "sellers").collect()
    assert read_csv(spark, path, "sellers", multiline=True).collect()[0].seller_city == "sao\npaulo"


def test_parquet_round_trip(spark, tmp_path, monkeypatch):
    t = shop(spark)
    write_tables(t, str(tmp_path / "db"))
    monkeypatch.setenv(TABLES_DIR_VARIABLE, str(tmp_path / "db"))
    for again in (load_tables(spark, str(tmp_path / "db")), load_tables(spark)):
        for name, df in t.items():
            assert sorted(map(str, again[name].collect())) == sorted(map(str, df.collect()))
            assert again[name].dtypes == df.dtypes


def test_views_and_reuse(spark):
    t = keep(shop(spark))
    register_views(t)
    row = spark.sql("select count(*) n from order_items join orders using (order_id)").collect()[0]
    assert row.n == 10
    assert t["orders"].storageLevel.useDisk and t["orders"].storageLevel.useMemory
    release(t)
    assert not t["orders"].storageLevel.useMemory


def test_layout_prunes_by_status_and_splits_a_hot_customer(spark, tmp_path):
    directory = str(tmp_path / "layout")
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    orders = spark.range(3000).select(
        F.format_string("o%05d", "id").alias("order_id"),
        F.format_string("c%05d", hot).alias("customer_id"),
        F.when(F.col("id") % 100 == 1, "canceled").otherwise("delivered").alias("order_status"),
    )
    write_layout(orders, directory, 8)
    stored = spark.read.parquet(directory)
    assert stored.select(orders.columns).exceptAll(orders).count() == 0
    assert stored.count() == 3000

    lookup = stored.where((F.col("order_status") == "delivered") & (F.col("customer_id") == "c00500"))
    plan = lookup._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_status" in plan
    assert "EqualTo(customer_id,c00500)" in plan

    files = stored.where("order_status = 'delivered'").groupBy(F.input_file_name().alias("file"))
    ranges = files.agg(
        F.min("customer_id").alias("low"), F.max("customer_id").alias("high"), F.count("*").alias("n")
    ).collect()
    holding = [r for r in ranges if r.low <= "c00500" <= r.high]
    assert len(holding) == 1
    assert max(r.n for r in ranges) < 1000  # the hot customer alone has more


def _csv(tmp_path, name, lines):
    header = ",".join(SCHEMAS[name].names)
    return write(tmp_path, name, "\n".join([header, *lines]) + "\n")


def test_import_refuses_nulls_and_repeated_keys(spark, tmp_path):
    paths = {
        "sellers": _csv(tmp_path, "sellers", ["s1,1,x,SP", "s1,2,y,SP", "s1,3,z,SP", "s2,4,w,SP", ",5,v,SP"]),
        "customers": _csv(tmp_path, "customers", ["c1,,1,x,SP", "c2,ana,1,x,SP", "c3,,1,x,SP"]),
    }
    with pytest.raises(LoadError, match="sellers.seller_id: repeated key in 3 rows") as caught:
        import_csv(spark, paths, str(tmp_path / "db"))
    assert sorted(caught.value.violations) == [
        Violation("customers", "customer_unique_id", "NULL", 2),
        Violation("sellers", "seller_id", "NULL", 1),
        Violation("sellers", "seller_id", "repeated key", 3),
    ]
    assert versions.current(spark, str(tmp_path / "db")) == {}


def test_a_failing_load_leaves_the_tables_before(spark, tmp_path):
    directory = str(tmp_path / "db")
    old = shop(spark)
    write_tables(old, directory)
    new = {name: df.limit(1) for name, df in old.items()}
    fifth = list(new)[4]
    new[fifth] = new[fifth].withColumn("review_id", F.raise_error(F.lit("lost the source")).cast("string"))
    with pytest.raises(Exception, match="lost the source"):
        write_tables(new, directory)
    for name, df in load_tables(spark, directory).items():
        assert sorted(map(str, df.collect())) == sorted(map(str, old[name].collect()))


def test_a_load_of_some_tables_keeps_the_others(spark, tmp_path):
    directory = str(tmp_path / "db")
    write_tables(shop(spark), directory)
    before = load_tables(spark, directory)
    one = spark.createDataFrame([("s9", "1", "x", "SP")], SCHEMAS["sellers"])
    write_tables({"sellers": one}, directory)
    after = load_tables(spark, directory)
    assert [r[0] for r in after["sellers"].collect()] == ["s9"]
    assert after["orders"].count() == 9
    # Frames made before still read what they were made of.
    assert before["sellers"].count() == 2


def test_old_versions_are_dropped_on_request(spark, tmp_path):
    directory = str(tmp_path / "db")
    for n in range(1, 5):
        sellers = spark.createDataFrame([(f"s{i}", "1", "x", "SP") for i in range(n)], SCHEMAS["sellers"])
        write_tables({"sellers": sellers}, directory)
    assert len(versions.drop_old(spark, directory, keep=2)) == 2
    assert load_tables(spark, directory, ["sellers"])["sellers"].count() == 4
    assert versions.drop_old(spark, directory, keep=2) == []
