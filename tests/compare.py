"""Run one registered query on both engines and compare schema and rows exactly."""

from __future__ import annotations

from pathlib import Path

import duckdb

_KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = con.execute(sql)
    types = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    names = [d[0] for d in result.description]
    return names, types, result.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names, types, expected = oracle_rows(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    want = normal(names, expected)
    assert len(got) == len(want), f"{len(got)} rows, expected {len(want)}"
    different = [(g, w) for g, w in zip(got, want) if g != w]
    assert not different, f"{len(different)} of {len(got)} rows differ, first: {different[0]}"
    assert dict(df.dtypes) == types
    return len(got)
