"""Small tables for the operators' tests."""

from __future__ import annotations

import random

WORDS = "the of and to in was that with for haed thion erent ointh reand seth lomin dorta vell ipsu".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=True):
    """Documents of (doc_id, text[, lang]), with extra columns whose names invite clashes."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if not extra:
        return df
    return df.selectExpr("*", "1 as hit", "'x' as start", "2 as row", "3 as name", "'k' as fp", "4 as n", "5 as m", "6 as score")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "", ","]) for _ in range(n))


def empty(spark):
    return docs(spark, [], extra=False)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
