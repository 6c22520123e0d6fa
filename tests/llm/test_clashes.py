"""Operators that keep a table's columns keep their values, whatever the columns are called."""

import random

from helpers import WORDS, docs, prose

from basketry.llm import chat, compression_quality, decontaminate, language_id, licenses, merkle, packing, phrases
from basketry.llm import pii, quality_rules, simhash, suffix_dedup, warc_zip

TAKEN = (
    "__key __first __fp __id __k __m __stratum __kept __base_failed __cut_stratum __hit __items text_key items"
    " base_spans more_spans fp root a.b words gaps"
).split()


def test_extra_columns_keep_their_values(spark):
    rng = random.Random(4)
    item = " ".join(rng.choice(WORDS) + str(i) for i in range(20))
    table = [(1, prose(rng, 60)), (2, prose(rng, 30) + " " + item), (3, prose(rng, 40) + " a@b.com"), (4, None)]
    df = docs(spark, table, extra=False).selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in TAKEN])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality long")
    results = {
        "passing": (quality_rules.passing(df, labels), {1, 2, 3}),
        "distinct": (simhash.distinct_documents(df), {1, 2, 3, 4}),
        "remove_documents": (decontaminate.remove_documents(df, bench), {1, 3, 4}),
        "remove_spans": (decontaminate.remove_spans(df, bench), {1, 2, 3, 4}),
        "masked": (pii.masked(df), {1, 2, 3, 4}),
    }
    for name, (out, ids) in results.items():
        assert out.columns == df.columns, name
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == ids, name
        for r in rows:
            assert all(r[c] == f"{c}{r['doc_id']}" for c in TAKEN), name


def test_needed_columns_alone(spark):
    df = docs(spark, [(1, "one two three four"), (2, None)], extra=False).select("doc_id", "text")
    assert simhash.distinct_documents(df).count() == 2
    assert pii.masked(df.select("text")).count() == 2


def test_spans_of_a_long_text_are_removed_in_time(spark):
    """Each kept word costs the same, so 200,000 of them take seconds."""
    rng = random.Random(5)
    item = " ".join(rng.choice(WORDS) + str(i) for i in range(20))
    text = "clean word, " * 100_000
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.remove_spans(docs(spark, [(1, text + item + " end")]), bench).collect()
    assert out[0]["text"] == text + "end"


INNER = (
    "t x p r bucket rank at length text_key __found __id k n m h1 last s i j name start end kind f size phrase tree lo hi"
    " digest path leaf root children piece base score quality payload _at _range _place a.b again row fold"
).split()


def widened(df):
    return df.selectExpr("*", *[f"'{c}' as `{c}`" for c in INNER if c not in df.columns])


def test_extra_columns_change_no_result(spark):
    """Names that the operators use inside, on every table that they read."""
    rng = random.Random(6)
    shared = prose(rng, 120)
    texts = [prose(rng, rng.randrange(1, 90)) for _ in range(12)] + [shared, "MIT License. " + shared, None, "", shared]
    df = docs(spark, [(i, t, rng.choice(["en", "de"])) for i, t in enumerate(texts)], extra=False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality long")
    pages = spark.createDataFrame([(1, "u", "<p>" * 50), (2, "u", "<p>" * 50), (3, None, None)], "page_id long, url string, html string")
    turns = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b")], "conv_id long, turn long, role string, text string")
    runs = {
        "suffix_dedup": (suffix_dedup.report, [df]),
        "language_id": (language_id.report, [df]),
        "packing": (lambda d: packing.pack(packing.pieces(d)), [df]),
        "compression_quality": (compression_quality.report, [df, labels]),
        "licenses": (licenses.report, [df]),
        "merkle": (merkle.report, [df]),
        "phrases": (lambda d: phrases.collocations(d, least=2), [df]),
        "warc_zip": (warc_zip.report, [pages]),
        "chat": (chat.rendered, [turns]),
    }
    for name, (run, tables) in runs.items():
        plain, wide = run(*tables), run(*[widened(x) for x in tables])
        assert wide.columns == plain.columns, name
        assert sorted(map(repr, wide.collect())) == sorted(map(repr, plain.collect())), name
