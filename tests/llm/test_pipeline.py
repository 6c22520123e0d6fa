"""The pipeline against brute force on the smallest tables, and on odd documents."""

import random
import re

from helpers import DOCS
from test_decontaminate import plain as hits
from test_pii import spans
from test_simhash import groups, plain_fingerprint

import corpus_pipeline
from basketry.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = table(spark, SF, "documents")
    odd = [(None, None, None, None, None), (70001, "", "en", "x", 0), (70002, None, "xx", None, None), (None, "ten words that are said by one who has none " * 3, "en", "x", 1)]
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame(odd, DOCS))
    stages = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = [docs]
    for n in names[:-1]:
        kept.append(spark.createDataFrame(stages[n](spark, kept[-1], SF).collect(), DOCS))
        assert kept[-1].columns == docs.columns
    raw, good, distinct, clean, masked = [[(r.doc_id, r.text) for r in k.collect()] for k in kept]

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def base_failed(t):
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
        return len(w) < 10 or 100 * len(hit) > 20 * len(w)

    # So few labels certify no cutoff, so the base rules decide.
    assert sorted(good, key=repr) == sorted([r for r in raw if not base_failed(r[1])], key=repr)
    prints = {t: plain_fingerprint(t) for _, t in good}
    first = {}
    for group in groups(sorted(set(prints.values())), 3):
        members = [i for i, t in good if prints[t] in group]
        ids = [i for i in members if i is not None]
        first[tuple(group)] = min(ids) if ids else None
    assert sorted(map(repr, first.values())) == sorted(repr(i) for i, _ in distinct)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = [repr(r[0]) for r in hits(distinct, items) if r[-1]]
    assert sorted(repr(i) for i, _ in clean) == sorted(repr(i) for i, _ in distinct if repr(i) not in bad)
    texts = dict(masked)
    assert len(masked) == len(clean) and not any(spans(t) for t in texts.values())
    assert all(texts[i] == t for i, t in clean if not re.search("[0-9@]", t))
    packed = stages[names[-1]](spark, kept[-1], SF).collect()
    assert {r.doc_id for r in packed} == set(texts)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def small_tables(spark, folder, rows, items=(), marks=()):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(marks), "doc_id long, quality long").write.parquet(f"{folder}/labels.parquet")


def test_empty_tables(spark, tmp_path):
    small_tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_long_null_and_repeated_rows_without_labels_or_benchmark(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(200_000))
    good = " ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) + " write to a@b.example or call"
    rows = [(1, long, "en", "s", len(long)), (2, None, None, None, None), (3, "", "en", "s", 0), (4, good, "en", "s", len(good))]
    rows += [(4, good, "en", "s", len(good)), (5, good.upper(), "en", "s", len(good)), (None, "few words", None, "s", 9)]
    small_tables(spark, tmp_path / "odd", rows)
    packed = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    # Of the copies one stays; the null, the empty and the short text fail the base rules.
    assert {r.doc_id for r in packed} == {1, 4}
    assert sum(r.piece == 0 for r in packed) == 2 and sum(r.length for r in packed if r.doc_id == 1) > 400_000


def test_extra_columns_pass_through_every_stage(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k * 7919 % 1009}" for k in range(30)), "en", "s", 9) for i in range(4)]
    small_tables(spark, tmp_path / "wide", rows)
    names = ["hit", "fp", "root", "start", "quality", "item_id", "rank", "bucket", "__key", "a.b"]
    docs = table(spark, str(tmp_path / "wide"), "documents")
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path / "wide"))
        assert kept.columns == docs.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in kept.collect() for c in names)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / "wide")).collect()} == {0, 1, 2, 3}
