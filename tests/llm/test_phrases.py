import random
import re
from collections import Counter

from helpers import docs, empty

from basketry.llm import phrases


def plain(table, least=10, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").encode().lower().decode()):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in (1, 2, 3):
                counts.update((lang, *words[s : s + m]) for s in range(len(words) - m + 1))
    wanted = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    found = {}
    for (lang, *w), a in wanted.items():
        if any(
            100 * b >= 50 * a and len(q) > len(w) + 1 and q[0] == lang and list(q[i : i + len(w)]) == w
            for q, b in wanted.items() if len(q) == 4 and len(w) == 2
            for i in (1, 2)
        ):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[(lang, *w[:k])], counts[(lang, *w[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, rows in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def case(n=150):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["Ünder", "É", "a b", "x\x1cy", "-"]
    table = [(None, None, None), (1, "", "en"), (2, " \t.,", "en")]
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "und", "a b\nc"])
        text = "".join(
            rng.choice(words[: rng.choice([4, 12, 45])]).title() + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!", "\x0b"])
            for _ in range(rng.randrange(60))
        )
        table.append((i, text, lang))
    table += [table[20]] * 12 + [(900, "the same pair " * 3000, "en"), (901, "zap " * 25 + "rare words here", "fr")]
    return table


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_equals_brute_force(spark):
    table = case()
    df = docs(spark, table).selectExpr("*", "1 as f", "2 as size", "'p' as phrase", "3 as rank")
    want = plain(table)
    found = phrases.report(df.repartition(4))
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == want
    assert len({r[0] for r in want}) >= 4 and any(r[2].count(" ") == 2 for r in want)


def test_result_does_not_depend_on_the_sample_or_the_filters(spark):
    table = case()
    want = plain(table, 5, 30)
    df = docs(spark, table)
    # Nothing proposed, a strict proposal, all proposed, and filters so small that all bits are set.
    for options in ({"sample": 10**6}, {"lowered": 4.0}, {"sample": 1, "lowered": 1.0}, {"bits": 64}, {"bits": 1 << 12}):
        found = phrases.collocations(df, top=30, least=5, **options).select(COLUMNS)
        assert sorted(map(tuple, found.collect())) == want, options


def test_border_and_failures_are_counted_once(spark):
    df = docs(spark, case())
    counts = phrases.frequent(df, sample=3).collect()
    assert len({(r["lang"], r["phrase"]) for r in counts}) == len(counts)


def test_small_chunks_give_the_same(spark, monkeypatch):
    table = case(40)
    run = phrases._counter(None, None, 3)
    whole, parts = Counter(), Counter()
    batch = phrases.pa.RecordBatch.from_pydict({"lang": [x[2] or "und" for x in table], "text": [x[1] for x in table]})
    for total, chunk in ((whole, phrases.CHUNK), (parts, 50)):
        monkeypatch.setattr(phrases, "CHUNK", chunk)
        for made in run(iter([batch])):
            for phrase, n in zip(made[0].to_pylist(), made[1].to_pylist(), strict=True):
                total[phrase] += n
    assert whole == parts and whole


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**14
    rows = [("en", "x", 1, 3 * big + 1), ("en", "y", 1, big + 7), ("en", "x y", 2, big + 3)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    (found,) = phrases.scored(counts).collect()
    assert found["score"] == 1_000_000 * (big + 3) ** 2 // ((3 * big + 1) * (big + 7))


def test_empty_table(spark):
    assert phrases.report(empty(spark)).count() == 0
