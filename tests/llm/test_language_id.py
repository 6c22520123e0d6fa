import itertools
import random
import zlib

import numpy as np
from helpers import docs, empty

from basketry.llm import language_id

SAMPLES = {
    "en": "the of and with that house water night under through people should".split(),
    "de": "der die und nicht schön wasser straße zwischen menschen immer".split(),
    "ru": "и не что человек вода ночь между когда дом".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(SAMPLES[lang]) for _ in range(n))


def corpus(rng, n=60):
    return [(i, text(rng, lang, 30), lang) for i, lang in zip(range(n), itertools.cycle(SAMPLES))]


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], np.ones((language_id.BUCKETS, 3)), np.ones((20, 3)))
    scored = [rng.normal(0, 12, (n, 3)) for n in (0, 1, 5, 7, 2)]
    for scores, labels in zip(scored, model.decode(scored), strict=True):
        def value(path, scores=scores):
            return sum(scores[i, x] for i, x in enumerate(path)) - language_id.PENALTY * sum(a != b for a, b in zip(path, path[1:]))

        best = max(map(value, itertools.product(range(3), repeat=len(scores))))
        assert abs(value(labels) - best) < 1e-9


def test_spans_and_edge_cases(spark):
    rng = random.Random(2)
    train = docs(spark, corpus(rng))
    model = language_id.train(train)
    assert model.languages == ["de", "en", "ru"]
    mixed = text(rng, "en", 12) + ". " + text(rng, "de", 20) + " 12 " + text(rng, "ru", 5)
    table = [(1, mixed), (1, mixed), (2, None), (3, ""), (4, "12 .. !"), (None, text(rng, "ru", 9)), (6, "日本語"), (7, text(rng, "de", 50_000))]
    found = language_id.label(docs(spark, table), model).toPandas()
    by = {None if np.isnan(i) else int(i): r for i, r in zip(found.doc_id.astype(float), found.itertuples())}
    assert [x.lang for x in by[1].spans] == ["en", "de", "ru"] and by[1].lang_pred == "de"
    assert mixed[by[1].spans[1].start : by[1].spans[1].end] == mixed.split(". ")[1].split(" 12 ")[0]
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and [by[i].score for i in (2, 3, 4)] == [0] * 3
    assert by[None].lang_pred == "ru" and by[7].lang_pred == "de" and by[6].lang_pred in model.languages
    assert 0 < by[1].score < 1 and by[7].score == 1


def test_report_learns_from_the_right_fold(spark):
    rng = random.Random(3)
    table = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "wrong") for i, t, lang in corpus(rng, 90)]
    found = {r.doc_id: r for r in language_id.report(docs(spark, table)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(found[i].lang_pred == list(SAMPLES)[i % 3] for i in found)
    assert language_id.report(docs(spark, [(1, "some text", None)])).first().lang_pred == "und"
    assert language_id.report(empty(spark)).count() == 0


def test_every_language_is_learned(spark):
    """As many languages as there are, however rare."""
    table = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i:02}") for i in range(90)]
    table += [(1000 + i, t, lang) for i, t, lang in table]
    model = language_id.train(docs(spark, table))
    assert len(model.languages) >= 70
