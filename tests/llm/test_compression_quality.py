import random
import zlib

from helpers import docs, empty, prose

from basketry.llm import compression_quality as q


def case(rng, n=400):
    table, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        junk = " ".join(rng.choice(["buy", "now", "cheap", "click", "!!!"]) + "$$" for _ in range(60))
        table.append((i, junk if bad else prose(rng, 70)))
        marks.append((i, 0 if bad else 1))
    return table, marks


def test_held_out_accuracy_and_folds(spark):
    table, marks = case(random.Random(1))
    # Wrong labels in the held-out fold would show if they were read.
    told = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in marks]
    labels = spark.createDataFrame([*told, (1, None), (None, 1)], "doc_id long, quality int")
    extra = [(900, None), (901, ""), (None, prose(random.Random(2), 60)), (3, prose(random.Random(3), 90)), (902, prose(random.Random(4), 60_000))]
    found = q.report(docs(spark, table + extra), labels).toPandas()
    assert len(found) == len(table) + 5 and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    truth = dict(marks)
    held = [(r.predicted, truth[r.doc_id]) for r in found.itertuples() if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert found[found.doc_id == 900].score.iloc[0] == found[found.doc_id == 901].score.iloc[0]
    assert all(r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 3 == 1) for r in found.dropna().itertuples())


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.report(docs(spark, [(1, "a b c")]), none).first().score == 0.5
    assert q.report(empty(spark), none).count() == 0


def test_pieces_are_the_whole_text():
    for n in (0, 1, 1999, 2000, 2001, 3000, 3001, 9999):
        text = prose(random.Random(n), n)[:n]
        parts = q.pieces(text)
        assert b"".join(parts) == text.encode() and all(len(p) <= 3000 for p in parts)
