import hashlib
import random
import zlib

from helpers import DOCS, empty, prose
from pyspark.sql import functions as F

from basketry.llm import merkle
from basketry.llm.shared import ranked


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    """The top, and for every leaf the (earlier, later) siblings on its way up."""
    paths, own = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, k in enumerate(own):
            start = k // 16 * 16
            paths[i].append((digests[start:k], digests[k + 1 : start + 16]))
        digests = [h(*digests[g : g + 16]) for g in range(0, len(digests), 16)]
        own = [k // 16 for k in own]
    return digests[0], paths


def plain(table):
    sources = {}
    for row in table:
        sources.setdefault(row[3], []).append(row)
    trees = {}
    for source, rows in sources.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[source] = tree([leaf(r, r[1]) for r in rows])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, over = tree([trees[s][0] for s in order])
    out = []
    for source, up in zip(order, over, strict=True):
        for row, path in zip(sources[source], trees[source][1], strict=True):
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = text.encode().lower().decode()
            fold = leaf(row, text)
            for before, after in path + up:
                fold = h(*before, fold, *after)
            proof = h(*[x for before, after in path + up for x in before + after])
            out.append((row[0], leaf(row, row[1]), trees[source][0], root, proof, fold, fold == root))
    return sorted(out, key=repr)


def case():
    rng = random.Random(3)
    table = [(i, prose(rng, 5).title(), "en", "big", 30) for i in range(300)]
    table += [(i, prose(rng, 3), None, "exact", 1) for i in range(256)]
    table += [(i, "Ä Text", "de", f"s{i}", None) for i in range(40)]
    table += [(1000, None, None, None, None), (None, "x", "en", None, 1), (None, None, "en", "é", 2), (7, "", "en", "", 0)]
    table += [(5, "Twice", "en", "ties", 5)] * 40 + [(5, "Other", "en", "ties", 5), (6, "LONG " * 50_000, "en", "ties", 9)]
    return table


def frame(spark, table):
    return spark.createDataFrame(table, DOCS).selectExpr("*", "1 as lo", "2 as rank", "3 as tree", "'x' as digest", "4 as n")


def test_equals_brute_force(spark):
    table = case()
    found = merkle.report(frame(spark, table).repartition(5))
    want = plain(table)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert {r[-1] for r in want} == {True, False}


def test_few_rows(spark):
    for table in ([(1, "A", "en", "s", 1)], [(1, "A", "en", "s", 1), (2, "b", "en", "t", 1)]):
        assert sorted(map(tuple, merkle.report(frame(spark, table)).collect())) == plain(table)
    assert merkle.report(empty(spark)).count() == 0


def test_rank_of_a_group_that_holds_nearly_all_rows(spark):
    rows = [("hot", i % 7) for i in range(5000)] + [(None, 1), (None, None), ("a", 3)]
    found = ranked(spark.createDataFrame(rows, "g string, v long"), "g", F.col("v")).collect()
    hot = sorted((r["rank"], r["v"]) for r in found if r["g"] == "hot")
    assert [x for x, _ in hot] == list(range(5000)) and [v for _, v in hot] == sorted(i % 7 for i in range(5000))
    assert sorted((r["rank"], r["v"], r["n"]) for r in found if r["g"] is None) == [(0, None, 2), (1, 1, 2)]


def test_plan_has_no_python_and_no_product(spark):
    plan = merkle.report(frame(spark, case()))._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
