"""Removal of long repeated substrings by induction from sorted sample suffixes.

A byte goes if a string of ``LENGTH`` bytes around it also starts anywhere else. Such strings
are windows of the texts' suffixes, so this asks which suffixes share a prefix of ``LENGTH``
bytes with a neighbour in suffix order. The order is not built for every suffix:

1. *Sample.* Each window has an anchor: the place of its least 8-gram hash, the first of equal
   ones. Equal windows have equal anchors, so only suffixes at anchors (about one in 200) are
   sample suffixes; every other suffix is one that lies j bytes before its anchor.
2. *Reduce.* Tuples of the sample suffixes are named by hashes of the bytes that all windows
   of a range of j have in common, and of the bytes that any of them has. A name that occurs
   once has no repeat in that range; where all bytes of two tuples agree, every window of the
   range is repeated. Only tuples for which neither holds go on: they mark the ends of repeats.
3. *Sort.* Spark's sorter, which spills sorted runs to disk and merges them, brings these
   tuples in the order of their suffixes, and neighbours get their common-prefix lengths.
4. *Induce.* From the order at the anchor, the order of the suffixes j = 1, 2, ... bytes before
   it follows by one stable step each: a class of equal left bytes is split by the next byte to
   the left, while the common-prefix length that a repeat needs to the right falls by one.
5. *Recurse.* A name that more than ``GATHER`` tuples share is not gathered. Its range of j is
   halved, the longer common bytes name the tuples anew, and steps 2 to 4 follow for each half;
   a single j has one whole window as its name and needs no gathering.

This is induced sorting with Spark's external sort in the place of hand-made priority queues,
on the sample only; see the README for why.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` keep everything; repeated
documents repeat each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from basketry.llm.shared import stored

LENGTH, GRAM = 400, 8
#: Tuples of one name that one task sorts and induces together, at most; and those of one step.
GATHER, STEP = 20_000, 8_000
#: Window starts whose anchors are found at once.
BLOCK = 1 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """(place, least j, largest j): the windows that start j bytes before the place have it as anchor."""
    width = LENGTH - GRAM + 1
    for at in range(0, len(raw) - LENGTH + 1, BLOCK):
        part = np.frombuffer(raw, np.uint8)[at : at + BLOCK + LENGTH - 1]
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, GRAM))
        mixed = grams.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed &= np.uint64(0xFFFFFFFF00000000)
        mixed |= np.arange(len(mixed), dtype=np.uint64)
        place = (_least(mixed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        p = place[first]
        yield from zip((p + at).tolist(), (p - last).tolist(), (p - first).tolist(), strict=True)


def _ranges() -> list[tuple[int, int]]:
    half = (LENGTH - GRAM) // 2
    return [(0, half), (half + 1, LENGTH - GRAM)]


def names(part: bytes, at: int, j0: int, j1: int, a: int, b: int) -> tuple[int, int]:
    """Hashes of the common bytes of the range j0..j1, and of all bytes of the windows a..b.

    ``part[at]`` is the anchor. Together they are a name of 128 bits.
    """
    common = xxhash.xxh3_64_intdigest(part[at - j0 : at + LENGTH - j1], j0 * 1024 + j1)
    every = xxhash.xxh64_intdigest(part[at - b : at + LENGTH - a], a * 1024 + b)
    return common - (common >> 63 << 64), every - (every >> 63 << 64)


def tuples(text: str | None) -> list[tuple[int, int, int, int, int, int, int]]:
    """(p, j0, j1, a, b, name, whole) for each anchor and range of j."""
    raw = (text or "").encode()
    rows = []
    for p, low, high in anchors(raw):
        for j0, j1 in _ranges():
            a, b = max(low, j0), min(high, j1)
            if a <= b:
                rows.append((p, j0, j1, a, b, *names(raw, p, j0, j1, a, b)))
    return rows


FIELDS = {"p": IntegerType(), "j0": IntegerType(), "j1": IntegerType(), "a": IntegerType(), "b": IntegerType(),
          "name": LongType(), "whole": LongType()}


@F.pandas_udf(StructType([StructField(k, ArrayType(v)) for k, v in FIELDS.items()]))
def _tuples(texts: pd.Series) -> pd.DataFrame:
    found = [list(zip(*tuples(t), strict=True)) or [()] * len(FIELDS) for t in texts]
    return pd.DataFrame([[list(c) for c in row] for row in found], columns=list(FIELDS))


def _key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step 2: the tuples that are repeated as a whole, and those that stay open.

    Of tuples that are equal as a whole one goes on, as a partner for the open ones.
    """
    marked = rows.withColumn("row", F.xxhash64("doc_id", "text_key", "p"))
    whole = marked.groupBy("name", "whole", "a", "b").agg(
        F.count("*").alias("n"), F.min("row").alias("first"), F.max("sure").alias("any_sure")
    )
    whole = stored(whole.select("name", "whole", "a", "b", "n", "first", "any_sure"), "names")
    shared = whole.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1")
    classes = (
        whole.join(shared, "name", "left")
        .where("n > 1 or kinds is not null")
        .withColumnsRenamed({"name": "__name", "whole": "__whole", "a": "__a", "b": "__b"})
    )
    same = [F.col(c) == F.col(f"__{c}") for c in ("name", "whole", "a", "b")]
    found = marked.join(stored(classes, "classes"), same)
    kept = [*rows.columns, "n", "kinds", "row", "first", "any_sure"]
    found = stored(found.select(*kept), "tuples")
    repeated = found.where("n > 1 and not sure").select(
        "doc_id", "text_key", (F.col("p") - F.col("b")).alias("start"), (F.col("p") - F.col("a") + LENGTH).alias("end")
    )
    still = found.where("kinds is not null and row = first").withColumn("sure", F.expr("sure or n > 1 or any_sure"))
    return repeated, still.drop("n", "row", "first", "any_sure")


def _halved(rows: DataFrame) -> DataFrame:
    """Step 5: the tuples of both halves of their range of j, named anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                middle = (r["j0"] + r["j1"]) // 2
                for j0, j1 in ((r["j0"], middle), (middle + 1, r["j1"])):
                    a, b = max(r["a"], j0), min(r["b"], j1)
                    if a <= b:
                        part = r["part"][r["b"] - b : r["b"] + LENGTH - a]
                        name, whole = names(part, b, j0, j1, a, b)
                        new = {"j0": j0, "j1": j1, "a": a, "b": b, "name": name, "whole": whole, "part": part}
                        out.append(r | new)
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def induce(group: np.ndarray, a: np.ndarray, b: np.ndarray, parts: list[bytes], j0: np.ndarray) -> list[tuple[int, int, int]]:
    """Step 4 for tuples in the order of (group, suffix at the anchor): (tuple, first j, last j).

    ``parts[i]`` are the bytes from ``b[i]`` before the anchor; all of a group agree in the
    bytes down to ``j0`` before it.
    """
    n = len(group)
    right = np.array([len(x) for x in parts]) - b
    suffixes = np.zeros((n, LENGTH + 1), np.uint8)
    before = np.zeros((n, int((b - j0).max()) + 1), np.uint8)
    for i, x in enumerate(parts):
        raw = np.frombuffer(x, np.uint8)
        suffixes[i, : right[i]] = raw[b[i] :]
        depth = b[i] - j0[i]
        before[i, :depth] = raw[:depth][::-1]
    differ = suffixes[1:] != suffixes[:-1]
    differ[:, -1] = True
    common = np.minimum(differ.argmax(axis=1), np.minimum(right[1:], right[:-1]))
    common = np.concatenate([[0], np.where(group[1:] == group[:-1], common, 0)])
    found: dict[int, list[list[int]]] = {}
    alive = np.arange(n)
    left = group.copy()
    for step in range(before.shape[1]):
        j = j0 + step
        # Neighbours with the prefix that a window at this j still needs are one class.
        needs = LENGTH - j
        classes = np.cumsum(common < needs)
        now = alive[(a[alive] <= j[alive]) & (j[alive] <= b[alive])]
        both = left[now].astype(np.int64) * (n + 1) + classes[now]
        _, at, count = np.unique(both, return_inverse=True, return_counts=True)
        for i in now[count[at] > 1].tolist():
            spans = found.setdefault(i, [])
            if spans and spans[-1][1] == j[i] - 1:
                spans[-1][1] = int(j[i])
            else:
                spans.append([int(j[i]), int(j[i])])
        alive = alive[b[alive] > j[alive]]
        if not len(alive):
            break
        _, at, count = np.unique(left[alive].astype(np.int64) * 256 + before[alive, step], return_inverse=True, return_counts=True)
        left[alive] = at
        alive = alive[count[at] > 1]
    return [(i, x, y) for i, spans in found.items() for x, y in spans]


def _induced(rows: DataFrame) -> DataFrame:
    """Steps 3 and 4: (doc_id, text_key, start, end) of the repeats that the tuples still hide."""
    ordered = rows.withColumn("suffix", F.expr("substring(part, b + 1)")).repartition("name")
    ordered = ordered.sortWithinPartitions("name", "j0", "suffix").drop("suffix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                # Groups are never torn; they have at most ``GATHER`` tuples.
                if len(held) >= STEP and (held[-1]["name"], held[-1]["j0"]) != (r["name"], r["j0"]):
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    places = [StructField("start", IntegerType()), StructField("end", IntegerType())]
    schema = StructType([rows.schema["doc_id"], rows.schema["text_key"], *places])
    arrow_schema = to_arrow_schema(schema)

    def done(held: list[dict]) -> pa.RecordBatch:
        keys = [(r["name"], r["j0"]) for r in held]
        group = np.concatenate([[0], np.cumsum([x != y for x, y in zip(keys[1:], keys, strict=False)])]).astype(np.int64)
        a, b, j0 = (np.array([r[c] for r in held], np.int64) for c in ("a", "b", "j0"))
        out = []
        for i, x, y in induce(group, a, b, [r["part"] for r in held], j0):
            r = held[i]
            if not r["sure"]:
                out.append({"doc_id": r["doc_id"], "text_key": r["text_key"], "start": r["p"] - y, "end": r["p"] - x + LENGTH})
        return pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return ordered.mapInArrow(run, schema)


def repeats(docs: DataFrame, gather: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, end): byte ranges that cover exactly what is repeated."""
    gather = GATHER if gather is None else gather
    keyed = _key(docs)
    fields = [F.col(f"x.{k}").alias(k) for k in FIELDS]
    zipped = F.arrays_zip(*[f"t.{k}" for k in FIELDS])
    rows = (
        keyed.select("doc_id", "text_key", _tuples("text").alias("t"))
        .select("doc_id", "text_key", F.explode(zipped).alias("x"))
        .select("doc_id", "text_key", *fields, F.lit(False).alias("sure"))
    )
    found, still = _split(stored(rows, "sample"))
    texts = keyed.distinct().select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("text").cast("binary").alias("raw"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    part = F.expr(f"substring(raw, p - b + 1, {LENGTH} + b - a)").alias("part")
    still = stored(still.join(texts, on).select(*still.columns, part), "open")
    while True:
        crowded = still.groupBy("name").count().where((F.col("count") > gather)).select(F.col("name").alias("__name"))
        crowded = stored(crowded, "crowded")
        if crowded.isEmpty():
            return found.unionByName(_induced(still.drop("kinds")))
        here = F.col("name") == F.col("__name")
        found = found.unionByName(_induced(still.join(crowded, here, "left_anti").drop("kinds")))
        # A range of one j is a window, and its name is its whole text: nothing is left to tell apart.
        wide = still.join(crowded, here, "left_semi").drop("kinds").where("j0 < j1")
        more, still = _split(stored(_halved(wide), "halves"))
        found = found.unionByName(more)
        still = stored(still, "open")


def _cut(text: str | None, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    raw = (text or "").encode()
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    gone = np.cumsum(edge)[: len(raw)] > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def report(docs: DataFrame, gather: int | None = None) -> DataFrame:
    """One row per document: its bytes, removed bytes and runs, and a digest of the rest."""
    spans = (
        repeats(docs, gather)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans")
    )
    kinds = StructType([StructField("n", LongType()), StructField("runs", LongType()), StructField("digest", StringType())])

    @F.pandas_udf(kinds)
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for text, s, e in zip(texts, starts, ends, strict=True):
            kept, n, runs = _cut(text, np.asarray(s, np.int64), np.asarray(e, np.int64))
            rows.append((n, runs, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n", "runs", "digest"])

    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    joined = _key(docs).join(stored(spans, "spans"), on, "left")
    none = F.array().cast("array<int>")
    rows = joined.withColumn(
        "c", cut("text", F.coalesce("spans.start", none), F.coalesce("spans.end", none))
    )
    return rows.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.col("c.n").alias("n_removed"),
        F.col("c.runs").alias("n_spans"),
        F.col("c.digest").alias("kept_sha256"),
    )
