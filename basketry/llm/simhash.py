"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits; bit b is 1 if it is set in over half the XXH64 hashes (seed 42) of
the text's word shingles. Documents link at ``bits`` or fewer differing bits.

Links are searched between distinct fingerprints only. A fingerprint is cut into ``segments``
segments. Two fingerprints that differ in d bits agree in some segment up to d // segments
bits, so each enumerates the small Hamming ball of each of its segments, fetches the
fingerprints that have such a segment from that segment's table, and compares all 64 bits.
Of the two that could find each other, only the one with the smaller segment looks.

Segment values that more than ``CROWD`` distinct fingerprints share (a large group of near
copies) are not joined with themselves. Their fingerprints are linked exactly through the
points around them: two fingerprints within 3 bits have a point within 1 bit of one and 2 of
the other, and all that are within 2 bits of a point are within 3 of each that is within 1.
So each point ties its members to one of those, without forming pairs. For other distances
the ball is split likewise into ceil(d/2) and floor(d/2).

Components come from alternating star contraction; every round is written to the shared
folder.

Defined cases: a null text, and one without words, has fingerprint zero, linked like any
other; null ids count as larger than all others, so a component of null ids has a null id;
repeated rows share their component. Extra columns are ignored by ``components``
and kept by ``distinct_documents``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from basketry.llm.shared import REST, folded, stored, unfolded
from basketry.llm.stars import connected

SEED, SHINGLE, BITS, SEGMENTS = 42, 3, 3, 2
CROWD = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``__fp``, the fingerprint as a signed long."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return docs.withColumn("__fp", run("text"))


def _ball(width: int, radius: int) -> list[int]:
    """Masks of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _segments(bits: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of the segments that can hold the closest agreement."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    radius, rest = divmod(bits, segments)
    parts = [(a, b - a, radius - (i > rest)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return [p for p in parts if p[2] >= 0]


def _through_points(crowd: DataFrame, bits: int) -> DataFrame:
    """Edges between crowded fingerprints, by the points near them."""
    near, far = bits // 2, bits - bits // 2
    masks = [
        F.struct(F.lit(_signed(m)).alias("mask"), F.lit(m.bit_count() <= near).alias("near"))
        for m in _ball(64, far)
    ]
    # At most as many members as a ball has points, since fingerprints are distinct.
    return (
        crowd.select("fp", F.explode(F.array(*masks)).alias("p"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("p.mask")).alias("point"), "p.near")
        .groupBy("point")
        .agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.collect_set("fp").alias("fps"))
        .where(F.col("b").isNotNull() & (F.size("fps") > 1))
        .select(F.explode("fps").alias("a"), "b")
        .where("a != b")
    )


def links(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within ``bits`` bits.

    Every such pair is an edge, except that members of a crowded segment value may be tied
    through a common neighbour instead.
    """
    edges = None
    for shift, width, radius in _segments(bits, segments):
        value = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        entries = fps.select("fp", value.alias("value"))
        crowded = (
            entries.groupBy("value").count().where(F.col("count") > crowd).select("value")
        )
        crowded = stored(crowded, "crowded")
        masks = F.array(*[F.lit(_signed(m)) for m in _ball(width, radius)])
        probe = F.col("value").bitwiseXOR(F.col("mask")).alias("value")
        busy = not crowded.isEmpty()
        table = entries.join(crowded, "value", "left_anti") if busy else entries
        table = table.withColumnRenamed("fp", "b")
        # Of two open entries the one with the smaller value looks; equal values by fingerprint.
        probes = (
            (entries.join(crowded, "value", "left_anti") if busy else entries)
            .select("fp", "value", F.explode(masks).alias("mask"))
            .where(F.col("value").bitwiseXOR(F.col("mask")) >= F.col("value"))
            .select("fp", "mask", probe)
        )
        close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= bits
        found = (
            probes.join(table, "value")
            .where(close & ((F.col("mask") != 0) | (F.col("fp") < F.col("b"))))
            .select(F.col("fp").alias("a"), "b")
        )
        if busy:
            inside = entries.join(crowded, "value", "left_semi")
            outward = (
                inside.select("fp", "value", F.explode(masks).alias("mask"))
                .select("fp", probe)
                .join(table, "value")
                .where(close)
                .select(F.col("fp").alias("a"), "b")
            )
            found = found.unionByName(outward).unionByName(_through_points(inside, bits))
        edges = found if edges is None else edges.unionByName(found)
    return edges


def _located(docs: DataFrame, shingle: int, bits: int, segments: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every document, and (fp, root) of every fingerprint."""
    rows = fingerprints(docs.select("doc_id", "text"), shingle).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.col("__fp").alias("fp")
    )
    rows = stored(rows, "fingerprints")
    fps = stored(rows.select("fp").distinct(), "distinct-fingerprints")
    roots = connected(links(fps, bits, segments))
    return rows, fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def components(
    docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, segments: int = SEGMENTS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    rows, roots = _located(docs, shingle, bits, segments)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = stored(roots.join(least, "fp"), "placed")
    ids = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    by_fp = stored(placed.join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def distinct_documents(
    docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, segments: int = SEGMENTS
) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns."""
    rows, roots = _located(docs, shingle, bits, segments)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    least = rows.groupBy("fp").agg(F.min(rank).alias("first"))
    kept = roots.join(least, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = stored(kept.select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__k")), "kept")
    keyed = folded(docs, "doc_id", "text").withColumn("__key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(kept["__id"]) & (keyed["__key"] == kept["__k"])
    # Repeated rows are the only ties left; one that is run again picks the same.
    tie = F.to_json(REST) if REST in keyed.columns else F.lit(1)
    first = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(tie))
    chosen = keyed.join(kept, same, "left_semi").withColumn("__first", first).where("__first = 1")
    return unfolded(chosen, docs.columns)
