"""Quality rules whose cutoffs carry a risk guarantee from labelled documents.

Each rule rejects a document if one signal exceeds a cutoff. Cutoffs are chosen per stratum
(``lang``) on labelled documents: going from the most lenient cutoff of a fixed list to the
strictest, a cutoff is certified as long as the exact binomial (Clopper-Pearson) upper bound
of its false-rejection rate stays within the rule's share of the limit. With R rules and S
strata a rule may reject ``LIMIT / R`` of the good documents, and a bound holds with
confidence ``1 - DELTA / (R * S)``; so with confidence ``1 - DELTA`` no stratum loses more
than ``LIMIT`` of its good documents to all rules together. Testing in a fixed order and
stopping at the first failure needs no further correction for the number of cutoffs.

Of the certified cutoffs a rule takes the one that gains most: bad documents rejected less
``PRICE`` times the good ones. It takes none if that is not positive, or if the stratum has
too few labels to certify anything.

Good and bad documents with the same text count once, since copies are not independent. The
counts cover every labelled document and are one row per stratum.

Defined cases: a null text has no words and fails the base rules; a document with a null
``lang`` is in a stratum of its own; labels with a null quality are ignored, a document with
both labels counts as both; repeated documents each get a row. Extra columns are ignored by
``report`` and kept by ``passing``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from basketry.llm.shared import folded, stored, unfolded

LIMIT, DELTA, PRICE = 0.05, 0.05, 10
#: Cutoffs from lenient to strict. A rule rejects signals above its cutoff.
CUTOFFS: dict[str, list[float]] = {
    "symbols": [0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "repeats": [0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05, 0.03],
    "duplicate_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "capitals": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "long_words": [40, 30, 25, 20, 18, 16, 14, 12, 10, 9, 8],
    "short_words": [-1, -1.25, -1.5, -1.75, -2, -2.25, -2.5, -2.75, -3],
}
MIN_WORDS, REPEAT_PERCENT = 10, 20

_SPACE = b" \t\n\x0b\x0c\r"
_EVERY = bytes(range(256))
_NOT_SPACE = bytes(set(_EVERY) - set(_SPACE))
_NOT_SYMBOL = bytes(set(_EVERY) - set(b"#*$%&|<>"))
_NOT_CAPITAL = bytes(set(_EVERY) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_NOT_LETTER = bytes(set(_EVERY) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters"
)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """How many words lie in a window of ``size`` words that occurs at least twice."""
    n = len(words)
    if n <= size:
        return 0
    # Windows with different hashes differ, so most texts need no exact comparison.
    mixed = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    hashed = mixed[: n - size + 1].copy()
    for k in range(1, size):
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += mixed[k : n - size + 1 + k]
    if not (np.diff(np.sort(hashed)) == 0).any():
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    windows, width = ids, len(index)
    for k in range(1, size):
        # Numbered anew each time, so the product stays within n * n.
        _, windows = np.unique(windows[: n - k] * width + ids[k:], return_inverse=True)
    counts = np.bincount(windows)
    starts = np.flatnonzero(counts[windows] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def measure(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - len(raw.translate(None, _NOT_SPACE)),
        len(raw.translate(None, _NOT_SYMBOL)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw.translate(None, _NOT_CAPITAL)),
        len(raw.translate(None, _NOT_LETTER)),
    )


@F.pandas_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def _signals(m: Column) -> dict[str, Column]:
    def share(a: Column, b: Column) -> Column:
        return a / F.greatest(b, F.lit(1))

    return {
        "symbols": share(m["n_symbols"], m["word_chars"]),
        "repeats": share(m["n_repeat_words"], m["n_words"]),
        "duplicate_lines": share(m["n_dup_lines"], m["n_lines"]),
        "capitals": share(m["n_capitals"], m["n_letters"]),
        "long_words": share(m["word_chars"], m["n_words"]),
        "short_words": -share(m["word_chars"], m["n_words"]),
    }


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1, dtype=float)
    steps = np.log(n - i + 1) - np.log(i) + math.log(p) - math.log1p(-p)
    terms = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = terms.max()
    return float(min(1.0, math.exp(top) * np.exp(terms - top).sum()))


def choose(good: list[int], bad: list[int], n_good: int, limit: float, delta: float) -> int | None:
    """The place of the best certified cutoff; ``good`` and ``bad`` are rejections by cutoff."""
    best, gain = None, 0
    for i, (g, b) in enumerate(zip(good, bad, strict=True)):
        # The upper bound is within the limit exactly if so few rejections are this unlikely.
        if n_good == 0 or binomial_at_most(g, n_good, limit) > delta:
            break
        if b - PRICE * g > gain:
            best, gain = i, b - PRICE * g
    return best


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, text_key, m) of every document: one pass, stored without the texts."""
    rows = docs.select(
        "doc_id",
        F.col("lang").alias("stratum"),
        F.xxhash64("text").alias("text_key"),
        _measured("text").alias("m"),
    )
    return stored(rows, "measures")


def cutoffs(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum`` and the cutoff of each rule, null for none, of every stratum that has one.

    ``measured`` comes from ``measures``.
    """
    marks = (
        labels.select("doc_id", "quality")
        .where("doc_id is not null and quality in (0, 1)")
        .distinct()
        .select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality"))
    )
    marked = measured.join(marks, F.col("doc_id") == F.col("__id"))
    counted = marked.dropDuplicates(["stratum", "text_key", "__quality"]).where(
        ~_base_failed(F.col("m"))
    )
    sums = [F.sum(F.when(F.col("__quality") == 1, 1).otherwise(0)).alias("n_good")]
    for rule, signal in _signals(F.col("m")).items():
        for i, cut in enumerate(CUTOFFS[rule]):
            over = signal > F.lit(float(cut))
            for y, name in ((1, "good"), (0, "bad")):
                hit = F.when((F.col("__quality") == y) & over, 1).otherwise(0)
                sums.append(F.sum(hit).alias(f"{name}_{rule}_{i}"))
    table = counted.groupBy("stratum").agg(*sums)
    strata = marked.select("stratum").distinct().count()
    limit, delta = LIMIT / len(CUTOFFS), DELTA / (len(CUTOFFS) * max(1, strata))

    def pick(batches):
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                chosen = {}
                for rule, cuts in CUTOFFS.items():
                    good, bad = ([int(r[f"{y}_{rule}_{i}"]) for i in range(len(cuts))] for y in ("good", "bad"))
                    at = choose(good, bad, int(r["n_good"]), limit, delta)
                    chosen[rule] = None if at is None else float(cuts[at])
                rows.append({"stratum": r["stratum"]} | chosen)
            yield pd.DataFrame(rows, columns=["stratum", *CUTOFFS])

    picked = table.mapInPandas(pick, "stratum string, " + ", ".join(f"{r} double" for r in CUTOFFS))
    # Stored, so that Spark knows how small it is: else it would shuffle all texts by stratum.
    some = F.coalesce(*[F.col(r) for r in CUTOFFS]).isNotNull()
    return stored(picked.where(some), "cutoffs")


def _judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with columns __m and __stratum) and its ``__base_failed`` and ``__kept``."""
    cuts = cuts.select(*[F.col(c).alias(f"__cut_{c}") for c in cuts.columns])
    rejected = F.lit(False)
    for rule, signal in _signals(F.col("__m")).items():
        rejected = rejected | F.coalesce(signal > F.col(f"__cut_{rule}"), F.lit(False))
    return (
        rows.join(cuts, F.col("__stratum").eqNullSafe(F.col("__cut_stratum")), "left")
        .withColumn("__base_failed", _base_failed(F.col("__m")))
        .withColumn("__kept", ~F.col("__base_failed") & ~rejected)
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its measures, the base verdict and the final one."""
    measured = measures(docs.select("doc_id", "text", "lang"))
    rows = measured.withColumnsRenamed({"m": "__m", "stratum": "__stratum"})
    return _judged(rows, cutoffs(measured, labels)).select(
        "doc_id",
        *[F.col("__m")[m].alias(m) for m in MEASURES],
        F.col("__base_failed").alias("base_failed"),
        F.col("__kept").alias("kept"),
    )


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents, all columns kept.

    Measures twice, which costs less than shuffling the texts to join the verdicts.
    """
    cuts = cutoffs(measures(docs), labels)
    rows = folded(docs, "text", "lang").withColumn("__m", _measured(F.col("text")))
    judged = _judged(rows.withColumn("__stratum", F.col("lang")), cuts)
    return unfolded(judged.where("__kept"), docs.columns)
