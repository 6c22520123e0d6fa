"""Quality score from compressed sizes under a good and a bad dictionary.

Two zstandard dictionaries are built from pieces of labelled good and bad text. Every whole
text is compressed piece by piece with either dictionary. The normalised difference of the
two sizes, (bad - good) / larger, and the compressed share of the text become a score between
0 and 1 by a logistic fit to other labelled documents.

Training is bounded: at most ``PIECES`` pieces of ``PIECE`` characters per class for the
dictionaries and ``CALIBRATION`` documents for the fit, taken in the order of a hash. Labelled
rows are split by ``crc32(doc_id) mod 3``: 0 builds the dictionaries, 2 calibrates, and 1 is
held out, never read for training. Labels, language, source and id are no input of a score.

Defined cases: a null text is an empty one; an empty text gets the score of the fit at sizes
of equal length; labels with a null quality are ignored; without labels of both classes every
score is 0.5. Extra columns are ignored; repeated documents each get a row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

PIECE, PIECES, CALIBRATION = 2000, 4000, 20_000
DICTIONARY_BYTES, LEVEL = 65_536, 3

Model = tuple[bytes, bytes, list[float]]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


@lru_cache(4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def pieces(text: str) -> list[bytes]:
    """The whole text in pieces of ``PIECE`` characters, the last one longer than half of that."""
    if not text:
        return []
    cuts = list(range(0, len(text), PIECE))
    if len(cuts) > 1 and len(text) - cuts[-1] <= PIECE // 2:
        cuts.pop()
    return [text[a:b].encode() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def features(text: str | None, good: bytes, bad: bytes) -> tuple[float, float]:
    """Normalised size difference, and the log of the compressed share of the text."""
    parts = pieces(text or "")
    if not parts:
        return 0.0, 0.0
    by_good, by_bad = _compressor(good), _compressor(bad)
    g = sum(len(by_good.compress(p)) for p in parts)
    b = sum(len(by_bad.compress(p)) for p in parts)
    return (b - g) / max(b, g), float(np.log(g / sum(map(len, parts))))


def _featured(good: bytes, bad: bytes):
    @F.pandas_udf(StructType([StructField("difference", DoubleType()), StructField("share", DoubleType())]))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t, good, bad) for t in texts], columns=["difference", "share"], dtype=float)

    return measure


def _terms(difference: np.ndarray, share: np.ndarray) -> np.ndarray:
    # Both very high and very low shares are unusual, so the square is a term too.
    return np.stack([np.ones_like(share), difference, share, share**2, difference * share], axis=1)


def fit(difference: np.ndarray, share: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic weights by Newton's method."""
    x = _terms(difference, share)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (label - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    marks = (
        labels.select("doc_id", "quality")
        .where("doc_id is not null and quality in (0, 1)")
        .distinct()
        .select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality"))
    )
    part = fold(F.col("__id"))
    order = F.xxhash64(F.col("__id"))
    # The ids of the sample are picked from the labels alone, so only their texts are read on.
    text = docs.select("doc_id", "text").where("length(text) > 0")
    samples = []
    for y in (1, 0):
        chosen = marks.where((part == 0) & (F.col("__quality") == y)).orderBy(order).limit(PIECES)
        cut = F.expr(
            f"transform(sequence(0, int((length(text) - 1) / {PIECE})),"
            f" i -> substring(text, i * {PIECE} + 1, {PIECE}))"
        )
        rows = (
            text.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
            .select("doc_id", F.posexplode(cut).alias("i", "piece"))
            .orderBy(F.xxhash64("doc_id", "i"), "piece")
            .limit(PIECES)
            .collect()
        )
        samples.append([r["piece"].encode() for r in rows])
    if not all(samples):
        return None
    good, bad = (_dictionary(s) for s in samples)
    chosen = marks.where(part == 2).orderBy(order).limit(CALIBRATION)
    rows = (
        text.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
        .select("__quality", _featured(good, bad)("text").alias("f"))
        .select("__quality", "f.*")
        .toPandas()
    )
    if rows["__quality"].nunique() < 2:
        return None
    return good, bad, fit(rows["difference"].to_numpy(), rows["share"].to_numpy(), rows["__quality"].to_numpy(float))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the joined samples where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a column ``score``."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))
    good, bad, weights = model

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        pairs = np.array([features(t, good, bad) for t in texts], dtype=float).reshape(-1, 2)
        z = _terms(pairs[:, 0], pairs[:, 1]) @ np.array(weights)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn("score", scored("text"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
