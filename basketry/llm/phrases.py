"""Phrase collocations by Toivonen's sampling method.

Texts are cut into pieces and words; a phrase is two or three words that follow each other in a
piece, and counts per language. Those with ``LEAST`` occurrences or more are wanted, and only they
need exact counts:

1. *Sample.* One row in ``SAMPLE`` proposes: the words and pairs of words that reach a lowered
   threshold there.
2. *Full pass.* All words are counted, and of the longer phrases those proposed and their negative
   border, the phrases not proposed whose parts all are: pairs of proposed words, and triples of
   proposed pairs. A phrase with a part that is rare is hardly ever looked at.
3. *Border failures.* A wanted word or pair that the sample had not proposed may be part of wanted
   phrases that were not counted. If there is any, an expansion pass counts the phrases that these
   failures allow and that were not counted before. Words are exact after the full pass, and the
   expansion lets every pair with a new word be part of a triple, so it leaves the set closed.

What was proposed travels as two bit filters of fixed size (``FILTER_BITS``), whatever the size of
the corpus. A filter never loses a phrase; where bits are shared it only lets a pass count
some that need not be, so results do not depend on it.

Each task counts a few MB of text at a time as numbers (words by their place in a dictionary) and
hands on one row for each distinct phrase; Spark adds them up, combined on the map side. The best
phrases are found by a distributed rank, not by a window over a language.

Scores use decimals of 38 digits, exact for counts up to 10**15.

Defined cases: a null text has no words; a null language is ``und``; ids are not read but to
draw the sample; repeated rows count each; ties in the score go by count, then by the phrase's
bytes; an empty table has no phrases. Extra columns are ignored. A text is held whole by one task, at
some 30 times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import only, ranked, stored

LEAST, SCALE, COVERED, TOP = 10, 1_000_000, 50, 2000
#: One row in SAMPLE is drawn; a phrase is proposed at this part of the count expected of a wanted one.
SAMPLE, LOWERED = 4, 0.8
FILTER_BITS = 1 << 26
#: Bytes of text that are counted at once; a worker holds some 30 times as much.
CHUNK = 6_000_000
UNKNOWN_LANGUAGE = "und"
SEED, TURN = 42, 17
_OUT = "phrase string, f long"
_SPACE, _END = 32, 10
_GAP, _BREAK = (pa.scalar(x, pa.large_string()) for x in " \n")
_TABLE = bytes(
    _END if chr(c) in ".,;:!?\n\x0b\x0c\r" else _SPACE if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


class Filters(NamedTuple):
    """Bits of the hashes of proposed words and pairs."""

    words: np.ndarray
    pairs: np.ndarray

    def joined(self, other: Filters) -> Filters:
        return Filters(self.words | other.words, self.pairs | other.pairs)


def _turned(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(TURN)) | (h >> np.uint64(64 - TURN))


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


class Words(NamedTuple):
    """The words of a text by number; ``follows`` tells whether the next word is in the same piece."""

    known: pa.Array
    ids: np.ndarray
    follows: np.ndarray


def words_of(text: bytes) -> Words:
    data = np.frombuffer(text.translate(_TABLE), np.uint8)
    inside = (data != _SPACE) & (data != _END)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    pieces = np.cumsum(data == _END, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = pa.py_buffer(data[inside].tobytes())
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), letters])
    coded = found.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), pieces[1:] == pieces[:-1])


def _tally(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns of numbers from 0, and how often each occurs."""
    if len(columns) == 1:
        found, n = np.unique(columns[0], return_counts=True)
        return [found], n
    heads, codes = (columns[0], None) if len(columns) == 2 else (columns[:2], None)
    if len(columns) == 3:
        width = int(columns[1].max(initial=0)) + 1
        heads, codes = np.unique(columns[0] * width + columns[1], return_inverse=True)
    last = columns[-1]
    width_last = int(last.max(initial=0)) + 1
    found, n = np.unique((columns[0] if codes is None else codes) * width_last + last, return_counts=True)
    head, tail = np.divmod(found, width_last)
    if codes is None:
        return [head, tail], n
    return [*np.divmod(heads[head], width), tail], n


def counted(
    text: bytes, lang: str, new: Filters | None, old: Filters | None, longest: int
) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of the words (unless ``old``), pairs and triples that ``new`` admits and ``old`` did not.

    Without filters every phrase is admitted.
    """
    known, ids, follows = words_of(text)
    if not len(ids):
        return
    if old is None:
        yield pa.array([""], pa.large_string()), np.array([len(ids)])
        n = np.bincount(ids, minlength=len(known))
        yield known, n
    first, second = ids[:-1], ids[1:]
    pair = follows
    if new is not None:
        salt = np.uint64(xxhash.xxh64_intdigest(lang, SEED))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in known.to_pylist()), np.uint64, len(known))
        pair_hash = hashes[first] ^ _turned(hashes)[second] ^ salt

        def admitted(f: Filters) -> np.ndarray:
            fine = _has(f.words, hashes ^ salt)
            return follows & fine[first] & fine[second]

        pair = admitted(new)
        inner = pair & _has(new.pairs, pair_hash)
        if old is not None:
            before = admitted(old)
            seen = before & _has(old.pairs, pair_hash)
            seen = seen[:-1] & seen[1:]
            # A pair with a new word has no exact count yet.
            inner |= pair & ~before
            pair = pair & ~before
    else:
        inner, old = pair, None
    at = np.flatnonzero(pair)
    (a, b), n = _tally(first[at], second[at])
    yield pc.binary_join_element_wise(known.take(a), known.take(b), _GAP), n
    if longest < 3:
        return
    triple = inner[:-1] & inner[1:]
    if old is not None:
        triple &= ~seen
    at = np.flatnonzero(triple)
    (a, b, c), n = _tally(ids[at], ids[at + 1], ids[at + 2])
    yield pc.binary_join_element_wise(known.take(a), known.take(b), known.take(c), _GAP), n


def _counter(new, old, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if x is None else x.value for x in (new, old)]
        waiting: dict[str, list[bytes]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, texts in waiting.items():
                for phrases, n in counted(b"\n".join(texts), lang, *filters, longest):
                    keys = pc.binary_join_element_wise(phrases, pa.scalar(lang, pa.large_string()), _BREAK)
                    made = pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(n, pa.int64())], ["phrase", "f"])
                    for start in range(0, len(made), 50_000):
                        yield made.slice(start, 50_000)
            waiting.clear()

        held = 0
        for batch in batches:
            for lang, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                waiting.setdefault(lang, []).append(raw)
                held += len(raw)
                if held >= CHUNK:
                    yield from flushed()
                    held = 0
        yield from flushed()

    return run


def _pass(texts: DataFrame, new: Filters | None, old: Filters | None, longest: int, least: int) -> DataFrame:
    """(lang, phrase, size, f) of the phrases that a pass counts, ``least`` times or more; size 0 is all words."""
    send = texts.sparkSession.sparkContext.broadcast
    run = _counter(*[None if x is None else send(x) for x in (new, old)], longest)
    rows = texts.mapInArrow(run, _OUT).groupBy("phrase").agg(F.sum("f").alias("f"))
    # One column travels: the phrase, a line feed (no word has one) and the language.
    phrase = F.substring_index("phrase", "\n", 1)
    rows = rows.select(F.expr("substring(phrase, instr(phrase, '\n') + 1)").alias("lang"), phrase.alias("phrase"), "f")
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return stored(rows.withColumn("size", size).where((F.col("f") >= least) | (F.col("size") == 0)), "phrases")



def _bits(h: Column, rows: DataFrame, bits: int) -> np.ndarray:
    """A filter of the hashes: at most ``bits / 64`` rows come to the driver."""
    at = h.bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    lanes = rows.select(F.shiftright(at, 6).alias("lane"), bit.alias("bit"))
    found = lanes.groupBy("lane").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["lane"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def filters(counts: DataFrame, bits: int) -> Filters:
    """Filters of all words and pairs in ``counts``."""
    salt = F.xxhash64("lang")
    part = F.split("phrase", " ")
    second = F.xxhash64(part[1])
    turned = F.shiftleft(second, TURN).bitwiseOR(F.shiftrightunsigned(second, 64 - TURN))
    pairs = F.xxhash64(part[0]).bitwiseXOR(turned).bitwiseXOR(salt)
    return Filters(
        _bits(F.xxhash64("phrase").bitwiseXOR(salt), counts.where("size = 1"), bits),
        _bits(pairs, counts.where("size = 2"), bits),
    )


def frequent(
    docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, lowered: float = LOWERED, bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of up to three words with ``least`` or more occurrences, and
    the number of all words of each language as size 0."""
    lang = F.coalesce("lang", F.lit(UNKNOWN_LANGUAGE)).alias("lang")
    texts = only(docs, "doc_id", "lang", "text")
    drawn = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)
    proposed = filters(_pass(drawn.select(lang, "text"), None, None, 2, max(1, int(lowered * least / sample))), bits)
    texts = texts.select(lang, "text")
    counts = _pass(texts, proposed, None, 3, least)
    wider = proposed.joined(filters(counts, bits))
    if any((a != b).any() for a, b in zip(wider, proposed, strict=True)):
        counts = counts.unionAll(_pass(texts, wider, proposed, 3, least))
    return counts


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of each phrase by its lowest-scoring cut."""
    parts = F.split("phrase", " ")
    cuts = (
        counts.where("size > 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .select(
            "lang", "phrase", "size", F.col("f").alias("a"), "k",
            F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("head"),
            F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
        )
    )
    known = counts.where("size between 1 and 2")
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    a, l, r = (F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r"))
    over = F.lit(SCALE).cast("decimal(7,0)") * a * a
    score = F.call_function("div", over, l * r)
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.*").drop("k")


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The ``top`` phrases of each language that no longer phrase covers."""
    counts = frequent(docs, **options)
    found = scored(counts)
    part = F.split("phrase", " ")
    ends = F.array(*[F.array_join(F.slice(part, k, 2), " ") for k in (1, 2)])
    longer = (
        counts.where("size = 3")
        .select("lang", F.explode(ends).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    covered = F.coalesce(100 * F.col("longer") >= COVERED * F.col("a"), F.lit(False))
    kept = found.join(longer, ["lang", "phrase"], "left").where((F.col("size") == 3) | ~covered)
    kept = kept.select("lang", "phrase", "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = ranked(kept, "lang", *order, name="collocations").where(F.col("rank") < top).drop("n")
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").withColumn("rank", F.col("rank") + 1)


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
