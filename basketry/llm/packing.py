"""Best-fit packing of tokenised documents by linear grouping.

Documents become token ids and an end id; only longer ones are cut into pieces. All packing
works on the number of pieces of each length (at most ``capacity`` numbers), so the plan has
the same size whatever the number of documents:

1. Lengths over ``capacity / SMALL`` are large. In falling order they are dealt into
   ``GROUPS`` groups of equal cardinality, and each is rounded up to its group's longest.
2. For these few sizes the best mix of configurations (ways to fill a sequence) is a linear
   program, solved by column generation; each is used a whole number of times, rounded down.
3. Actual lengths are put in the places of the rounded ones, each the longest left that its place
   and the room saved by the places before it allow.
4. What is left over of the large, and then the small, goes best-fit into the room that remains,
   and into new sequences where there is none.

Where small pieces are too few to fill it, that room is lost. So step 4 is done with all sequences
of step 3, with only those that are nearly full, and with none; the plan with the fewest
sequences counts, on a tie the one that keeps the most. The result thus never needs more sequences
than best-fit alone.

Pieces then take the places of their length by rank. Ranks are counted per (length, bucket of
the id), so a length that a third of all pieces share is spread over many tasks.

Ids are those of the ``tokenizers`` library for the vocabulary file, special tokens in the text
included. Long texts are cut where a word certainly ends (a letter, then a space or a mark), which
no token crosses, so an encoder never holds more than about ``CUT`` characters. Parts of
common scripts without special tokens are encoded by ``tiktoken`` with the same vocabulary, which
is several times faster and gives the same ids there (a test compares them); the others by
``tokenizers``.

Defined cases: a null or empty text is the end id alone; repeated documents are packed each;
an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from basketry.llm.shared import stored

CAPACITY, END = 2048, 0
#: Pieces over ``capacity / SMALL`` are large.
SMALL, GROUPS = 3, 64
#: A sequence is nearly full if at most this part of it is free.
NEARLY = 32
VOCABULARY = "byte_bpe_50k"
#: Pieces of one length that one task ranks, at most about.
RANKED = 1_000_000
#: Characters after which a long text is cut at the next place where a word ends.
CUT = 1 << 16
# A letter of a script without joining marks before a space or a mark that is no apostrophe.
_WORD_END = re.compile("[A-Za-zÀ-ÖØ-öø-ɏА-яぁ-ゖァ-ヺ一-龥가-힣](?=[ \n.,;:!?()、。，！？；：])")
#: Latin, Greek and Cyrillic letters and common punctuation; controls but tab and newline are left out.
_COMMON = re.compile("[^\t\n\x20-\x7e\xa1-ɏͰ-ͳΆ-ΡΣ-ϿЀ-ҁ‐-‧€]")


class Encoder:
    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.special = "<|"  # every special token of the vocabulary starts so
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        self.fast = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        found = []
        for part in parts_of(text):
            common = not _COMMON.search(part) and self.special not in part
            found.append(
                self.fast.encode_ordinary(part) if common else self.slow.encode(part, add_special_tokens=False).ids
            )
        return np.concatenate([np.array(x, "<u4") for x in found]) if found else np.zeros(0, "<u4")


def parts_of(text: str, most: int = CUT) -> Iterator[str]:
    """``text`` in parts that no token crosses, each cut at the first word end after ``most`` characters."""
    at = 0
    while at < len(text):
        end = _WORD_END.search(text, at + most) if len(text) > at + most else None
        yield text[at : end.end()] if end else text[at:]
        at = end.end() if end else len(text)


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    longs = ArrayType(LongType())
    fields = {"start": longs, "length": longs, "ids_crc32": longs}
    if with_ids:
        fields["ids"] = ArrayType(longs)

    @F.pandas_udf(StructType([StructField(k, v) for k, v in fields.items()]))
    def run(texts: pd.Series) -> pd.DataFrame:
        encode = encoder(vocabulary).ids
        rows = []
        for text in texts:
            ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
            parts = [(s, n, ids[s : s + n]) for s, n in cut(len(ids), capacity)]
            row = [[s for s, *_ in parts], [n for _, n, _ in parts], [zlib.crc32(x.tobytes()) for *_, x in parts]]
            rows.append(row + [[x.tolist() for *_, x in parts]] * with_ids)
        return pd.DataFrame(rows, columns=list(fields))

    zipped = F.arrays_zip(*[f"p.{k}" for k in fields])
    return (
        docs.select("doc_id", run("text").alias("p"))
        .select("doc_id", F.posexplode(zipped).alias("piece", "x"))
        .select("doc_id", "piece", *[F.col("x")[k].alias(k) for k in fields])
    )


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for i in np.argsort(-values / sizes):
        s, v = int(sizes[i]), values[i]
        if v <= 0:
            continue
        # Blocks of s places need only the block before.
        for at in range(s, capacity + 1, s):
            end = min(at + s, capacity + 1)
            better = best[at - s : end - s] + v > best[at:end] + 1e-12
            best[at:end] = np.where(better, best[at - s : end - s] + v, best[at:end])
            took[at:end] = np.where(better, i, took[at:end])
    pattern = np.zeros(len(sizes), int)
    at = capacity
    while at > 0 and took[at] >= 0:
        pattern[took[at]] += 1
        at -= int(sizes[took[at]])
    return float(pattern @ values), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, rounded down from the best fractional mix."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(30 * k):
        value, pattern = _best_pattern(sizes, np.linalg.solve(basis.T, np.ones(k)), capacity)
        if value <= 1 + 1e-7:
            break
        now = np.linalg.solve(basis, demand)
        change = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.full(k, np.inf)
        np.divide(np.maximum(now, 0), change, out=ratio, where=change > 1e-9)
        basis[:, int(ratio.argmin())] = pattern
    times = np.floor(np.linalg.solve(basis, demand) + 1e-9).astype(np.int64)
    return [(basis[:, i].round().astype(int), int(t)) for i, t in enumerate(times) if t > 0]


def groups(counts: np.ndarray, smallest: int, n: int) -> list[list[tuple[int, int]]]:
    """Large lengths in falling order, dealt into n groups of equal cardinality: (length, number)."""
    total = int(counts[smallest:].sum())
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in range(len(counts) - 1, smallest - 1, -1):
        left = int(counts[length])
        while left:
            if not room:
                room = -(-total // n)
                out.append([])
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


Bins = list[tuple[int, list[int]]]


def _configured(counts: np.ndarray, capacity: int, n_groups: int) -> Bins:
    """Sequences that hold actual lengths in the places of the configurations' rounded ones.

    Each place takes the longest piece left that its rounded length allows, and whatever room
    shorter pieces before it have left.
    """
    dealt = groups(counts, capacity // SMALL + 1, n_groups)
    if not dealt:
        return []
    demand: dict[int, int] = {}
    for group in dealt:
        demand[group[0][0]] = demand.get(group[0][0], 0) + sum(n for _, n in group)
    sizes = np.array(sorted(demand, reverse=True))
    left = {length: int(n) for length, n in enumerate(counts) if n and length > capacity // SMALL}
    lengths = sorted(left)
    made: Bins = []
    for pattern, times in configurations(sizes, np.array([demand[s] for s in sizes], float), capacity):
        places = [int(sizes[j]) for j, n in enumerate(pattern) for _ in range(n)]
        while times:
            taken: list[int] = []
            spare = capacity - sum(places)
            for place in places:
                at = bisect_right(lengths, place + spare) - 1
                while at >= 0 and left[lengths[at]] <= taken.count(lengths[at]):
                    at -= 1
                if at < 0:
                    break
                taken.append(lengths[at])
                spare += place - taken[-1]
            if len(taken) < len(places):
                break
            # As many sequences as hold the same actual lengths.
            same = min(times, *[left[x] // taken.count(x) for x in taken])
            for x in taken:
                left[x] -= same
                if not left[x]:
                    lengths.remove(x)
            made.append((same, taken))
            times -= same
    return made


def _filled(kept: Bins, counts: np.ndarray, capacity: int) -> Bins:
    """The kept sequences, and everything else best-fit."""
    rest = counts.copy()
    for number, lengths in kept:
        np.subtract.at(rest, lengths, number)
    return _best_fit(kept, rest, capacity)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Bins:
    """Sequences as (number, lengths in them), using every piece of ``counts[length]`` once."""
    counts = counts.astype(np.int64).copy()
    done: Bins = [(int(counts[capacity]), [capacity])] if counts[capacity] else []
    counts[capacity] = 0
    made = _configured(counts, capacity, GROUPS)
    nearly = [b for b in made if len(b[1]) == 1 or capacity - sum(b[1]) <= capacity // NEARLY]
    plans = [(_filled(kept, counts, capacity), sum(n * len(x) for n, x in kept)) for kept in (made, nearly, [])]
    return done + min(plans, key=lambda p: (sum(n for n, _ in p[0]), -p[1]))[0]


def _best_fit(bins: Bins, counts: np.ndarray, capacity: int) -> Bins:
    """The rest, longest first, each into the fullest sequence with room for it."""
    by_room: list[Bins] = [[] for _ in range(capacity + 1)]
    for number, lengths in bins:
        by_room[capacity - sum(lengths)].append((number, lengths))
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        room = length
        while left:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                by_room[capacity].append((-(-left // (capacity // length)), []))
                room = capacity
            number, lengths = by_room[room].pop()
            fit = min(room // length, left)
            full = min(number, left // fit)
            by_room[room - fit * length].append((full, lengths + [length] * fit))
            if number > full:
                by_room[room].append((number - full, lengths))
            left -= full * fit
            room = length
    return [b for part in by_room for b in part if b[1]]


def places(bins: Bins) -> dict[str, np.ndarray]:
    """Runs of ranks of a length and where they go, ordered by length and rank."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for number, lengths in bins:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + number
            offset += length
        sequence += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (from ``pieces``) with sequence_id and offset."""
    parts = stored(parts, "pieces")
    found = parts.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r["length"]] = r["count"]
    table = places(plan(counts, capacity))
    # One ordered key for (length, rank).
    keys = (table["length"] << 44) + table["rank"]

    @F.pandas_udf(StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        sequence = table["sequence"][at] + rank.to_numpy() - table["rank"][at]
        return pd.DataFrame({"sequence_id": sequence, "offset": table["offset"][at]})

    buckets = 16 + int(counts.max()) // RANKED
    marked = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        marked.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    return (
        marked.withColumn("rank", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "bucket"])
        .withColumn("at", place("length", F.col("base") + F.col("rank")))
        .select(*[F.col(c) for c in parts.columns], "at.sequence_id", "at.offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence; ``packed`` needs the column ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return rows.select("sequence_id", F.flatten("x.ids").alias("ids"))
