"""Language spans of mixed text: script candidates, then Viterbi over per-word scores.

A word is a maximal run of letters. Its script (from ranges of code points) narrows the
languages to those that use the script in the training text. A language's score of a word is
the sum of its log chances of the centred character trigrams. Viterbi then finds the labels
of a text's words with the highest total score less ``PENALTY`` per change of language;
neighbouring words of one language form a span.

The model is learned from documents with a non-null ``lang`` whose ``crc32(doc_id) mod 5`` is
not 0: per language at most about ``PER_LANGUAGE`` documents, picked by a hash of the id. It has
``BUCKETS`` numbers for each language that occurs, whatever the size of the corpus. Prediction
reads nothing but the whole text.

Many texts are decoded in step, one word of each at a time; a long text only adds steps.

Defined cases: a null text, and one without a letter, has no span, language ``und`` and score
0; words in a script that no learned language uses are open to every language; without any
training document everything is ``und``; equal scores go to the language first in
alphabetical order. Extra columns are ignored; repeated documents each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

UNKNOWN = "und"
PENALTY = 12.0
PER_LANGUAGE = 4000
BUCKETS = 1 << 16
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.02
#: Letters scored at once, and characters of texts decoded in step.
SLICE, BATCH = 500_000, 6_000_000
IMPOSSIBLE = -1000.0

# First code points of script ranges. "" is every other range.
SCRIPTS = [
    (0x0000, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, ""), (0x0750, "arabic"), (0x0780, ""),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, ""), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, ""), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x2C60, "latin"), (0x2C80, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"),
    (0x3190, ""), (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"),
    (0xA000, ""), (0xA720, "latin"), (0xA800, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"),
    (0xFB00, ""), (0x20000, "han"), (0x32000, ""),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its lower case, and its script."""
    chars = [chr(i) for i in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
    lower = np.arange(len(chars), dtype=np.uint32)
    for i in np.flatnonzero(letter):
        low = chars[i].lower()
        if len(low) == 1:
            lower[i] = ord(low)
    starts = np.array([s for s, _ in SCRIPTS])
    names = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.int8)
    script = names[np.searchsorted(starts, np.arange(len(chars)), side="right") - 1]
    return letter, lower, script


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters, and the bucket of the trigram around each."""
    letter, lower, _ = _characters()
    is_letter = letter[codes]
    at = np.flatnonzero(is_letter)
    padded = np.full(len(codes) + 2, 32, np.uint32)
    padded[1:-1] = np.where(is_letter, lower[codes], 32)
    mixed = padded[at] * np.uint32(2654435761) ^ padded[at + 1] * np.uint32(2246822519)
    mixed ^= padded[at + 2] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    return at, (mixed >> np.uint32(13)) & np.uint32(BUCKETS - 1)


class Model:
    """Log chances by bucket and language, and which scripts a language uses."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=0) + 0.1 * BUCKETS
        self.logs = np.log((counts + 0.1) / total).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=0))
        self.uses = share >= SCRIPT_SHARE
        self.uses[~self.uses.any(axis=1)] = True

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and its score by language."""
        codes = _codes(text)
        letter, _, script = _characters()
        flags = np.zeros(len(codes) + 2, np.int8)
        flags[1:-1] = letter[codes]
        edges = np.diff(flags)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        scores = np.zeros((len(starts), len(self.languages)), np.float32)
        done = 0
        while done < len(starts):
            # Whole words up to a bounded number of characters, one at least.
            stop = max(done + 1, int(np.searchsorted(ends, starts[done] + SLICE, side="right")))
            part = codes[starts[done] : ends[stop - 1]]
            at, buckets = _grams(part)
            first = np.searchsorted(at, starts[done:stop] - starts[done])
            scores[done:stop] = np.add.reduceat(self.logs[buckets], first, axis=0)
            done = stop
        scores[~self.uses[script[codes[starts]]]] += IMPOSSIBLE
        return starts, ends, scores

    def decode(self, scored: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of each word of each text, found for all texts in step."""
        lengths = np.array([len(s) for s in scored])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        every = np.concatenate([scored[i] for i in order]) if len(order) else np.zeros((0, 1))
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        stay = np.ones((len(every), len(self.languages)), bool)
        source = np.zeros(len(every), np.int16)
        last = np.zeros((len(lengths), len(self.languages)))
        for t in range(steps):
            k = active[t]
            rows = offsets[:k] + t
            if t:
                best = last[:k].argmax(axis=1)
                change = last[np.arange(k), best] - PENALTY
                stay[rows] = last[:k] >= change[:, None]
                source[rows] = best
                np.maximum(last[:k], change[:, None], out=last[:k])
            last[:k] += every[rows]
        label = np.zeros(len(every), np.int16)
        now = last.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            rows = offsets[:k] + t
            label[rows] = now[:k]
            kept = stay[rows, now[:k]]
            now[:k] = np.where(kept, now[:k], source[rows])
        out: list[np.ndarray] = [label[:0]] * len(scored)
        for j, i in enumerate(order):
            out[i] = label[offsets[j] : offsets[j + 1]]
        return out

    def label(self, texts: list[str]) -> Iterator[tuple[list[tuple[int, int, str]], str, float]]:
        """Per text its spans (start, end, language), its main language and that one's share."""
        found = [self.words(t) for t in texts]
        for (starts, ends, _), labels in zip(found, self.decode([s for *_, s in found]), strict=True):
            if not len(labels):
                yield [], UNKNOWN, 0.0
                continue
            letters = np.bincount(labels, ends - starts, len(self.languages))
            main = int(letters.argmax())
            cut = np.flatnonzero(np.diff(labels)) + 1
            begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(labels)]])
            spans = [
                (int(starts[a]), int(ends[b - 1]), self.languages[labels[a]])
                for a, b in zip(begin, stop, strict=True)
            ]
            yield spans, self.languages[main], float(letters[main] / letters.sum())


def train(docs: DataFrame) -> Model | None:
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)
    )
    known = rows.groupBy("lang").count().collect()  # a row for each language
    if not known:
        return None
    languages = sorted(r["lang"] for r in known)
    share = {r["lang"]: min(1.0, PER_LANGUAGE / r["count"]) for r in known}
    level = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < level * 1_000_000)

    def count(batches):
        n = np.zeros((BUCKETS, len(languages)), np.int64)
        scripts = np.zeros((len(SCRIPT_NAMES), len(languages)), np.int64)
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                j = languages.index(lang)
                codes = _codes(text)
                at, buckets = _grams(codes)
                n[:, j] += np.bincount(buckets, minlength=BUCKETS)
                scripts[:, j] += np.bincount(_characters()[2][codes[at]], minlength=len(SCRIPT_NAMES))
        for kind, table in ((0, n), (1, scripts)):
            place, j = np.nonzero(table)
            yield pd.DataFrame({"kind": kind, "place": place, "j": j, "n": table[place, j]})

    counted = (
        sample.select("text", "lang")
        .mapInPandas(count, "kind long, place long, j long, n long")
        .groupBy("kind", "place", "j")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    n = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for kind, table in ((0, n), (1, scripts)):
        part = counted[counted["kind"] == kind]
        table[part["place"], part["j"]] = part["n"]
    return Model(languages, n, scripts)


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans``, an array of (start, end, lang)."""
    kinds = {"lang_pred": StringType(), "score": DoubleType()}
    kinds |= {"start": ArrayType(LongType()), "end": ArrayType(LongType()), "lang": ArrayType(StringType())}

    @F.pandas_udf(StructType([StructField(k, v) for k, v in kinds.items()]))
    def run(column: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in column]
        found: list = []
        while len(found) < len(texts):
            stop, size = len(found) + 1, len(texts[len(found)])
            while stop < len(texts) and size + len(texts[stop]) <= BATCH:
                size += len(texts[stop])
                stop += 1
            part = texts[len(found) : stop]
            found += model.label(part) if model else [([], UNKNOWN, 0.0)] * len(part)
        return pd.DataFrame(
            {"lang_pred": [f[1] for f in found], "score": [f[2] for f in found]}
            | {k: [[x[i] for x in f[0]] for f in found] for i, k in enumerate(("start", "end", "lang"))}
        )

    spans = F.arrays_zip("__found.start", "__found.end", "__found.lang")
    return (
        docs.withColumn("__found", run("text"))
        .withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")})
        .withColumn("spans", spans)
        .drop("__found")
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its fold, main language and that one's share of the letters."""
    return label(docs.select("doc_id", "text"), train(docs)).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score"
    )
