"""Benchmark decontamination: a broadcast set of test n-grams scanned over training text.

Words are runs of letters, digits and non-ASCII characters of the text with A-Z lowered. A
window is ``n`` consecutive words of a benchmark item, or the whole item if it is shorter.

The scan does not look up every window of a document. A window of m words that occurs at
word s holds exactly one of the document's chunks of g = ceil(m/2) words that start at
multiples of m - g + 1. So a document looks up one chunk per m - g + 1 words in the set of
all g-word runs of the windows; around a chunk that is found, the full windows are compared
word for word. Nothing is missed, and the text itself is never shuffled.

The sets are broadcast in blocks of at most ``block`` windows, so a broadcast has a fixed
bound; a larger benchmark takes more passes.

Defined cases: a null or wordless text has no words and no hits; a null item text has no
window; items with equal ids count once; repeated documents each get their row; documents
with equal ids and different texts are told apart by a hash of the text. Extra columns are
ignored by ``report`` and kept by the two removers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import bound, folded, lower_ascii, only, unfolded

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Windows of one broadcast; about 100 bytes each.
BLOCK = 500_000
#: A document is contaminated if at least one word in this many is hit.
RATIO = 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(window, length, items): each distinct window with the ids of its items as text."""
    split = only(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    return (
        split.where(F.size("w") > 0)
        .withColumn("s", F.explode(starts))
        .select(
            F.col("item_id").cast("string").alias("item"),
            F.slice("w", F.col("s"), F.lit(n)).alias("window"),
        )
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("length", F.size("window"))
    )


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("text_key", F.xxhash64("text"))


def _scan(docs: DataFrame, block: DataFrame, m: int) -> DataFrame:
    """(doc_id, text_key, start, length, items) for every place of the block's windows of m words."""
    g = (m + 1) // 2
    stride = m - g + 1

    def gram(array: str, at: Column) -> Column:
        # Single elements, because slice() copies the whole array inside a lambda.
        return F.xxhash64(*[F.get(array, at + k) for k in range(g)])

    grams = (
        block.select(F.explode(F.sequence(F.lit(0), F.lit(stride - 1))).alias("s"), "window")
        .select(gram("window", F.col("s")).alias("gram"))
        .distinct()
    )
    chunks = F.transform(F.sequence(F.lit(0), F.col("n") - g, F.lit(stride)), lambda i: gram("w", i))
    first = F.greatest(F.col("c") * stride - (stride - 1), F.lit(0))
    last = F.least(F.col("c") * stride, F.col("n") - m)
    # The outer form keeps Spark from testing the size of the chunks ahead of the projection,
    # which would split the text once more for every chunk.
    near = (
        docs.withColumn("chunks", F.when(F.col("n") >= m, chunks))
        .select("doc_id", "text_key", "w", "n", F.posexplode_outer("chunks").alias("c", "gram"))
        .join(F.broadcast(grams), "gram")
        .where(last >= first)
        .select(
            "doc_id",
            "text_key",
            first.alias("first"),
            last.alias("last"),
            F.slice("w", first + 1, last - first + m).alias("near"),
        )
    )
    return (
        near.withColumn("start", F.explode_outer(F.sequence("first", "last")))
        .withColumn("window", F.slice("near", F.col("start") - F.col("first") + 1, F.lit(m)))
        .join(F.broadcast(block.select("window", "items")), "window")
        .select("doc_id", "text_key", "start", F.lit(m).alias("length"), "items")
    )


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per hit document: (doc_id, text_key, hit, items).

    ``hit`` holds the hit word positions, from 0; ``items`` the ids of the items with
    occurring windows, sorted as strings.
    """
    found = windows(benchmark, n)
    lengths = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    keyed = _key(only(docs, "doc_id", "text")).select(
        "doc_id", "text_key", words(F.col("text")).alias("w")
    ).withColumn("n", F.size("w"))
    parts = []
    for m, count in sorted(lengths.items()):
        blocks = -(-count // block)
        for b in range(blocks):
            part = found.where(
                (F.col("length") == m) & (F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
            )
            parts.append(_scan(keyed, part, m))
    if not parts:
        empty = keyed.select("doc_id", "text_key").limit(0)
        return empty.select(
            "*", F.expr("array(0)").alias("hit"), F.expr("array('')").alias("items")
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    spans = F.transform(
        "starts", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)
    )
    return (
        rows.groupBy("doc_id", "text_key")
        .agg(
            F.collect_set(F.struct("start", "length")).alias("starts"),
            F.collect_set("items").alias("items"),
        )
        .select(
            "doc_id",
            "text_key",
            F.array_distinct(F.flatten(spans)).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )


def _with_hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (which has text_key) with hit and items of ``found``; null where there are none."""
    right = found.select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"),
        F.col("hit").alias("__hit"), F.col("items").alias("__items"),
    )
    on = docs["doc_id"].eqNullSafe(right["__id"]) & (docs["text_key"] == right["__key"])
    return docs.join(right, on, "left").drop("__id", "__key")


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document: its words, hit words, items and the verdict."""
    base = _key(only(docs, "doc_id", "text")).select(
        "doc_id", "text_key", F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    n_hit = F.coalesce(F.size("__hit"), F.lit(0)).cast("long")
    items = F.coalesce("__items", F.array().cast("array<string>"))
    return _with_hits(base, hits(docs, benchmark, n)).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        _contaminated(n_hit, F.col("n_words")).alias("contaminated"),
        items.alias("items"),
    )


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (RATIO * n_hit >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    joined = _with_hits(_key(folded(docs, "doc_id", "text")), hits(docs, benchmark, n))
    n_hit = F.coalesce(F.size("__hit"), F.lit(0))
    bad = F.when(n_hit > 0, _contaminated(n_hit, F.size(words(F.col("text"))))).otherwise(False)
    return unfolded(joined.where(~bad), docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` with every hit word, and the separators after it, cut out of ``text``."""
    joined = _with_hits(_key(folded(docs, "doc_id", "text")), hits(docs, benchmark, n))
    lead = F.regexp_extract("text", f"^({SEPARATORS_ANY_CASE})", 1)
    after_word = f"(?<=[^{SEPARATORS_ANY_CASE[1:-2]}])({SEPARATORS_ANY_CASE})"
    # The text is split once and bound; a column would be split anew for every kept word.
    parts = F.struct(
        F.array_remove(F.split("text", SEPARATORS_ANY_CASE, -1), "").alias("words"),
        F.regexp_extract_all("text", F.lit(after_word), F.lit(1)).alias("gaps"),
    )

    def joined_again(p: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(p["words"]) - 1)
        return F.array_join(
            F.transform(
                F.array_except(every, F.col("__hit")),
                lambda i: F.concat(F.get(p["words"], i), F.coalesce(F.get(p["gaps"], i), F.lit(""))),
            ),
            "",
        )

    cut = F.concat(lead, bound(parts, joined_again))
    text = F.when(F.col("__hit").isNull(), F.col("text")).otherwise(cut)
    return unfolded(joined.withColumn("text", text), docs.columns)
