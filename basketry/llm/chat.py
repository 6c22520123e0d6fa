"""Chat formatting of maximal conversations: logged snapshots of a longer one are collapsed.

A log often holds a conversation several times, each time with more turns. Every turn gets a
rolling hash of all turns up to it: sums of 64-bit turn hashes that depend on the place of the
turn, so one running window gives the hashes of all prefixes. A conversation is dropped if its
whole hash is the hash of a proper prefix of another one (an anti-join on length and hash); of
conversations with equal turns that with the smallest id stays. The rest is rendered.

Only hashes are compared, never pairs of conversations; prefixes and whole conversations are
reduced to distinct ones before they meet, so a first turn or a conversation that a third of
the log shares arrives as one row per task.

Turns are in the order of turn, role and text, nulls first. Defined cases: exact repeats of a
turn within a conversation count once; null roles and texts equal each other only, and are
rendered as empty; rows with a null conv_id are one conversation with a null id; a marker's
opening ``<|`` within a text is rendered as ``< |``. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.shared import stored

COLUMNS = ("conv_id", "turn", "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, h1, h2, h3, h4, last): the hash of the first k turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    row = F.struct("turn", "role", "text")
    # Two hashes, each in halves, so that sums of any number of turns stay exact.
    hashes = {"x": F.xxhash64("k", *_told_apart()), "y": F.xxhash64(*_told_apart(), F.col("k") + 7)}
    placed = (
        turns.select(*COLUMNS)
        .withColumn("again", F.coalesce(row.eqNullSafe(F.lag(row).over(w)), F.lit(False)))
        .where(~F.col("again"))
        .withColumn("k", F.row_number().over(w))
        .withColumns(hashes)
    )
    halves = [f(F.col(c)) for c in ("x", "y") for f in (_low, _high)]
    return placed.select(
        "conv_id",
        "k",
        *[F.sum(h).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"h{i}") for i, h in enumerate(halves, 1)],
        F.lead("k").over(w).isNull().alias("last"),
    )


def _told_apart() -> list[Column]:
    # A null adds nothing to a hash, so it is marked.
    return [c for name in ("role", "text") for c in (F.col(name), F.col(name).isNull())]


def _low(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << 32) - 1))


def _high(h: Column) -> Column:
    return F.shiftrightunsigned(h, 32)


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one contains as its beginning."""
    found = stored(prefixes(turns), "prefixes")
    key = ["k", "h1", "h2", "h3", "h4"]
    whole = found.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    proper = found.where("not last").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"))


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text) of every maximal conversation."""
    kept = stored(maximal(turns), "maximal").withColumnRenamed("conv_id", "__id")
    row = F.struct("turn", "role", "text")
    parts = F.transform(
        F.array_distinct(F.array_sort(F.collect_list(row))),
        lambda t: F.concat(
            F.lit("<|"),
            F.coalesce(t["role"], F.lit("")),
            F.lit("|>\n"),
            F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|"), F.lit("< |")),
            F.lit("<|end|>\n"),
        ),
    )
    # Only turns that are rendered are gathered.
    left = turns.select(*COLUMNS)
    left = left.join(kept, left["conv_id"].eqNullSafe(kept["__id"]))
    return left.groupBy("conv_id", "n_turns").agg(F.array_join(parts, "").alias("text"))
