"""A Merkle manifest of a dataset: node digests, proofs and their verification.

Every row is a leaf. Leaves of a source ascend by id and form a tree with ``FAN`` children a
node; the sources' roots form one more tree of the same kind, whose top is the root.

Nodes carry nested-interval labels: a node covers the leaf ranks ``lo`` to ``hi`` of its tree, so
one is an ancestor of another exactly if its interval contains the other's, and no links are
stored. At level k all intervals of a tree start at multiples of ``FAN ** k``; that quotient is
the bucket by which a containment join finds the ancestor, at most ``FAN`` rows to a bucket. The
siblings of a node are the children of its parent whose intervals lie left or right of its own:
the difference of the parent's interval and the node's.

Ranks need no task that sees a whole source: rows are sorted over ranges of (source, id, leaf) and
stored with their place; a place becomes a rank by the number of rows of the source in earlier
ranges, which is one number for each source and range. Trees are built upwards, ``FAN``
digests to a group; paths are attached downwards, level by level, so no join key has more than
``FAN`` rows, whatever part of all rows one source holds. A path is stored once per lowest
inner node and shared by its leaves. Every level is written to the shared folder, so a
lost executor costs one level.

All expressions are Spark's own.

Defined cases: a null field counts as ``-``, a null id or source comes first; repeated rows and
repeated ids are leaves each, equal ids by leaf digest; a row alone in its source is that
source's root; an empty table has no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import lower_ascii, only, ranked, same, stored

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 5
_PATH = "array<struct<before:string,after:string>>"


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(**fields: Column) -> Column:
    return F.sha2(F.concat(*[_encoded(x) for x in fields.values()]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): ``tampered`` is the digest after tampering, null where none happens."""
    fields = {name: F.col(f"`{name}`") for name in FIELDS}
    changed = fields | {"text": lower_ascii(fields["text"])}
    hit = F.crc32(fields["doc_id"].cast("string")) % TAMPERED_EVERY == 0
    return docs.select(
        "doc_id", "source", digest_of(**fields).alias("leaf"), F.when(hit, digest_of(**changed)).alias("tampered")
    )


def levels(leaf_rows: DataFrame) -> list[DataFrame]:
    """The leaves with ``lo`` and ``hi``, then each level of inner nodes with their ``children``.

    A tree of n leaves has nodes of width w (leaves covered, at most) as long as n > w / FAN.
    """
    out = [leaf_rows.withColumnsRenamed({"rank": "lo"}).withColumn("hi", F.col("lo"))]
    largest = leaf_rows.agg(F.max("n")).first()[0] or 0
    width = 1
    while width < largest:
        nodes = (
            out[-1]
            .where(F.col("n") > width)
            .groupBy("tree", F.floor(F.col("lo") / F.lit(width * FAN)).alias("bucket"))
            .agg(
                F.first("n").alias("n"),
                F.min("lo").alias("lo"),
                F.max("hi").alias("hi"),
                F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"),
            )
            .withColumn("digest", F.sha2(F.array_join("children.digest", ""), 256))
        )
        out.append(stored(nodes.select("tree", "n", "lo", "hi", "digest", "children"), "level"))
        width *= FAN
    return out


def tops(of: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the last node left of each tree."""
    found = None
    for k, level in enumerate(of):
        last = level.where((F.col("n") <= FAN**k)).select("tree", "digest")
        found = last if found is None else found.unionAll(last)
    return found


def _beside(condition) -> Column:
    return F.array_join(F.transform(F.filter("_children", condition), lambda c: c["digest"]), "")


def with_paths(of: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path``, the siblings on the way up, and the columns of ``above``.

    ``above`` has a row for each tree: its ``path`` is where that of the tree's top goes on.
    """
    carried = [F.col(c) for c in above.columns if c not in ("tree", "path")]
    over = above.withColumnsRenamed({"tree": "_tree", "path": "_path"})
    found = None
    for k in range(len(of) - 1, -1, -1):
        own = [F.col(c) for c in of[k].columns if c not in ("n", "children")]
        if k:
            own.append(F.col("children"))
        top = of[k].where(F.col("n") <= FAN**k).join(over, same("tree", "_tree"))
        level = top.select(*own, F.col("_path").alias("path"), *carried)
        if found is not None:
            ancestor = found.select(
                F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                F.col("children").alias("_children"), F.col("path").alias("_path"), *carried,
            )
            width = F.lit(FAN ** (k + 1))
            bucket = F.floor(F.col("lo") / width) == F.floor(F.col("_lo") / width)
            inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            below = of[k].where(F.col("n") > FAN**k).join(ancestor, same("tree", "_tree") & bucket & inside)
            step = F.struct(
                _beside(lambda c: c["hi"] < F.col("lo")).alias("before"),
                _beside(lambda c: c["lo"] > F.col("hi")).alias("after"),
            )
            level = level.unionAll(below.select(*own, F.concat(F.array(step), "_path").alias("path"), *carried))
        found = level
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each leaf: its source and rank (``lo``), digests, ``path``, ``subroot`` and ``root``."""
    made = stored(leaves(only(docs, *FIELDS)), "leaves")
    placed = ranked(made, "source", F.col("doc_id").asc_nulls_first(), F.col("leaf"))
    of_sources = levels(placed.withColumnsRenamed({"source": "tree", "leaf": "digest"}))
    subroots = stored(tops(of_sources).withColumnsRenamed({"tree": "source", "digest": "subroot"}), "subroots")

    # The sources' roots are the leaves of one more tree.
    over = ranked(subroots.withColumn("all", F.lit(0)), "all", F.col("source").asc_nulls_first(), name="sources")
    of_all = levels(over.withColumnsRenamed({"all": "tree", "subroot": "digest"}))
    end = tops(of_all).select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    above = with_paths(of_all, end).select(
        F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    found = with_paths(of_sources, stored(above, "above"))
    return found.withColumnsRenamed({"tree": "source", "digest": "leaf"})


def folded(leaf: Column) -> Column:
    """The root that a leaf gives with the siblings on its ``path``."""
    return F.aggregate("path", leaf, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]), 256))


def report(docs: DataFrame) -> DataFrame:
    """Per document: its digests, its proof, and whether what may be tampered still gives the root."""
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    found = manifest(docs).withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
