"""Personal data: contract patterns, and further spans by weak supervision.

Base spans of the kinds email, ip, card and phone are exact: leftmost non-overlapping matches
of one pattern per kind, kept if they pass the kind's test.

Further candidates (keys and passwords, written-out addresses, unprefixed phone and social
security numbers) are voted on by four labelers: the strict shape of the candidate, a
gazetteer of words shortly before it, the characters around it, and its mix of characters.
Every vote is 1, -1 or 0 (abstains). Expectation-maximisation over the counts of each vote
pattern estimates how reliable each labeler is and how likely each pattern is personal data;
a logistic classifier is then trained on those soft labels and its own features, and decides
about every candidate. A candidate that touches a base span is left out.

Only counts per vote and feature pattern (at most ``3**4 * 24``) reach the driver, whatever
the size of the corpus. Everything else is SQL functions in one pass over the documents.

Defined cases: a null text is an empty one and has no spans; repeated rows each get their
result; without candidates nothing is added. Extra columns are ignored by ``report`` and
kept by ``masked``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import folded, unfolded

# A run of name characters or digits is entered at its start only, or where the last match
# ended: elsewhere in the run the same match would fail. This keeps long runs linear. Labels and
# their repetition are possessive: what ends a label can only be a dot, so giving back never helps,
# and a greedy group would take a stack frame for each label.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text needs for a match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

MORE = {
    "secret": r"(?<![A-Za-z0-9_/+.@-])(?=[A-Za-z_/+-]*[0-9])(?=[0-9_/+-]*[A-Za-z])[A-Za-z0-9_/+-]{16,}",
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.\x20-])\x20?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
STRICT = {
    "secret": r"^(?:AKIA[A-Z0-9]{16}|[0-9a-f]{16,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,})$",
    "email": r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
    "phone": r"\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
# Words that speak for and against personal data shortly before a candidate.
FOR = "password|passwd|pwd|token|secret|api|apikey|key|credential|login|phone|tel|call|fax|mobile|mail|email|contact|ssn|social"
AGAINST = "version|license|isbn|issn|section|page|chapter|figure|table|release|http|https|www|href|src|commit|build"
LABELERS = ("shape", "gazetteer", "context", "mix")
CONTEXT = 24


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    turned = F.split(F.reverse(digits), "")

    def step(d: Column, i: Column) -> Column:
        n = d.cast("int")
        doubled = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, doubled).otherwise(n)

    summed = F.aggregate(F.transform(F.filter(turned, lambda d: d != ""), step), F.lit(0), lambda a, x: a + x)
    return summed % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{small}(?:\.{small}){{3}}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _found(
    text: Column, pattern: str, kind: str, keep: Callable[[Column], Column], context: bool = False
) -> Column:
    """Array of (kind, start, end[, match, before, after]) of the matches that ``keep`` passes.

    Splitting at the pattern gives the parts between matches, so their lengths give places in
    code points.
    """
    parts = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        parts.alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")
    )
    item = "struct<kind:string,start:int,end:int"
    item += ",match:string,before:string,after:string>" if context else ">"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        fields = [F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")]
        if context:
            fields += [x["m"].alias("match"), F.right(x["p"], F.lit(CONTEXT)).alias("before")]
            fields += [F.lit("").alias("after")]
        take = x["m"].isNotNull() & keep(x["m"])
        new = F.when(take, F.concat(acc["out"], F.array(F.struct(*fields)))).otherwise(acc["out"])
        return F.struct(end.alias("at"), new.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("out"))
    return F.aggregate(zipped, start, add, lambda acc: acc["out"])


def _base(text: Column) -> Column:
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return F.concat(
        *[
            F.when(
                text.rlike(NEEDS[kind]), _found(text, pattern, kind, lambda m, k=kind: _valid(k, m))
            ).otherwise(none)
            for kind, pattern in BASE.items()
        ]
    )


def _candidates(text: Column) -> Column:
    """Array of the further candidates with their surroundings."""
    none = F.array().cast(
        "array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>"
    )
    return F.concat(
        *[
            F.when(
                text.rlike(pattern), _found(text, pattern, kind, lambda m: F.lit(True), context=True)
            ).otherwise(none)
            for kind, pattern in MORE.items()
        ]
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(c: Column) -> dict[str, Column]:
    match, before = c["match"], c["before"]
    share = F.length(_digits(match)) / F.length(match)
    strict = F.lit(False)
    for kind, pattern in STRICT.items():
        strict = strict | ((c["kind"] == kind) & match.rlike(pattern))
    return {
        "shape": _vote(strict, ~strict),
        "gazetteer": _vote(
            before.rlike(rf"(?i)\b(?:{FOR})\b"), before.rlike(rf"(?i)\b(?:{AGAINST})\b")
        ),
        "context": _vote(before.rlike(r"[=:][\x20\"']*$"), before.rlike(r"[/\\#]$")),
        "mix": _vote(share >= 0.25, share < 0.1),
    }


def _features(c: Column) -> dict[str, Column]:
    """The classifier's own view of a candidate: small integers, so patterns can be counted."""
    match = c["match"]
    return {
        "secret": F.when(c["kind"] == "secret", 1).otherwise(0),
        "long": F.when(F.length(match) >= 20, 1).otherwise(0),
        "one_case": F.when(match.rlike("^(?:[^a-z]*|[^A-Z]*)$"), 1).otherwise(0),
        "joined": F.when(match.rlike("[_/+-]"), 1).otherwise(0),
    }


def expectation_maximisation(
    counts: dict[tuple[int, ...], int], rounds: int = 50
) -> tuple[dict[tuple[int, ...], float], list[dict[int, dict[int, float]]], float]:
    """Chance of class 1 per vote pattern, each labeler's vote chances per class, and the prior."""
    if not counts:
        return {}, [], 0.0
    n = len(next(iter(counts)))
    chance = {p: 0.5 + 0.4 * max(-1, min(1, sum(p))) for p in counts}
    total = sum(counts.values())
    table: list[dict[int, dict[int, float]]] = []
    prior = 0.5
    for _ in range(rounds):
        weight = {
            1: sum(c * chance[p] for p, c in counts.items()),
            0: sum(c * (1 - chance[p]) for p, c in counts.items()),
        }
        prior = (weight[1] + 1) / (total + 2)
        table = []
        for j in range(n):
            of: dict[int, dict[int, float]] = {}
            for y in (0, 1):
                votes = {
                    v: sum(
                        c * (chance[p] if y else 1 - chance[p]) for p, c in counts.items() if p[j] == v
                    )
                    for v in (-1, 0, 1)
                }
                # A weak prior that a labeler is right more often than wrong keeps the classes' sense.
                of[y] = {v: (votes[v] + (2 if v == 2 * y - 1 else 1)) / (weight[y] + 4) for v in votes}
            table.append(of)
        for p in counts:
            yes = math.log(prior) + sum(math.log(table[j][1][p[j]]) for j in range(n))
            no = math.log(1 - prior) + sum(math.log(table[j][0][p[j]]) for j in range(n))
            chance[p] = 1 / (1 + math.exp(max(-500, min(500, no - yes))))
    return chance, table, prior


def logistic(rows: list[tuple[list[float], float, float]], rounds: int = 400) -> list[float]:
    """Weights (the constant first) of a logistic fit to (features, target, weight) rows."""
    if not rows:
        return []
    total = sum(w for *_, w in rows)
    weights = [0.0] * (len(rows[0][0]) + 1)
    for _ in range(rounds):
        slope = [0.01 * w for w in weights]
        for x, y, w in rows:
            z = weights[0] + sum(a * b for a, b in zip(weights[1:], x, strict=True))
            gap = (1 / (1 + math.exp(max(-500, min(500, -z)))) - y) * w / total
            slope[0] += gap
            for i, b in enumerate(x):
                slope[i + 1] += gap * b
        weights = [a - 1.0 * s for a, s in zip(weights, slope, strict=True)]
    return weights


def train(docs: DataFrame) -> list[float]:
    """Weights of the span classifier, from the votes on every candidate of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.explode(_candidates(text)).alias("c")).select("c")
    names = {**_votes(F.col("c")), **_features(F.col("c"))}
    rows = (
        found.select(*[v.alias(k) for k, v in names.items()]).groupBy(*names).count().collect()
    )
    patterns: dict[tuple[int, ...], int] = {}
    for r in rows:
        key = tuple(r[k] for k in LABELERS)
        patterns[key] = patterns.get(key, 0) + r["count"]
    chance, _, _ = expectation_maximisation(patterns)
    return logistic(
        [
            ([float(r[k]) for k in names], chance[tuple(r[k] for k in LABELERS)], r["count"])
            for r in rows
        ]
    )


def _accepted(weights: list[float], base: Column, text: Column) -> Column:
    if not weights:
        return F.array().cast("array<struct<kind:string,start:int,end:int>>")

    def take(c: Column) -> Column:
        z = F.lit(weights[0])
        for w, x in zip(weights[1:], {**_votes(c), **_features(c)}.values(), strict=True):
            z = z + w * x
        clear = ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return (z >= 0) & clear

    return F.transform(
        F.filter(_candidates(text), take),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )


def find(docs: DataFrame, weights: list[float]) -> DataFrame:
    """``docs`` with ``base_spans`` and ``more_spans``: arrays of (kind, start, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("base_spans", _base(text)).withColumn(
        "more_spans", _accepted(weights, F.col("base_spans"), text)
    )


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def report(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """One row per document: counts per base kind, a digest of the base spans, and all spans.

    All spans are ordered by kind, base kinds first, then by start.
    """
    weights = train(docs) if weights is None else weights
    found = find(docs.select("doc_id", "text"), weights)
    order = [*BASE, *[k for k in MORE if k not in BASE]]
    both = F.concat("base_spans", "more_spans")
    every = F.flatten(
        F.array(*[F.array_sort(_of_kind(both, k)) for k in order])
    )
    return found.select(
        "doc_id",
        *[
            F.size(_of_kind(F.col("base_spans"), k)).cast("long").alias(f"n_{k}")
            for k in BASE
        ],
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"),
        _written(every).alias("spans"),
    )


def masked(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one."""
    weights = train(docs) if weights is None else weights
    spans = F.array_sort(
        F.transform(
            F.concat("base_spans", "more_spans"),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        grown = F.concat(
            acc["out"],
            F.substring("text", acc["at"] + 1, s["start"] - acc["at"]),
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
        )
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(grown).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate(
        spans, start, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text")))
    )
    found = find(folded(docs, "text"), weights)
    masked_text = F.when(F.size(spans) > 0, text).otherwise(F.col("text"))
    return unfolded(found.withColumn("text", masked_text), docs.columns)
