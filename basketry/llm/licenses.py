"""Licence scan: identifier tags and notice phrases, and what their expressions permit.

Two Aho-Corasick automata read each whole text once. One finds notice phrases in the text's
words, the other identifier tags (``SPDX-License-Identifier:``) in its characters. What follows
a tag on its line is read as a licence expression by a shunting-yard parser: ``with`` binds
tighter than ``and``, that tighter than ``or``, and parentheses group.

An expression is evaluated to the restriction that a user must accept, from 0 (public domain)
to 5 (no commercial use, or unknown terms): ``or`` takes the lesser of its sides, ``and`` the
greater, and an exception added by ``with`` makes a copyleft licence one step weaker. A document
is restricted as its most restrictive tag or notice is.

The score is the confidence that the document states a licence: 1 less the product of what each
distinct kind of evidence leaves open, so a well-formed tag says more than a passing phrase.

Reading stops at the first token that the grammar does not allow there. An operator left without
its right side is dropped and missing parentheses are closed; the tag then counts as malformed.

Defined cases: a null or empty text has no words, empty labels, score 0 and a null restriction;
repeated documents get a row each; extra columns are ignored; an empty table gives no rows. Time
is linear in the length of a text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels that every result must have.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases: label, confidence.
NOTICES = {
    "permission is hereby granted free of charge to any person": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "licensed under the apache license version 2 0": ("apache", 0.9),
    "released under the mit license": ("mit", 0.8),
    "licensed under the mit license": ("mit", 0.8),
    "gnu general public license": ("gpl", 0.7),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.7),
    "eclipse public license": ("epl", 0.7),
    "bsd license": ("bsd", 0.6),
    "isc license": ("isc", 0.6),
    "cc0": ("cc0", 0.4),
    "released into the public domain": ("public-domain", 0.8),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "creative commons attribution": ("cc-by", 0.6),
    "all rights reserved": ("proprietary", 0.4),
}
BASE_CONFIDENCE, TAG_CONFIDENCE, BAD_TAG_CONFIDENCE = 0.5, 0.95, 0.6
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Families of identifiers and their restriction; an identifier belongs to the longest that begins it.
FAMILIES = {
    "public-domain": 0, "cc0": 0, "unlicense": 0, "0bsd": 0,
    "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl": 1, "cc-by": 1, "python": 1,
    "lgpl": 2, "mpl": 2, "epl": 2, "cddl": 2,
    "gpl": 3, "cc-by-sa": 3,
    "agpl": 4,
    "cc-by-nc": 5, "cc-by-nd": 5, "proprietary": 5,
}
UNKNOWN, UNKNOWN_RESTRICTION = "unknown", 5
COPYLEFT = range(2, 5)
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else 32 for c in _LOWER)
_FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " restriction int, n_tags long, n_malformed_tags long"
)


def family(identifier: str) -> str:
    parts = identifier.rstrip(".:-+").split("-")
    for n in range(len(parts), 0, -1):
        if (name := "-".join(parts[:n])) in FAMILIES:
            return name
    return UNKNOWN


def restriction_of(label: str) -> int:
    return FAMILIES.get(label, UNKNOWN_RESTRICTION)


def _apply(operator: str, values: list[int]) -> None:
    right, left = values.pop(), values.pop()
    if operator == "with":
        values.append(left - 1 if left in COPYLEFT else left)
    else:
        values.append(max(left, right) if operator == "and" else min(left, right))


def evaluate(text: str, at: int = 0) -> tuple[int | None, list[str], bool]:
    """(restriction, labels, well-formed) of the lower-case expression that starts at ``at``.

    Two stacks: operands already valued, and operators and parentheses that wait.
    """
    values: list[int] = []
    waiting: list[str] = []
    labels: list[str] = []
    well, last, open_groups = True, "(", 0
    while m := _TOKEN.match(text, at):
        token = m[1]
        wants_operand = last in _BINDS or last == "("
        if wants_operand and last == "with" and token not in _BINDS and token not in "()":
            values.append(0)  # the exception's name
            last = "exception"
        elif wants_operand and last != "with" and token == "(":
            waiting.append(token)
            open_groups += 1
            last = "("
        elif wants_operand and last != "with" and token not in _BINDS and token != ")":
            labels.append(family(token))
            values.append(restriction_of(labels[-1]))
            last = "identifier"
        elif not wants_operand and token in _BINDS and (token != "with" or last == "identifier"):
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                _apply(waiting.pop(), values)
            waiting.append(token)
            last = token
        elif not wants_operand and token == ")" and open_groups:
            while waiting[-1] != "(":
                _apply(waiting.pop(), values)
            waiting.pop()
            open_groups -= 1
            last = ")"
        else:
            break
        at = m.end()
    if last in _BINDS or last == "(":
        well = False
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    while waiting:
        if (operator := waiting.pop()) == "(":
            well = False
        else:
            _apply(operator, values)
    return (values[0] if values else None), labels, well and bool(values)


@lru_cache(1)
def _automata():
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES}:
        phrases.add_word(f" {phrase} ", phrase)
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None) -> tuple:
    """The fields of one whole text, in the order of the result's columns."""
    phrases, tags = _automata()
    lowered = (text or "").encode().translate(_LOWER)
    words = lowered.translate(_WORD_BYTES).split()
    # One character for each byte: all patterns are ASCII.
    joined = b" %s " % b" ".join(words)
    base_ends, base_labels, labels, terms, evidence = [], set(), set(), set(), {}
    told = -1
    for end, phrase in phrases.iter(joined.decode("latin-1")):
        # Of phrases that end at one place the longest comes first, and says whose terms hold.
        if phrase in NOTICES:
            label, evidence[phrase, "notice"] = NOTICES[phrase]
            labels.add(label)
            terms.add(label)
            told = end
        if phrase in BASE:
            base_ends.append((end, phrase.count(" ") + 1))
            base_labels.add(BASE[phrase])
            evidence[phrase, "base"] = BASE_CONFIDENCE
            if told != end:
                terms.add(BASE[phrase])
    labels |= base_labels
    restrictions = [restriction_of(x) for x in terms]
    n_tags = n_bad = 0
    line = lowered.decode("latin-1")
    for end, tag in tags.iter(line):
        restriction, found, well = evaluate(line, end + 1)
        n_tags += 1
        n_bad += not well
        if restriction is not None:
            labels.update(found)
            restrictions.append(restriction)
            evidence[tag, well] = TAG_CONFIDENCE if well else BAD_TAG_CONFIDENCE
    first = last = None
    if base_ends:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        ends, sizes = np.array(base_ends).T
        starts = np.searchsorted(spaces, ends) - sizes
        first, last = int(starts.min()), int(starts.max())
    doubt = 1.0
    for confidence in sorted(evidence.values()):
        doubt *= 1 - confidence
    return (
        len(words), len(base_ends), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)),
        1 - doubt, max(restrictions, default=None), n_tags, n_bad,
    )


def _scanned(texts: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in _FIELDS.split(",")]
    found = pd.DataFrame([scan(x) for x in texts], columns=names, dtype=object)
    kinds = {"first_word": "Int64", "last_word": "Int64", "restriction": "Int32"}
    whole = {x: "int64" for x in ("n_words", "n_base", "n_tags", "n_malformed_tags")}
    return found.astype(kinds | whole | {"score": "float64"})


def report(docs: DataFrame) -> DataFrame:
    """One row per document: words, base places and labels, all labels, score and restriction."""
    scanned = F.pandas_udf(_scanned, _FIELDS)
    return docs.select("doc_id", scanned("text").alias("r")).select("doc_id", "r.*")
