import hashlib
import random
import re

import pytest
from helpers import docs, empty, prose

from basketry.llm import pii

# The patterns as the contract gives them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def spans(text):
    return [
        f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())
    ]


def texts():
    rng = random.Random(1)
    parts = ["a.b@c.de", "x@y", "a@b.c@d.e", "me@x.y.z-", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "0010.020.030.255", "256.1.1.1",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004 9", "4-0-0-0-0", "+1 (234) 555-6789", "+12", "+1 2 ) 3",
             "+49.30.1234567", "é", "𝒳", "@", "+", "..", "a@-.b", "%@x.y%u@v.w"]
    glue = [" ", "", ",", "\n", "x", "1"]
    out = ["".join(rng.choice(parts) + rng.choice(glue) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    return [None, "", *out, "9" * 20_000, "a" * 50_000 + "@", "a@" * 5000, "1." * 20_000, prose(rng, 20_000) + " a@b.cc"]


def test_base_spans_are_the_definition(spark):
    table = list(enumerate(texts()))
    found = {r.doc_id: r for r in pii.report(docs(spark, table), []).collect()}
    for i, t in table:
        want = spans(t)
        assert found[i].spans == ",".join(want), repr((t or "")[:80])
        assert found[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in want) for k in PATTERNS]


def test_expectation_maximisation_finds_the_good_labeler():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = 1 if rng.random() < 0.4 else -1
        votes = tuple(y if rng.random() < p else (0 if rng.random() < 0.3 else -y) for p in (0.95, 0.8, 0.85, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    chance, table, prior = pii.expectation_maximisation(counts)
    assert prior == pytest.approx(0.4, abs=0.05)
    assert table[0][1][1] > table[3][1][1] and chance[(1, 1, 1, 1)] > 0.99 > 0.01 > chance[(-1, -1, -1, -1)]
    assert pii.expectation_maximisation({}) == ({}, [], 0.0) and pii.logistic([]) == []


def test_further_spans_and_masks(spark):
    rng = random.Random(3)
    table = []
    for i in range(60):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        table.append((i, f"{prose(rng, 9)} token = \"{key}\" {prose(rng, 9)}"))
        table.append((100 + i, f"{prose(rng, 5)} see version rel_notes_chapter_{i}x {prose(rng, 5)}"))
    df = docs(spark, [*table, (500, "write to é a.b@c.de, or +1 (234) 555-6789."), (501, None), (502, "none")])
    weights = pii.train(df)
    found = {r.doc_id: r.spans for r in pii.report(df, weights).collect()}
    assert sum("secret" in found[i] for i in range(60)) >= 58
    assert not any(found[100 + i] for i in range(60)) and found[501] == found[502] == ""
    masked = pii.masked(df, weights)
    by = {r.doc_id: r.text for r in masked.collect()}
    assert by[500] == "write to é [EMAIL], or [PHONE]." and by[501] is None and by[502] == "none"
    assert "[SECRET]" in by[0] and masked.columns == df.columns
    assert pii.report(empty(spark)).count() == 0


def test_addresses_of_very_many_labels(spark):
    """A matcher that takes a stack frame for each label would end the worker."""
    base = "x@a" + ".a" * 100_000
    table = [(1, base), (2, f"see {base}.. or {base}-"), (3, "x [at] a" + " [dot] a" * 100_000), (4, "x[at]a" + ".b" * 100_000 + " [dot] ")]
    found = {r.doc_id: r.spans for r in pii.report(docs(spark, table), [1.0] + [0.0] * 8).collect()}
    assert found[1] == ",".join(spans(base))
    assert found[2] == ",".join(spans(table[1][1]))
    assert found[3] == f"email:0:{len(table[2][1])}" and found[4] == f"email:0:{len(table[3][1]) - 7}"


def labelled(rng, n):
    """Made-up texts with the places of their personal data, and things that only look like it."""

    def key(k, letters="0123456789abcdefABCDEFGHKMNPQRSTUVWXYZ"):
        return "".join(rng.choice(letters) for _ in range(k))

    def number(k):
        return "".join(rng.choice("123456789") for _ in range(k))

    real = [
        lambda: ("api_key = ", key(32), ""), lambda: ('password: "', key(20), '"'), lambda: ("token=", "AKIA" + key(16, "ABCDEFGH23456789"), ""),
        lambda: ("secret: ", key(40, "0123456789abcdef"), "."), lambda: ("phone: ", f"{rng.choice('2345')}{number(2)}-{rng.choice('2345')}{number(2)}-{number(4)}", ""),
        lambda: ("mail: ", f"ana{number(2)} [at] mail [dot] com", ""), lambda: ("ssn: ", f"{rng.choice('1234')}{number(2)}-{number(2)}-{number(4)}", ""),
    ]
    decoys = [
        lambda: f"see release/notes_of_chapter_{number(1)}", lambda: f"in src/some-long-path-name-{number(1)}-of-things",
        lambda: f"version my_module_name_with_{number(1)}_parts", lambda: f"chapter the-second-part-of-section-{number(1)}",
        lambda: "plain words only", lambda: f"page {number(3)}",
    ]
    for i in range(n):
        text, places = prose(rng, 8), []
        for _ in range(rng.randrange(3)):
            before, match, after = rng.choice(real)()
            text += " " + before
            places.append((len(text), len(text) + len(match)))
            text += match + after + " " + prose(rng, 6)
            text += " " + rng.choice(decoys)() + " " + prose(rng, 4)
        yield i, text, places


def test_added_spans_against_labels(spark):
    """Trained without labels on other made-up texts; recall and precision of whole spans."""
    weights = pii.train(docs(spark, [(i, t) for i, t, _ in labelled(random.Random(8), 500)]))
    held = list(labelled(random.Random(9), 300))
    found = {r.doc_id: r.more_spans for r in pii.find(docs(spark, [(i, t) for i, t, _ in held]), weights).collect()}
    got = {(i, s.start, s.end) for i, xs in found.items() for s in xs}
    want = {(i, *p) for i, _, places in held for p in places}
    hits = {(i, a, b) for i, a, b in want if any(j == i and s <= a and b <= e <= b + 1 and a - s <= 1 for j, s, e in got)}
    print(len(want), len(got), len(hits))
    assert len(want) > 200 and len(hits) >= 0.9 * len(want) and len(hits) >= 0.9 * len(got)
