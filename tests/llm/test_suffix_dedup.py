import hashlib
import random
from collections import Counter

import pytest
from helpers import docs, empty, prose, rows

from basketry.llm import suffix_dedup


def plain(texts):
    """By definition: every window of every text is counted."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 400] for r in raws for i in range(len(r) - 399))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - 399):
            if seen[r[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def hard_texts():
    rng = random.Random(4)
    passage, other = prose(rng, 150), prose(rng, 120)
    exact = prose(rng, 90)[:400]
    texts = [None, "", "short", exact, "x" + exact + "y", exact[1:] + "z", "é" * 300, "aé" * 300]
    for n in (0, 1, 40, 200):
        texts.append(prose(rng, n) + " " + passage + " " + prose(rng, n))
    # Parts of one passage that begin and end anywhere, so partners differ from place to place.
    for _ in range(12):
        a = rng.randrange(0, 300)
        texts.append(prose(rng, 30) + passage[a : a + rng.randrange(380, 520)] + prose(rng, 30))
    # Near copies with single edits, an exact copy, and repeats within one text.
    for _ in range(6):
        at = rng.randrange(len(other))
        texts.append(other[:at] + "#" + other[at:])
    texts += [other, other, passage + passage[:450], "ab" * 500, "abc" * 400, "q" * 1000, "q" * 401]
    return texts


@pytest.mark.parametrize("gather", [None, 2])
def test_equals_the_definition(spark, gather):
    texts = hard_texts()
    found = suffix_dedup.report(docs(spark, list(enumerate(texts))), gather)
    got = rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(((i, *r) for i, r in enumerate(plain(texts))), key=repr)
    assert got == want


def test_equal_and_null_ids(spark):
    rng = random.Random(5)
    one, two = prose(rng, 120), prose(rng, 130)
    texts = [(None, one), (None, two), (1, one), (1, two + "!"), (2, one), (2, one)]
    got = rows(suffix_dedup.report(docs(spark, texts)), "doc_id", "n_removed")
    want = sorted(zip([t[0] for t in texts], [r[1] for r in plain([t[1] for t in texts])]), key=repr)
    assert got == want
    assert suffix_dedup.report(empty(spark)).count() == 0


def test_anchors_cover_every_window_once(monkeypatch):
    raw = prose(random.Random(6), 800).encode()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    starts = sorted(p - j for p, a, b in suffix_dedup.anchors(raw) for j in range(a, b + 1))
    assert starts == list(range(len(raw) - 399))
