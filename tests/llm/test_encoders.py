"""Why the fast encoder gives the ids of ``tokenizers`` on texts of common scripts.

Both join the neighbours of the lowest rank first, leftmost of equal ones. ``tokenizers`` joins
a pair only if it is in its list of merges; the fast one joins any two parts that are together
a word of the vocabulary. If the bytes of every word, joined by all lower ranks, end as just
the pair of its merge, then no other pair can ever stand for it and both take the same steps.
What is left is the cut of a text into words to join, which depends on classes of characters.
"""

import base64
import itertools
import json
import sys

import public_tokenizers
import pytest
from tokenizers.pre_tokenizers import ByteLevel

from basketry.llm import packing


@pytest.fixture(scope="module")
def merges():
    """Pairs of bytes in the order of their merges."""
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        model = json.load(f)["model"]
    plain = {c: c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174}
    others = [c for c in range(256) if c not in plain]
    letter = {chr(v): k for k, v in plain.items()} | {chr(256 + i): c for i, c in enumerate(others)}

    def raw(text):
        return bytes(letter[c] for c in text)

    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocabulary = {raw(k): v for k, v in model["vocab"].items() if not k.startswith("<|end")}
    return [(raw(a), raw(b)) for a, b in pairs], vocabulary


def test_every_word_is_reached_by_its_merge_alone(merges):
    pairs, vocabulary = merges
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    assert ranks == vocabulary
    assert [ranks[a + b] for a, b in pairs] == list(range(256, 256 + len(pairs))) and len(ranks) == 256 + len(pairs)
    for a, b in pairs:
        limit = ranks[a + b]
        parts = [bytes([c]) for c in a + b]
        while True:
            rank, i = min(((ranks.get(x + y, limit), i) for i, (x, y) in enumerate(itertools.pairwise(parts))))
            if rank >= limit:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [a, b]


def test_common_characters_are_cut_alike():
    import regex

    cut, pattern = ByteLevel(add_prefix_space=False), regex.compile(public_tokenizers.PATTERN)
    e = packing.encoder()
    common = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and not packing._COMMON.search(chr(i))]
    assert 800 < len(common) < 2000
    # Each character beside one of every class, on both sides.
    for c in common:
        text = "".join(f"{c}{x}{c}{c}{y}{c}" for x in "a1! \n'" for y in "b2? \t") + f"'{c} '{c}{c}  {c}"
        assert [x for _, x in cut.pre_tokenize_str(text)] == [m.span() for m in pattern.finditer(text)], repr(c)
        assert e.fast.encode_ordinary(text) == e.slow.encode(text, add_special_tokens=False).ids, repr(c)
