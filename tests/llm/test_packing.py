import random
import zlib

import numpy as np
import public_tokenizers
from helpers import docs, empty, prose
from tokenizers import Tokenizer

from basketry.llm import packing


def untouched():
    """The contract's encoder, as the library loads it."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_an_untouched_tokenizer():
    rng = random.Random(1)
    e, plain = packing.encoder(), untouched()
    assert e.ids("x <|endoftext|> y").tolist() == [87, 220, 50256, 331]
    alphabet = "ab Z9'.,\n\t!#ßéñЖλ€—x  "
    texts = ["", "don't  stop\n\n x", "<|endoftext|>", "日本語 text", "a\u0085b c\x1cd", "x" * 3000, "a<|endoftext|>b <|x|>"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert e.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_texts_are_cut_where_no_token_crosses(monkeypatch):
    rng = random.Random(5)
    e, plain = packing.encoder(), untouched()
    alphabet = "ab Z9'.,\n\t!#ßéñЖλ€—x  日本語。、한국ぁé\u0301٣<|"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) + rng.choice(["", "<|endoftext|>"]) for _ in range(300)]
    texts += ["word " * 500, "語" * 300, "it's  " * 200, "a.b,c " * 100 + "\n" * 50]
    for most in (1, 7, 40):
        for t in texts:
            parts = list(packing.parts_of(t, most))
            assert "".join(parts) == t and all(parts)
            ids = [i for p in parts for i in plain.encode(p, add_special_tokens=False).ids]
            assert ids == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert max(map(len, packing.parts_of("some words, " * 50_000 + "語、" * 9, 1000))) < 1010


def test_a_long_mixed_text_is_encoded_in_parts():
    """One uncommon character sends its part, not the whole text, to the slower encoder."""
    e, seen = packing.encoder(), []
    real = e.slow

    class Spy:
        def encode(self, text, **options):
            seen.append(len(text))
            return real.encode(text, **options)

    e.slow = Spy()
    try:
        ids = e.ids("plain words here " * 60_000 + "日本 " + "plain words here " * 60_000)
    finally:
        e.slow = real
    assert len(seen) == 1 and seen[0] < 2 * packing.CUT and len(ids) > 300_000


def _size(bins):
    return sum(number for number, _ in bins)


def test_plans_use_every_length_once_and_need_no_more_than_best_fit():
    rng = np.random.default_rng(2)
    for n, capacity in ((0, 16), (1, 16), (50, 16), (3000, 512), (40_000, 2048)):
        counts = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
        bins = packing.plan(counts, capacity)
        used = np.zeros_like(counts)
        for number, lengths in bins:
            assert number > 0 and 0 < sum(lengths) <= capacity
            np.add.at(used, lengths, number)
        assert (used == counts).all()
        assert _size(bins) <= _size(packing._best_fit([], counts, capacity))


def test_configurations_place_most_large_pieces():
    """Sequences of two or more large pieces come from configurations, in plans as good as best-fit's."""
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2048, 200_000), np.clip(rng.lognormal(6, 1, 50_000).astype(int), 1, 2047)):
        counts = np.bincount(lengths, minlength=2049)
        made = packing._configured(counts, 2048, packing.GROUPS)
        kept = [b for b in made if len(b[1]) == 1 or 2048 - sum(b[1]) <= 2048 // packing.NEARLY]
        large = 2048 // packing.SMALL
        placed = sum(n * len(x) for n, x in kept)
        assert all(x > large for _, xs in made for x in xs)
        assert placed >= 0.7 * counts[large + 1 :].sum()
        assert sum(n for n, x in kept if len(x) > 1) >= 0.2 * placed
        assert _size(packing._filled(kept, counts, 2048)) <= _size(packing._best_fit([], counts, 2048))


def test_groups_have_equal_cardinality():
    counts = np.array([0, 5, 7, 0, 9, 3])
    dealt = packing.groups(counts, 2, 4)
    assert [sum(n for _, n in g) for g in dealt] == [5, 5, 5, 4]
    assert dealt[0] == [(5, 3), (4, 2)]


def test_pieces_and_places(spark):
    rng = random.Random(3)
    long = prose(rng, 400)
    table = [(1, long), (1, long), (2, None), (3, ""), (None, "word"), *[(9, "tie")] * 30, (5, prose(rng, 40))]
    packed = packing.pack(packing.pieces(docs(spark, table), 64, with_ids=True), 64)
    found = packed.toPandas()
    ends = {}
    for r in found.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert max(ends.values()) <= 64
    ids = [*packing.encoder().ids(long), 0]
    one = found[found.doc_id == 1].sort_values("piece")
    assert sorted(one.piece) == sorted([*range(-(-len(ids) // 64))] * 2)
    assert [x for p in one.drop_duplicates("piece").ids for x in p] == ids
    assert (one[one.piece > 0].length == 64).all()
    assert len(found[found.doc_id == 9]) == 30 and found[found.doc_id == 2].length.tolist() == [1]
    sequences = packing.sequences(packed).toPandas()
    assert sequences.ids.map(len).sum() == found.length.sum()
    assert packing.pack(packing.pieces(empty(spark))).count() == 0
