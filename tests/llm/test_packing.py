import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestrata.llm import packing, tokens

PATH = public_tokenizers.path(packing.VOCABULARY)


def test_words_give_the_library_s_ids():
    plain, own = Tokenizer.from_file(PATH), tokens.Words(PATH)
    rnd = random.Random(2)
    texts = ["", "A\u0130b", "x<|endoftext|>y", "it's they'll I'd 'S", "a\x1cb\x85c\xa0d", "\u03a3\u0391\u03a3", "\u65e5\u672c \u8a9e", "12 345x6", "\U0001f600 ok", "\u00ff\u00df \u0149", "e\u0301 \u00e9", "don\u2019t \u2014 \u20ac5", "\u00bd\u00b2\u00aa"]
    texts += ["".join(rnd.choice("abcdefgh \u00e9\u00df\u00f1.,'!?-1234\n") for _ in range(80)) for _ in range(400)]
    texts += ["word " * 50_000, "x" * 200_000, " ".join(f"{i:x}" for i in range(30_000))]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 40)
    own, plain = tokens.Words(PATH), Tokenizer.from_file(PATH)
    for i in range(50):
        text = f"word{i} caf\u00e9{i}, it's"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert own.size == sum(map(len, own)) + sum(map(len, own.pieces)) < 80
    assert own.encode("") == b""


def check(rows, texts, length):
    plain = Tokenizer.from_file(PATH)
    ids = Counter((d, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in texts)
    assert sum(r.length for r in rows) == sum(len(x) * n for (_, x), n in ids.items())
    crcs = Counter((d, s, min(length, len(x) - s), zlib.crc32(np.array(x[s : s + length], "<u4").tobytes()), len(x)) for (d, x), n in ids.items() for s in range(0, len(x), length) for _ in range(n))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == crcs
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length


def test_pieces_and_sequences(spark, make_docs, odd_rows):
    rnd = random.Random(3)
    texts = odd_rows + [(100 + i, "tok " * rnd.randint(0, 90)) for i in range(200)]
    check(packing.sequences(make_docs(texts).repartition(5), length=64).collect(), texts, 64)


def test_empty_table(make_docs):
    assert packing.sequences(make_docs([])).count() == 0


def test_pack_places_every_piece_and_wastes_little():
    rnd = random.Random(4)
    histogram = dict(Counter(rnd.randint(1, 2048) for _ in range(20_000)))
    patterns = packing.pack(histogram)
    placed = Counter()
    for count, pieces in patterns:
        assert sum(pieces) <= 2048
        for size in pieces:
            placed[size] += count
    assert placed == Counter(histogram)
    used, n = sum(k * v for k, v in histogram.items()), sum(c for c, _ in patterns)
    assert used / (2048 * n) > 0.98


def test_a_length_fills_new_packs_with_itself():
    assert sum(c for c, _ in packing.pack({100: 1000})) == 50
    assert sum(c for c, _ in packing.pack({1: 2048 * 3 + 1})) == 4
    rnd = random.Random(5)
    for low, high, n, most in ((20, 120, 5000, 0.08), (1, 40, 100_000, 0.02), (300, 700, 5000, 0.15), (1, 2048, 500, 0.15)):
        histogram = dict(Counter(rnd.randint(low, high) for _ in range(n)))
        patterns = packing.pack(histogram)
        placed = Counter()
        for count, pieces in patterns:
            assert sum(pieces) <= 2048
            for size in pieces:
                placed[size] += count
        assert placed == Counter(histogram)
        used = sum(k * v for k, v in histogram.items())
        assert used / (2048 * sum(c for c, _ in patterns)) > 1 - most, (low, high)
