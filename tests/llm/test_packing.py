"""Packing: exact round trip to the tokenizer's ids, gapless sequences, few of them."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from textloom.llm.packing import OpenBins, best_fit_packing, default_vocabulary


def ids_of(text):
    t = Tokenizer.from_file(default_vocabulary()[0])
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, found, size):
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
    assert set(by_doc) == {k for k, _ in rows}
    for key, text in rows:
        own = sorted(by_doc[key], key=lambda r: r["piece"])
        want = ids_of(text)
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == want
        assert len(own) == 1 or (len(want) > size and all(r["length"] == size for r in own[1:]))
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= size
    return len(by_sequence)


def test_round_trip(documents):
    draw = random.Random(6)
    words = ["alpha", "βeta", "<|endoftext|>", "x1", "don't", "\n\n", "  ", "日本", "é"]
    rows = [(k, " ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 30, 200, 900, 4000])))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "y" * 5000), (203, "  \t" * 800)]
    found = best_fit_packing(documents(rows, extra=True), with_ids=True).collect()
    sequences = check(rows, found, 1024)
    assert sequences <= -(-sum(r["length"] for r in found) // 1024) * 1.05 + 1


def test_many_small_documents_fill_their_sequences(documents):
    draw = random.Random(2)
    rows = [(k, "word " * draw.randrange(1, 700)) for k in range(1500)]
    found = best_fit_packing(documents(rows), bucket_pieces=300).collect()
    sequences = len({r["sequence_id"] for r in found})
    assert sequences <= sum(r["length"] for r in found) / 1024 * 1.03 + 5


def test_open_bins_against_a_plain_search():
    draw = random.Random(1)
    bins, plain, made = OpenBins(50, 6), {}, 0
    for _ in range(2000):
        n = draw.randrange(1, 51)
        number, at = bins.place(n)
        fitting = [free for free in plain.values() if free >= n]
        if fitting:
            assert plain[number] == min(fitting) == 50 - at
        else:
            assert (number, at) == (made, 0)
            if len(plain) == 6:
                fullest = min(plain.values())
                gone = next(k for k in plain if plain[k] == fullest and (k not in [x for b in bins.bins for x in b]))
                del plain[gone]
            made += 1
            plain[number] = 50
        plain[number] -= n
        if plain[number] == 0:
            del plain[number]


def test_edges(documents):
    assert best_fit_packing(documents([])).count() == 0
    found = best_fit_packing(documents([(None, "a b"), (None, None), (1, "x"), (1, "x")])).collect()
    assert sum(r["length"] for r in found) == 3 + 1 + 2 + 2


def test_special_tokens_are_those_of_tokenizers_by_default(documents):
    plain = Tokenizer.from_file(default_vocabulary()[0])
    texts = ["alpha <|endoftext|> beta", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n", "<|endoftext", "no such token", "z" * 3000 + "<|endoftext|>", None]
    rows = list(enumerate(texts))
    found = best_fit_packing(documents(rows), with_ids=True, special_tokens=True).collect()
    for k, text in rows:
        own = sorted((r for r in found if r["doc_id"] == k), key=lambda r: r["piece"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist()
        assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, 2]
