"""Patterns, ids and layout of packed sequences."""

import weakref
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from usagelens.llm import packing
from usagelens.llm.common import kept, trimmed, trimmed_group

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, and more words.", "", None, " \n\t ", "UPPER Case ÄÖÜ straße ΣΊΣΥΦΟΣ İstanbul", "it's 42 o'clock, isn't it? 7 7 7",
    "<|endoftext|> in a text", "odd blank and\x1cmore\x0bhere\x85", "a,b.c!?,. _x_ --- ,. ...", "combining é and ́alone", "日本語 テキスト 👍🏽 end",
    "no-break " * 3000, "x" * 9000, "password=9176eba8d140742834 ½ ² Ⅷ",
]


def test_ids_are_the_tokenizers_own():
    plain, mine = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    mine.limit = 5
    for text in TEXTS * 2:
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(mine.ids(text or ""), "<u4").tolist() == want


def test_combinations_fill_the_window():
    ways = packing.combinations(12, 4)
    assert (ways.sum(1) == 12).all() and len({tuple(w) for w in ways.tolist()}) == len(ways) == 1 + 6 + 12 + 15
    assert (np.diff(ways, axis=1) <= 0).all()


@pytest.mark.parametrize("seed", range(3))
def test_patterns_use_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    histogram = np.bincount(np.minimum(64, draw.lognormal(2.4, 1, 5000).astype(int) + 1), minlength=65)
    used, total = np.zeros(65, np.int64), 0
    for pattern, times in packing.plan_patterns(histogram):
        assert sum(pattern) <= 64
        np.add.at(used, list(pattern), times)
        total += times
    assert (used == histogram).all()
    assert (histogram * np.arange(65)).sum() / (64 * total) > 0.97


def test_least_squares_is_nonnegative_and_optimal():
    ways = packing.combinations(16, 3)
    wanted = np.random.default_rng(0).integers(0, 50, 16).astype(float)
    x = packing.nonnegative_least_squares(ways, wanted)
    a = np.zeros((17, len(ways)))
    for j, way in enumerate(ways):
        np.add.at(a[:, j], way, 1)
    gradient = a[1:].T @ (wanted - a[1:] @ x)
    assert x.min() >= 0 and gradient.max() <= 1e-3 * wanted.max() and abs(gradient[x > 1e-6]).max() <= 1e-3 * wanted.max()


def test_pieces_lie_gapless_and_whole(documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "same id"), (100, "same id")]
    docs = documents(rows)
    packed = packing.pack_documents(docs, PATH, window=64)
    found = packed.collect()
    plain = Tokenizer.from_file(PATH)
    ids = {d: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        part = ids[r["doc_id"]][r["start"]: r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.pop(100) == [(0, len(ids[100]))] * 2
    for doc, parts in pieces.items():
        assert [s for s, _ in sorted(parts)] == list(range(0, len(ids[doc]), 64)) and sum(n for _, n in parts) == len(ids[doc])
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    whole = packing.sequences(docs.where("doc_id < 100"), packed.where("doc_id < 100"), PATH, window=64).collect()
    assert all(len(r["ids"]) == 4 * (r["tokens"] if r["tokens"].bit_count() == 1 else 64) for r in whole)
    assert packing.pack_documents(documents([]), PATH).count() == 0


@pytest.mark.parametrize("length", [3, 17, 40])
def test_short_pieces_leave_little_padding(length):
    histogram = np.zeros(4097, np.int64)
    histogram[length] = 100_000
    patterns = packing.plan_patterns(histogram, unit=16)
    assert sum(p.count(length) * n for p, n in patterns) == 100_000 and max(sum(p) for p, _ in patterns) <= 4096
    assert 100_000 * length / (4096 * sum(n for _, n in patterns)) > 0.98


def test_mixed_lengths_are_packed_by_their_own_lengths(documents):
    draw = np.random.default_rng(3)
    lengths = np.concatenate([draw.integers(2, 30, 40_000), np.minimum(4096, draw.lognormal(6, 1, 20_000).astype(int) + 1)])
    histogram = np.bincount(lengths, minlength=4097)
    patterns = packing.plan_patterns(histogram, unit=16)
    used = np.zeros(4097, np.int64)
    for pattern, times in patterns:
        assert sum(pattern) <= 4096
        np.add.at(used, list(pattern), times)
    assert (used == histogram).all()
    assert lengths.sum() / (4096 * sum(n for _, n in patterns)) > 0.99
    rows = documents([(i, "word " * (i % 7)) for i in range(3000)])
    packed = packing.pack_documents(rows, PATH).collect()
    assert len(packed) == 3000
    tokens = sum(r["length"] for r in packed)
    assert tokens / (4096 * len({r["sequence_id"] for r in packed})) > tokens / (4096 * -(-tokens // 4096)) - 1e-9


def test_words_are_listed_together():
    words = pa.array(["a", "né", "中\U0001f600", "b"])
    assert packing._listed(words) == words.to_pylist() and packing._listed(words[:0]) == [] and packing._listed(words[:1]) == ["a"]


def test_a_worker_keeps_words_for_tasks_that_look_them_up_only():
    class Words:
        pass

    refs = []

    def lookup(batches):
        refs.append(weakref.ref(kept("words", Words)))
        yield from batches

    for _ in range(2):
        assert list(trimmed(lookup, keeps="words")(iter([1]))) == [1]
    assert refs[0]() is refs[1]() is not None
    assert list(trimmed(iter)(iter([2]))) == [2]
    assert refs[0]() is None
    list(trimmed(lookup, keeps="words")(iter([])))
    trimmed_group(lambda left, right: left)(None, None)
    assert refs[2]() is None


def test_words_of_few_texts_are_looked_up_at_one_time(documents, monkeypatch):
    asked, runs = [], []

    class Counting:
        def all_ids(self, texts):
            asked.append(sum(map(len, texts)))
            return [b"" for _ in texts]

    monkeypatch.setattr(packing, "trimmed", lambda run, keeps: runs.append(run) or run)
    monkeypatch.setattr(packing, "_tokenizer", lambda path: Counting())
    packing.token_pieces(documents([(1, "a")]), PATH)
    texts = pa.array(["word " * 60_000] * 12)
    found = list(runs[0](iter([pa.RecordBatch.from_arrays([pa.array(range(12)), texts], ["doc_id", "text"])])))
    assert [x for b in found for x in b.column("doc_id").to_pylist()] == list(range(12))
    assert sum(asked) == 12 * 300_000 and max(asked) < packing.TEXT_CHARS + 300_000 < 2_000_000
