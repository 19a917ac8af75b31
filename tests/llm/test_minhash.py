"""DartMinHash estimates, and classes against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from usagelens.llm import minhash
from usagelens.llm.shingles import batch_shingles, word_hashes


@pytest.mark.parametrize("most", [1, 7, 300])
def test_signatures_estimate_weighted_similarity(most):
    draw = np.random.default_rng(most)
    seen, true = [], []
    for _ in range(40):
        elements = draw.integers(0, 2**63, 300).astype(np.uint64)
        a, b = (draw.integers(1, most + 1, 300).astype(float) * draw.choice([0, 1, 1, 1], 300) for _ in range(2))
        i, j = np.flatnonzero(a), np.flatnonzero(b)
        signed = minhash.dart_minhash(np.concatenate([elements[i], elements[j]]), np.concatenate([a[i], b[j]]), np.repeat([0, 1], [len(i), len(j)]), 2, 128)
        seen.append((signed[0] == signed[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(seen) - np.mean(true)) < 0.025


def test_signatures_do_not_depend_on_company():
    draw = np.random.default_rng(0)
    elements, owner = draw.integers(0, 2**63, 90).astype(np.uint64), np.repeat([0, 1, 2], [5, 80, 5])
    together = minhash.dart_minhash(elements, np.ones(90), owner, 3, 64)
    alone = minhash.dart_minhash(elements[5:85], np.ones(80), np.zeros(80, int), 1, 64)
    assert (together[1] == alone[0]).all() and (together != 0).all()


def test_shingles_of_odd_texts():
    texts = pa.array(["one two three four five six", "one two", "", None, " \t\n", "two one", "é " * 9, "one  two\tthree four\nfive six"])
    found = list(batch_shingles(texts, 5, limit=20))
    assert [len(s) for _, s, _ in found] == [2, 1, 0, 0, 0, 1, 1, 2]
    assert found[0][1].tolist() == found[7][1].tolist() and found[1][1].tolist() != found[5][1].tolist()
    assert found[6][2].tolist() == [5]
    assert len(word_hashes(b"a b a")[0]) == 3 and word_hashes(b"a b a")[0][0] == word_hashes(b"a b a")[0][2]


def corpus():
    draw = random.Random(2)
    words = [f"w{k}" for k in range(4000)]
    passage = [draw.choice(words) for _ in range(60)]
    rows = []
    for d in range(60):
        rows.append([draw.choice(words) for _ in range(draw.choice([3, 40, 120, 400]))] + (passage if d % 2 else []))
    for d in range(60, 160):
        text = list(rows[draw.randrange(12)])
        for _ in range(draw.randrange(0, 1 + len(text) // 60)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append(text)
    return [(d, " ".join(t)) for d, t in enumerate(rows)] + [(500, None), (501, ""), (502, "  "), (503, None)]


def shingle_set(text):
    words = (text or "").split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_classes_equal_all_pairs(documents):
    rows = corpus()
    sets = {d: shingle_set(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {d: (root(d), root(d) == d) for d in sets}


def test_empty_table_null_ids_and_repeated_rows(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    rows = [(1, "a b c d e f")] * 2 + [(2, "a b c d e f"), (None, "a b c d e f")]
    docs = documents(rows)
    got = minhash.near_duplicates(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=str)
    left = minhash.without_copies(docs)
    assert left.columns == docs.columns and left.count() == 1


def test_rows_of_null_and_repeated_ids_are_documents_each(documents):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(1)), (None, text(2)), (7, text(1)), (7, text(3)), (7, text(3)), (8, None), (8, None), (9, "")]
    left = sorted(str(r["text"]) for r in minhash.without_copies(documents(rows)).collect())
    assert left == sorted([text(1), text(2), text(3), "None", "None", ""])


def test_a_group_of_edited_copies_does_not_meet_in_pairs(documents, monkeypatch):
    """Copies of one text with so many edits of their own that few are near another: what is held against each other grows with the group."""
    draw, held = random.Random(12), []
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(400):
        words = list(base)
        for i in draw.sample(range(150), 0 if d == 77 else draw.randrange(1, 9)):
            words[i] = f"e{d}x{i}"
        rows.append((d, " ".join(words)))
    real = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *rest: held.append(pairs.count()) or real(pairs, *rest))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(documents(rows)).collect()}
    sets, up = {d: shingle_set(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert got == {d: root(d) for d in sets} and len(set(got.values())) > 100
    assert sum(held) < 10 * len(rows)


def test_weighted_sets_count_repeats(documents):
    rows = [(1, "a b c d e " * 20), (2, "a b c d e " * 4), (3, "a b c d e " * 19)]
    plain = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(documents(rows)).collect()}
    weighted = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(documents(rows), weighted=True).collect()}
    assert plain == {1: 1, 2: 1, 3: 1} and weighted == {1: 1, 2: 2, 3: 1}
