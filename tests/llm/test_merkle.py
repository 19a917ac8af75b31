"""Proofs against a tree built row by row."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from usagelens.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(row):
    text = row[4]
    if row[0] is None or text is None or zlib.crc32(str(row[0]).encode()) % 3:
        return row
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute_force(rows, fanout):
    """Per row in order of the result's values: the columns of the manifest."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels, ranked = {}, {}
    for lang in order:
        ranked[lang] = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        level = [leaf_of(r) for r in ranked[lang]]
        levels[lang] = [level]
        while len(level) > 1:
            level = [digest("".join(level[i: i + fanout])) for i in range(0, len(level), fanout)]
            levels[lang].append(level)
    subroots = [levels[lang][-1][0] for lang in order]
    root, result = digest("".join(subroots)), []
    for t, lang in enumerate(order):
        for i, row in enumerate(ranked[lang]):
            proof, node, at = "", leaf_of(lowered(row)), i
            for level in levels[lang][:-1]:
                begin = at // fanout * fanout
                family = level[begin: begin + fanout]
                proof += "".join(h for k, h in enumerate(family) if k != at - begin)
                family[at - begin] = node
                node, at = digest("".join(family)), at // fanout
            proof += "".join(h for k, h in enumerate(subroots) if k != t)
            folded = digest("".join([*subroots[:t], node, *subroots[t + 1:]]))
            result.append((row[0], leaf_of(row), subroots[t], root, digest(proof), folded, folded == root))
    return sorted(result, key=str)


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return docs.withColumns({c: F.lit("clash") for c in ("tree", "rank", "leaf", "found", "n", "low", "high", "path", "bucket", "root")})


def manifest(spark, rows, fanout=8):
    found = merkle.manifest(table(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fanout)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=str)


def drawn(n, langs, seed):
    draw = random.Random(seed)
    words = ["Ab", "cd", "É", "x\n", "", "ZZ"]
    return [(i * 3 - n, draw.choice(["s", None, "tü"]), draw.choice(langs), draw.randrange(9), "".join(draw.choices(words, k=draw.randrange(6)))) for i in range(n)]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 150])
def test_one_tree_of_every_shape(spark, n):
    rows = drawn(n, ["en"], n)
    assert manifest(spark, rows) == brute_force(rows, 8)


def test_trees_of_different_depth_and_null_language(spark):
    rows = drawn(300, ["en"] * 12 + ["de"] * 3 + [None, "Zz", "é"], 5)
    rows += [(5000, "s", "lone", 1, "A leaf of its own"), (5001, None, "", None, None)]
    assert manifest(spark, rows) == brute_force(rows, 8)
    assert manifest(spark, rows, 2) == brute_force(rows, 2)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 9 + [(7, "s", "en", 3, "AbC")] * 11 + [(7, "s", "en", 3, "abd"), (9, "", "en", 0, ""), (10, "s", "en", 1, "Q" * 300_000)]
    assert manifest(spark, rows) == brute_force(rows, 8)


def test_only_changed_texts_fail(spark):
    rows = drawn(120, ["en", "fr"], 9)
    for row, found in zip(sorted(rows, key=lambda r: str(r[0])), sorted(manifest(spark, rows), key=lambda r: str(r[0]))):
        assert found[6] == (lowered(row) == row)


def test_no_rows(spark):
    assert manifest(spark, []) == []
