"""Cover-tree links and top-k search against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import covertree, topk

ODD = [(900, None), (901, [0.0, 0.0, 0.0, 0.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 1.0, 0.0, 0.0]),
       (904, [float("inf"), 1.0, 0.0, 0.0]), (905, []), (906, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]


def vectors(seed=1, n=240):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(40, 4))
    rows = base[draw.integers(0, 40, n)] + draw.normal(size=(n, 4)) * draw.choice([0.0, 0.02, 0.3], (n, 1))
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(rows)]


@pytest.fixture
def table(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        return df.withColumns({c: F.lit("clash") for c in ("vector", "class", "n", "least", "node", "distance", "unit", "label")})

    return make


def brute_links(rows, threshold):
    fit = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 4
           and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = {i: [] for i, _ in fit}
    for i, v in fit:
        for j, w in fit:
            if i != j and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                linked[i].append(j)
    component = {}
    for i in sorted(linked):
        if i not in component:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in component:
                    component[k] = i
                    todo += linked[k]
    return {i: (len(linked[i]), component[i]) for i in linked}


def test_links_equal_all_pairs(table, block_rows=50, max_centres=3):
    rows = vectors() + ODD
    got = covertree.near_duplicates(table(rows), 0.9, max_centres=max_centres, block_rows=block_rows).collect()
    want = brute_links(rows, 0.9)
    assert len(got) == len(rows)
    for r in got:
        n, component = want.get(r["vec_id"], (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, component, component == r["vec_id"])


def test_nodes_within_the_limit_are_linked_whole(table):
    tight = [(i, [1.0, 0.001 * i, 0.0, 0.0]) for i in range(60)] + [(100, [0.0, 0.0, 1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_duplicates(table(tight), 0.9, max_centres=2, block_rows=8).collect()}
    assert got == {**{i: (59, 0) for i in range(60)}, 100: (0, 100)}


def test_repeated_rows_and_empty_tables(table):
    rows = [(1, [1.0, 0.0, 0.0, 0.0])] * 3 + [(2, [2.0, 0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0])]
    got = sorted(tuple(r) for r in covertree.near_duplicates(table(rows)).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert covertree.near_duplicates(table([])).count() == 0
    assert [tuple(r) for r in covertree.near_duplicates(table([(5, None)])).collect()] == [(5, 0, 5, True)]


def test_tree_covers_its_rows():
    points = np.random.default_rng(0).normal(size=(300, 5))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    tree = covertree.build_tree(unit)
    assert sorted(tree.order.tolist()) == list(range(300))
    placed = unit[tree.order]
    for k in range(len(tree.centre)):
        own = placed[tree.start[k]: tree.end[k]]
        assert np.linalg.norm(own - placed[tree.centre[k]], axis=1).max() <= tree.radius[k] + 1e-7
        if tree.last[k]:
            children = range(tree.child[k], tree.last[k])
            assert sum(tree.end[c] - tree.start[c] for c in children) == tree.end[k] - tree.start[k]


def test_top_k_equals_all_pairs(table, k=5, block_rows=16, rings=4):
    rows = vectors(2) + [(i + 300, v) for i, v in vectors(2)[:30]] + ODD
    got = topk.top_k(table(rows), F.col("vec_id") % 20 == 0, k, max_pivots=4, rings=rings, block_rows=block_rows).collect()
    fit = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for i, v in fit:
        if i % 20 == 0:
            ranked = sorted((-int(v @ w), j) for j, w in fit if j != i)[:k]
            want |= {(i, n, j, -s) for n, (s, j) in enumerate(ranked, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_large_components_are_exact(table):
    """Whole numbers far beyond what doubles multiply exactly, with ties broken in the last digit; scores stop at 64 bits."""
    draw = np.random.default_rng(7)
    base = draw.integers(-(2**20), 2**20, size=(120, 4)).astype(float)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(500, [1e30, 0.0, 0.0, 0.0]), (520, [-1e30, 1.0, 0.0, 0.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(table(rows), F.col("vec_id") % 20 == 0, 5, max_pivots=4, rings=4, block_rows=16).collect()}
    whole = {i: [max(-(2**63), min(2**63 - 1, int(np.floor(256 * x)) if abs(x) < 1e15 else int(np.sign(x)) * 2**63)) for x in v] for i, v in rows}
    for i in range(0, 120, 20):
        exact = {j: sum(a * b for a, b in zip(whole[i], whole[j])) for j in whole if j != i}
        ranked = sorted((-max(topk.LOWEST, min(topk.HIGHEST, s)), j) for j, s in exact.items())[:5]
        assert [got[i, n] for n in range(1, 6)] == [(j, -s) for s, j in ranked]


def test_top_k_of_empty_and_repeated_rows(table):
    assert topk.top_k(table([]), F.col("vec_id") >= 0).count() == 0
    same = [(0, [1.0, 0.0])] * 3 + [(1, [1.0, 0.0])] * 2
    got = [tuple(r) for r in topk.top_k(table(same), F.col("vec_id") >= 0).collect()]
    assert sorted(got) == [(0, 1, 1, 65536), (1, 1, 0, 65536)]
