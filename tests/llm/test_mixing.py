"""Weighted fair queueing: targets, nearness, repeats and reruns."""

import pytest
from pyspark.sql import functions as F

from usagelens.llm import mixing


def filled(sizes, weights=(1, 2, 3), repeat=3):
    """Targets by handing the excess round until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(repeat * sizes[s] for s in full)
        room = sum(weight[s] for s in order if s not in full)
        target = {s: repeat * sizes[s] if s in full else rest * weight[s] / room for s in order}
        over = {s for s in order if s not in full and target[s] > repeat * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 5, None: 40, "d": 1}, {"x": 7}, {"a": 0, "b": 50}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def texts():
    rows = [(i, " ".join(["w"] * (1 + i % 23)), "en", f"s{i % 3}") for i in range(600)]
    rows += [(1000 + i, "tiny one", "en", "t") for i in range(4)]
    return rows + [(2000, None, None, None), (2001, "", "en", "s1"), (2002, "a b\tc", "en", None)]


def test_mix_comes_near_its_targets(documents):
    mix = mixing.mix_sources(documents(texts()))
    rows = mix.docs.collect()
    assert len(rows) == 607
    assert {r["doc_id"]: r["size"] for r in rows if r["doc_id"] >= 2000} == {2000: 0, 2001: 0, 2002: 2}
    taken, target = {}, {}
    for r in rows:
        assert r["taken"] in {r["size"] * k for k in range(4)}
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 25 for s in taken)
    assert sum(taken.values()) <= mix.budget


def test_reruns_agree_whatever_the_partitions(documents):
    first = mixing.mix_sources(documents(texts())).docs
    second = mixing.mix_sources(documents(texts()).repartition(7, "n", F.rand(1))).docs
    assert sorted(first.collect(), key=str) == sorted(second.collect(), key=str)


def test_empty_table_and_empty_texts(documents):
    assert mixing.mix_sources(documents([])).docs.count() == 0
    rows = mixing.mix_sources(documents([(1, "", "en", "a"), (2, None, "en", "b")])).docs.collect()
    assert [(r["size"], r["taken"], r["target"]) for r in rows] == [(0, 0, 0.0)] * 2


def test_mixed_documents_repeat_as_often_as_taken(documents):
    docs = documents(texts())
    mix = mixing.mix_sources(docs)
    out = mixing.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    times = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert times == {r["doc_id"]: r["taken"] // r["size"] for r in mix.docs.collect() if r["taken"]}


def test_null_and_repeated_ids_are_rows_of_their_own(documents):
    rows = [(1, f"one {'w ' * (i % 5)}x", "en", f"s{i % 3}") for i in range(90)] + [(None, f"none {i}", "en", "s1") for i in range(40)]
    rows += [(1, "same row", "en", "s2")] * 50 + [(i, "w w w", "en", "s0") for i in range(100, 160)]
    docs = documents(rows)
    mix = mixing.mix_sources(docs)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = out.select("doc_id", F.size(F.split(F.trim("text"), " +")).alias("words"), "source").collect()
    total = sum(r["words"] for r in found)
    assert mix.budget - 10 <= total <= mix.budget
    assert sum(r["doc_id"] is None for r in found) > 0
    target = {r["source"]: r["target"] for r in mix.targets.collect()}
    for source in target:
        assert abs(sum(r["words"] for r in found if r["source"] == source) - target[source]) <= 12
