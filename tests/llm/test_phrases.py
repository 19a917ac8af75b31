"""Phrases against a count over all texts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from usagelens.llm import phrases


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", piece) for piece in re.split("[.,;:!?\x0a-\x0d]", lower)]


def counts(rows, longest):
    found, total = Counter(), Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            total["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found["und" if lang is None else lang, tuple(words[i: i + k])] += 1
    return found, total


def brute_force(rows, least, longest, top):
    found, total = counts(rows, longest)
    frequent = {key: c for key, c in found.items() if c >= least}
    result = {}
    for (lang, phrase), a in frequent.items():
        if len(phrase) < 2:
            continue
        if any(other == lang and len(p) > len(phrase) and c >= a and any(p[i: i + len(phrase)] == phrase for i in range(len(p))) for (other, p), c in frequent.items()):
            continue
        cuts = []
        for k in range(1, len(phrase)):
            l, r = found[lang, phrase[:k]], found[lang, phrase[k:]]
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        result.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, total[lang], -score)
        for lang, found in result.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def documents_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return docs.withColumns({c: F.lit("clash") for c in ("c", "n", "words", "phrase", "a", "l", "r", "score", "rank", "k", "hash")})


def got(spark, rows, **options):
    found = phrases.collocations(documents_of(spark, rows), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, found.collect()))


def drawn(n, seed):
    draw = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "d", "É", "zeta\x0beta", "x-y", "of", "the", "a b"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!"]
    made = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randrange(30)))
        if draw.random() < 0.4:
            text += " one Two three four five six"
        made.append((i, draw.choice([text, text, text, None if i % 7 == 0 else ""]), draw.choice(["en", "en", "en", "fr", None, "und"])))
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_counting_everything(spark, seed):
    rows = drawn(160, seed)
    want = brute_force(rows, 5, 5, 40)
    assert len(want) > 20
    assert got(spark, rows, least=5, top=40) == want


def test_what_the_sample_misses_is_found(spark, monkeypatch):
    """A sample without any row proposes nothing; the border fails, and one expansion finds the rest at every length."""
    rows, passes = drawn(120, 3), []
    real = phrases._pass
    monkeypatch.setattr(phrases, "_pass", lambda texts, known, frequent, lengths, least, only=None: passes.append(frequent is not None) or real(texts, known, frequent, lengths, least, only))
    docs = documents_of(spark, rows)
    monkeypatch.setattr(phrases, "_sampled", lambda texts, one_in: texts.limit(0))
    found, total = counts(rows, 5)
    want = {(lang, len(p), " ".join(p), c) for (lang, p), c in found.items() if c >= 10} | {(lang, 0, "", n) for lang, n in total.items()}
    result = [tuple(r) for r in phrases.frequent_phrases(docs, least=10).collect()]
    assert len(result) == len(set(result)) and set(result) - {(x, 0, "", 0) for x in total} == want - {(x, 0, "", 0) for x in total}
    assert passes == [False] * 4 + [True] and max(len(p.split()) for _, _, p, _ in want) == 5


def test_failures_of_any_length_are_found(spark, monkeypatch):
    """The sample holds some of the words only, so that failures are words, pairs and longer phrases at once."""
    rows = drawn(150, 11)
    monkeypatch.setattr(phrases, "_sampled", lambda texts, one_in: texts.withColumn("text", F.regexp_replace("text", "(?i)beta|two three|of the", ".")))
    found, _ = counts(rows, 5)
    want = {(lang, " ".join(p), c) for (lang, p), c in found.items() if c >= 8}
    result = [(r["lang"], r["phrase"], r["c"]) for r in phrases.frequent_phrases(documents_of(spark, rows), least=8, slack=1.0, one_in=1).where("words > 0").collect()]
    assert len(result) == len(set(result)) and set(result) == want


def test_a_full_filter_only_costs(spark, monkeypatch):
    rows = drawn(80, 5)
    monkeypatch.setattr(phrases.Known, "has", lambda self, hashes: hashes == hashes)
    found, _ = counts(rows, 5)
    want = {(lang, " ".join(p), c) for (lang, p), c in found.items() if c >= 8}
    assert {(r["lang"], r["phrase"], r["c"]) for r in phrases.frequent_phrases(documents_of(spark, rows), least=8).where("words > 0").collect()} == want


def test_products_are_exact():
    from decimal import Decimal

    assert Decimal(1000) * 10**15 * 10**18 < 10**38


def test_repeated_words_and_ties(spark):
    rows = [(i, "a a a a a a. b b", "en") for i in range(20)] + [(99, "c d " * 30, "en"), (None, "c d " * 30, None)]
    assert got(spark, rows, least=20, top=2000) == brute_force(rows, 20, 5, 2000)


def test_long_texts_are_whole(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 1 << 10)
    rows = [(1, "one two, " * 2000, "en"), (2, "no mark here " * 400, "en"), (3, None, "en"), (4, "", None), (5, ".,;", "de")]
    assert got(spark, rows, least=50, top=2000) == brute_force(rows, 50, 5, 2000)


def test_no_rows(spark):
    assert got(spark, [(1, None, None)]) == []
    assert phrases.collocations(documents_of(spark, [(1, "a", "b")]).limit(0)).collect() == []
