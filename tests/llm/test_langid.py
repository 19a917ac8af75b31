"""Held-out accuracy, calibration, and defined results of odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import langid

# A few words of each language.
WORDS = {
    "en": "the and of water house with through night light thing would should there which".split(),
    "de": "und der die das nicht schon über straße wasser haus durch nacht licht würde".split(),
    "ru": "и не что вода дом через ночь свет вещь должен который там время слово".split(),
    "zh": "水 房子 夜晚 光 东西 应该 那里 时间 话语 我们 他们 因为 所以 但是".split(),
}


def text_of(draw, lang, words):
    return " ".join(draw.choices(WORDS[lang], k=words))


@pytest.fixture(scope="module")
def drawn():
    draw = random.Random(4)
    return [(i, text_of(draw, lang, draw.randrange(3, 60)), lang) for i, lang in enumerate(draw.choices(list(WORDS), weights=[20, 5, 3, 1], k=900))]


@pytest.fixture(scope="module")
def model(spark, drawn):
    docs = spark.createDataFrame(drawn, "doc_id long, text string, lang string")
    return langid.train(docs, F.col("doc_id") % 3 != 0, max_rows=300)


def test_held_out_accuracy_and_order_of_rows(spark, drawn, model):
    held = [row for row in drawn if row[0] % 3 == 0]
    docs = spark.createDataFrame([row[:2] for row in held], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in held]) >= 0.99
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs.repartition(5), model).collect()}
    assert got == again


def test_scores_equal_a_sum_over_subwords(model):
    text = "Die Straße und the water, 1234 -- нет"
    found = langid.subwords(text.lower().encode())
    want = langid._softmax((model.logits[found].astype(float).mean(0) + model.bias)[None] / model.temperature)[0]
    assert np.allclose(model.probabilities(model.means([text]))[0], want, atol=1e-5)


def test_subwords_are_those_of_letters():
    assert langid.subwords(b"ab12  ;cd").tolist() == langid.subwords(b"ab cd").tolist()
    assert len(langid.subwords(b"abc")) == 4 + 3 + 2


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "a"), (None, "the water"), (5, "the " * 700_000), (5, "das haus über"), (6, "\u0000 � 水")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "lang", "lang_pred", "rejected", "n", "draw", "of")})
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    kinds = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in got if r["doc_id"] in (1, 2, 3)}
    assert set(kinds.values()) == {("und", 0.0, True)}
    assert [r["lang_pred"] for r in got if r["doc_id"] is None] == ["en"]
    assert {r["lang_pred"] for r in got if r["doc_id"] == 5} == {"en", "de"}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_learns_only_where_it_may(spark):
    rows = [(1, "water the", "en"), (2, "wasser das", "de"), (3, "вода", None), (None, "vatten", "sv"), (4, "123", "num"), (5, None, "xx")]
    docs = spark.createDataFrame(rows * 30, "doc_id long, text string, lang string")
    assert langid.train(docs, F.col("doc_id") != 2).languages == ["en"]
    none = langid.train(docs, F.lit(False))
    assert none.languages == []
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_a_hot_language_leaves_the_rare_ones_their_share(spark, drawn):
    docs = spark.createDataFrame(drawn, "doc_id long, text string, lang string").withColumn("draw", F.lit("clash"))
    assert langid.train(docs, F.lit(True), max_rows=80).languages == sorted(WORDS)


def test_calibration():
    draw = np.random.default_rng(1)
    logits = draw.normal(0, 1, (400, 3))
    right = np.array([draw.choice(3, p=p) for p in langid._softmax(logits)])
    temperature, least = langid.calibrate(logits * 4, np.zeros(3), right, 0.8)
    assert 3 <= temperature <= 5.7
    p = langid._softmax(logits * 4 / temperature)
    accepted = p.max(1) >= least
    assert 0 < accepted.mean() < 1 and (p.argmax(1) == right)[accepted].mean() >= 0.8
    assert langid.calibrate(np.zeros((0, 3)), np.zeros(3), np.zeros(0, int), 0.9) == (1.0, 0.0)
