"""Perplexities against a model counted text by text, and decisions on small corpora."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usagelens.llm import quality

WORDS = "the of and river stone garden window letter evening morning water silver mountain".split()


def clean(draw, n=60):
    return " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."


def grams_of(text, order):
    line = "\n" + text
    return [line[i: i + order] for i in range(len(line) - order + 1)]


def plain_model(texts, order):
    """Probability of an n-gram's last symbol after its others, by counting all texts."""
    levels = {order: Counter(g for t in texts for g in grams_of(t, order))}
    for n in range(order, 1, -1):
        levels[n - 1] = Counter(g[1:] for g in levels[n])
    discounts, sums = {}, {}
    for n, counts in levels.items():
        kinds = Counter(counts.values())
        n1, n2, n3, n4 = (kinds.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        discounts[n] = [max(0.05, min(k, k - (k + 1) * y * b / a if n1 and n2 and n3 and n4 else 0.5)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, taken = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            taken[g[:-1]] += discounts[n][min(c, 3) - 1]
        sums[n] = total, taken

    def probability(gram):
        n = len(gram)
        below = probability(gram[1:]) if n > 1 else 1 / quality.POINTS
        total, taken = sums[n]
        if not total.get(gram[:-1]):
            return below
        c = levels[n].get(gram, 0)
        own = c - discounts[n][min(c, 3) - 1] if c else 0.0
        return (own + taken[gram[:-1]] * below) / total[gram[:-1]]

    return probability


def perplexity(model, text, order):
    logs = [math.log(model(g)) for g in grams_of(text, order)]
    return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("order", [2, 4])
def test_perplexities_equal_those_of_plain_counts(documents, order):
    """Untrusted texts by all trusted ones, trusted ones by those of the other folds."""
    import zlib

    draw = random.Random(1)
    rows = [(i, clean(draw, 12) + draw.choice(["", "\0x", "é𝒳 " * 3, "\n\n"]), "en") for i in range(60)]
    rows += [(100 + i, "zx " * 5 + clean(draw, 5) + "ω", "en") for i in range(5)]
    got = {r["doc_id"]: r for r in quality.classify(documents(rows), documents(rows).where("doc_id < 50").select("doc_id"), order=order, quantile=0.5).collect()}
    texts = {i: t.replace("\0", "�") for i, t, _ in rows}
    fold = lambda i: zlib.crc32(str(i).encode()) % quality.FOLDS
    whole = plain_model([texts[i] for i in range(50)], order)
    for i in [0, 7, 23, 55, 101, 104]:
        model = whole if i >= 50 else plain_model([texts[j] for j in range(50) if fold(j) != fold(i)], order)
        assert got[i]["n_grams"] == len(grams_of(texts[i], order))
        assert math.isclose(got[i]["perplexity"], perplexity(model, texts[i], order), rel_tol=2e-3)


def test_probabilities_add_to_one(spark):
    draw = random.Random(5)
    texts = [clean(draw) for _ in range(20)]
    counts = Counter(g for t in texts for g in grams_of(t, 3))
    letters = sorted({c for t in texts for c in "\n" + t})
    rows = [("x", a + b + c, counts.get(a + b + c, 0)) for a, b in {(g[0], g[1]) for g in counts} for c in letters]
    model = quality.kneser_ney(spark.createDataFrame(rows, "lang string, gram string, c long"), 3, symbols=len(letters))
    sums = model.groupBy(F.substring("gram", 1, 2)).agg(F.sum("p_c").alias("p")).collect()
    # What contexts leave for symbols that no lower order has seen is spread over all symbols.
    assert sums and all(abs(r["p"] - 1) < 0.02 for r in sums)


def test_long_texts_are_cut_without_loss(monkeypatch):
    text, order = clean(random.Random(3), 300), 4
    want = sorted(grams_of(text, order))
    for held in (1, 2, 3, 5, 64, 10_000):
        monkeypatch.setattr(quality, "HELD_CHARS", held)
        lines, alphabet = list(quality._lines(text, order)), quality.Alphabet()
        codes, sizes = quality.gram_codes(lines, alphabet, order)
        assert sizes.sum() == len(codes) and sorted(alphabet.letters(codes, order)) == want


def test_junk_is_rejected_and_clean_text_kept(documents):
    draw = random.Random(2)
    rows = [(i, clean(draw), ["en", "fr", None][i % 3]) for i in range(240)]
    junk = [(1000 + i, " ".join(w.upper() + "$$#" for w in clean(draw).split()), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, "a", None), (2003, "Quiet river " * 60_000, "xx")]
    docs = documents(rows + junk + odd)
    trusted = docs.where("doc_id < 200").select("doc_id")
    got = {r["doc_id"]: r for r in quality.classify(docs, trusted, order=3).collect()}
    assert sum(got[i]["kept"] for i, *_ in rows) >= 205  # limits from a dozen documents a language
    assert not any(got[i]["kept"] for i, *_ in junk)
    assert all(got[i]["kept"] and got[i]["perplexity"] is None for i in (2000, 2001, 2002))
    assert got[2003]["n_grams"] == len("Quiet river " * 60_000) - 1
    assert all(r["kept"] for r in quality.classify(docs, trusted.limit(0)).collect())
    assert quality.classify(docs.limit(0), trusted).count() == 0


def test_shards_of_any_size_give_the_same(documents, monkeypatch):
    draw = random.Random(8)
    rows = [(i, clean(draw, 20) if i % 9 else "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(400)), draw.choice(["en", "de"])) for i in range(80)]
    docs = documents(rows)
    trusted = docs.where("doc_id < 60").select("doc_id")
    read = lambda: sorted(map(tuple, quality.classify(docs, trusted).collect()), key=str)
    want = read()
    for name, value in (("SHARD_CHARS", 2_000), ("BLOCK_ROWS", 3), ("ALPHABET", 4_000), ("HELD_CHARS", 900)):
        monkeypatch.setattr(quality, name, value)
        assert read() == want


def test_letters_outside_latin_are_told_apart(documents):
    draw = random.Random(6)
    words = "река камень сад окно письмо вечер утро вода серебро гора".split()
    line = lambda: " ".join(draw.choice(words) for _ in range(60))
    mixed = lambda text: "".join(draw.choice("щъыэюяжфхц") if c != " " else c for c in text)
    rows = [(i, line(), "ru") for i in range(240)] + [(1000 + i, mixed(line()), "ru") for i in range(20)]
    docs = documents(rows)
    got = {r["doc_id"]: r for r in quality.classify(docs, docs.where("doc_id < 220").select("doc_id")).collect()}
    assert sum(got[i]["kept"] for i in range(240)) >= 232
    assert not any(got[1000 + i]["kept"] for i in range(20))


def test_rare_languages_go_by_model_and_limit_of_all(documents):
    draw = random.Random(7)
    rows = [(i, clean(draw), "en") for i in range(220)] + [(1000 + i, clean(draw), "xx") for i in range(48)]
    docs = documents(rows)
    trusted = docs.where("doc_id < 220 OR (doc_id >= 1000 AND doc_id < 1008)").select("doc_id")
    got = {r["doc_id"]: r for r in quality.classify(docs, trusted).collect()}
    assert sum(got[1008 + i]["kept"] for i in range(40)) >= 38
    assert got[1008]["threshold"] != got[0]["threshold"] and got[1008]["perplexity"] is not None


def test_rows_are_kept_each_for_itself(documents):
    """Rows of null or repeated ids stay or go by their own text, and keep all their columns."""
    draw = random.Random(9)
    junk = "#$%& ZZZZ QQQQ " * 20
    rows = [(i, clean(draw), "en") for i in range(230)]
    odd = [(None, clean(draw), "en"), (None, junk, "en"), (225, junk, "en"), (700, junk, None), (700, None, None), (700, "", "en")]
    docs = documents(rows + odd)
    kept = quality.kept_rows(docs, docs.where("doc_id < 220 AND text NOT LIKE '#%'").select("doc_id"))
    assert kept.columns == docs.columns
    got = kept.collect()
    assert not [r for r in got if r["text"] == junk]
    assert len([r for r in got if r["doc_id"] is None]) == 1 and len([r for r in got if r["doc_id"] == 700]) == 2
    assert len(got) >= 230 and {r["key"] for r in got} == {"clash"}


def test_texts_of_very_many_letters(documents):
    text = "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x1F000)]))
    docs = documents([(1, text, "zz"), (2, text[::-1], "zz"), (3, "plain words here", "en")])
    got = {r["doc_id"]: r for r in quality.classify(docs, docs.where("doc_id = 3").select("doc_id")).collect()}
    assert got[1]["n_grams"] == got[2]["n_grams"] == len(text) - 2 and np.isfinite(got[1]["perplexity"])


def test_counting_a_shard_holds_little_beside_its_text():
    draw = random.Random(4)
    texts = ["".join(draw.choices("abcdefghij ", k=200_000)) for _ in range(16)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    blocks = pa.table({"shard": [0], "block": [sink.getvalue().to_pybytes()], "first": [0]})
    marked = pa.table({"row": pa.array([0, 3], pa.int64()), "fold": pa.array([0, 1], pa.int32())})
    tracemalloc.start()
    found = quality._counted(4, "text", "lang")(blocks, marked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows > 10_000 and peak < 40_000_000, peak
