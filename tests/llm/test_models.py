"""Toxicity and secrets on small corpora with known answers."""

import random

import numpy as np
from pyspark.sql import functions as F

from usagelens.llm import secrets, toxicity

WORDS = "the of and river stone garden window letter evening morning water silver mountain".split()


def clean(draw, n=60):
    return " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_machine_learns_words_and_pairs(documents, spark):
    draw = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        text, kind = clean(draw), i % 4
        toxic = kind == 0
        extra = {0: "blorfer zunk", 1: "blorfer", 2: "zunk", 3: ""}[kind]
        rows.append((i, f"{text} {extra}"))
        marks.append((i, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, "river " * 100_000 + "blorfer zunk")]
    docs, labels = documents(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, machine).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    right = sum(got[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert got[9002]["predicted"] == 1 and got[9000]["score"] == got[9001]["score"] and got[9000]["predicted"] == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, nothing).collect()} == {0}
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_a_word_that_says_nothing_alone_is_learnt_beside_another(documents, spark):
    """``zunk`` is as common in toxic text as elsewhere; ``blorfer`` is toxic beside it only, and rare."""
    draw, rows, marks = random.Random(31), [], []
    for i in range(3_000):
        kind = "both" if i % 25 == 0 else "insult" if i % 25 == 1 else "group" if i % 25 in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14) else "none"
        toxic = kind == "both" or (kind == "none" and i % 25 == 24)
        extra = {"both": "blorfer zunk", "insult": "blorfer", "group": "zunk", "none": "gahk" if toxic else ""}[kind]
        rows.append((i, f"{clean(draw, 12)} {extra}"))
        marks.append((i, int(toxic)))
    with_zunk = [m for (_, t), (_, m) in zip(rows, marks) if "zunk" in t]
    assert abs(np.mean(with_zunk) - np.mean([m for _, m in marks])) < 0.02
    docs, labels = documents(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    assert set(toxicity.term_buckets("zunk")) & set(machine.buckets.tolist())
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, machine).collect()}
    held = [(got[i], m) for i, m in marks if i % 3 == 1]
    assert sum(p == m for p, m in held) >= 0.98 * len(held)


def test_scores_equal_the_sum_over_all_pairs(documents):
    draw = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    buckets = np.array(sorted({b for w in words for b in toxicity.term_buckets(w)}))
    machine = toxicity.FactorizationMachine(buckets, -0.4, draw.normal(0, 1, len(buckets)), draw.normal(0, 0.5, (len(buckets), 3)))
    texts = ["alpha beta beta", "Gamma. delta, EPSILON alpha", "nothing known", "", None, "beta " * 5_000]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(list(enumerate(texts))), machine).collect()}
    for i, text in enumerate(texts):
        x = sorted({int(np.searchsorted(buckets, b)) for w in toxicity.words_of(text) if w in words for b in toxicity.term_buckets(w)})
        z = -0.4 + sum(machine.weights[a] for a in x) + sum(machine.factors[a] @ machine.factors[b] for n, a in enumerate(x) for b in x[:n])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_pair_term_of_the_machine():
    rows = [[0], [1], [0, 1], []] * 50
    bias, w, v = toxicity.fit(rows, np.array([0.0, 0.0, 1.0, 0.0] * 50), 2, steps=2000)
    machine = toxicity.FactorizationMachine(np.arange(2), bias, w, v)
    value = lambda x: bias + w[x].sum() + 0.5 * ((v[x].sum(0) ** 2 - (v[x] ** 2).sum(0)).sum())
    assert value([0, 1]) > 1 > -1 > max(value([0]), value([1])) and machine.score(None) < 0.5


def test_secrets_are_told_from_words_and_numbers(documents):
    draw = random.Random(5)
    rows = []
    for i in range(120):
        value = "".join(draw.choice("0123456789abcdef") for _ in range(20))
        key = "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        word = draw.choice(WORDS) + draw.choice(WORDS) + draw.choice(WORDS) + "watersilver"
        number = "".join(draw.choice("0123456789") for _ in range(16))
        rows.append((i, f"{clean(draw, 8)} password={value} then {key}, {word} or {number} end", "en", "src"))
    rows += [(500, None), (501, ""), (502, "river " * 50_000 + "x")]
    docs = documents(rows)
    got = secrets.scan(docs, learn_from=F.col("doc_id") % 3 != 1)
    found = got.collect()
    assert len(found) == 480 and {r["doc_id"] for r in found} == set(range(120))
    held = [r for r in found if r["doc_id"] % 3 == 1 and r["label"] is not None]
    assert len(held) > 100 and sum(r["predicted"] == r["label"] for r in held) >= 0.98 * len(held)
    clear = {r["doc_id"]: r["text"] for r in secrets.redacted(docs, got).collect()}
    assert clear[0].count("[SECRET]") == sum(r["predicted"] for r in found if r["doc_id"] == 0) >= 2 and "AKIA" not in clear[0]
    assert clear[500] is None and clear[501] == ""
    assert secrets.scan(docs.limit(0)).count() == 0
    none = secrets.scan(documents([(1, "only one " + "a" * 30)])).collect()
    assert [(r["score"], r["predicted"]) for r in none] == [(None, 0)]


def test_short_secrets_digests_and_rare_words(documents):
    draw = random.Random(9)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    rows = []
    for i in range(90):
        short = pick("abcdefgh", 3) + draw.choice("@!#") + pick("0123456789", 2) + pick("KLMNOP", 3)
        rows.append((i, f"{clean(draw, 6)} password: '{short}' and commit {pick('0123456789abcdef', 40)} or number {pick('0123456789', 16)} end", "en"))
    rows += [(1000, "token=ab1.cd2.ef3 then", "en"), (1001, "zephyr quokka zephyr", "xx")]
    docs = documents(rows)
    assert {"zephyr", "quokka"} <= secrets.dictionary(docs, words=5)
    got = secrets.scan(docs, learn_from=F.col("doc_id") % 3 != 1).collect()
    held = [r for r in got if r["doc_id"] < 90 and r["doc_id"] % 3 == 1]
    assert sorted({(r["length"], r["label"], r["predicted"]) for r in held}) == [(9, 1, 1), (16, 0, 0), (40, 0, 0)] and len(held) == 90
    assert [(r["start"], r["length"]) for r in got if r["doc_id"] == 1000] == [(6, 11)]


def test_url_passwords_and_private_keys_are_candidates(documents):
    body = "\n".join(["MIIEpAIBAAKCAQEA" + "abCD12+/" * 6] * 3)
    rows = [(1, "see postgres://bob:s3cr3t@host/db then"), (2, f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"), (3, "ratio 3:4@5 and http://host:80/path")]
    found = secrets.candidates(documents(rows), frozenset()).withColumn("label", secrets.format_labels()).collect()
    assert sorted((r["doc_id"], r["value"][:8], r["label"]) for r in found) == [(1, "s3cr3t", 1), (2, "MIIEpAIB", 1)]
    assert [r["size"] for r in found if r["doc_id"] == 2] == [len(body)]


def test_the_name_before_a_value_is_no_feature():
    value = "Zx81kQmW02Lp77"
    plain = secrets.describe(value, "please look: ", " thanks", "src", frozenset())
    assert plain == secrets.describe(value, "please password=", " thanks", "src", frozenset())
    assert secrets.describe(value, "my secret token and then key: ", "", "src", frozenset())[secrets.FEATURES.index("hint_before")] == 1


def test_dictionary_has_all_scripts_and_ranks_by_language(documents):
    rows = [(i, "река камень " + ("лес" if i else ""), "ru") for i in range(5)] + [(9, "straße weg", "de"), (10, None, "de"), (11, "河流水 石头山", None)]
    assert secrets.dictionary(documents(rows), words=2) == {"река", "камень", "straße", "weg", "河流水", "石头山"}


def test_scores_equal_the_forest_row_by_row(documents):
    """The scan against every tree walked by hand."""
    draw = random.Random(21)
    rows = [(i, f"{clean(draw, 5)} password={''.join(draw.choice('0123456789abcdef') for _ in range(18))} or {draw.randrange(10**16, 10**17)} end", "en", "src") for i in range(60)]
    docs = documents(rows)
    found = secrets.candidates(docs, secrets.dictionary(docs)).withColumn("label", secrets.format_labels())
    model = secrets.train(found)
    got = {(r["doc_id"], r["start"]): r["score"] for r in secrets.scan(docs).collect()}
    for r in found.collect()[:40]:
        x = [r[f] for f in secrets.FEATURES]
        votes = []
        for tree in model.trees:
            node = tree._call_java("rootNode")
            while node.numDescendants() > 0:
                split = node.split()
                node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
            stats = list(node.impurityStats().stats())
            votes.append(stats[1] / sum(stats))
        assert abs(got[r["doc_id"], r["start"]] - np.mean(votes)) < 1e-9
