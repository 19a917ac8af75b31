"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import trimmed
from usagelens.sources.workspace import cut_lineage

#: Terms are hashed into this many buckets.
BUCKETS = 1 << 18
#: Beginnings of a word that are terms besides the word itself.
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def term_buckets(word: str) -> list[int]:
    """Buckets of a word and of its beginnings; endings differ where a language inflects."""
    terms = ["=" + word, *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for t in terms]


@dataclass
class FactorizationMachine:
    """score(x) = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>), over the chosen buckets present in x."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    _known: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self._place = {int(b): i for i, b in enumerate(self.buckets)}

    def features(self, text: str | None) -> list[int]:
        if len(self._known) > 300_000:
            self._known.clear()
        found: set[int] = set()
        for word in words_of(text):
            mine = self._known.get(word)
            if mine is None:
                mine = tuple(self._place[b] for b in term_buckets(word) if b in self._place)
                self._known[word] = mine
            if mine:
                found.update(mine)
        return sorted(found)

    def score(self, text: str | None) -> float:
        x = self.features(text)
        value = self.bias
        if x:
            v = self.factors[x]
            value += self.weights[x].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def fit(rows: list[list[int]], labels: np.ndarray, size: int, rank: int = 8, steps: int = 8_000, rate: float = 0.1, decay: float = 1e-4, seed: int = 7):
    """Bias, weights and factors by AdaGrad on the logistic loss: about ``steps`` batches, in an order that the seed fixes."""
    draw = np.random.default_rng(seed)
    base = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    bias, w, v = float(np.log(base / (1 - base))), np.zeros(size), draw.normal(0, 0.01, (size, rank))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    filled = [i for i, row in enumerate(rows) if row]
    empty = labels[[i for i, row in enumerate(rows) if not row]] if len(filled) < len(rows) else labels[:0]
    for _ in range(-(-steps // max(1, -(-len(filled) // 64)))):
        order = draw.permutation(filled)
        for s in range(0, len(order), 64):
            batch = order[s: s + 64].tolist()
            x = np.concatenate([rows[i] for i in batch]).astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            sums = np.zeros((len(batch), rank))
            np.add.at(sums, owner, v[x])
            squares = np.bincount(owner, (v[x] ** 2).sum(1), len(batch))
            z = bias + np.bincount(owner, w[x], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]
            # The rows without any term pull at the bias alone, with their share of a batch.
            share = len(batch) / max(1, len(filled))
            gradient = error.sum() + share * float((1 / (1 + np.exp(-bias)) - empty).sum())
            gb += gradient**2
            bias -= rate * gradient / np.sqrt(gb)
            unique, at = np.unique(x, return_inverse=True)
            dw = np.bincount(at, error[owner], len(unique)) + decay * w[unique]
            dv = np.zeros((len(unique), rank))
            np.add.at(dv, at, error[owner, None] * (sums[owner] - v[x]))
            dv += decay * v[unique]
            gw[unique] += dw**2
            gv[unique] += dv**2
            w[unique] -= rate * dw / np.sqrt(gw[unique])
            v[unique] -= rate * dv / np.sqrt(gv[unique])
    return bias, w, v


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_evidence: float = 20.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> FactorizationMachine:
    """A machine from labelled documents, those of ``labels`` (``doc_id``, ``toxic``).

    Fitted on a bounded sample: the ``max_rows`` labelled ids of smallest hash. Per bucket it is
    counted, over the whole texts of the sample, in how many toxic and other documents it occurs;
    buckets of a likelihood ratio of ``min_evidence`` or more are terms. Then it is counted again
    among the documents that have such a term, and the buckets that tell toxic from other ones
    there are terms too: a word may say nothing alone and much beside another one, which is what
    the machine's pairs are for. There is no limit to the number of terms but that of the buckets. Only those counts and each sampled
    document's terms come to the driver. Without labelled documents all scores are near 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    chosen = cut_lineage(chosen.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(max_rows))
    last = chosen.agg(F.max("draw")).first()[0]
    if last is None:
        return FactorizationMachine(np.zeros(0, np.int64), -7.0, np.zeros(0), np.zeros((0, 1)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.xxhash64("doc_id") <= last)
    # At most max_rows ids, so they may be broadcast.
    sample = cut_lineage(texts.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("text", "toxic"))

    alone = _telling(sample, np.zeros(0, np.int64), min_evidence)
    buckets = np.union1d(alone, _telling(sample, alone, min_evidence)) if len(alone) else alone
    machine = FactorizationMachine(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), 1)))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([shared.value.features(x.as_py()) for x in batch.column("text")], pa.list_(pa.int32())), batch.column("toxic")], ["x", "toxic"],
            )

    rows = sorted((list(r["x"]), int(r["toxic"] > 0)) for r in sample.mapInArrow(described, "x array<int>, toxic int").collect())
    machine.bias, machine.weights, machine.factors = fit([x for x, _ in rows], np.array([y for _, y in rows], float), len(buckets))
    machine._known.clear()
    return machine


def _telling(sample: DataFrame, beside: np.ndarray, min_evidence: float) -> np.ndarray:
    """The buckets whose presence goes with the label, by likelihood ratio; given buckets, among the documents that have any of these."""
    wanted = np.zeros(BUCKETS, bool)
    wanted[beside] = True
    wanted = sample.sparkSession.sparkContext.broadcast(wanted) if len(beside) else None

    # Bucket -1 counts the documents themselves.
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                found = list({b for word in words_of(text.as_py()) for b in term_buckets(word)})
                if wanted is None or wanted.value[found].any():
                    counts[int(toxic.as_py() > 0), found] += 1
                    documents[int(toxic.as_py() > 0)] += 1
        some = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(counts[1, some], documents[1])), pa.array(np.append(counts[0, some], documents[0]))], ["bucket", "t", "c"])

    counted = sample.mapInArrow(trimmed(occurrences), "bucket long, t long, c long").groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = cut_lineage(counted)
    totals = counted.where("bucket = -1").first()
    tox, clean = (float(totals["t"]), float(totals["c"])) if totals else (0.0, 0.0)
    n = tox + clean
    part = lambda k, m: F.when(k > 0, k * F.log(k * n / m)).otherwise(0.0)
    t, c, both = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    evidence = 2 * (
        part(t, both * tox) + part(c, both * clean) + part(F.lit(tox) - t, (F.lit(n) - both) * tox) + part(F.lit(clean) - c, (F.lit(n) - both) * clean)
    )
    strong = counted.where((F.col("bucket") >= 0) & (both < n)).withColumn("evidence", evidence).where(F.col("evidence") >= min_evidence)
    return np.sort(strong.select("bucket").toArrow().column("bucket").to_numpy())


def score(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row, over its whole text; null and empty texts have the score of no terms."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(trimmed(run), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
