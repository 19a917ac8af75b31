"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import trimmed
from usagelens.llm.shingles import mixed
from usagelens.sources.workspace import cut_lineage

#: Subwords are hashed into this many buckets, each with one embedding.
BUCKETS = 1 << 16
#: A subword is so many bytes in a row of the lower-case text.
SIZES = (2, 3, 4)
#: What is predicted where there is nothing to go by.
UNKNOWN = "und"
#: Bytes of text that are hashed together.
CHUNK = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[:128] = [not chr(b).isalpha() for b in range(128)]


def subwords(data: bytes) -> np.ndarray:
    """Buckets of all subwords of a text, whose runs of ASCII characters other than letters are one blank each."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    blank = _BLANK[raw]
    raw = np.where(blank, np.uint8(32), raw)[~(blank & np.concatenate([[False], blank[:-1]]))]
    found, code = [], np.zeros(len(raw), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(raw) < n:
            break
        code = code[: len(raw) - n + 1] * np.uint64(256) + raw[n - 1:]
        if n in SIZES:
            found.append(mixed(code + np.uint64(n << 40)) & np.uint64(BUCKETS - 1))
    return np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)


def _parts(text: str) -> Iterator[bytes]:
    """A text in lower case, in pieces that overlap so that no subword is lost."""
    data = text.lower().encode("utf-8", "surrogatepass")
    for start in range(0, max(1, len(data) - max(SIZES) + 1), CHUNK):
        yield data[start: start + CHUNK + max(SIZES) - 1]


def bucket_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text, ascending, and how often each occurs."""
    total = None
    for part in _parts(text or ""):
        found = subwords(part)
        if total is None and len(found) < BUCKETS:
            if len(part) <= CHUNK:
                return np.unique(found, return_counts=True)
        total = np.bincount(found, minlength=BUCKETS) + (0 if total is None else total)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


@dataclass
class LanguageModel:
    """``logits`` has per bucket its embedding times the softmax weights, so a text's logits are their mean over its subwords."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Scores under this are rejected: too often wrong on documents that the weights were not fitted to.
    least: float

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        return _softmax((means + self.bias) / self.temperature)

    def means(self, texts: list[str | None]) -> np.ndarray:
        """Mean logits of each text over all its subwords."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for k, text in enumerate(texts):
            for part in _parts(text or ""):
                found = subwords(part)
                sums[k] += np.bincount(found, minlength=BUCKETS) @ self.logits if len(found) > BUCKETS // 4 else self.logits[found].sum(0, dtype=float)
                counts[k] += len(found)
        return sums / np.maximum(counts, 1)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sums(values: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Sums of the rows of each owner; owners ascend."""
    result = np.zeros((owners, values.shape[1]))
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    result[owner[begins]] = np.add.reduceat(values, begins)
    return result


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, width: int = 12, passes: int = 8, rate: float = 0.2, batch: int = 32, seed: int = 11,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias by stochastic gradient descent with AdaGrad steps, in an order that the seed fixes.

    A row is its buckets and how often it has each; its features are the mean of their embeddings.
    Languages weigh alike, however many rows each has.
    """
    draw = np.random.default_rng(seed)
    embedding, weights, bias = draw.uniform(-1, 1, (BUCKETS, width)) / width, draw.normal(0, 0.1, (width, classes)), np.zeros(classes)
    squares = [np.full((BUCKETS, 1), 1e-8), np.full((width, classes), 1e-8), np.full(classes, 1e-8)]
    share = len(labels) / (np.maximum(np.bincount(labels, minlength=classes), 1) * classes)
    for _ in range(passes):
        order = draw.permutation(len(rows))
        for s in range(0, len(order), batch):
            mine = order[s: s + batch]
            sizes = [len(rows[i][0]) for i in mine]
            if not sum(sizes):
                continue
            x = np.concatenate([rows[i][0] for i in mine])
            weight = np.concatenate([rows[i][1] / rows[i][1].sum() for i in mine if len(rows[i][0])])
            owner = np.repeat(np.arange(len(mine)), sizes)
            means = _sums(embedding[x] * weight[:, None], owner, len(mine))
            error = _softmax(means @ weights + bias)
            error[np.arange(len(mine)), labels[mine]] -= 1
            error *= share[labels[mine], None] / len(mine)
            back = error @ weights.T
            by = np.argsort(x, kind="stable")
            begins = np.flatnonzero(np.diff(x[by], prepend=-1))
            unique, steps = x[by][begins], np.add.reduceat((back[owner] * weight[:, None])[by], begins)
            for value, squared, where, gradient in (
                (weights, squares[1], slice(None), means.T @ error), (bias, squares[2], slice(None), error.sum(0)),
                (embedding, squares[0], unique, steps),
            ):
                squared[where] += gradient**2 if squared.shape == value.shape else (gradient**2).mean(1, keepdims=True)
                value[where] -= rate * gradient / np.sqrt(squared[where])
    return embedding, weights, bias


def calibrate(means: np.ndarray, bias: np.ndarray, labels: np.ndarray, wanted: float) -> tuple[float, float]:
    """A temperature, and the least score that is accepted, from rows that the weights were not fitted to.

    The temperature is that of the least log loss. Accepted scores are right in a share of
    ``wanted`` at least, as far as these rows tell; the least score is 0 where all of them are.
    """
    if not len(labels):
        return 1.0, 0.0
    grid = 2.0 ** np.arange(-4, 4.01, 0.25)
    losses = [-np.log(np.maximum(_softmax((means + bias) / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = _softmax((means + bias) / temperature)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum(p.argmax(1)[order] == labels[order]) / np.arange(1, len(labels) + 1)
    good = np.flatnonzero(right >= wanted)
    if not len(good):
        return temperature, 1.0
    return temperature, 0.0 if good[-1] == len(labels) - 1 else float(p.max(1)[order][good[-1]])


def train(
    docs: DataFrame, learn_from: Column, max_rows: int = 4_000, wanted: float = 0.99,
    text_col: str = "text", lang_col: str = "lang",
) -> LanguageModel:
    """A model from the rows for which ``learn_from`` holds, whose text has a letter and whose language is known.

    It is fitted on a bounded sample: of each language the same share of ``max_rows``, or all its
    rows if these are fewer, by a hash of the row, ``max_rows`` in all at most. Only the sampled
    rows' counts of buckets, over whole texts, come to the driver; a fifth of the sample is kept
    for calibration. Languages beyond ``max_rows`` would have no sampled row. Without any row the
    model has no language, and all is predicted as unknown.
    """
    rows = docs.where(learn_from & has_letter(F.col(text_col)) & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(1), "text", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 62) - 1)) / float(1 << 62))
    sizes = cut_lineage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    share = max_rows / max(1, sizes.count())
    rates = sizes.select(F.col("lang").alias("of"), (F.lit(share) / F.col("n")).alias("rate"))
    drawn = rows.join(rates, F.col("lang") == F.col("of")).where(F.col("draw") < F.col("rate"))
    sample = cut_lineage(drawn.orderBy(F.col("draw") / F.col("rate"), "lang", "text").limit(max_rows).select("text", "lang"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bucket_counts(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
                ["lang", "buckets", "counts"],
            )

    taken = sample.mapInArrow(trimmed(counted), "lang string, buckets binary, counts binary").toArrow()
    taken = sorted(zip(*(taken.column(c).to_pylist() for c in ("lang", "buckets", "counts"))))
    languages = sorted({lang for lang, _, _ in taken}, key=lambda x: x.encode("utf-8", "surrogatepass"))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    found = [(np.frombuffer(b, np.int32), np.frombuffer(c, np.int32).astype(float)) for _, b, c in taken]
    labels = np.array([languages.index(lang) for lang, _, _ in taken])
    aside = np.arange(len(taken)) % 5 == 4
    embedding, weights, bias = fit([found[i] for i in np.flatnonzero(~aside)], labels[~aside], len(languages))
    logits = (embedding @ weights).astype(np.float32)
    means = np.array([logits[b].T @ (c / c.sum()) if len(b) else np.zeros(len(languages)) for b, c in (found[i] for i in np.flatnonzero(aside))])
    temperature, least = calibrate(means.reshape(-1, len(languages)), bias, labels[aside], wanted)
    return LanguageModel(languages, logits, bias, temperature, least)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row, over its whole text.

    ``lang_pred`` is the likeliest learned language and ``score`` its calibrated probability;
    null texts and those without a letter are unknown, with score 0. ``rejected`` marks
    predictions that should not be relied on: scores under the model's ``least``, and the unknown.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(has_letter(F.col(text_col)), F.col(text_col)).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    # As large as the buckets and the learned languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            some = [k for k, text in enumerate(texts) if text is not None and model.languages]
            languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if some:
                p = model.probabilities(model.means([texts[k] for k in some]))
                for k, best, value in zip(some, p.argmax(1).tolist(), p.max(1).tolist()):
                    languages[k], scores[k] = model.languages[best], min(1.0, value)
            rejected = [text is None or score < model.least for text, score in zip(texts, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
