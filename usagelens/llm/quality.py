"""Quality by language model: interpolated modified Kneser-Ney n-grams of trusted text, and perplexity thresholds.

N-grams are those of whole code points. Their tables are spread over the n-grams and grow with
the corpus; texts stay in shards, to which the values of the n-grams that they have are brought.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import in_short_batches, trimmed, trimmed_group
from usagelens.sources.bucketed import write_bucketed
from usagelens.sources.workspace import cut_lineage, written_alone

#: Trusted documents are dealt into so many folds; each is scored by the counts of the others. The values of an
#: n-gram, one of all folds and one without each, are 16 bits each of one long.
FOLDS = 3
#: Name of the model of all languages together; it scores rows whose language has no model.
POOLED = "*"
#: Code points there can be; one never seen has this share.
POINTS = 0x110000
#: Characters whose n-grams are taken together, characters and rows of a shard, and rows of a block.
HELD_CHARS, SHARD_CHARS, SHARD_ROWS, BLOCK_ROWS = 1 << 19, 1 << 26, 1 << 20, 512
#: N-grams of a table that are text at one time.
TABLE_ROWS = 1 << 16
#: Letters of a shard at most, and letters beyond which a text is read without those outside the basic plane.
ALPHABET, MANY_LETTERS = (1 << 16) - 2, 1 << 15
#: Logarithms are whole numbers of this fraction, so sums do not depend on an order.
LOG_UNIT = 1 << 10
LONGEST = 4


def _suffix(gram: Column, n: int) -> Column:
    return F.substring(gram, 2, n - 1)


def _context(gram: Column, n: int) -> Column:
    return F.substring(gram, 1, n - 1)


def kneser_ney(
    counts: DataFrame, order: int, symbols: int = POINTS, columns: tuple[str, ...] = ("c",),
    suffix: Callable[[Column, int], Column] = _suffix, context: Callable[[Column, int], Column] = _context,
) -> DataFrame:
    """Interpolated modified Kneser-Ney probabilities: ``lang, gram`` and a ``p_`` column for each of ``columns``.

    ``counts`` has ``lang, gram`` and a column of counts per model, whose n-grams are scored side
    by side; n-grams that a model has not seen count 0 there and get what their contexts leave
    them. The highest order has the counts themselves, a lower one the number of different
    symbols seen before its n-gram. Three discounts per order, language and model, for counts of
    1, 2 and more, come from the counts of counts. Each order's table is joined by n-gram to the
    next lower one, and by context to its sums: joins of tables spread over their n-grams, none
    of them a window. ``suffix`` and ``context`` give an n-gram of n symbols without its first
    and its last one; ``symbols`` is how many symbols there can be.
    """
    level, levels = counts, []
    for n in range(order, 0, -1):
        levels.append((n, level))
        if n > 1:
            level = cut_lineage(level.groupBy("lang", suffix(F.col("gram"), n).alias("gram")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in columns]))
    lower = None
    for n, level in reversed(levels):
        ones = level.groupBy("lang").agg(*[F.count_if(F.col(c) == k).cast("double").alias(f"{c}_n{k}") for c in columns for k in (1, 2, 3, 4)])
        cut = level.join(cut_lineage(ones.select("lang", *[d for c in columns for d in _discounts(c)])), "lang")
        taken = {c: F.when(F.col(c) > 0, F.element_at(F.col(f"d_{c}"), F.least(F.col(c), F.lit(3)).cast("int"))).otherwise(0.0).alias(f"d_{c}") for c in columns}
        cut = cut.select("lang", "gram", context(F.col("gram"), n).alias("context"), *columns, *taken.values())
        sums = cut.groupBy("lang", "context").agg(*[F.sum(c).alias(f"t_{c}") for c in columns], *[F.sum(f"d_{c}").alias(f"s_{c}") for c in columns])
        own = cut.join(sums, ["lang", "context"])
        if lower is not None:
            below = lower.select("lang", F.col("gram").alias("below"), *[F.col(f"p_{c}").alias(f"q_{c}") for c in columns])
            own = own.withColumn("below", suffix(F.col("gram"), n)).join(below, ["lang", "below"])
        value = {}
        for c in columns:
            q = F.lit(1 / symbols) if lower is None else F.col(f"q_{c}")
            # A context that the model has not seen leaves all to the order below.
            value[f"p_{c}"] = F.when(F.col(f"t_{c}") > 0, (F.col(c) - F.col(f"d_{c}") + F.col(f"s_{c}") * q) / F.col(f"t_{c}")).otherwise(q)
        lower = cut_lineage(own.select("lang", "gram", *[v.alias(k) for k, v in value.items()]))
    return lower


def _discounts(c: str) -> list[Column]:
    """The three discounts of a model as one array, from its counts of counts; where one is zero the estimates do not exist, and half a count is taken."""
    n = [F.col(f"{c}_n{k}") for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    enough = (n[0] > 0) & (n[1] > 0) & (n[2] > 0) & (n[3] > 0)
    each = [F.greatest(F.lit(0.05), F.least(F.lit(float(k)), F.when(enough, k - (k + 1) * y * n[k] / n[k - 1]).otherwise(0.5))) for k in (1, 2, 3)]
    return [F.array(*each).alias(f"d_{c}")]


class Alphabet:
    """The code points of a shard, numbered as they come, so that an n-gram is one number."""

    def __init__(self):
        self.points, self.number = [np.zeros(1, np.uint32)], np.zeros(POINTS, np.uint16)
        self.size = 1

    def symbols(self, text: str) -> np.ndarray:
        flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        # Neither can be part of a string of a table.
        flat = np.where((flat == 0) | (flat >> 11 == 0x1B), np.uint32(0xFFFD), flat)
        found = self.number[flat]
        if not found.all():
            new = np.unique(flat[found == 0])
            self.number[new] = np.arange(self.size, self.size + len(new))
            self.points.append(new)
            self.size += len(new)
            found = self.number[flat]
        return found

    def letters(self, codes: np.ndarray, order: int) -> list[str]:
        """The n-grams of the numbers."""
        points = np.concatenate(self.points)
        grid = np.empty((len(codes), order), np.uint32)
        for i in range(order):
            grid[:, i] = points[(codes >> np.uint64(16 * (order - 1 - i))) & np.uint64(0xFFFF)]
        return grid.view(f"<U{order}").ravel().tolist() if len(codes) else []


def gram_codes(lines: list[str], alphabet: Alphabet, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the n-grams of the lines one after the other, and how many each has."""
    symbols = alphabet.symbols("".join(lines)).astype(np.uint64)
    lengths = np.array([len(line) for line in lines], np.int64)
    ends = np.cumsum(lengths)
    size = max(0, len(symbols) - order + 1)
    codes, inside = np.zeros(size, np.uint64), np.ones(size, bool)
    for i in range(order):
        codes = (codes << np.uint64(16)) | symbols[i: size + i]
    for i in range(1, order):
        inside[ends[(ends - i >= 0) & (ends - i < size)] - i] = False
    return codes[inside], np.maximum(0, lengths - order + 1)


def _lines(text: str | None, order: int) -> Iterator[str]:
    """A text as a line of its own, behind a line feed; a long one in parts that together have its n-grams; none if it has no n-gram."""
    if not text or len(text) + 1 < order:
        return
    if len(text) > MANY_LETTERS and len(set(text)) > MANY_LETTERS:
        text = "".join(c if c < "\U00010000" else "\ufffd" for c in text)
    line = "\n" + text
    yield from [line] if len(line) <= HELD_CHARS else (line[s: s + HELD_CHARS + order - 1] for s in range(0, len(line) - order + 1, HELD_CHARS))


def _blocks(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows as blocks of a shard each: ``shard, block, first``, the number in its shard of the block's first row.

    A shard is what a task reads, up to bounds of characters, rows and letters; a block is up to
    ``BLOCK_ROWS`` rows with all their columns, packed. Written once, bucketed by shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chars, count = TaskContext.get().partitionId() << 24, 0, 0
        letters: set[str] = set()

        def packed(part: pa.RecordBatch) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([count])], ["shard", "block", "first"])

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch, begin = whole.slice(start, BLOCK_ROWS), 0
                for k, text in enumerate(batch.column(text_col)):
                    text = text.as_py() or ""
                    new = set() if text.isascii() else set(text) - letters
                    if len(letters) + len(new) > ALPHABET - 256 or chars > SHARD_CHARS or count + k - begin >= SHARD_ROWS:
                        if k > begin:
                            yield packed(batch.slice(begin, k - begin))
                        shard, chars, count, begin, letters, new = shard + 1, 0, 0, k, set(), set(text)
                    letters |= new
                    chars += len(text)
                yield packed(batch.slice(begin))
                count += batch.num_rows - begin

    return write_bucketed(rows.mapInArrow(trimmed(run), "shard long, block binary, first long"), ["shard"], name="quality")


def _unpacked(blocks: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The blocks of a shard in order, each with the number of its first row."""
    first = blocks.column("first").to_numpy()
    for i in np.argsort(first).tolist():
        for batch in pa.ipc.open_stream(blocks.column("block")[i].as_py()):
            yield int(first[i]), batch


def _folds_of(marked: pa.Table, first: int, n: int) -> np.ndarray:
    """The folds of a block's rows, -1 where they are not trusted."""
    folds, at = np.full(n, -1, np.int32), marked.column("row").to_numpy() - first
    mine = (at >= 0) & (at < n)
    folds[at[mine]] = marked.column("fold").to_numpy()[mine]
    return folds


def _counted(order: int, text_col: str, lang_col: str):
    """Per shard and language: its distinct n-grams with their counts in the trusted texts of each fold, and in a row of null n-gram how many trusted texts have any."""

    def run(blocks: pa.Table, marked: pa.Table) -> pa.Table:
        alphabet, found, sized, done = Alphabet(), {}, {}, []
        waiting: dict[tuple[str | None, int], list[str]] = {}

        def counted() -> None:
            for name, lines in waiting.items():
                found.setdefault(name, []).append(np.unique(gram_codes(lines, alphabet, order)[0], return_counts=True))
            for name, parts in found.items():
                if len(parts) > 1:
                    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    found[name] = [(codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64))]
            waiting.clear()

        held = 0
        for first, batch in _unpacked(blocks):
            folds = _folds_of(marked, first, batch.num_rows).tolist()
            for text, lang, fold in zip(batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist(), folds):
                for k, line in enumerate(_lines(text, order)):
                    sized[lang] = sized.get(lang, 0) + (fold >= 0 and k == 0)
                    waiting.setdefault((lang, fold), []).append(line)
                    held += len(line)
                    if held > HELD_CHARS:
                        counted()
                        held = 0
        counted()
        shard = blocks.column("shard")[0]

        def rows(lang, grams, counts) -> pa.Table:
            offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * FOLDS)
            lists = pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64).ravel()))
            return pa.table([pa.array([shard.as_py()] * len(grams), pa.int64()), pa.array(lang, pa.string()), pa.array(grams, pa.string()), lists], ["shard", "lang", "gram", "counts"])

        for lang, n in sized.items():
            mine = {fold: parts[0] for (other, fold), parts in found.items() if other == lang}
            codes = np.unique(np.concatenate([p[0] for p in mine.values()]))
            counts = np.zeros((len(codes), FOLDS), np.int64)
            for fold, (its, times) in mine.items():
                if fold >= 0:
                    counts[np.searchsorted(codes, its), fold] = times
            done.append(rows([lang] * len(codes), alphabet.letters(codes, order), counts))
            done.append(rows([lang], [None], np.full((1, FOLDS), n)))
        return pa.concat_tables(done) if done else rows([], [], np.zeros((0, FOLDS)))

    return run


def _scored(order: int, id_col: str, text_col: str, lang_col: str):
    """Per shard: the log sums of its rows by their own model, and of the trusted ones by that of all languages too."""

    def table(values: pa.Table, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
        codes = np.zeros(values.num_rows, np.uint64)
        for s in range(0, len(codes), TABLE_ROWS):
            points = alphabet.symbols("".join(values.column("gram").slice(s, TABLE_ROWS).to_pylist())).reshape(-1, order)
            for i in range(order):
                codes[s: s + TABLE_ROWS] = (codes[s: s + TABLE_ROWS] << np.uint64(16)) | points[:, i]
        logs = values.column("logs").to_numpy().astype("<i8", copy=False).view("<i2").reshape(len(codes), 4)
        by = np.argsort(codes)
        return codes[by], logs[by]

    def run(blocks: pa.Table, values: pa.Table) -> pa.Table:
        alphabet, models, done = Alphabet(), {}, []
        marked = values.filter(values.column("name").is_null())
        values = values.select(["name", "gram", "logs"]).filter(values.column("name").is_valid())
        kinds = pa.concat_arrays([pa.array([], pa.string()), *values.column("name").chunks]).dictionary_encode()
        for k, name in enumerate(kinds.dictionary.to_pylist()):
            models[name] = table(values.take(pa.array(np.flatnonzero(kinds.indices.to_numpy() == k))), alphabet)
        del values, kinds
        for first, batch in _unpacked(blocks):
            texts, langs, n = batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist(), batch.num_rows
            folds = _folds_of(marked, first, n)
            sums, grams = np.zeros((n, 2), np.int64), np.array([max(0, len(t) + 2 - order) if t else 0 for t in texts], np.int64)
            own = np.array([lang is not None and "=" + lang in models for lang in langs], bool)
            groups: dict[str | None, list[int]] = {}
            for k in np.flatnonzero(grams).tolist():
                groups.setdefault(langs[k], []).append(k)
            for lang, members in groups.items():
                wanted = [(0, POOLED, members)]
                if own[members[0]]:
                    wanted = [(0, "=" + lang, members), (1, POOLED, [k for k in members if folds[k] >= 0])]
                for which, name, rows in wanted:
                    for at, lines in _portions(rows, texts, order):
                        codes, sizes = gram_codes(lines, alphabet, order)
                        seen, logs = models[name]
                        value = logs[np.searchsorted(seen, codes), np.repeat(folds[at] + 1, sizes)].astype(np.int64)
                        np.add.at(sums[:, which], np.array(at), np.add.reduceat(value, np.cumsum(sizes) - sizes))
            done.append(pa.table(
                [pa.array([blocks.column("shard")[0].as_py()] * n, pa.int64()), pa.array(np.arange(first, first + n)), batch.column(id_col), pa.array(langs, pa.string()),
                 pa.array(folds >= 0), pa.array(grams), pa.array(own), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                ["shard", "row", "doc_id", "lang", "trusted", "c", "own", "log", "pooled_log"]))
        return pa.concat_tables(done)

    return run


def _portions(rows: list[int], texts: list[str], order: int) -> Iterator[tuple[list[int], list[str]]]:
    """The lines of the rows' texts in lists of bounded size, each with the row that it is of."""
    at, lines, held = [], [], 0
    for k in rows:
        for line in _lines(texts[k], order):
            at.append(k)
            lines.append(line)
            held += len(line)
            if held > HELD_CHARS // 2:
                yield at, lines
                at, lines, held = [], [], 0
    if lines:
        yield at, lines


@in_short_batches
def _judged(docs: DataFrame, trusted: DataFrame, order: int, quantile: float, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """The blocks of the rows, and per row ``shard, row, doc_id, lang, n_grams, perplexity, threshold, kept``."""
    if not 1 < order <= LONGEST:
        raise ValueError(f"n-grams of 2 to {LONGEST} symbols are numbered in 64 bits")
    blocks = _blocks(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return blocks, written_alone(lambda: _judged_blocks(blocks, kind, trusted, order, quantile, id_col, text_col, lang_col))


def _judged_blocks(blocks: DataFrame, kind: str, trusted: DataFrame, order: int, quantile: float, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in batches:
            for k in range(packed.num_rows):
                shard = packed.column("shard")[k].as_py()
                for first, batch in _unpacked(pa.Table.from_batches([packed.slice(k, 1)])):
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(np.arange(first, first + n)), batch.column(id_col)], ["shard", "row", "doc_id"])

    ids = trusted.select(F.col(trusted.columns[0]).alias("id")).where("id IS NOT NULL").distinct()
    places = blocks.mapInArrow(trimmed(numbered), f"shard long, row long, doc_id {kind}")
    fold = (F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int").alias("fold")
    marked = cut_lineage(places.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("shard", "row", fold))
    shards = blocks.groupBy("shard")
    grams = cut_lineage(shards.cogroup(marked.groupBy("shard")).applyInArrow(trimmed_group(_counted(order, text_col, lang_col)), "shard long, lang string, gram string, counts array<long>"))

    able = grams.where("gram IS NULL AND lang IS NOT NULL").groupBy("lang").agg(F.sum(F.col("counts")[0]).alias("n"))
    own = cut_lineage(able.where(F.col("n") >= math.ceil(1 / max(1e-9, 1 - quantile) - 1e-6)).select(F.col("lang").alias("own")))
    # All of a language with a model goes by that one, and its trusted text by that of all languages too, for the limit of the others.
    named = grams.where("gram IS NOT NULL").join(own, F.col("lang") == F.col("own"), "left")
    mine, every = F.concat(F.lit("="), "own"), F.lit(POOLED)
    names = F.when(F.col("own").isNull(), F.array(every)).when(F.exists("counts", lambda c: c > 0), F.array(mine, every)).otherwise(F.array(mine))
    asked = named.select("shard", F.explode(names).alias("lang"), "gram", "counts")
    folds = [f"c{k}" for k in range(FOLDS)]
    summed = asked.groupBy("lang", "gram").agg(*[F.sum(F.col("counts")[k]).alias(f"in{k}") for k in range(FOLDS)])
    everything = sum((F.col(f"in{k}") for k in range(1, FOLDS)), F.col("in0"))
    counts = cut_lineage(summed.select("lang", "gram", everything.alias("c"), *[(everything - F.col(f"in{k}")).alias(c) for k, c in enumerate(folds)]))
    probability = kneser_ney(counts, order, columns=("c", *folds))
    # The model of all folds first, then those without each; no value is under e^-31.
    each = [F.greatest(F.round(F.log(F.col(f"p_{c}")) * LOG_UNIT), F.lit(-31.0 * LOG_UNIT)).cast("long") for c in ("c", *folds)]
    logs = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x.bitwiseAND(F.lit(0xFFFF)), 16 * k) for k, x in enumerate(each)])
    values = asked.select("shard", "lang", "gram").join(probability.select("lang", "gram", logs.alias("logs")), ["lang", "gram"])
    # Languages without a model may ask for the same; behind the join their rows lie together already.
    values = values.groupBy("lang", "gram", "shard").agg(F.first("logs").alias("logs"))
    brought = values.select("shard", F.col("lang").alias("name"), "gram", "logs", F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("fold")).unionByName(marked, allowMissingColumns=True)

    result = f"shard long, row long, doc_id {kind}, lang string, trusted boolean, c long, own boolean, log long, pooled_log long"
    scored = shards.cogroup(brought.groupBy("shard")).applyInArrow(trimmed_group(_scored(order, id_col, text_col, lang_col)), result)
    reading = lambda log: F.when(F.col("c") > 0, F.exp(-F.col(log) / LOG_UNIT / F.col("c")))
    pooled = F.when(F.col("own") & F.col("trusted"), reading("pooled_log")).alias("pooled")
    name = F.when(F.col("own"), F.concat(F.lit("="), "lang")).otherwise(F.lit(POOLED)).alias("name")
    under = cut_lineage(scored.select("shard", "row", "doc_id", "lang", "trusted", "c", name, reading("log").alias("perplexity"), pooled))
    pairs = F.array(F.struct(F.col("name").alias("of"), F.col("perplexity").alias("value")), F.struct(F.lit(POOLED).alias("of"), F.col("pooled").alias("value")))
    measured = under.where("trusted").select(F.explode(pairs).alias("m")).select("m.*").where("value IS NOT NULL")
    limits = cut_lineage(measured.groupBy("of").agg(F.percentile_approx("value", quantile, 10_000).alias("threshold")))
    judged = under.join(limits, F.col("name") == F.col("of"), "left").withColumnRenamed("c", "n_grams")
    return judged.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def classify(
    docs: DataFrame, trusted: DataFrame, order: int = 4, quantile: float = 0.995,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Which documents read like trusted text: ``doc_id, lang, n_grams, perplexity, threshold, kept``.

    ``trusted`` has the ids of trusted documents in its first column. A document is kept if its
    perplexity under its language's model is at most the ``quantile`` of that language's trusted
    documents. All trusted text is counted; as seen text reads easier than new text, a trusted
    document is scored by the counts without its own fold, one in ``FOLDS``. A language with so
    few trusted documents that the quantile would be their largest value, and the null one, go
    by the model of all languages together and by the limit of all trusted documents under that
    model. Texts that are null, empty or too short for one n-gram have no perplexity and are
    kept, as nothing speaks against them; without any trusted text all rows are. One row per row
    of ``docs``; extra columns do not matter.

    The tables of n-grams grow with the corpus and stay in Spark, spread over their n-grams,
    with the counts of all folds side by side. Rows are packed into shards of what a task reads,
    which are written once, bucketed by shard; every shard asks for its distinct n-grams, and
    their values come to where it lies. No text is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    judged = _judged(rows, trusted, order, quantile, "doc_id", "text", "lang")[1]
    return judged.select("doc_id", "lang", "n_grams", "perplexity", "threshold", "kept")


def kept_rows(
    docs: DataFrame, trusted: DataFrame, order: int = 4, quantile: float = 0.995,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The rows that ``classify`` keeps, columns as before; ids may be null or repeat, as each row is judged for itself.

    The rows come out of the blocks that were scored, so they are not shuffled either.
    """
    rows = docs.withColumn("__lang", F.col(lang_col).cast("string"))
    blocks, judged = _judged(rows, trusted, order, quantile, id_col, text_col, "__lang")
    columns = docs.columns

    def kept(blocks: pa.Table, gone: pa.Table) -> pa.Table:
        out = np.sort(gone.column("row").to_numpy())

        def left(first: int, batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            begin, end = np.searchsorted(out, [first, first + batch.num_rows])
            keep[out[begin:end] - first] = False
            return batch.select(columns).filter(pa.array(keep))

        # Block by block, so that a shard is not held twice.
        return pa.Table.from_batches([left(first, batch) for first, batch in _unpacked(blocks)])

    rejected = judged.where("NOT kept").select("shard", "row")
    return blocks.groupBy("shard").cogroup(rejected.groupBy("shard")).applyInArrow(trimmed_group(kept), docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id")
