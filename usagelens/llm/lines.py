"""Line dedup: a segment-partition edit join over the lines of all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, bounded_filter, components, in_short_batches, leaders, maybe_in, merged, shared_keys, trimmed, with_row_keys
from usagelens.llm.shingles import BASE, INVERSE, mixed, powers_of
from usagelens.sources.workspace import cut_lineage, written_alone

#: Words of the filter of keys that occur more than once: 2^26 bits.
KEY_FILTER = 1 << 20


def split_lines(text: str | None) -> list[str]:
    """Lines between line feeds, blanks at their ends taken off."""
    return [line.strip(" \t\r\x0b\x0c") for line in text.split("\n")] if text else []


def line_id(line: str) -> int:
    """64-bit digest of a line, signed."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines in one array, and where each line begins (with the end last)."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)


def segment_keys(lines: list[str], distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the segment partition join: ``line, key, is_index`` arrays.

    A line of length n is indexed under its distance + 1 segments, the first ones shorter where
    n does not divide. A line probes the indexes of its own length and of up to ``distance``
    shorter ones, with the substrings that can match there: those at which the parts to the
    left and to the right leave enough edits to both. Two lines within the distance share a
    key, one as index and the longer one as probe. Lines must have more than ``distance``
    characters.
    """
    flat, at = _points(lines)
    length = np.diff(at)
    with np.errstate(over="ignore"):
        powers, inverse = (powers_of(x, len(flat) + 1) for x in (BASE, INVERSE))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    rows, keys, index = [], [], []
    parts = distance + 1

    def add(who: np.ndarray, start: np.ndarray, size: np.ndarray, indexed: np.ndarray, i: int, is_index: bool) -> None:
        begin = at[who] + start
        with np.errstate(over="ignore"):
            code = (prefix[begin + size] - prefix[begin]) * inverse[begin]
            code = mixed(code + mixed(indexed.astype(np.uint64) * np.uint64(parts) + np.uint64(i)))
        rows.append(who)
        keys.append(code.view(np.int64))
        index.append(np.full(len(who), is_index))

    everyone = np.arange(len(lines))
    for shorter in range(distance + 1):
        indexed = length - shorter
        able = everyone[indexed > distance]
        base, rest = indexed[able] // parts, indexed[able] % parts
        for i in range(parts):
            begun = i * base + np.maximum(0, i - (parts - rest))
            size = base + (i >= parts - rest)
            if shorter == 0:
                add(able, begun, size, indexed[able], i, True)
            low = np.maximum(0, np.maximum(begun - i, begun + shorter - (distance - i)))
            high = np.minimum(length[able] - size, np.minimum(begun + i, begun + shorter + (distance - i)))
            for step in range(2 * distance + 1):
                fits = low + step <= high
                add(able[fits], (low + step)[fits], size[fits], indexed[able][fits], i, False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(index)


def within_distance(left: list[str], right: list[str], distance: int, cells: int = 2_000_000) -> np.ndarray:
    """Whether each pair of lines is within the edit distance, by a banded bit-parallel computation.

    Pairs go side by side: one word a pair has the band of 2 * distance + 1 rows of the matrix,
    which moves down by a row with every character. Pairs of like lengths are taken together, as
    many as fit in ``cells`` characters.
    """
    result = np.zeros(len(left), bool)
    m, n = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    short = np.minimum(m, n) <= distance
    for k in np.flatnonzero(short & (np.abs(m - n) <= distance)):
        result[k] = _plain_distance(left[k], right[k]) <= distance
    todo = np.flatnonzero(~short & (np.abs(m - n) <= distance))
    todo = todo[np.argsort(m[todo], kind="stable")]
    while len(todo):
        widths = m[todo]
        count = max(1, int(np.searchsorted(np.arange(1, len(todo) + 1) * np.maximum.accumulate(widths), cells)))
        part, todo = todo[:count], todo[count:]
        result[part] = _banded([left[k] for k in part], [right[k] for k in part], distance)
    return result


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _padded(lines: list[str], before: int, width: int, filler: int) -> np.ndarray:
    """Lines as columns of a matrix of code points, ``before`` rows from the top."""
    flat, at = _points(lines)
    grid = np.full((width, len(lines)), filler, np.uint32)
    length = np.diff(at)
    column = np.repeat(np.arange(len(lines)), length)
    grid[before + np.arange(len(flat)) - np.repeat(at[:-1], length), column] = flat
    return grid


def _banded(pattern: list[str], text: list[str], k: int) -> np.ndarray:
    m, n = np.array([len(x) for x in pattern], np.int64), np.array([len(x) for x in text], np.int64)
    columns = int(n.max())
    # The filler is no character, and differs between the sides.
    rows = _padded(pattern, k, columns + 3 * k + 2, 0xFFFFFFF0)
    letters = _padded(text, 0, columns, 0xFFFFFFF1)
    one, top = np.uint64(1), np.uint64(63)
    plus = np.full(len(m), (2**64 - 1) << (63 - k) & (2**64 - 1), np.uint64)
    minus = np.zeros(len(m), np.uint64)
    score = np.full(len(m), k, np.int64)
    alive = np.arange(len(m))
    final = np.full(len(m), k + 1, np.int64)
    for j in range(columns):
        match = np.zeros(len(alive), np.uint64)
        for o in range(2 * k + 1):
            match |= (rows[j + o, alive] == letters[j, alive]).astype(np.uint64) << np.uint64(63 - 2 * k + o)
        with np.errstate(over="ignore"):
            zero = (((match & plus) + plus) ^ plus) | match | minus
        across_plus = minus | ~(zero | plus)
        across_minus = zero & plus
        left = j - (m[alive] - k)
        down = left < 0
        bit = np.uint64(62) - np.clip(left, 0, 62).astype(np.uint64)
        step = np.where(down, 1 - (zero >> top).astype(np.int64),
                        ((across_plus >> bit) & one).astype(np.int64) - ((across_minus >> bit) & one).astype(np.int64))
        score = score + np.where(j < n[alive], step, 0)
        plus = across_minus | ~((zero >> one) | across_plus)
        minus = (zero >> one) & across_plus
        ended = n[alive] == j + 1
        if ended.any() or j % 32 == 31:
            final[alive[ended]] = score[ended]
            # What is left can take off as many as the rows below the diagonal.
            go = ~ended & (score <= 3 * k)
            if not go.all():
                alive, plus, minus, score = alive[go], plus[go], minus[go], score[go]
                if not len(alive):
                    break
    return final <= k


#: Bounds of the queries: equal lines link unless empty, others by an edit for every five characters of the shorter one, two at most.
WHOLE = {"min_chars": 1, "near_chars": 1, "chars_per_edit": 5}


def allowed_edits(left: list[str], right: list[str], distance: int, chars_per_edit: int) -> np.ndarray:
    """How many edits may lie between the lines of each pair: one for every ``chars_per_edit`` characters of the shorter one (0: no such bound)."""
    shorter = np.minimum([len(x) for x in left], [len(x) for x in right]).astype(np.int64)
    return np.minimum(distance, shorter // chars_per_edit) if chars_per_edit else np.full(len(shorter), distance)


def _distinct_lines(batch: pa.RecordBatch, least: int) -> list[str]:
    return list({line for text in batch.column("text") for line in split_lines(text.as_py()) if len(line) >= least})


@in_short_batches
def line_classes(
    docs: DataFrame, distance: int = 2, min_chars: int = 10, near_chars: int = 30,
    id_col: str = "doc_id", text_col: str = "text", chars_per_edit: int = 0,
) -> DataFrame:
    """Classes of lines within an edit distance of each other, over all lines of all documents.

    One row per line: ``doc_id, line_no`` (from 0), ``n_chars``, ``class_doc_id, class_line_no``
    (the first line of its class, in order of document and number), ``kept`` (it is that one).
    Classes are what links of at most ``distance`` edits connect, directly or through others.
    Lines are taken without the blanks at their ends. Lines under ``near_chars`` characters
    link with equal lines only, lines under ``min_chars`` with none. With ``chars_per_edit``
    two lines may be an edit apart for every so many characters of the shorter one (and no more
    than ``distance``), so that short lines are not put together for being short; lines whose
    share is d edits are keyed by d + 1 segments. Null texts have no lines,
    an empty text one empty line. Rows that repeat a document id give the same line numbers
    again. Lines are told apart by a 64-bit digest.

    Equal lines are one from the start. Keys of one line drop out, by sums that are reduced
    before they are shuffled and a filter of fixed size. In a first round the lines of a key meet
    its leader only, the one whose keys are the most popular ones, and what is within the
    distance is one class; in a second round those of a key that are still in different classes
    meet, if their lengths, letters and pairs of neighbours differ by so little that they can be
    within the distance. So a large group of like lines costs its size, and no link between
    classes is passed over. Lines meet in joins whose large side Spark can split.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.select("text").where("text IS NOT NULL")
    near_chars = max(near_chars, chars_per_edit or distance + 1)
    # Lines of length from, to by the edits they are keyed for; a longer line may be the shorter one's by its edits.
    spans = [(distance, max(near_chars, distance + 1), None)] if not chars_per_edit else [
        (d, max(near_chars, d * chars_per_edit, d + 1), (d + 1) * chars_per_edit - 1 + d if d < distance else None) for d in range(1, distance + 1)]

    def keyed(filtered):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    lines = _distinct_lines(whole.slice(start, 512), near_chars)
                    for edits, low, high in spans:
                        for part in _portions([x for x in lines if low <= len(x) <= (high or len(x))]):
                            ids = np.array([line_id(x) for x in part], np.int64)
                            who, key, is_index = segment_keys(part, edits)
                            tag = (ids[who] & ~1) | is_index
                            if filtered is None:
                                # A line meets itself at its own segments, which counts once.
                                by = np.lexsort((who, key))
                                kept = by[np.concatenate([[True], (np.diff(key[by]) != 0) | (np.diff(who[by]) != 0)])] if len(by) else by
                            else:
                                kept = np.flatnonzero(maybe_in(filtered.value, key))
                            key, tag = key[kept], tag[kept]
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tag)], ["key", "tag"])

        return trimmed(run)

    classes = written_alone(lambda: _linked(texts, keyed, near_chars, distance, chars_per_edit).withColumnRenamed("node", "id"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                split = [split_lines(t.as_py()) if t.as_py() != "" else [""] for t in batch.column("text")]
                lines = [x for part in split for x in part]
                counts = [len(part) for part in split]
                numbers = np.concatenate([np.arange(c) for c in counts]) if counts else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(numbers, pa.int32()),
                     pa.array([len(x) for x in lines], pa.int32()),
                     pa.array([line_id(x) & -2 if len(x) >= min_chars else None for x in lines], pa.int64())],
                    ["doc_id", "line_no", "n_chars", "id"],
                )

    kind = dict(rows.dtypes)["doc_id"]
    every = rows.where("text IS NOT NULL").mapInArrow(trimmed(occurrences), f"doc_id {kind}, line_no int, n_chars int, id long")
    every = every.join(classes, "id", "left").select("doc_id", "line_no", "n_chars", F.coalesce("component", "id").alias("class"))
    every = cut_lineage(every)
    # Written, so that the join deals both sides anew and Spark can split a class of many lines.
    first_of = cut_lineage(every.where("class IS NOT NULL").groupBy("class").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"),
    ).where("n > 1").drop("n"))
    joined = every.join(first_of, "class", "left")
    mine = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.line_no") == F.col("line_no"))
    return joined.select(
        "doc_id", "line_no", "n_chars",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"),
        F.coalesce("first.line_no", "line_no").alias("class_line_no"),
        (F.col("first").isNull() | mine).alias("kept"),
    )


def _linked(texts: DataFrame, keyed: Callable, near_chars: int, distance: int, chars_per_edit: int) -> DataFrame:
    """``node, component`` of the line ids that links connect; ``keyed`` gives the keys of a batch's lines, all or those of a filter."""
    # Keys met once are of one line. The others pass a filter, with a few more, and are then told apart by the lines that have them.
    again = texts.mapInArrow(keyed(None), "key long, tag long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = texts.mapInArrow(keyed(bounded_filter(again, "key", KEY_FILTER)), "key long, tag long").distinct()
    # The last bit of a tag tells an index entry from a probe; ids lose that bit throughout.
    entries = cut_lineage(entries).select("key", F.col("tag").bitwiseAND(F.lit(-2)).alias("id"), _is_index().alias("is_index"))
    live = shared_keys(entries, F.max("is_index"))

    known = _texts_of(texts, live.select("id").distinct(), near_chars)
    star = live.join(leaders(live, F.col("is_index")), "key").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    first = cut_lineage(_verified(star, known, distance, chars_per_edit))
    labels = components(first)
    profile = known.select("id", *TRAITS).join(labels.withColumnRenamed("node", "id"), "id", "left")
    profile = profile.select("id", F.coalesce("component", "id").alias("class"), *TRAITS).dropDuplicates(["id"])
    placed = live.select("key", "id", "is_index").join(profile, "id")
    open_keys = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    placed = cut_lineage(placed.join(open_keys, "key"))
    ours = placed.where("is_index").select("key", *[F.col(c).alias(f"{c}_a") for c in ("id", "class", *TRAITS)])
    theirs = placed.where("NOT is_index").select("key", *[F.col(c).alias(f"{c}_b") for c in ("id", "class", *TRAITS)])
    apart = (F.col("class_a") != F.col("class_b")) & _alike(distance)
    rest = ours.join(theirs, (ours["key"] == theirs["key"]) & apart).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    links = first.unionByName(_verified(rest, known, distance, chars_per_edit))
    return components(links)


#: What two lines are told apart by before they meet.
TRAITS = ("n_chars", "letters", "pairs", "more_pairs")


def _alike(distance: int) -> Column:
    """Whether lines can be within the distance: an edit changes the parity of two letters at most, and of four pairs of neighbours."""
    differ = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    return (F.abs(F.col("n_chars_a") - F.col("n_chars_b")) <= distance) & (differ("letters") <= 2 * distance) & (differ("pairs") + differ("more_pairs") <= 4 * distance)


def _is_index() -> Column:
    return F.col("tag").bitwiseAND(F.lit(1)) == 1


def _portions(lines: list[str], chars: int = 1 << 18) -> Iterator[list[str]]:
    """Lists of lines of about ``chars`` characters; a longer line is one of its own."""
    part, held = [], 0
    for line in lines:
        part.append(line)
        held += len(line)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def letter_parity(line: str) -> int:
    """A bit for every letter class (code point modulo 64): whether the line has an odd number of them."""
    return _parity(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, 64)[0]


def pair_parity(line: str) -> list[int]:
    """The same for 128 classes of neighbouring characters, in two numbers."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _parity(((points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(13)) & np.uint32(127), 128)


def _parity(classes: np.ndarray, count: int) -> list[int]:
    odd = np.bincount(classes, minlength=count) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def _texts_of(texts: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """``id, line`` and the traits of the given line ids."""
    ids = cut_lineage(ids)
    shared = bounded_filter(ids.select(F.shiftright("id", 1).alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                lines = _distinct_lines(whole.slice(start, 512), least)
                found = np.array([line_id(x) & -2 for x in lines], np.int64)
                chosen = np.flatnonzero(maybe_in(shared.value, found >> 1)).tolist()
                pairs = [pair_parity(lines[k]) for k in chosen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[chosen]), pa.array([lines[k] for k in chosen], pa.string()),
                     pa.array([len(lines[k]) for k in chosen], pa.int32()), pa.array([letter_parity(lines[k]) for k in chosen], pa.int64()),
                     *(pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1))],
                    ["id", "line", *TRAITS],
                )

    lines = texts.mapInArrow(trimmed(run), "id long, line string, n_chars int, letters long, pairs long, more_pairs long")
    return cut_lineage(lines.join(ids, "id", "left_semi").dropDuplicates(["id", "line"]))


def _verified(pairs: DataFrame, texts: DataFrame, distance: int, chars_per_edit: int = 0) -> DataFrame:
    """The pairs ``a, b`` whose lines are within the distance, or the edits that their length allows."""
    ours, theirs = (texts.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("line", *TRAITS)]) for name in "ab")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    likely = pairs.join(ours.drop("line_a"), "a").join(theirs.drop("line_b"), "b").where(_alike(distance)).select("a", "b").distinct()
    met = likely.join(ours.select("a", "line_a"), "a").join(theirs.select("b", "line_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist()
            allowed, close = allowed_edits(left, right, distance, chars_per_edit), np.zeros(len(left), bool)
            for edits in np.unique(allowed).tolist():
                mine = np.flatnonzero(allowed == edits).tolist()
                close[mine] = within_distance([left[k] for k in mine], [right[k] for k in mine], edits)
            yield batch.select(["a", "b"]).filter(pa.array(close))

    return met.select("a", "b", "line_a", "line_b").mapInArrow(trimmed(run), "a long, b long")


def without_repeats(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the lines that ``classes`` does not keep taken out; columns as before.

    A document of which lines were taken out and none is left is dropped; all others stay, null
    and empty texts too. Needs ids that are unique; ``unrepeated`` takes any rows.
    """
    gone = classes.where("NOT kept").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(merged(gone), F.col(id_col) == F.col("__id"), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains("__gone", i))
    joined = joined.withColumn("__left", F.when(F.col("__gone").isNotNull(), left))
    blank = ~F.exists("__left", lambda x: F.trim(x) != "")
    joined = joined.where(F.col("__left").isNull() | ~blank)
    text = F.when(F.col("__left").isNull(), F.col(text_col)).otherwise(F.array_join("__left", "\n"))
    return joined.withColumn(text_col, text).select(docs.columns)


def unrepeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """The documents without the lines that repeat earlier ones; ids may be null or repeat, columns as before. ``bounds`` as for ``line_classes``."""
    keyed = with_row_keys(docs, id_col)
    return without_repeats(keyed, line_classes(keyed, id_col=ROW, text_col=text_col, **bounds), ROW, text_col).select(docs.columns)
