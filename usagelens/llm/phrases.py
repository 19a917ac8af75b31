"""Phrases of several words by Toivonen's method: a sample proposes, full passes count proposals and their border until closed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import trimmed
from usagelens.llm.shingles import BASE, mixed, span_hashes, word_hashes
from usagelens.operators.windows import number_in_order
from usagelens.sources.workspace import cut_lineage

#: Bits of the filter that holds proposed phrases: 8 MB, whatever their number.
FILTER_BITS = 1 << 26
#: Bytes of text that are counted together, and of the windows that a sample draws.
CHUNK, WINDOW = 2 << 20, 1 << 9
UNKNOWN = "und"

# What ends a piece, what parts words.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"

_ENDS, _BLANKS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(ENDS)] = True
_BLANKS[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Known:
    """A set of phrases as a filter of fixed size: it passes all of them and few others, and more others as it fills up."""

    def __init__(self, hashes: DataFrame):
        word = F.expr(f"(hash >> 6) & {FILTER_BITS // 64 - 1}")
        found = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toArrow()
        self.table = np.zeros(FILTER_BITS // 64, np.int64)
        self.table[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.int64)
        return ((self.table[(h >> 6) & (FILTER_BITS // 64 - 1)] >> (h & 63)) & 1).astype(bool)


def _extended(code: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on by a word."""
    return mixed(code * np.uint64(BASE) + last)


def phrase_hashes(phrases: pa.Array, langs: np.ndarray) -> np.ndarray:
    """Hashes of space-joined phrases in languages with the given hashes, as positions of a text have them."""
    counts = pc.add(pc.count_substring(phrases, " "), 1).to_numpy(zero_copy_only=False)
    words = word_hashes("\n".join(phrases.to_pylist()).encode("utf-8", "surrogatepass"))[0]
    first = np.cumsum(counts) - counts
    code = mixed(words[first] + langs)
    for k in range(1, int(counts.max(initial=1))):
        more = np.flatnonzero(counts > k)
        code[more] = _extended(code[more], words[first[more] + k])
    return code


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    kinds = langs.dictionary_encode()
    each = [mixed(np.uint64(len(x)) + np.array([int.from_bytes((x.encode("utf-8", "surrogatepass") + bytes(8))[:8], "little")], np.uint64))[0] for x in kinds.dictionary.to_pylist()]
    return np.array(each, np.uint64)[kinds.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _reach(known: Known | None, codes: list[np.ndarray], inside: list[np.ndarray], longest: int) -> list[np.ndarray]:
    """Per length, at which positions the phrase is proposed or on the border: single words, and what goes on in both directions from the set."""
    reach = [inside[0]]
    for k in range(2, longest + 1):
        part = reach[-1] & (known.has(codes[k - 2]) if known else False)
        reach.append(part & np.concatenate([part[1:], [False]]) & inside[k - 1])
    return reach


def _open(counted: list[np.ndarray], frequent: Known, codes: list[np.ndarray], inside: list[np.ndarray], longest: int) -> list[np.ndarray]:
    """Per length, at which positions the phrase was not counted, while all its parts are frequent or were not counted either."""
    possible, found = inside[0] & frequent.has(codes[0]), [np.zeros(len(inside[0]), bool)]
    for k in range(2, longest + 1):
        both = possible & np.concatenate([possible[1:], [False]]) & inside[k - 1]
        found.append(both & ~counted[k - 1])
        if k < longest:
            possible = both & (~counted[k - 1] | frequent.has(codes[k - 1]))
    return found


def _counted(
    texts: list[tuple[str, bytes]], known: Known | None, frequent: Known | None, lengths: range, only: Known | None = None, hashed: bool = False,
) -> Iterator[pa.RecordBatch]:
    """Rows of ``key, c`` over the texts: of phrases that ``known`` reaches or, given the ``frequent`` ones of these, of those that are open still.

    A key is a language, a line feed, which no phrase has, and the phrase; that of no phrase counts all words of a language.
    ``hashed`` gives rows of ``hash, c`` instead, and ``only`` leaves those whose hashes it has.
    """
    raw = _LOWER[np.frombuffer(b"\n".join(data for _, data in texts) + b"\n", np.uint8)]
    end = _ENDS[raw]
    letter = ~(end | _BLANKS[raw])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    n, longest = len(start), lengths[-1]
    if not n:
        return
    langs = pa.array([lang for lang, _ in texts], pa.string()).dictionary_encode()
    names = langs.dictionary
    text_of = np.searchsorted(np.cumsum([len(data) + 1 for _, data in texts]), start, "right")
    lang_of = langs.indices.to_numpy()[text_of].astype(np.int64)
    piece = np.cumsum(end, dtype=np.int32)[start]
    # Whether a phrase of k words from a position stays inside one piece.
    inside = [np.ones(n, bool)]
    for k in range(2, longest + 1):
        inside.append(np.concatenate([piece[k - 1:] == piece[: max(0, n - k + 1)], np.zeros(min(n, k - 1), bool)]))
    if longest > 1:
        last = span_hashes(raw, start, stop)
        codes = [mixed(last + _lang_hashes(names)[lang_of])]
        for k in range(2, longest + (hashed or only is not None)):
            codes.append(_extended(codes[-1], np.concatenate([last[k - 1:], np.zeros(min(n, k - 1), np.uint64)])))
        reach = _reach(known, codes, inside, longest)
        if frequent is not None:
            reach = _open(reach, frequent, codes, inside, longest)
        if hashed:
            for k in lengths:
                found, counts = np.unique(codes[k - 1][reach[k - 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["hash", "c"])
            return
        if only is not None:
            for k in range(1, longest + 1):
                # What begins a phrase of the set is in it too.
                reach[k - 1] = reach[k - 1] & only.has(codes[k - 1]) & (reach[k - 2] if k > 1 else True)
        del last, codes
    else:
        reach = inside
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[letter].tobytes())])

    def batch(k: int, place: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        parts = [words.take(pa.array(place + i)) for i in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
        key = pc.binary_join_element_wise(names.take(pa.array(lang_of[place])), phrase, "\n")
        return pa.RecordBatch.from_arrays([key, pa.array(counts.astype(np.int64))], ["key", "c"])

    if frequent is not None:
        # What is open is little, and is put together by the phrases themselves.
        for k in lengths:
            place = np.flatnonzero(reach[k - 1])
            if len(place):
                found = pa.Table.from_batches([batch(k, place, np.ones(len(place)))]).group_by("key").aggregate([("c", "sum")])
                yield from found.rename_columns(["key", "c"]).to_batches()
        return
    coded = words.dictionary_encode()
    ids, word = np.unique(lang_of * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
    dense = word
    for k in range(1, longest + 1):
        at = np.flatnonzero(reach[k - 1])
        if not len(at):
            break
        key = word[at] if k == 1 else dense[at] * len(ids) + word[at + k - 1]
        if k < longest:
            _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            dense = np.zeros(n, np.int64)
            dense[at] = inverse
        else:
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
        if k in lengths:
            yield batch(k, at[first], counts)
    if 1 in lengths:
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(names, "", "\n"), pa.array(np.bincount(lang_of, minlength=len(names)))], ["key", "c"])


def _cut(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a piece ends."""
    while len(data) > CHUNK:
        ends = np.flatnonzero(_ENDS[np.frombuffer(data[:CHUNK], np.uint8)])
        if not len(ends):
            more = np.flatnonzero(_ENDS[np.frombuffer(data, np.uint8)])
            ends = more[:1]
        if not len(ends):
            break
        yield data[: ends[-1] + 1]
        data = data[ends[-1] + 1:]
    yield data


def _candidates(texts: DataFrame, known: Broadcast, lengths: range, least: int) -> Known:
    """The hashes under which a pass counts ``least`` or more: those of all phrases that often, and of few others. Half the bytes of phrases are shuffled."""
    counted = _run(texts, "hash long, c long", known, None, lengths, hashed=True).groupBy("hash").agg(F.sum("c").alias("c"))
    return Known(counted.where(F.col("c") >= least).select("hash"))


def _run(texts: DataFrame, schema: str, known: Broadcast | None, frequent: Broadcast | None, lengths: range, only: Broadcast | None = None, hashed: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = known.value if known else None, frequent.value if frequent else None, lengths, only.value if only else None, hashed
        held, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for part in _cut((text.as_py() or "").encode("utf-8", "surrogatepass")):
                    held.append((lang, part))
                    size += len(part) + 1
                    if size > CHUNK:
                        yield from _counted(held, *sets)
                        held, size = [], 0
        if held:
            yield from _counted(held, *sets)

    return texts.mapInArrow(trimmed(run), schema)


def _pass(texts: DataFrame, known: Broadcast | None, frequent: Broadcast | None, lengths: range, least: int, only: Broadcast | None = None) -> DataFrame:
    """The phrases of a pass that occur ``least`` times at least, with exact counts, and the languages' word counts."""
    counted = _run(texts, "key string, c long", known, frequent, lengths, only).groupBy("key").agg(F.sum("c").alias("c"))
    phrase = F.substring_index("key", "\n", -1)
    counted = counted.where((F.col("c") >= least) | (phrase == "")).select(
        F.expr("substring(key, 1, length(key) - length(substring_index(key, '\\n', -1)) - 1)").alias("lang"),
        F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), phrase.alias("phrase"), "c")
    return counted


def _sampled(texts: DataFrame, one_in: int) -> DataFrame:
    """One in ``one_in`` windows of the texts, cut at blanks or ends, drawn anew in each; so no document is in or out as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(TaskContext.get().partitionId() + 17)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                data, parts = (text.as_py() or "").encode("utf-8", "surrogatepass"), []
                for k in np.flatnonzero(draw.random(len(data) // WINDOW + 1) * one_in < 1).tolist():
                    # From the first blank in the window before to the first one in this.
                    low, high = (data.find(b" ", at) if at else 0 for at in (k * WINDOW, (k + 1) * WINDOW))
                    parts.append(data[low: high if high >= 0 else len(data)] if low >= 0 else b"")
                found.append(b"\n".join(parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column("lang")], ["text", "lang"])

    return texts.mapInArrow(trimmed(run), "text string, lang string")


def _hashed(phrases: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = phrase_hashes(batch.column("phrase"), _lang_hashes(batch.column("lang"))) if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    return phrases.where("words > 0").select("lang", "phrase").mapInArrow(run, "hash long")


def frequent_phrases(
    docs: DataFrame, least: int = 100, longest: int = 5, one_in: int = 8, slack: float = 0.5, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang, words, phrase, c``: every phrase of 1 to ``longest`` words that occurs ``least`` times in its language, counted exactly.

    Per language (null: ``und``), ``c`` counts all occurrences within pieces, overlaps included;
    the row with ``words`` 0 counts all words. A sample of one in ``one_in`` windows of the texts proposes the
    phrases found there ``slack`` times as often as expected of ``least``, a length at a time. A
    full pass, first by hashes and then by the phrases whose hashes come to ``least``, counts the proposed phrases and their negative border, that is, all that occurs
    whose parts without the first and without the last word are both proposed, and every word.
    Frequent phrases of the border that were not proposed are its failures. If there are any, an
    expansion pass counts all that was not counted and has only parts that are frequent or were
    not counted either. As each part of a frequent phrase is frequent, none is then left, so
    sample and proposals set the cost and never the result.

    The sets are filters of fixed size in the tasks: what they pass wrongly is counted too, and
    drops out by its exact count. When a filter fills up it only stops saving.
    """
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")).where("text IS NOT NULL")
    context = docs.sparkSession.sparkContext
    sample, floor = cut_lineage(_sampled(texts, one_in)), max(2, int(least / one_in * slack))
    proposed, known = None, None
    # Words, then pairs, then what pairs make up.
    for lengths in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if lengths:
            found = cut_lineage(_pass(sample, known, None, lengths, floor).where("words > 0"))
            proposed = found if proposed is None else proposed.unionByName(found)
            known = context.broadcast(Known(_hashed(proposed)))

    only = context.broadcast(_candidates(texts, known, range(1, longest + 1), least))
    frequent = cut_lineage(_pass(texts, known, None, range(1, longest + 1), least, only))
    failures = frequent.where((F.col("words") > 0) & (F.col("words") < longest)).join(proposed.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    if failures.isEmpty():
        return frequent
    found = context.broadcast(Known(_hashed(frequent)))
    return cut_lineage(frequent.unionByName(_pass(texts, known, found, range(2, longest + 1), least)))


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2_000, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The strongest phrases of 2 to ``longest`` words per language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are taken with A-Z in lower case, cut into pieces at sentence marks and line ends, and
    these into words at blanks. ``a`` is how often a phrase occurs, ``n`` how many words its
    language has. Of the cuts of a phrase in two, with ``l`` and ``r`` occurrences of the parts,
    that of the lowest floor(1000 a n / (l r)) counts, of equal ones the first. A phrase inside a
    longer candidate that occurs as often is left out. Rows without text have no words; null
    languages are ``und``. Products are exact decimals.

    Every part of a frequent phrase is frequent, so the tables that meet hold phrases of ``least``
    occurrences only. Ranks come from ranges of the order, so a language may be large.
    """
    found = frequent_phrases(docs, least, longest, text_col=text_col, lang_col=lang_col)
    phrases = cut_lineage(found.where("words > 0").select("lang", "words", "phrase", "c"))
    sizes = cut_lineage(found.where("words = 0").select("lang", F.col("c").alias("n")))
    candidates = phrases.where("words > 1").withColumnRenamed("c", "a")
    split = F.split("phrase", " ")
    ends = [F.array_join(F.slice(split, start, F.col("words") - 1), " ") for start in (1, 2)]
    # A phrase inside a longer one of the same count is inside one that is longer by a word.
    covered = candidates.where("words > 2").select("lang", F.explode(F.array(*ends)).alias("phrase"), "a").distinct()
    candidates = candidates.join(covered, ["lang", "phrase", "a"], "left_anti")
    cuts = candidates.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    split = F.split("phrase", " ")
    cuts = cuts.withColumns({"left": F.array_join(F.slice(split, 1, F.col("k")), " "), "right": F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    counts = lambda part, name: phrases.select("lang", F.col("phrase").alias(part), F.col("c").alias(name))
    cuts = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"]).join(sizes, "lang")
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest.alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    ranked = number_in_order(scored, ["lang"], [F.col("score").desc(), F.col("a").desc(), "phrase"], name="rank", unique_order=True)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
