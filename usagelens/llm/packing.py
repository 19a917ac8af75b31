"""Packing token pieces into training sequences by non-negative least squares over their lengths."""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from usagelens.llm.common import in_short_batches, kept, trimmed
from usagelens.sources.workspace import cut_lineage

#: Characters of texts whose words are looked up together, about: their arrays are many times as large.
TEXT_CHARS = 1_000_000
#: Pieces of one length class numbered by one task at most, about.
RANK_ROWS = 100_000


_LETTER = np.ones(256, bool)
_LETTER[list(b" \t\n\r\x0c")] = False


class WordTokenizer:
    """Ids of a tokenizer that never joins characters across blanks, with the ids of words kept.

    Texts with other blanks than the plain ones, or with what may be a special token, go through
    the tokenizer whole, so the ids are its own in every case. The words not yet known of many
    texts go through it together: those of letters only as one line, of which each takes the ids
    up to one that ends a word; others with a digit between them, which is a token of its own;
    words with digits go alone. Marks behind a last letter are tokens of their own, and case
    does not matter where the tokenizer ignores it, so a word is learnt once for all of these.
    """

    #: Words kept; when there are more, those not met again since the last time are forgotten.
    limit = 400_000
    # Blanks other than the plain ones, and what special tokens begin with.
    _whole = (*"\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff", *map(chr, range(0x2000, 0x200C)), "<|")
    _marks, _line = string.punctuation.replace("'", ""), 256

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        mark = self._encode("7")
        probe = self._encode("ab 7 ab")
        self.mark = mark[0] if len(mark) == 1 and list(probe) == [*self._encode("ab"), *mark, *self._encode("ab")] else None
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(names.values(), default=0) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        # For words of lower-case ASCII letters, of which a line is cut at its blanks alone.
        self.letters = Tokenizer.from_file(path)
        self.letters.no_truncation()
        self.letters.no_padding()
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if self.letters.encode("ab the xyzzyq", add_special_tokens=False).ids != list(self._encode("ab the xyzzyq")):
            self.letters = self.tokenizer
        apart = list(self._encode("ab,;")) == [*self._encode("ab"), *self._encode(",;")]
        self.tails, self.caseless = apart, list(self._encode("AbcXyz")) == list(self._encode("abcxyz"))

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: its words are looked up once each for all texts, and put in place side by side."""
        # Most texts have no odd character, which a look at all of them together tells at once.
        together = "\n".join(texts)
        odd = [x for x in self._whole if x in together]
        whole = [self.mark is None or any(x in text for x in odd) for text in texts] if odd or self.mark is None else [False] * len(texts)
        plain = [text for text, alone in zip(texts, whole) if not alone]
        found = self._of_words(plain)
        return [self._encode(text).tobytes() if alone else next(found) for text, alone in zip(texts, whole)]

    def _of_words(self, texts: list[str]) -> Iterator[bytes]:
        data = [text.encode("utf-8", "surrogatepass") for text in texts]
        raw = np.frombuffer(b"\n".join([b"", *data, b""]), np.uint8)
        letter = _LETTER[raw]
        edge = (np.flatnonzero(letter[1:] != letter[:-1]) + 1).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
        start, length = edge[::2], edge[1::2] - edge[::2]
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(length, out=offsets[1:])
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letter])]).dictionary_encode()
        taken = pa.array(self._known(_listed(words.dictionary)), pa.large_binary()).take(words.indices)
        # The tokens of a text end where those of its last word do.
        last = np.searchsorted(start, np.cumsum([1, *[len(x) + 1 for x in data]]))
        _, ends, tokens = taken.buffers()
        cuts = np.frombuffer(ends, np.int64, len(start) + 1)[last].tolist() if len(start) else [0] * len(last)
        whole = memoryview(tokens) if tokens is not None else memoryview(b"")
        return (bytes(whole[a:b]) for a, b in zip(cuts, cuts[1:]))

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        missing = [w for w, ids in zip(words, found) if ids is None]
        if self.older:
            again = {w: ids for w, ids in zip(missing, map(self.older.get, missing)) if ids is not None}
            self.known |= again
            missing = [w for w in missing if w not in again]
        self._learn(set(missing))
        return [self.known[w] if ids is None else ids for w, ids in zip(words, found)]

    def _learn(self, new: set[str]) -> None:
        alone = [w for w in new if w.isalpha()]
        others = new.difference(alone)
        cores = [w.rstrip(self._marks) if self.tails else w for w in others]
        pairs = [(w, c, w[len(c):]) if c and c[-1].isalpha() else (w, w, "") for w, c in zip(others, cores)]
        keys = self._keys(alone)
        parts = self._keys([c for _, c, _ in pairs])
        wanted = {*keys, *parts, *{tail for _, _, tail in pairs}} - self.known.keys() - {""}
        self.known |= self._encoded(wanted)
        get = self.known.__getitem__
        self.known.update(zip(alone, map(get, keys)))
        self.known.update((w, get(c) + (get(tail) if tail else b"")) for (w, _, tail), c in zip(pairs, parts))

    def _keys(self, words: list[str]) -> list[str]:
        """The words as they are learnt: those of ASCII in lower case if case is ignored."""
        text = " ".join(words)
        if not words or not self.caseless:
            return words
        return text.lower().split(" ") if text.isascii() else [w.lower() if w.isascii() else w for w in words]

    def _encoded(self, words: set[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()]
        simple = [w for w in letters if w.isascii() and w.islower()]
        for tokenizer, kind in ((self.letters, simple), (self.tokenizer, list(set(letters).difference(simple)))):
            lines = [kind[i: i + self._line] for i in range(0, len(kind), self._line)]
            for line, encoding in zip(lines, tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
                ids = np.array(encoding.ids, "<u4")
                at = np.flatnonzero(self.ends[ids]) + 1
                # Each has one end at least, so as many as words are one each.
                if len(at) == len(line) and at[-1] == len(ids):
                    found |= _cut(line, ids, np.concatenate([[0], at[:-1]]), at)
        plain = [w for w in words if w not in found and not any(c.isnumeric() for c in w)]
        for i in range(0, len(plain), self._line):
            line = plain[i: i + self._line]
            ids = self._encode(" 7 ".join(line))
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(line) - 1:
                found |= _cut(line, ids, np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]]))
        return found | {w: self._encode(w).tobytes() for w in words if w not in found}


def _listed(words: pa.Array) -> list[str]:
    """The words, none of which has a line feed: decoding them all as one text is faster than each by itself."""
    if not len(words):
        return []
    _, offsets, data = words.buffers()
    cuts = np.frombuffer(offsets, np.int32, len(words) + 1)
    return np.insert(np.frombuffer(data, np.uint8)[: cuts[-1]], cuts[1:-1], 10).tobytes().decode("utf-8", "surrogatepass").split("\n")


def _cut(words: list[str], ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, bytes]:
    raw = ids.tobytes()
    return {w: raw[s:e] for w, s, e in zip(words, (start * 4).tolist(), (end * 4).tolist())}


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process, whose known words last from task to task, until a task of another operator comes."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(path, lambda: WordTokenizer(path))


def token_pieces(
    docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: each document's ids with the end id, in windows and a rest.

    ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text is the end id alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for whole in batches:
            texts, first, held = [], 0, 0
            for k, text in enumerate(whole.column("text")):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > TEXT_CHARS or k == whole.num_rows - 1:
                    at, start, total, parts = [], [], [], []
                    for i, found in enumerate(tokenizer.all_ids(texts), first):
                        ids = found + end
                        for s in range(0, len(ids), 4 * window):
                            at.append(i)
                            start.append(s // 4)
                            total.append(len(ids) // 4)
                            parts.append(ids[s: s + 4 * window])
                    yield pa.RecordBatch.from_arrays(
                        [whole.column("doc_id").take(pa.array(at)), pa.array(start, pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()),
                         pa.array(total, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"],
                    )
                    texts, first, held = [], k + 1, 0

    return rows.mapInArrow(trimmed(run, keeps=tokenizer_path), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


def combinations(units: int, depth: int) -> np.ndarray:
    """All ways to fill ``units`` with at most ``depth`` whole parts, the largest first, 0 where there is no further part."""
    found = [np.array([[units]])]
    for parts in range(2, depth + 1):
        rows = np.arange(1, units)[:, None]
        for left in range(parts - 2, 0, -1):
            low, rest = rows[:, -1], units - rows.sum(1)
            # The next part is at least the one before, and leaves room for those to come.
            high = rest // (left + 1)
            counts = np.maximum(0, high - low + 1)
            grown = np.repeat(rows, counts, axis=0)
            step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = np.concatenate([grown, (np.repeat(low, counts) + step)[:, None]], axis=1)
        last = units - rows.sum(1)
        rows = np.concatenate([rows, last[:, None]], axis=1)[last >= rows[:, -1]]
        found.append(rows[:, ::-1])
    return np.concatenate([np.pad(f, ((0, 0), (0, depth - f.shape[1]))) for f in found])


def nonnegative_least_squares(columns: np.ndarray, wanted: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 of least |A x - wanted|, by active sets; column j of A counts the parts of ``columns[j]``.

    A is kept as its parts only. Systems are solved over the columns in use, of which there are
    no more than lengths, by their normal equations with a slight ridge.
    """
    units = len(wanted)
    rounds = rounds or 2 * units
    x = np.zeros(len(columns))
    scale = max(1.0, float(np.abs(wanted).max()))
    goal, residual = wanted / scale, wanted / scale
    used, a = np.zeros(0, np.int64), np.zeros((units, 0))

    def solve(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a.T @ a + 1e-10 * np.eye(a.shape[1]), a.T @ goal)

    for _ in range(rounds):
        gradient = np.concatenate([[0.0], residual])[columns].sum(1)
        gradient[used] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= 1e-7:
            break
        used = np.append(used, j)
        a = np.column_stack([a, np.bincount(columns[j], minlength=units + 1)[1:]])
        solved = solve(a)
        while len(used) and solved.min() <= 0:
            now, bad = x[used], solved <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - solved[bad], 1e-300))
            now = now + step * (solved - now)
            keep = ~(bad & (now <= 1e-12))
            x[used] = np.where(keep, now, 0)
            used, a = used[keep], a[:, keep]
            solved = solve(a) if len(used) else solved[:0]
        x[used] = solved
        residual = goal - a @ x[used]
        if np.abs(residual).max() < 1e-7:
            break
    return x * scale


def plan_patterns(histogram: np.ndarray, depth: int = 4, unit: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used: all pieces of ``histogram`` and no more.

    ``histogram[n]`` counts the pieces of length n, from 0 to the length of a window. Lengths are
    rounded up to classes of ``unit``; the repeat counts of the combinations of classes that fill
    a window exactly come from least squares, rounded and cut to what is there. Each use of a
    combination takes the longest pieces of its classes, and what these leave of the window is
    filled greedily with the longest pieces that fit, by their own lengths. The rest is packed
    greedily, the longest first and then the longest that still fits; a pattern repeats as long
    as its pieces last.
    """
    window, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    patterns: list[tuple[tuple[int, ...], int]] = []

    def filled(classes: list[int]) -> list[int]:
        """The longest pieces of the classes, and what fits besides."""
        room, taken = window, {}
        for b in classes:
            low = (b - 1) * unit + 1
            there = np.flatnonzero(left[low: b * unit + 1] > [taken.get(n, 0) for n in range(low, b * unit + 1)])
            if len(there):
                part = low + int(there[-1])
                taken[part] = taken.get(part, 0) + 1
                room -= part
        spare = left.copy()
        for part, n in taken.items():
            spare[part] -= n
        while room:
            fits = np.flatnonzero(spare[1: room + 1])
            if not len(fits):
                break
            part = int(fits[-1]) + 1
            take = int(min(spare[part], room // part))
            taken[part] = taken.get(part, 0) + take
            spare[part] -= take
            room -= take * part
        return [part for part in sorted(taken, reverse=True) for _ in range(taken[part])]

    def use(pattern: list[int], most: int) -> int:
        parts, counts = np.unique(pattern, return_counts=True)
        times = int(min(most, (left[parts] // counts).min()))
        left[parts] -= counts * times
        patterns.append((tuple(pattern), times))
        return times

    classes = np.zeros(window // unit + 1, np.int64)
    np.add.at(classes, -(-np.arange(window + 1) // unit), left)
    classes[0] = 0
    ways = combinations(window // unit, depth)
    present = np.concatenate([[True], classes[1:] > 0])
    ways = ways[present[ways].all(axis=1)]
    if len(ways):
        times = nonnegative_least_squares(ways, classes[1:].astype(float))
        for j in np.argsort(-times):
            if times[j] < 0.5:
                break
            way, wanted = [int(p) for p in ways[j] if p], int(np.rint(times[j]))
            while wanted and all(left[(b - 1) * unit + 1: b * unit + 1].sum() >= way.count(b) for b in set(way)):
                wanted -= use(filled(way), wanted)
    while left[1:].any():
        use(filled([]), 2**62)
    return patterns


@dataclass(frozen=True)
class Slots:
    """Where the n-th piece of a length class goes: for each class, runs of slots of one pattern."""

    first: list[np.ndarray]
    sequence: list[np.ndarray]
    each: list[np.ndarray]
    place: list[np.ndarray]


def lay_out(patterns: list[tuple[tuple[int, ...], int]], units: int) -> Slots:
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(units + 1)]
    filled = [0] * (units + 1)
    sequence = 0
    for pattern, times in patterns:
        for part in sorted(set(pattern)):
            each = pattern.count(part)
            runs[part].append((filled[part], sequence, each, pattern.index(part)))
            filled[part] += each * times
        sequence += times
    column = lambda k: [np.array([r[k] for r in run], np.int64) for run in runs]
    return Slots(column(0), column(1), column(2), column(3))


@in_short_batches
def pack(pieces: DataFrame, window: int = 4096, unit: int = 16, depth: int = 4) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, start, length, ...``) of at most ``window`` tokens.

    Only the histogram of the lengths, of ``window`` numbers, comes to the driver, where the
    patterns are planned (see ``plan_patterns``). Pieces are written with a row number and
    numbered within their length, in parts of bounded size dealt by row, so repeated and null ids
    are spread too; the number says which sequence and place a piece has. Offsets run gapless from 0 in each
    sequence. Rows of equal id and start are pieces each. Without pieces the result is empty.
    """
    columns = pieces.columns
    pieces = cut_lineage(pieces.withColumns({"__class": F.col("length").cast("int"), "__row": F.monotonically_increasing_id()}))
    counted = pieces.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = np.zeros(window + 1, np.int64)
    for row in counted:
        histogram[row["__class"]] = row["n"]
    slots = lay_out(plan_patterns(histogram, depth, unit), window)

    parts = F.expr(f"element_at(array({', '.join(str(max(1, -(-n // RANK_ROWS))) for n in histogram.tolist())}), `__class` + 1)")
    named = pieces.withColumn("__part", F.pmod(F.xxhash64("__row"), parts).cast("int"))
    sums = named.groupBy("__class", "__part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__class").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__class", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__class", "__part").orderBy("__row")
    ranked = named.withColumn("__rank", F.row_number().over(inside)).join(starts, ["__class", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.col("__before")).drop("__part", "__before")
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes) + ", sequence_id long, __place long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            klass, rank = batch.column("__class").to_numpy(), batch.column("__rank").to_numpy()
            sequence, at = np.zeros(len(klass), np.int64), np.zeros(len(klass), np.int64)
            for b in np.unique(klass).tolist():
                mine = np.flatnonzero(klass == b)
                run = np.searchsorted(slots.first[b], rank[mine], side="right") - 1
                inner, each = rank[mine] - slots.first[b][run], slots.each[b][run]
                sequence[mine] = slots.sequence[b][run] + inner // each
                at[mine] = slots.place[b][run] + inner % each
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(at)], [*batch.schema.names, "sequence_id", "__place"])

    placed = ranked.mapInArrow(place, schema)
    before = Window.partitionBy("sequence_id").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every piece of every document lies: ``doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset``.

    The ids themselves, of which the checksum is taken, are those of ``token_pieces``; they are
    not shuffled, and ``sequences`` puts them together.
    """
    pieces = token_pieces(docs, tokenizer_path, window, end_id, id_col, text_col)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), window)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training sequences: ``sequence_id, tokens, ids``, padded to the window unless a power of two long. Needs unique ids."""
    pieces = token_pieces(docs, tokenizer_path, window, end_id, id_col, text_col).select("doc_id", "start", "ids")
    found = packed.select("doc_id", "start", "sequence_id", "offset").join(pieces, ["doc_id", "start"])
    joined = found.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["ids"]), "")
    joined = joined.select("sequence_id", (F.length(text) / 8).cast("long").alias("tokens"), text.alias("text"))
    whole = F.bit_count("tokens") == 1
    pad = np.array([pad_id], "<u4").tobytes().hex().upper()
    padded = F.when(whole, F.col("text")).otherwise(F.concat("text", F.repeat(F.lit(pad), (F.lit(window) - F.col("tokens")).cast("int"))))
    return joined.select("sequence_id", "tokens", F.unhex(padded).alias("ids"))
