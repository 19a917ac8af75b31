"""Word shingles of whole batches of texts, hashed side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd base of the rolling hash, and its inverse, modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits in, 64 well-mixed bits out."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers_of(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a text in UTF-8."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    return span_hashes(raw, start, end), start


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, which depends on nothing else."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers_of(BASE, len(raw)), dtype=np.uint64)])
        return mixed((sums[end] - sums[start]) * powers_of(INVERSE, len(raw) + 1)[start] + mixed((end - start).astype(np.uint64)))


def _pieces(data: bytes, limit: int) -> Iterator[bytes]:
    """A long text in pieces cut between words; a word longer than the limit stays whole."""
    at = 0
    while len(data) - at > limit:
        end = max(data.rfind(b" ", at, at + limit), data.rfind(b"\n", at, at + limit))
        if end <= at:
            ends = [x for x in (data.find(b" ", at + limit), data.find(b"\n", at + limit)) if x >= 0]
            end = min(ends, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def batch_shingles(texts: pa.Array, words: int = 5, limit: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text, in order: its place, its distinct shingle hashes in ascending order, and how often each occurs.

    A shingle is ``words`` words in a row; a shorter text with any word at all is one shingle.
    Null, empty and blank texts have none. Texts are taken together up to ``limit`` bytes.
    """
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        joined = b"\n".join(data for _, data in held)
        hashes, start = word_hashes(joined)
        ends = np.cumsum([len(data) + 1 for _, data in held])
        last = np.searchsorted(start, ends)
        first = 0
        for (place, _), end in zip(held, last.tolist()):
            yield place, *_distinct(hashes[first:end], words)
            first = end

    for place, text in enumerate(texts):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if len(data) > limit:
            if held:
                yield from flush()
                held, size = [], 0
            yield place, *_distinct(np.concatenate([word_hashes(p)[0] for p in _pieces(data, limit)]), words)
            continue
        if size + len(data) > limit:
            yield from flush()
            held, size = [], 0
        held.append((place, data))
        size += len(data)
    if held:
        yield from flush()


def _distinct(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    size = min(words, len(hashes))
    count = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        code = np.full(count, size, np.uint64)
        for i in range(size):
            code = mixed(code * np.uint64(BASE) + hashes[i: i + count])
    return np.unique(code, return_counts=True)
