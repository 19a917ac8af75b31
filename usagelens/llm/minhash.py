"""Near-duplicate documents by DartMinHash signatures and banded joining."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import bounded_filter, components, in_short_batches, leaders, maybe_in, shared_keys, trimmed
from usagelens.llm.shingles import batch_shingles, mixed
from usagelens.sources.workspace import cut_lineage, written_alone

#: Bands and rows: a pair of similarity 0.8 shares no band once in 20,000 times, one of 0.3 shares one in 17 times.
BANDS, ROWS = 25, 5
#: Documents of a key that still meet in pairs in the second round; it bears on speed only.
FEW = 32


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, coordinates: int) -> np.ndarray:
    """DartMinHash signatures of many weighted sets side by side: ``owners`` x ``coordinates``.

    Element ``elements[i]`` has weight ``weights[i]`` > 0 in set ``owner[i]``. The weight axis of
    an element falls into the regions [0, 1), [1, 2), [2, 4), [4, 8), ... Into each region darts
    are thrown at unit rate over weight and rank: their ranks rise by exponential gaps, and each
    has a place on the weight axis and a coordinate, all out of a hash of element, region and
    number, so that sets with a common element see the same darts. A set has the darts below its
    weight, and per coordinate the earliest of them is its signature: two sets agree on a
    coordinate with the probability of their weighted Jaccard similarity. Ranks are drawn up to a
    limit at which a set expects about k ln k + 2k darts, in the order of the number of its
    elements; a set with an empty coordinate is drawn anew up to twice the rank.
    """
    result = np.zeros((owners, coordinates), np.uint64)
    if not len(elements):
        return result
    total = np.bincount(owner, weights, owners)
    wanted = coordinates * math.log(coordinates) + 2 * coordinates
    limit = np.zeros(owners)
    limit[total > 0] = 2.0 ** np.ceil(np.log2(wanted / total[total > 0]))
    todo = np.arange(len(elements))
    while len(todo):
        best = np.full(owners * coordinates, np.inf)
        value = np.zeros(owners * coordinates, np.uint64)
        for place, rank, dart in _darts(elements[todo], weights[todo], owner[todo], limit, coordinates):
            order = np.lexsort((dart, rank, place))
            place, rank, dart = place[order], rank[order], dart[order]
            first = np.ones(len(place), bool)
            first[1:] = place[1:] != place[:-1]
            place, rank, dart = place[first], rank[first], dart[first]
            better = (rank < best[place]) | ((rank == best[place]) & (dart < value[place]))
            best[place[better]], value[place[better]] = rank[better], dart[better]
        drawn = np.unique(owner[todo])
        result[drawn] = value.reshape(owners, coordinates)[drawn]
        lacking = drawn[np.isinf(best.reshape(owners, coordinates)[drawn]).any(axis=1)]
        limit[lacking] *= 2
        todo = todo[np.isin(owner[todo], lacking)]
    return result


def _darts(elements, weights, owner, limit, coordinates) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set and coordinate, rank, dart) of all darts, a number at a time."""
    region, begin = 0, 0.0
    inside = np.arange(len(elements))
    while len(inside):
        width = 1.0 if region == 0 else 2.0 ** (region - 1)
        live, rank, number = inside, np.zeros(len(inside)), 0
        with np.errstate(over="ignore"):
            seed = mixed(elements[inside] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(region + 1))
        while len(live):
            with np.errstate(over="ignore"):
                dart = mixed(seed + np.uint64(0xD1342543DE82EF95) * np.uint64(number + 1))
                other = mixed(dart ^ np.uint64(0xA0761D6478BD642F))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
            go = rank < limit[owner[live]]
            live, rank, seed, dart, other = live[go], rank[go], seed[go], dart[go], other[go]
            at = begin + width * ((other >> np.uint64(32)).astype(float) * 2.0**-32)
            hit = at < weights[live]
            coordinate = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(coordinates)) >> np.uint64(32)
            yield owner[live[hit]] * coordinates + coordinate[hit].astype(np.int64), rank[hit], dart[hit]
            number += 1
        begin += width
        region += 1
        inside = inside[weights[inside] > begin]


def _signatures(bands: int, rows: int, words: int, weighted: bool):
    coordinates = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group: list[tuple[int, np.ndarray, np.ndarray]] = []
            held = 0
            for found in batch_shingles(batch.column("text"), words):
                group.append(found)
                held += len(found[1]) + 2 * coordinates
                if held > 100_000:
                    yield _signed(batch, group, coordinates, rows, weighted)
                    group, held = [], 0
            if group:
                yield _signed(batch, group, coordinates, rows, weighted)

    return run


def _signed(batch: pa.RecordBatch, group, coordinates: int, rows: int, weighted: bool) -> pa.RecordBatch:
    sizes = np.array([len(s) for _, s, _ in group], np.int64)
    elements = np.concatenate([s for _, s, _ in group])
    counts = np.concatenate([c for _, _, c in group])
    owner = np.repeat(np.arange(len(group)), sizes)
    signature = dart_minhash(elements, counts.astype(float) if weighted else np.ones(len(elements)), owner, len(group), coordinates)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(coordinates // rows, dtype=np.uint64)[None] + np.uint64(1), (len(group), coordinates // rows)).copy()
        for r in range(rows):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows])
        # A set's digest: two sums over its elements (with their counts, if these matter).
        term = elements * np.uint64(0xD6E8FEB86659FD93) + (counts.astype(np.uint64) if weighted else np.uint64(1))
        digest = [np.zeros(len(group), np.uint64) for _ in range(2)]
        for k, d in enumerate(digest):
            np.add.at(d, owner, mixed(term ^ np.uint64(0x2545F4914F6CDD1D * (k + 1) % 2**64)))
    bits = np.zeros((len(group), 128), np.uint8)
    bits[:, : min(128, coordinates)] = (signature[:, :128] & np.uint64(1)).astype(np.uint8)
    sketch = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    some = sizes > 0
    if weighted:
        sizes = np.bincount(owner, counts, len(group)).astype(np.int64)
    at = pa.array(np.array([p for p, _, _ in group], np.int64)[some])
    flat = pa.array(keys[some].view(np.int64).ravel())
    offsets = pa.array(np.arange(int(some.sum()) + 1, dtype=np.int32) * (coordinates // rows))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(at), pa.array(sizes[some]), pa.array(digest[0][some].view(np.int64)), pa.array(digest[1][some].view(np.int64)),
         pa.array(sketch[some, 0]), pa.array(sketch[some, 1]), pa.ListArray.from_arrays(offsets, flat)],
        ["doc_id", "size", "d1", "d2", "s1", "s2", "keys"],
    )


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, bands: int = BANDS, rows: int = ROWS, weighted: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Classes of documents whose word shingles have a Jaccard similarity of ``similarity`` or more.

    One row per row of ``docs``: ``doc_id, class_id`` (smallest id of its class), ``kept`` (it
    is that one). Classes are what links connect, directly or through others. With ``weighted``
    a shingle weighs as often as it occurs, else once. Null, empty and blank texts have no
    shingles and are classes of their own; so are rows of null id. Ids must be whole numbers;
    rows that share an id are one document where their shingles are equal.

    Documents of equal shingles are one from the start, and band keys of one document drop out.
    In a first round the documents of a key meet its leader only: the one whose keys are the
    most popular ones, as the original of a group of edited copies has what most of them share.
    In a second round documents of a key that are still in different classes meet, if size and a
    bit of each coordinate agree well enough, and what each has in common with any other such
    document could make up the similarity. Under a key of more than ``FEW`` documents they meet
    only where they differ from its leader alike (see ``_by_differences``, which leaves out no
    pair that is near enough): a copy with many edits of its own has these in common with
    hardly any other, so a group of such copies does not meet in pairs. Every pair found is held
    against its exact similarity.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written_alone(lambda: _classes(texts, similarity, words, bands, rows, weighted))
    joined = texts.select("doc_id").join(found, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


@in_short_batches
def _classes(texts: DataFrame, similarity: float, words: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """``doc_id, class_id`` of the ids with shingles."""
    coordinates = bands * rows
    # Bits that differ between two sets of the least similarity: the mean and 5 standard deviations.
    odds = (1 - similarity) / 2
    width = min(128, coordinates)
    apart = math.ceil(width * odds + 5 * math.sqrt(width * odds * (1 - odds)))
    signed = texts.where("doc_id IS NOT NULL").mapInArrow(
        trimmed(_signatures(bands, rows, words, weighted)),
        "doc_id long, size long, d1 long, d2 long, s1 long, s2 long, keys array<long>",
    )
    signed = cut_lineage(signed)
    same = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("size", "s1", "s2", "keys")])
    same = cut_lineage(same)
    traits = same.select("id", "size", "s1", "s2")
    side = lambda name: traits.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "s1", "s2")])

    live = shared_keys(same.select("id", F.explode("keys").alias("key")))
    first_of = leaders(live)
    star = live.join(first_of, "key").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(side("a"), "a").join(side("b"), "b").where(_alike(similarity, apart))
    star = cut_lineage(star.select("a", "b"))
    first = cut_lineage(_verified(star, _sets_of(texts, _ends(star), words), similarity, weighted))

    linked = cut_lineage(components(first))
    placed = live.select("key", "id", "n").join(linked.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("key", "id", "n", F.coalesce("component", "id").alias("class"))
    open_keys = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    placed = cut_lineage(placed.join(open_keys, "key"))
    sets = _sets_of(texts, placed.select("id").distinct(), words)
    able = traits.join(_common(sets, weighted), "id")
    able = cut_lineage(able.where(F.col("common") >= similarity * F.col("size") - 1e-9))
    placed = cut_lineage(placed.join(able, "id"))
    few = placed.where(F.col("n") <= FEW)
    ours, theirs = (few.withColumnsRenamed({c: f"{c}_{name}" for c in (*able.columns, "class")}) for name in "ab")
    least = F.least("common_a", "common_b")
    meets = (ours["key"] == theirs["key"]) & (F.col("id_a") < F.col("id_b")) & (F.col("class_a") != F.col("class_b")) & _alike(similarity, apart)
    meets = meets & (least >= similarity * (F.col("size_a") + F.col("size_b") - least) - 1e-9)
    rest = ours.join(theirs, meets).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    led = placed.where(F.col("n") > FEW).join(first_of, "key").select("leader", "id", "class").distinct()
    many = _by_differences(cut_lineage(led), sets, similarity, weighted)
    many = many.join(side("a"), "a").join(side("b"), "b").where(_alike(similarity, apart)).select("a", "b")
    rest = cut_lineage(rest.unionByName(many).distinct())
    links = first.unionByName(_verified(rest, sets.join(_ends(rest), "id", "left_semi"), similarity, weighted))

    classes = same.join(components(links).withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("d1", "d2", F.coalesce("component", "id").alias("class_id"))
    # An id that has several texts is in the class of the smallest.
    return signed.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def _alike(similarity: float, apart: int):
    bits = F.bit_count(F.col("s1_a").bitwiseXOR(F.col("s1_b"))) + F.bit_count(F.col("s2_a").bitwiseXOR(F.col("s2_b")))
    return (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9) & (bits <= apart)


def _by_differences(led: DataFrame, sets: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """Pairs ``a, b`` of documents of different classes under one leader that may be near each other, from rows ``leader, id, class``.

    With D a document's difference from the leader's set, two sets of sizes m and n differ by
    their differences' difference. To be similar by s they may differ by c (m + n) at most, with
    c = (1 - s) / (1 + s), so their differences share o = (|Di| + |Dj| - c (m + n)) / 2 elements
    or more. That is at least one, as a document of another class than the leader's differs from
    it by more than c times their sizes. In one order of all elements, the first shared one then
    is not among the last o - 1 of either. What the leader lacks comes first in that order, as
    it is rare.
    """
    c = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                mine, first = (_multiset(row[f"elements_{x}"], row[f"counts_{x}"], weighted) for x in "ba")
                added, lost = np.setdiff1d(mine, first, assume_unique=True), np.setdiff1d(first, mine, assume_unique=True)
                differ = np.concatenate([added, lost]).view(np.int64)
                # No partner shares fewer than these: one outside the leader's class, or for such a document any.
                least = (len(differ) + c * (len(first) - len(mine))) / 2 if row["inside"] else (len(differ) - c * (len(first) + len(mine))) / 2
                n = len(differ) - max(1, math.ceil(least - 1e-9)) + 1
                if n > 0:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, row["a"])), pa.array(np.full(n, row["b"])), pa.array(np.full(n, row["class"])), pa.array(differ[:n]),
                         pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, len(differ), np.int32)), pa.array(np.full(n, len(mine), np.int32))],
                        ["leader", "id", "class", "element", "place", "differ", "size"])

    of_leader = led.where("id = leader").select(F.col("leader").alias("l"), F.col("class").alias("leader_class")).distinct()
    pairs = led.where("id <> leader").join(of_leader, F.col("leader") == F.col("l"), "left")
    pairs = pairs.select(F.col("leader").alias("a"), F.col("id").alias("b"), "class", F.coalesce(F.col("class") == F.col("leader_class"), F.lit(False)).alias("inside"))
    met = pairs.join(sets.withColumnsRenamed({x: f"{x}_a" for x in ("elements", "counts")}).withColumnRenamed("id", "a"), "a")
    met = met.join(sets.withColumnsRenamed({x: f"{x}_b" for x in ("elements", "counts")}).withColumnRenamed("id", "b"), "b")
    rows = cut_lineage(met.mapInArrow(trimmed(run), "leader long, id long, class long, element long, place int, differ int, size int"))
    names = ("id", "class", "place", "differ", "size")
    ours, theirs = (rows.withColumnsRenamed({x: f"{x}_{side}" for x in names}) for side in "ab")
    shared = F.greatest(F.lit(1), F.ceil((F.col("differ_a") + F.col("differ_b") - c * (F.col("size_a") + F.col("size_b"))) / 2 - 1e-9))
    reach = (F.col("place_a") <= F.col("differ_a") - shared) & (F.col("place_b") <= F.col("differ_b") - shared)
    met = ours.join(theirs, ["leader", "element"]).where((F.col("id_a") < F.col("id_b")) & (F.col("class_a") != F.col("class_b")) & reach)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _multiset(elements: bytes, counts: bytes, weighted: bool) -> np.ndarray:
    """The elements, ascending; with weights each as often as it occurs, told apart by number."""
    found = np.frombuffer(elements, np.uint64)
    if not weighted:
        return found
    times = np.frombuffer(counts, np.int32)
    number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        return np.sort(mixed(np.repeat(found, times) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _common(sets: DataFrame, weighted: bool) -> DataFrame:
    """``id, common``: how much of each set is in another of the sets too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                elements = np.frombuffer(batch.column("elements")[k].as_py(), np.int64)
                weights = np.frombuffer(batch.column("counts")[k].as_py(), np.int32) if weighted else np.ones(len(elements), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(elements), batch.column("id")[k].as_py())), pa.array(elements), pa.array(weights)], ["id", "element", "weight"])

    elements = sets.mapInArrow(trimmed(run), "id long, element long, weight int")
    # An element of one set is gone after the partial sums; of the others only their hashes go on.
    shared = elements.groupBy("element").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("element")
    return elements.join(shared, "element").groupBy("id").agg(F.sum("weight").alias("common"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _sets_of(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, elements, counts``: the shingles of the given documents, as bytes."""
    ids = cut_lineage(ids)
    table = bounded_filter(ids.select(F.xxhash64("id").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(maybe_in(table.value, whole.column("h").to_numpy())))
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found = [(s.tobytes(), c.astype(np.int32).tobytes()) for _, s, c in batch_shingles(batch.column("text"), words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([s for s, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())],
                    ["id", "elements", "counts"],
                )

    hashed = texts.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = hashed.mapInArrow(trimmed(run), "id long, elements binary, counts binary")
    return cut_lineage(sets.join(ids, "id", "left_semi"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """The pairs ``a, b`` of at least the similarity, computed on all their shingles."""
    ours = sets.select(F.col("id").alias("a"), F.col("elements").alias("elements_a"), F.col("counts").alias("counts_a"))
    theirs = sets.select(F.col("id").alias("b"), F.col("elements").alias("elements_b"), F.col("counts").alias("counts_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = [[np.frombuffer(x.as_py(), kind) for x in batch.column(name)] for name, kind in
                   (("elements_a", np.uint64), ("counts_a", np.int32), ("elements_b", np.uint64), ("counts_b", np.int32))]
            close = [jaccard(*four, weighted) >= similarity for four in zip(*get)]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    met = pairs.join(ours, "a").join(theirs, "b").select("a", "b", "elements_a", "counts_a", "elements_b", "counts_b")
    return met.mapInArrow(trimmed(run), "a long, b long").distinct()


def jaccard(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray, weighted: bool = False) -> float:
    """Jaccard similarity of two sets of distinct ascending elements, or of their counts."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not weighted:
        return len(i) / (len(a) + len(b) - len(i)) if len(a) + len(b) else 0.0
    common = int(np.minimum(a_counts[i], b_counts[j]).sum())
    everything = int(a_counts.sum()) + int(b_counts.sum()) - common
    return common / everything if everything else 0.0


def without_copies(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows without those that are near copies of another that stays; columns as before. Ids may be null or repeat, as each row is one document. ``options`` as for ``near_duplicates``."""
    keyed = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    gone = near_duplicates(keyed, id_col="__row", text_col=text_col, **options).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    return keyed.join(gone, F.col("__row") == F.col("__gone"), "left_anti").select(docs.columns)
