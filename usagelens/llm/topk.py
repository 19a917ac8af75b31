"""Exact top-k search by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.vectors import bounded_sample, common_length, farthest_first, matrix, usable
from usagelens.sources.workspace import cut_lineage

#: Inner products under this are exact in double precision; larger ones are summed up in 64-bit integers.
EXACT = 2**53
#: The ends of a score, for what 64 bits do not hold.
NONE, LOWEST, HIGHEST = -(2**63) + 1, -(2**63) + 2, 2**63 - 1


@dataclass(frozen=True)
class PivotIndex:
    """Vectors keyed by nearest pivot and ring of distance from it.

    ``rows``: ``vec_id, vector, pivot, distance, ring``. ``rings``: per (pivot, ring) the
    number of rows, the smallest and largest distance and norm; its size is bounded by
    ``max_pivots * rings``, so it may be collected.
    """

    rows: DataFrame
    rings: dict[str, np.ndarray]
    pivots: np.ndarray


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector``: components as floor(scale * x), x as double. Vectors that are unusable or not of the
    commonest length are left out, and so are null ids."""
    vector = F.col(vector_col)
    rows = vectors.where(usable(vector)).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )
    rows = rows.where(F.col("vec_id").isNotNull())
    return rows.where(F.size("vector") == common_length(rows, "vector"))


def build_index(rows: DataFrame, max_pivots: int = 16, sample: int = 512, rings: int = 32) -> PivotIndex:
    """Key every row by its nearest pivot and its distance from it.

    Pivots are drawn from a bounded sample (``sample`` rows by smallest hash) by farthest-first
    choice; they bear on the speed only, and every row is indexed. Rings are of equal width.
    """
    drawn = bounded_sample(rows, "vector", sample).astype(float)
    pivots = farthest_first(drawn, max_pivots)
    keyed = cut_lineage(rows.mapInArrow(_keyed(pivots), "vec_id long, vector array<long>, pivot int, distance double, norm double"))
    widest = (keyed.agg(F.max("distance")).first()[0] or 0.0) + 1e-9
    keyed = keyed.withColumn("ring", F.least(F.floor(F.col("distance") / (widest / rings)), F.lit(rings - 1)).cast("int"))
    found = keyed.groupBy("pivot", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("norm").alias("norm"),
    ).orderBy("pivot", "ring").collect()
    names = ("pivot", "ring", "n", "near", "far", "norm")
    return PivotIndex(keyed, {k: np.array([row[k] for row in found]) for k in names}, pivots)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Exact up to rounding: the squares are whole numbers."""
    squares = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _keyed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("vector"))
            distances = _distances(points, pivots)
            nearest = distances.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array(nearest.astype(np.int32)),
                 pa.array(distances[np.arange(len(points)), nearest]), pa.array(np.linalg.norm(points, axis=1))],
                ["vec_id", "vector", "pivot", "distance", "norm"],
            )

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, max_pivots: int = 16, rings: int = 32, block_rows: int = 4_096,
    query_rows: int = 512, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` other rows of highest integer inner product of each query row, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. Result: ``query_id, rank, vec_id, score``; fewer
    rows for a query with fewer candidates. Rows of null id, and vectors that are null, empty
    or hold null or non-finite components, or are not of the commonest length, take no part. Rows that
    repeat an id with an equal vector are one candidate; an id's own rows are never candidates.
    Components of any size are exact, and scores are where 64 bits hold them.

    Rows lie in rings around their nearest pivot. With d the distance of a query from a pivot,
    a row at distance r from that pivot is at least |d - r| from the query, so its inner product
    is at most (|query|^2 + |row|^2 - (d - r)^2) / 2. First each query searches rings outward
    until they hold enough rows, which gives it a k-th score; then the remaining rings whose
    bound reaches that score. Inside a block of rows, sorted by distance, the search expands
    from the query's own distance and stops by the same bound. Rings of many rows are several
    blocks, so the work on a large ring is spread; blocks of queries meet blocks of rows.
    """
    rows = quantised(vectors, scale, id_col, vector_col).dropDuplicates(["vec_id", "vector"])
    index = build_index(cut_lineage(rows), max_pivots, rings=rings)
    if not len(index.rings["n"]):
        return vectors.sparkSession.createDataFrame([], RESULT)
    ends = F.greatest(F.abs(F.array_max("vector").cast("double")), F.abs(F.array_min("vector").cast("double")))
    largest, width = index.rows.agg(F.max(ends), F.max(F.size("vector"))).first()
    kind = np.dtype(np.int32 if largest**2 * width < EXACT else np.int64)

    parts = np.maximum(1, -(-index.rings["n"] // block_rows))
    ring_parts = F.create_map(*[F.lit(int(x)) for pair in zip(index.rings["pivot"] * rings + index.rings["ring"], parts) for x in pair])
    unit = F.col("pivot") * rings + F.col("ring")
    blocks = (
        index.rows.withColumn("unit", unit)
        .withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), ring_parts[unit]))
        .groupBy("unit", "part")
        .agg(F.collect_list(F.struct("distance", "vec_id", "vector")).alias("members"))
        .mapInArrow(_pack(kind), "unit int, part long, ids binary, at binary, points binary, width int")
    )
    blocks = cut_lineage(blocks.select("unit", "ids", "at", "points", "width"))

    queries = index.rows.where(is_query).select("vec_id", "vector")
    query_parts = max(1, -(-queries.count() // query_rows))
    none = queries.withColumn("floor", F.lit(None).cast("long"))
    first = _search(none, blocks, index, rings, k, query_parts, True, kind)
    found = cut_lineage(first)
    floors = found.groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("scores"))
    floors = floors.select("query_id", F.when(F.size("scores") >= k, F.expr(f"element_at(scores, -{k})")).alias("floor"))
    known = queries.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    second = _search(known, blocks, index, rings, k, query_parts, False, kind)
    everything = found.unionByName(second)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # A query whose id occurs with several vectors may meet a row twice.
    best = everything.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


RESULT = "query_id long, rank int, vec_id long, score long"


def _pack(kind: np.dtype):
    """Rows of a block, sorted by distance and id, as bytes: ids, distances and a matrix of whole numbers of the given kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column("members")[i].values
                ids, at = members.field("vec_id").to_numpy(), members.field("distance").to_numpy()
                points = _whole(members.field("vector"))
                by = np.lexsort((ids, at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("unit").slice(i, 1), batch.column("part").slice(i, 1), pa.array([ids[by].tobytes()]),
                     pa.array([at[by].tobytes()]), pa.array([points[by].astype(kind).tobytes()]),
                     pa.array([points.shape[1]], pa.int32())],
                    ["unit", "part", "ids", "at", "points", "width"],
                )

    return run


def _whole(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of 64-bit integers."""
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _search(queries: DataFrame, blocks: DataFrame, index: PivotIndex, rings: int, k: int, query_parts: int, first: bool, kind: np.dtype) -> DataFrame:
    """One round: pick rings for each query, gather the queries of a ring in blocks, meet its blocks."""
    picked = queries.mapInArrow(_pick(index, rings, k, first), "unit int, vec_id long, vector array<long>, floor long, distance double")
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(query_parts))
    gathered = (
        picked.withColumn("part", spread)
        .groupBy("unit", "part")
        .agg(F.collect_list(F.struct("distance", "vec_id", "vector", "floor")).alias("members"))
    )
    packed = gathered.mapInArrow(_pack_queries(kind), "unit int, q_ids binary, q_points binary, q_floors binary, q_at binary")
    pairs = packed.join(blocks, "unit")
    return pairs.mapInArrow(_meet(k, kind), "query_id long, vec_id long, score long")


def _pick(index: PivotIndex, rings: int, k: int, first: bool):
    """The rings a query searches: nearest ones until they hold k others; or all others that can matter."""
    stats, pivots = index.rings, index.pivots
    units = stats["pivot"] * rings + stats["ring"]

    def bounds(points: np.ndarray):
        distance = _distances(points, pivots)[:, stats["pivot"]]
        gap = np.maximum(0, np.maximum(stats["near"] - distance, distance - stats["far"]))
        high = ((points**2).sum(1)[:, None] + stats["norm"] ** 2 - gap**2) / 2
        return distance, gap, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                points = matrix(batch.column("vector"))
                distance, gap, high = bounds(points)
                order = np.argsort(gap, axis=1, kind="stable")
                held = np.cumsum(stats["n"][order], axis=1)
                # Up to and with the ring that brings the rows, besides the query's own, to k.
                early = np.zeros(gap.shape, bool)
                np.put_along_axis(early, order, np.concatenate([np.zeros((len(points), 1)), held[:, :-1]], axis=1) < k + 1, axis=1)
                if first:
                    chosen = early
                else:
                    floor = batch.column("floor").to_pandas().to_numpy(dtype=float)
                    floor = np.where(np.isnan(floor), -np.inf, floor)
                    chosen = ~early & (high + 1e-6 * np.abs(high) + 1e-6 >= floor[:, None])
                q, u = np.nonzero(chosen)
                for at in range(0, len(q), 4_096):
                    i, j = q[at: at + 4_096], u[at: at + 4_096]
                    rows = batch.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(units[j].astype(np.int32)), rows.column("vec_id"), rows.column("vector"), rows.column("floor"),
                         pa.array(distance[i, j])], ["unit", "vec_id", "vector", "floor", "distance"],
                    )

    return run


def _pack_queries(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column("members")[i].values
                points = _whole(members.field("vector")).astype(kind)
                floors = members.field("floor").to_pandas().to_numpy(dtype=float)
                floors = np.where(np.isnan(floors), -np.inf, floors)
                ids, at = members.field("vec_id").to_numpy(), members.field("distance").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("unit").slice(i, 1), *(pa.array([x.tobytes()]) for x in (ids, points, floors, at))],
                    ["unit", "q_ids", "q_points", "q_floors", "q_at"],
                )

    return run


def _meet(k: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                width = raw["width"]
                points = np.frombuffer(raw["points"], kind).reshape(-1, width)
                ids, at = np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["at"])
                queries = np.frombuffer(raw["q_points"], kind).reshape(-1, width)
                found = expand(queries, np.frombuffer(raw["q_ids"], np.int64), np.frombuffer(raw["q_at"]),
                               np.frombuffer(raw["q_floors"]), points, ids, at, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def expand(queries, q_ids, q_at, floors, points, ids, at, k: int, step: int = 1_024):
    """Best k of a block for each query: the rows, sorted by distance, are taken outward in steps.

    A step's rows are searched for the queries whose bound there still reaches their k-th score.
    Steps go out from the median distance of the queries, for which the near ones come first.
    Points are whole numbers: 32-bit ones, whose products are exact in double precision, or
    64-bit ones. Bounds are doubles with some room in either case.
    """
    exact = points.dtype != np.int64
    none = -np.inf if exact else NONE
    if exact:
        points, queries = points.astype(float), queries.astype(float)
    steps = [(s, min(s + step, len(ids))) for s in range(0, len(ids), step)]
    middle = float(np.median(q_at)) if len(q_at) else 0.0
    steps.sort(key=lambda p: max(0.0, at[p[0]] - middle, middle - at[p[1] - 1]))
    norms, squares = (points.astype(float) ** 2).sum(1), (queries.astype(float) ** 2).sum(1)
    best_score = np.full((len(queries), k), none)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    for s, e in steps:
        gap = np.maximum(0, np.maximum(at[s] - q_at, q_at - at[e - 1]))
        high = (squares + norms[s:e].max() - gap**2) / 2
        live = np.flatnonzero(high + 1e-6 * np.abs(high) + 1e-6 >= np.maximum(floors, np.where(best_score[:, -1] == none, -np.inf, best_score[:, -1].astype(float))))
        if not len(live):
            continue
        scores = queries[live] @ points[s:e].T if exact else _products(queries[live], points[s:e])
        scores[q_ids[live][:, None] == ids[s:e][None]] = none
        all_scores = np.concatenate([best_score[live], scores], axis=1)
        all_ids = np.concatenate([best_id[live], np.broadcast_to(ids[s:e], scores.shape)], axis=1)
        if all_scores.shape[1] > 8 * k:  # the k-th highest score; all rows that reach it stay for the ties
            least = np.partition(all_scores, -k, axis=1)[:, -k]
            rows, columns = np.nonzero(all_scores >= least[:, None])
        else:
            rows, columns = np.nonzero(np.ones(all_scores.shape, bool))
        score, vec = all_scores[rows, columns], all_ids[rows, columns]
        order = np.lexsort((vec, -score, rows))
        rows, score, vec = rows[order], score[order], vec[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        best_score[live[rows[keep]], place[keep]] = score[keep]
        best_id[live[rows[keep]], place[keep]] = vec[keep]
    q, j = np.nonzero(best_score > none)
    return q_ids[q], best_id[q, j], best_score[q, j].astype(np.int64)


def _products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products in 64-bit integers; those beyond are its ends. Sums that pass the ends on the way come back right, as they wrap around."""
    with np.errstate(over="ignore"):
        found = queries @ points.T
    near = queries.astype(float) @ points.T.astype(float)
    found = np.where(near >= 2.0**63, HIGHEST, np.where(near < -(2.0**63), LOWEST, found))
    return np.maximum(found, LOWEST)
