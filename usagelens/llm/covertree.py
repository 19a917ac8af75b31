"""Near-duplicate vectors: exact threshold pairs by traversing two cover trees at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import components
from usagelens.llm.vectors import bounded_sample, common_length, farthest_first, matrix, usable
from usagelens.sources.workspace import cut_lineage

#: Slack of the bounds against rounding; pairs between the bounds are always computed.
SLACK = 1e-9
#: Row pairs that are computed at once rather than by way of their nodes, and the share of a node
#: pair's row pairs left by the bounds from which on all of them are.
SMALL, DENSE = 4_096, 0.01
#: Levels below the widest node, each of half the radius.
DEPTH = 6


@dataclass
class Tree:
    """A cover tree over the rows of a block, which are in the order of its depth-first walk.

    Per node: its centre (a row), covering radius (the exact largest distance of its rows from
    the centre), the rows from ``start`` to ``end``, and the children ``child`` up to ``last``
    (none for a leaf). Node 0 is the root.
    """

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    last: np.ndarray


def build_tree(unit: np.ndarray, depth: int = DEPTH) -> Tree:
    """Nested levels over unit vectors: the children of a node cover its rows at half its level's radius.

    The root's level has radius 2, the largest distance there is. A child takes the first
    row that none has covered yet as its centre, and all rows within the level's radius of it.
    """
    nodes: list[list] = []  # centre, radius, start, end, child, last; rows in order
    order: list[np.ndarray] = []
    placed = 0
    todo = [(np.arange(len(unit)), 0)] if len(unit) else []
    # Level by level, so that the children of a node have neighbouring numbers.
    while todo:
        following = []
        for rows, level in todo:
            distance = _distance(unit[rows], unit[rows[:1]])[:, 0]
            nodes.append([rows[0], float(distance.max()), rows, 0, 0, level])
        for at, (rows, level) in enumerate(todo):
            node = nodes[len(nodes) - len(todo) + at]
            if len(rows) == 1 or node[1] < SLACK or level == depth:
                continue
            parts = _cover(unit, rows, 2.0 ** -level)
            node[3], node[4] = len(nodes) + len(following), len(nodes) + len(following) + len(parts)
            following += [(part, level + 1) for part in parts]
        todo = following
    start, end = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    stack = [0] if nodes else []
    while stack:
        i = stack.pop()
        if i < 0:
            end[~i] = placed
            continue
        start[i] = placed
        stack.append(~i)
        if nodes[i][4]:
            stack.extend(range(nodes[i][4] - 1, nodes[i][3] - 1, -1))
        else:
            order.append(nodes[i][2])
            placed += len(nodes[i][2])
    walk = np.concatenate(order) if order else np.zeros(0, np.int64)
    place = np.empty(len(walk), np.int64)
    place[walk] = np.arange(len(walk))
    column = lambda k, kind: np.array([n[k] for n in nodes], kind)
    return Tree(walk, place[column(0, np.int64)] if nodes else walk, column(1, float), start, end, column(3, np.int64), column(4, np.int64))


def _cover(unit: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """Greedy cover of rows by balls around rows, in their order. Distances are computed for many rows at a time."""
    least, parts = 1 - radius**2 / 2, []
    open_rows = np.ones(len(rows), bool)
    for s in range(0, len(rows), 256):
        chunk = np.flatnonzero(open_rows[s: s + 256]) + s
        if not len(chunk):
            continue
        later = np.flatnonzero(open_rows)
        near = unit[rows[chunk]] @ unit[rows[later]].T >= least
        for k, i in enumerate(chunk.tolist()):
            if open_rows[i]:
                mine = later[near[k] & open_rows[later]]
                mine = np.concatenate([[i], mine[mine != i]])
                open_rows[mine] = False
                parts.append(rows[mine])
    return parts


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class _Links:
    """What a pair of blocks contributes: linked copies per row, and a spanning forest of the links."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.up = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.weights[j])
        np.add.at(self.count, j, self.weights[i])
        for a, b in zip(i.tolist(), j.tolist()):
            self.tie(a, b)

    def product(self, i: np.ndarray, j: np.ndarray) -> None:
        """All of i with all of j (two separate sets)."""
        self.count[i] += self.weights[j].sum()
        self.count[j] += self.weights[i].sum()
        for k in (*i.tolist(), *j.tolist()):
            self.tie(int(i[0]), k)

    def within(self, i: np.ndarray) -> None:
        self.count[i] += self.weights[i].sum() - self.weights[i]
        for k in i.tolist():
            self.tie(int(i[0]), k)


def traverse(raw: np.ndarray, a: Tree, b: Tree, shift: int, threshold: float, links: _Links) -> None:
    """Add the links between the rows of two trees (or within one, if ``b`` is ``a``).

    ``raw`` has the rows of ``a`` and, from ``shift`` on, those of ``b``. Pairs of nodes whose
    centres are farther apart than both covering radii and the limit are dropped; pairs that
    lie within the limit as a whole are added without looking at their rows; of the rest, the
    children are paired. Small pairs of nodes, and those of which the bounds leave much, are
    multiplied out. What comes near the limit is compared by its cosine.
    """
    norm = np.linalg.norm(raw, axis=1)
    unit = raw / norm[:, None]
    limit = np.sqrt(max(0.0, 2 - 2 * threshold))
    same = a is b

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        for s in range(0, len(i), 65_536):
            p, q = i[s: s + 65_536], j[s: s + 65_536]
            linked = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q]) >= threshold
            links.pairs(p[linked], q[linked])

    def dense(m: int, n: int) -> None:
        own = same and m == n
        i, j = np.arange(a.start[m], a.end[m]), shift + np.arange(b.start[n], b.end[n])
        for s in range(0, len(i), 1_024):
            part = i[s: s + 1_024]
            p, q = np.nonzero(unit[part] @ unit[j].T >= 1 - (limit + SLACK) ** 2 / 2)
            if own:
                p, q = p[part[p] < j[q]], q[part[p] < j[q]]
            compare(part[p], j[q])

    size_a, size_b = a.end - a.start, b.end - b.start
    stack = [(0, 0)] if len(a.centre) and len(b.centre) else []
    while stack:
        m, n = stack.pop()
        own = same and m == n
        inner_a, inner_b = a.last[m] > 0, b.last[n] > 0
        if not inner_a and not inner_b or size_a[m] * size_b[n] <= SMALL:
            dense(m, n)
            continue
        ours = np.arange(a.child[m], a.last[m]) if inner_a else np.array([m])
        theirs = np.arange(b.child[n], b.last[n]) if inner_b else np.array([n])
        found = []
        for s in range(0, len(ours), 1_024):
            part = ours[s: s + 1_024]
            dots = unit[a.centre[part]] @ unit[shift + b.centre[theirs]].T
            reach = a.radius[part][:, None] + b.radius[theirs][None]
            p, q = np.nonzero(dots >= 1 - (limit + reach + SLACK) ** 2 / 2)
            if own:
                p, q = p[part[p] <= theirs[q]], q[part[p] <= theirs[q]]
            whole = np.sqrt(np.maximum(0, 2 - 2 * dots[p, q])) + reach[p, q] <= limit - SLACK
            found.append((part[p], theirs[q], whole))
        x, y, whole = (np.concatenate(f) for f in zip(*found))
        if len(x) > 64 and (size_a[x] * size_b[y])[~whole].sum() > DENSE * size_a[m] * size_b[n]:
            # The bounds hold off too little here for their price.
            dense(m, n)
            continue
        for i, j, all_linked in zip(x.tolist(), y.tolist(), whole.tolist()):
            if own and i == j:
                if size_a[i] > 1 and all_linked:
                    links.within(np.arange(a.start[i], a.end[i]))
                elif size_a[i] > 1:
                    stack.append((i, j))
            elif all_linked:
                links.product(np.arange(a.start[i], a.end[i]), shift + np.arange(b.start[j], b.end[j]))
            else:
                stack.append((i, j))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, max_centres: int = 16, sample: int = 512, block_rows: int = 4_096,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Links of cosine ``threshold`` or more between all vectors, and the components they form.

    One row per vector: ``vec_id, n_links`` (other vectors linked directly), ``component_id``
    (smallest id reachable), ``kept`` (the vector of that id). Vectors that are null, empty,
    zero, hold null or non-finite components, have a null id or not the commonest length link
    with nothing: 0 links, a component of their own. An id that repeats with an equal vector is
    one row; with another vector it is a row of its own, and its rows share a component.

    Equal vectors are compared once. The upper tree is over all data: centres from a bounded
    sample, and around each centre shells of halving radii, a node per (centre, shell) with the
    exact covering radius over all its rows. Its size is bounded by ``max_centres * (DEPTH + 2)``,
    so the pairs of nodes that bounds leave are found on the driver. Nodes whose pairs are all
    within the limit are linked as a whole. The rest meet in blocks of bounded size, a tree
    each, in any number of tasks; a pair of blocks gives back counts and a spanning forest,
    never its pairs.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    fit = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    # A vector whose squares vanish in double precision has no direction.
    squares = F.aggregate(F.col("vector"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fit = fit & F.coalesce((squares > 0) & (squares < float("inf")), F.lit(False))
    length = common_length(rows.where(fit), "vector")
    fit = fit & (F.size("vector") == length)
    classes = rows.where(fit).select(F.col("vec_id"), F.transform("vector", lambda x: x.cast("double")).alias("vector")).distinct()
    classes = classes.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))
    drawn = bounded_sample(classes, "vector", sample)
    if not len(drawn):
        return _result(rows.distinct(), None)
    centres = farthest_first(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), max_centres)
    nodes = cut_lineage(classes.mapInArrow(_place(centres), "class long, least long, n long, vector array<double>, node int, distance double"))
    stats = nodes.groupBy("node").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.count(F.lit(1)).alias("rows"),
        F.sum("n").alias("n"), F.min("least").alias("least"),
    ).orderBy("node").collect()
    surviving, whole = node_pairs(stats, centres, threshold)

    spark = vectors.sparkSession
    number = spark.createDataFrame([(s["node"], max(1, -(-s["rows"] // block_rows))) for s in stats], "node int, parts long")
    blocks = (
        nodes.join(F.broadcast(number), "node")
        .groupBy("node", F.pmod(F.xxhash64("class"), "parts").alias("part"))
        .agg(F.collect_list(F.struct("class", "least", "n", "vector")).alias("members"))
        .mapInArrow(_pack, "node int, part long, classes binary, leasts binary, weights binary, points binary, width int, tree array<binary>")
    )
    blocks = cut_lineage(blocks)
    names = ("part", "classes", "leasts", "weights", "points", "width", "tree")
    pairs = spark.createDataFrame(surviving, "node_a int, node_b int")
    ours = blocks.select(F.col("node").alias("node_a"), *[F.col(c).alias(f"{c}_a") for c in names])
    theirs = blocks.select(F.col("node").alias("node_b"), *[F.col(c).alias(f"{c}_b") for c in names])
    met = F.broadcast(pairs).join(ours, "node_a").join(theirs, "node_b")
    met = met.where("node_a <> node_b OR part_a <= part_b")
    found = cut_lineage(met.mapInArrow(_meet(threshold), "class long, linked long, least long, other long"))

    linked = found.where("class IS NOT NULL").groupBy("class").agg(F.sum("linked").alias("linked"))
    edges = found.where("least IS NOT NULL").select(F.col("least").alias("a"), F.col("other").alias("b"))
    if whole:
        extra = spark.createDataFrame(whole, "node int, others long, own boolean, root long")
        tied = nodes.join(F.broadcast(extra), "node")
        edges = edges.unionByName(tied.select(F.col("least").alias("a"), F.col("root").alias("b")))
        more = tied.select("class", (F.col("others") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("linked"))
        linked = linked.unionByName(more).groupBy("class").agg(F.sum("linked").alias("linked"))
    labels = components(edges)
    per_class = (
        classes.join(linked, "class", "left").join(labels.withColumnRenamed("node", "least"), "least", "left")
        .select("vector", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    )
    return _result(rows.distinct(), per_class)


def _result(rows: DataFrame, per_class: DataFrame | None) -> DataFrame:
    if per_class is None:
        joined = rows.withColumns({"n_links": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    else:
        as_double = F.transform("vector", lambda x: x.cast("double"))
        joined = rows.withColumn("wide", as_double).join(per_class.withColumnRenamed("vector", "of"), (F.col("wide") == F.col("of")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _place(centres: np.ndarray):
    """Node of a vector: its nearest centre and the shell of halving radius around it that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("vector"))
            apart = _distance(points / np.linalg.norm(points, axis=1, keepdims=True), centres)
            nearest = apart.argmin(1)
            distance = apart[np.arange(len(points)), nearest]
            shell = np.clip(np.floor(1 - np.log2(np.maximum(distance, 1e-12))), 0, DEPTH + 1).astype(int)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("class", "least", "n", "vector")),
                 pa.array((nearest * (DEPTH + 2) + shell).astype(np.int32)), pa.array(distance)],
                ["class", "least", "n", "vector", "node", "distance"],
            )

    return run


def node_pairs(stats: list, centres: np.ndarray, threshold: float):
    """Pairs of nodes whose rows may link, and what nodes linked as a whole add: (node, others, own, root)."""
    limit = np.sqrt(max(0.0, 2 - 2 * threshold))
    node = np.array([s["node"] for s in stats])
    near, far = (np.array([s[k] for s in stats]) for k in ("near", "far"))
    apart = _distance(centres, centres)[np.ix_(node // (DEPTH + 2), node // (DEPTH + 2))]
    low = np.maximum(apart - far[:, None] - far[None], np.maximum(near[:, None] - apart - far[None], near[None] - apart - far[:, None]))
    high = apart + far[:, None] + far[None]
    i, j = np.nonzero((low <= limit + SLACK) & (np.arange(len(node))[:, None] <= np.arange(len(node))[None]))
    surviving, whole = [], []
    for a, b in zip(i.tolist(), j.tolist()):
        if high[a, b] > limit - SLACK:
            surviving.append((int(node[a]), int(node[b])))
            continue
        root = min(stats[a]["least"], stats[b]["least"])
        whole.append((int(node[a]), int(stats[b]["n"]), a == b, root))
        if a != b:
            whole.append((int(node[b]), int(stats[a]["n"]), False, root))
    return surviving, whole


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            members = batch.column("members")[i].values
            points = matrix(members.field("vector"))
            tree = build_tree(points / np.linalg.norm(points, axis=1, keepdims=True))
            column = lambda name: members.field(name).to_numpy()[tree.order].tobytes()
            parts = [x.tobytes() for x in (tree.centre, tree.radius, tree.start, tree.end, tree.child, tree.last)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(i, 1), batch.column("part").slice(i, 1), pa.array([column("class")]), pa.array([column("least")]),
                 pa.array([column("n")]), pa.array([_shortest(points[tree.order])]),
                 pa.array([points.shape[1]], pa.int32()), pa.array([parts], pa.list_(pa.binary()))],
                ["node", "part", "classes", "leasts", "weights", "points", "width", "tree"],
            )


def _shortest(points: np.ndarray) -> bytes:
    """As single precision where that loses nothing, which the length tells."""
    single = points.astype(np.float32)
    return single.tobytes() if np.array_equal(single, points) else points.tobytes()


def _unpack(batch: pa.RecordBatch, i: int, side: str):
    get = lambda name: batch.column(f"{name}_{side}")[i].as_py()
    classes, leasts, weights = (np.frombuffer(get(c), np.int64) for c in ("classes", "leasts", "weights"))
    raw, width = get("points"), get("width")
    kind = np.float32 if len(raw) == 4 * width * len(classes) else np.float64
    tree = [np.frombuffer(x, float if k == 1 else np.int64) for k, x in enumerate(get("tree"))]
    return classes, leasts, weights, np.frombuffer(raw, kind).astype(float).reshape(-1, width), Tree(np.arange(len(classes)), *tree)


def _meet(threshold: float):
    """Per pair of blocks, a row for every linked class: its links here, and a smaller class it is tied to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = all(batch.column(f"{c}_a")[i].as_py() == batch.column(f"{c}_b")[i].as_py() for c in ("node", "part"))
                ours = _unpack(batch, i, "a")
                theirs = ours if own else _unpack(batch, i, "b")
                classes, leasts, weights, points = (x if own else np.concatenate([x, y]) for x, y in zip(ours[:4], theirs[:4]))
                links = _Links(weights)
                traverse(points, ours[4], theirs[4], 0 if own else len(ours[0]), threshold, links)
                rows = np.flatnonzero(links.count)
                roots = np.array([links.find(k) for k in rows.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (classes[rows], links.count[rows], leasts[rows], leasts[roots])],
                    ["class", "linked", "least", "other"],
                )

    return run
