"""Table access, work tables and connected components, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.sources.workspace import cut_lineage

#: Words of the bounded filter: 2^23 bits, 1 MB.
FILTER_WORDS = 1 << 17

#: Bytes of rows that go to a Python function at one time, and the session's setting of them.
BATCH_BYTES, _BATCH_SETTING = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"

#: Column of the keys of rows.
ROW = "__row"

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *[p for p in paths if p]])


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What this worker keeps from task to task.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once a worker and kept until a task comes that is not ``trimmed`` with this name."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def _forget_others(name: str | None) -> bool:
    others = [k for k in _KEPT if k != name]
    for k in others:
        del _KEPT[k]
    return bool(others)


def trimmed(run: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """The same batch function, which gives its worker's freed memory back when a task ends; workers live on between tasks.

    What other operators' tasks left in the worker (``kept``) goes when a task begins, all but what is named ``keeps``;
    then memory is given back too, as a task's last tables are freed only behind its function.
    """

    def inner(batches: Iterator) -> Iterator:
        _forget_others(keeps)
        _give_back()
        yield from run(batches)
        _give_back()

    return inner


def trimmed_group(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of cogroups, behind each of them."""

    def inner(left: pa.Table, right: pa.Table) -> pa.Table:
        if _forget_others(None):
            _give_back()
        found = run(left, right)
        _give_back()
        return found

    return inner


def in_short_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same operator of a table, in whose own jobs rows go to Python in batches of ``BATCH_BYTES``, unless the session sets other ones.

    Every task has its batch in Spark's vectors, in a message and in its worker, all of them
    outside the heap, and by itself Spark fills batches up to 64 MB. What the operator returns is
    computed later, by the session's own setting.
    """

    @wraps(operator)
    def inner(rows: DataFrame, *args, **kwargs):
        conf = rows.sparkSession.conf
        if conf.get(_BATCH_SETTING, None) is not None:
            return operator(rows, *args, **kwargs)
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
        try:
            return operator(rows, *args, **kwargs)
        finally:
            conf.unset(_BATCH_SETTING)

    return inner


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def with_row_keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows, written once, with a key ``ROW`` that no two share: in order of the id, rows of one id in some order. Null ids have keys too."""
    return cut_lineage(docs.withColumn(ROW, F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))))


def merged(ids: DataFrame) -> DataFrame:
    """For the id side of a join with texts: ids grow with the data, so they are never broadcast and the plan is one at every size."""
    return ids.hint("merge")


def bounded_filter(hashes: DataFrame, column: str, words: int = FILTER_WORDS):
    """A filter of 64 bits times ``words``, a power of two, over a column of evenly spread longs, sent to all executors.

    ``maybe_in`` passes all of them, and some others. It thins rows before a join that does the
    rest; when it fills up it only stops saving.
    """
    word, bit = F.expr(f"(`{column}` >> 6) & {words - 1}"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
    table = np.zeros(words, np.int64)
    found = hashes.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table)


def maybe_in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return ((table[(hashes >> 6) & (len(table) - 1)] >> (hashes & 63)) & 1).astype(bool)


def shared_keys(entries: DataFrame, also: Column | None = None) -> DataFrame:
    """The rows ``key, id, ...`` whose key more than one id has, with ``n``, how many rows have it; ``also`` is a further condition on all rows of a key.

    Keys meet through partial sums and a join that Spark can split, never in a window.
    """
    sizes = entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"), (F.lit(True) if also is None else also).alias("also"))
    return cut_lineage(entries.join(cut_lineage(sizes.where("low <> high AND also").select("key", "n")), "key"))


def leaders(live: DataFrame, eligible: Column | None = None) -> DataFrame:
    """``key, leader``: of the ids of each key the one whose keys are the most popular, ties to the smallest."""
    weight = live.groupBy("id").agg(F.sum("n").alias("weight"))
    chosen = live.where(eligible) if eligible is not None else live
    best = chosen.join(weight, "id").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id")).alias("best"))
    return cut_lineage(best.select("key", F.col("best.id").alias("leader")))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Connected components of an undirected graph: ``node`` and ``component``, its smallest node.

    Large-star and small-star steps in turn until the edges stay as they are, which then join
    every node to its smallest. A node meets its own edges only through a minimum (reduced
    before the shuffle) and an inner join, whose large side Spark can split. Each round's edges
    are written to the shared folder. Nodes without edges, loops and null ends are left out.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges, before = cut_lineage(edges), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
