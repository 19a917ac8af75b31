"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, WORD, merged, with_row_keys
from usagelens.sources.workspace import cut_lineage

#: Slots of virtual time: per unit of time, and again per slot, to find where the budget ends.
SLOTS = 2048


@dataclass(frozen=True)
class Mix:
    """``docs``: a row per document row with what the mix takes of it. ``targets``: a row per source.

    Where the documents had row keys (see ``with_row_keys``), ``docs`` has them too.
    """

    docs: DataFrame
    targets: DataFrame
    budget: int


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Target words of each source: shares by weight, none above ``max_repeat`` times its size.

    ``sizes`` has one row per source: ``source``, ``source_size``. Sources take the weights in
    turn, in code point order, null last. What a full source cannot take goes to the others by
    weight: with sources in order of (cap / weight), all before the first whose share of the
    rest fits below its cap are full, and all from there on get that share. The windows run
    over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", place.alias("rank"), weight.cast("long").alias("weight"))
    rows = rows.withColumn("cap", F.col("source_size") * max_repeat)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("level", rest.cast("double") / F.sum("weight").over(after))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return rows.select("source", "rank", "weight", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """Which documents a mix takes, and how often.

    Each source hands out its documents in a shuffled order (by the MD5 of the id), up to
    ``max_repeat`` times over. A document's virtual finish time is the words its source has
    handed out by then, divided by the source's target, so every source is through with its
    target at time 1. All (document, pass) pairs are put in order of that time, and the order
    ends where the running sum would exceed the budget, the words of all sources.

    Running sums go by the first three digits of the hash, so no source is in one task; the end
    is looked for in slots of virtual time, which fill evenly whatever the sizes of the sources.
    No text is shuffled. Empty or null texts have size 0 and nothing is taken of them; a null
    source is a source; rows of one id are mixed as they stand, each on its own.
    """
    row = [ROW] if ROW in docs.columns else []
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("draw"), *row,
    ))
    targets = cut_lineage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0

    # A null source pairs with the null target; there is one row per source.
    known = targets.select(F.col("source").alias("of"), "rank", "source_size", "target")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", F.substring("draw", 1, 3))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rank", "bucket").orderBy("draw", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(inside)).join(starts, ["rank", "bucket"])
    rows = cut_lineage(rows.select(
        "doc_id", "source", "size", "source_size", "target", "rank", "draw", (F.col("start") + F.col("within")).alias("served"), *row,
    ))

    passes = [(p, _finish(p)) for p in range(1, max_repeat + 1)]
    pairs = rows.where("size > 0").select(
        "rank", "draw", "size", F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), t.alias("finish")) for p, t in passes])).alias("at"),
    ).select("rank", "draw", "size", "at.*").where(F.col("finish").isNotNull())
    last = _last_taken(pairs, budget)
    if last is None:
        taken = F.lit(0)
    else:
        place = lambda p, t: F.struct(t, "rank", "draw", F.lit(p))
        end = F.struct(*[F.lit(last[k]) for k in ("finish", "rank", "draw", "pass")])
        taken = sum((F.when(t.isNotNull() & (place(p, t) <= end), 1).otherwise(0) for p, t in passes), F.lit(0))
    taken = F.when(F.col("size") > 0, taken * F.col("size")).otherwise(0).cast("long")
    return Mix(rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *row), targets, budget)


def _finish(number: int) -> Column:
    """Virtual finish time of a row in its source's pass ``number``; null for a source without target."""
    served = (F.col("served") + F.col("source_size") * (number - 1)).cast("double")
    return F.when(F.col("target") > 0, served / F.col("target"))


def _last_taken(pairs: DataFrame, budget: int):
    """The last pair in order of (finish, rank, draw, pass) up to which the sizes add to the budget at most."""
    slot = F.floor(F.col("finish") * SLOTS)
    slots = pairs.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"))
    first, before = _crossing(slots, budget, 0)
    if first is None:
        return pairs.agg(F.max(F.struct("finish", "rank", "draw", "pass")).alias("last")).first()["last"]
    fine = F.floor(F.col("finish") * SLOTS * SLOTS)
    second, before = _crossing(pairs.where(slot == first).groupBy(fine.alias("slot")).agg(F.sum("size").alias("words")), budget, before)
    running = Window.orderBy("finish", "rank", "draw", "pass").rowsBetween(Window.unboundedPreceding, 0)
    within = pairs.where((slot == first) & (fine == second)).withColumn("words", F.sum("size").over(running) + before)
    found = within.where(F.col("words") <= budget).agg(F.max(F.struct("finish", "rank", "draw", "pass")).alias("last")).first()["last"]
    earlier = pairs.where((slot < first) | ((slot == first) & (fine < second)))
    return found or earlier.agg(F.max(F.struct("finish", "rank", "draw", "pass")).alias("last")).first()["last"]


def _crossing(slots: DataFrame, budget: int, before: int):
    """The slot in which the running sum passes the budget, and the sum before it."""
    running = slots.withColumn("end", F.sum("words").over(Window.orderBy("slot")) + before)
    row = running.where(F.col("end") > budget).orderBy("slot").first()
    return (None, before) if row is None else (row["slot"], row["end"] - row["words"])


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id") -> DataFrame:
    """The mix as documents: each taken document as often as it is taken, its columns unchanged.

    By row keys where ``docs`` and the mix have them. Without, rows are told apart by their id
    alone, which must then be unique and not null; ``mixed`` takes any rows.
    """
    key = ROW if ROW in docs.columns and ROW in mix.docs.columns else None
    times = mix.docs.where("taken > 0").select(F.col(key or "doc_id").alias("__id"), (F.col("taken") / F.col("size")).cast("int").alias("__times"))
    rows = docs.join(merged(times), F.col(key or id_col) == F.col("__id"))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix of ``docs``, whose ids may be null or repeat; columns as before."""
    keyed = with_row_keys(docs, id_col)
    return mixed_documents(keyed, mix_sources(keyed, weights, max_repeat, id_col, text_col, source_col), id_col).select(docs.columns)
