"""Per-group attributes, first rows, numbering and sampling that survive a very large group.

A plain window sends a whole group to one task. The operators here either keep at most n rows
of a group, in which case Spark trims each group before it shuffles, or aggregate per group
and join the small result back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.joins import keyed_join
from usagelens.sources.workspace import cut_lineage

#: Parts that the values of a group are dealt into, and rows of a group up to which Spark trims windows.
PARTS, TRIMMED = 32, 1_000


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add aggregates of each row's group to the row, null keys forming a group of their own.

    Groups are aggregated map-side and joined back; how, is left to their measured size.
    """
    groups = df.groupBy(*keys).agg(*[s.alias(n) for n, s in stats.items()])
    return keyed_join(df, groups, list(keys), "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, whole row kept; ``order`` says which, so the choice is repeatable."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")


def repeats(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """All rows but the first of each key: the rows a duplicate check on ``keys`` would flag."""
    return df.exceptAll(first_per_key(df, keys, order).select(df.columns))


def lowest_per_group(df: DataFrame, keys: Sequence[str], by: Column, n: int = 1) -> DataFrame:
    """Rows with the n lowest values per group, ties kept, nulls lowest.

    Equal values of a group become one row with their number, map-side; each of ``PARTS`` parts
    of a group keeps its n lowest values, and these meet to give the group's n-th lowest, with
    which its rows are joined. So all rows of one group may tie, and none meet in one task.
    """
    keys = list(keys)
    ranked = df.withColumn("__by", F.struct(by.isNotNull().alias("some"), by.alias("value")))
    values = ranked.groupBy(*keys, "__by").agg(F.count(F.lit(1)).alias("__rows"))
    spread = values.withColumn("__part", F.pmod(F.xxhash64("__by"), F.lit(PARTS)))
    inside = Window.partitionBy(*keys, "__part").orderBy("__by")
    few = spread.withColumn("__place", F.row_number().over(inside)).where(F.col("__place") <= n)
    below = Window.partitionBy(*keys).orderBy("__by").rowsBetween(Window.unboundedPreceding, -1)
    taken = few.withColumn("__below", F.coalesce(F.sum("__rows").over(below), F.lit(0))).where(F.col("__below") < n)
    last = taken.groupBy(*keys).agg(F.max("__by").alias("__last"))
    return keyed_join(ranked, last, keys, "inner").where(F.col("__by") <= F.col("__last")).select(df.columns)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """n random rows per group. The order is a seeded hash of ``by`` (default: the whole row).

    Up to ``TRIMMED`` rows of a group Spark trims each group before it shuffles; samples of more
    are numbered by ranges.
    """
    draw = F.xxhash64(F.lit(seed), *(by or df.columns))
    if n > TRIMMED:
        drawn = number_in_order(df.withColumn("__draw", draw), keys, ["__draw", *(by or df.columns)], "__place")
        return drawn.where(F.col("__place") <= n).select(df.columns)
    place = Window.partitionBy(*keys).orderBy(draw, *(by or df.columns))
    return df.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= n).drop("__place")


def sample_groups(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """All rows of n random groups."""
    keys = list(keys)
    drawn = df.select(keys).distinct().orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
    return keyed_join(df, F.broadcast(drawn), keys, "left_semi")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slice_by: Column, name: str = "ordinal"
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``.

    ``slice_by`` must not decrease along ``order`` (the day of a timestamp, say). A group is
    numbered slice by slice, each starting after the rows of the slices before, so a large
    group is as many tasks as it has slices.
    """
    # A struct of the keys matches null with null in a plain equality, so numbering and join
    # share one shuffle.
    keys = list(keys)
    sliced = df.withColumn("__group", F.struct(*keys, slice_by.alias("__slice")))
    sizes = sliced.groupBy("__group").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = (
        Window.partitionBy(*[F.col(f"__group.`{k}`") for k in keys])
        .orderBy("__group.__slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select("__group", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__group").orderBy(*order)
    placed = sliced.withColumn("__place", F.row_number().over(inside)).join(starts, "__group")
    return placed.withColumn(name, F.col("__start") + F.col("__place")).drop("__group", "__place", "__start")


def number_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "ordinal", unique_order: bool = False
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, however large a group is.

    All rows are dealt by ranges of (keys, order), sorted and counted per range; a range's rows
    go on where those of its group in earlier ranges end. So one group of all rows is numbered
    by all tasks, and only a count per group and range meets in one place. Null keys are a
    group. Rows that tie are told apart by a number written with them first, so that they too
    are dealt out; ``unique_order`` says that ``order`` leaves no ties, which saves that copy.
    """
    rows, by = df, [*keys, *order]
    if not unique_order:
        rows = cut_lineage(df.withColumn("__tie", F.monotonically_increasing_id()))
        by = [*by, "__tie"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    group = F.struct(*keys) if keys else F.lit(0)
    placed = cut_lineage(dealt.select(
        *df.columns, group.alias("__group"), F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at"),
    ))
    sizes = placed.groupBy("__group", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(sizes.select("__group", "__range", (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__start")))
    numbered = placed.join(starts, ["__group", "__range"]).withColumn(name, F.col("__at") + F.col("__start"))
    return numbered.drop("__group", "__range", "__at", "__start")


def sorted_head(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Sort ascending with nulls last, and keep the first n rows when n is given."""
    ordered = df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    return ordered if n is None else ordered.limit(n)
