"""Two versions of a table compared by digests of key ranges, so that only ranges that differ are read row by row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.sources.workspace import cut_lineage

#: Ranges of key hashes, in two levels: so many upper ones, and so many inside each.
UPPER, INNER = 256, 256
#: Rows of both versions that one task counts, about.
PART_ROWS = 1 << 19


def _ranged(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows with ``__range`` of their key and ``__digest`` of the whole row, columns in order of name; null differs from text."""
    told = [x for c in sorted(table.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    place = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(UPPER * INNER)).cast("int")
    return table.withColumns({"__range": place, "__digest": F.xxhash64(*told)})


def range_digests(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``range, rows, mix, total``: per key range the number of rows and two digests that no order bears on.

    At most ``UPPER * INNER`` rows, reduced map-side; keep them with a version to compare it
    later without reading it.
    """
    spread = F.xxhash64("__digest", F.lit(7))
    return _ranged(table, keys).groupBy(F.col("__range").alias("range")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(spread).alias("mix"), F.sum(F.col("__digest").cast("decimal(38,0)")).alias("total"),
    )


def _upper(digests: DataFrame) -> DataFrame:
    part = F.floor(F.col("range") / INNER).cast("int")
    return digests.groupBy(part.alias("range")).agg(F.sum("rows").alias("rows"), F.bit_xor("mix").alias("mix"), F.sum("total").alias("total"))


def _differing(current: DataFrame, earlier: DataFrame) -> DataFrame:
    sides = [df.select("range", F.struct("rows", "mix", "total").alias(name)) for df, name in ((current, "now"), (earlier, "then"))]
    return sides[0].join(sides[1], "range", "full").where(~F.col("now").eqNullSafe(F.col("then"))).select("range")


def differing_ranges(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """``range`` of two tables of digests that are not equal: upper ranges first, then those inside the ones that differ."""
    upper = _differing(_upper(current), _upper(earlier)).select(F.col("range").alias("upper"))
    inside = lambda df: df.join(upper, F.floor(F.col("range") / INNER) == F.col("upper"), "left_semi")
    return _differing(inside(current), inside(earlier))


def compare_versions(
    current: DataFrame, earlier: DataFrame, keys: Sequence[str],
    current_digests: DataFrame | None = None, earlier_digests: DataFrame | None = None,
) -> DataFrame:
    """``change, key_kept``, the columns, and ``copies``: the rows that one version has more often than the other.

    ``change`` is ``added`` or ``removed``; ``key_kept`` says that the other version has rows of
    the key too, so the row was changed. Together the rows are those of ``exceptAll`` both ways,
    in one row per distinct row. Columns must be the same on both sides; nulls are values, in keys too.

    Rows of equal ranges are dropped where they are read, so only differing ranges are shuffled.
    The list of ranges is bounded and therefore may be broadcast. The digests say how many rows
    these have, and so into how many parts they go: a task counts about ``PART_ROWS`` rows at any size.
    """
    columns = current.columns
    if sorted(columns) != sorted(earlier.columns):
        raise ValueError(f"different columns: {sorted(set(columns) ^ set(earlier.columns))}")
    now = cut_lineage(current_digests if current_digests is not None else range_digests(current, keys))
    then = cut_lineage(earlier_digests if earlier_digests is not None else range_digests(earlier, keys))
    ranges = cut_lineage(differing_ranges(now, then))
    open_rows = now.select("range", "rows").unionByName(then.select("range", "rows")).join(ranges, "range", "left_semi")
    parts = max(1, math.ceil((open_rows.agg(F.sum("rows")).first()[0] or 0) / PART_ROWS))
    sides = []
    for table, is_now in ((current, True), (earlier, False)):
        inside = _ranged(table.select(columns), keys).join(F.broadcast(ranges), F.col("__range") == F.col("range"), "left_semi")
        sides.append(inside.select(*[F.col(f"`{c}`") for c in columns], F.lit(is_now).alias("__is_now")))
    rows = sides[0].unionByName(sides[1]).repartition(parts, *[F.col(f"`{c}`") for c in columns])
    counted = cut_lineage(rows.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count_if("__is_now").alias("__now"), F.count_if(~F.col("__is_now")).alias("__then")))
    counted = counted.withColumn("__key", F.struct(*[F.col(f"`{k}`") for k in keys]))
    sided = counted.select("__key", (F.col("__now") > 0).alias("__in_now"), (F.col("__then") > 0).alias("__in_then")).repartition(parts, "__key")
    sided = sided.groupBy("__key").agg(F.max("__in_now").alias("__in_now"), F.max("__in_then").alias("__in_then"))
    changed = counted.where("__now <> __then").repartition(parts, "__key").hint("merge").join(sided, "__key")
    added = F.col("__now") > F.col("__then")
    return changed.select(
        F.when(added, "added").otherwise("removed").alias("change"), F.when(added, F.col("__in_then")).otherwise(F.col("__in_now")).alias("key_kept"),
        *[F.col(f"`{c}`") for c in columns], F.abs(F.col("__now") - F.col("__then")).alias("copies"),
    )
