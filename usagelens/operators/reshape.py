"""Union, wide-to-long, long-to-wide and nesting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def stack(*tables: DataFrame) -> DataFrame:
    """Union all by column name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per present cell of ``columns``; null cells are dropped and equal rows merged."""
    long = df.unpivot(list(ids), list(columns), name, value)
    return long.where(F.col(value).isNotNull()).distinct()


#: Headings of a wide table at most, as in Spark's own pivot.
MAX_HEADINGS = 10_000


def wide_values(df: DataFrame, column: str) -> list:
    """Distinct non-null values, sorted, as headings. More than ``MAX_HEADINGS`` are an error: keep the long form."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_HEADINGS + 1).collect()
    if len(found) > MAX_HEADINGS:
        raise ValueError(f"{column} has more than {MAX_HEADINGS} values, which are too many for columns")
    return sorted(row[0] for row in found)


def marker_matrix(
    df: DataFrame, rows: str | Sequence[str], column: str, values: Sequence[str] | None = None
) -> DataFrame:
    """One row per ``rows`` and one column per value, holding 1 where the pair occurs, else null."""
    headings = list(values) if values is not None else wide_values(df, column)
    ids = [rows] if isinstance(rows, str) else list(rows)
    return df.groupBy(*ids).pivot(column, headings).agg(F.max(F.lit(1)))


def value_as_marker(
    df: DataFrame, ids: Sequence[str], column: str, values: Sequence[str] | None = None, other: str | None = None
) -> DataFrame:
    """One row per ``ids`` and one column per value, holding the value itself where it occurs.

    With a given list of ``values`` and ``other`` a column of that name counts the rows of other
    values; without ``other`` they show in no column, and only the row of their ids is there.
    """
    headings = list(values) if values is not None else wide_values(df, column)
    if other is None:
        marks = marker_matrix(df, ids, column, headings)
        return marks.select(*ids, *[F.when(F.col(f"`{h}`") == 1, h).alias(h) for h in headings])
    rest = F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(headings))
    return df.groupBy(*ids).agg(*[F.max(F.when(F.col(column) == h, h)).alias(h) for h in headings], rest.alias(other))


def ordinal_wide(
    df: DataFrame, key: str, value: str, prefix: str, width: int | None = None
) -> DataFrame:
    """Distinct values of each key side by side, in value order, nulls last: ``prefix_1 .. prefix_k``.

    ``width`` defaults to the largest number of values of one key. A smaller ``width`` keeps
    the remaining values as a list in ``prefix_more``; give one where a key may have very many.
    """
    pairs = df.select(key, value).distinct()
    widest = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    width = widest if width is None else width
    # collect_list skips nulls, so a null value is carried in a struct.
    listed = pairs.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(value).isNull().alias("last"), F.col(value).alias("v")))
        ).alias("all")
    )
    columns = [F.get("all", F.lit(i))["v"].alias(f"{prefix}_{i + 1}") for i in range(width)]
    if width < widest:
        columns.append(F.slice("all", width + 1, widest)["v"].alias(f"{prefix}_more"))
    return listed.select(key, *columns)


def nest(df: DataFrame, keys: Sequence[str], name: str = "rows", parts: int = 1) -> DataFrame:
    """Rows of each group as lists of structs, one list for each of up to ``parts`` parts of a group.

    ``part`` (from 0) is a hash of the row, so the layout depends on the rows and ``parts`` alone;
    take more parts where a group may be too large for one task. Equal rows stay rows.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    split = df.withColumn("part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    return split.groupBy(*keys, "part").agg(F.collect_list(F.struct(*rest)).alias(name))


def unnest(df: DataFrame, keys: Sequence[str], name: str = "rows") -> DataFrame:
    """Back to one row per nested row."""
    return df.select(*keys, F.inline(name))


def normal_draws(grid: DataFrame, mean: Column, sd: Column, n: int, seed: int, name: str = "value") -> DataFrame:
    """n normal random numbers per row, in long form with ``draw`` from 1."""
    drawn = grid.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return drawn.withColumn(name, mean + sd * F.randn(seed))
