"""Counts, distinct counts, shares and cross-tabs. All aggregate map-side before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.nulls import n_distinct, null_flag, row_sum
from usagelens.functions.period import month_start
from usagelens.functions.text import percent_with_count
from usagelens.operators.reshape import wide_values
from usagelens.operators.select import text_columns
from usagelens.operators.sketches import LG_K
from usagelens.sources.workspace import cut_lineage


def group_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per group; a null key is a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def frequency(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per value or value pair; rows with a null key are left out and zero cells never appear."""
    return group_count(df.dropna("any", subset=list(keys)), *keys, name=name)


def distinct_count(df: DataFrame, column: str, name: str = "n", count_null: bool = False) -> DataFrame:
    """Distinct values of a column as a one-row table."""
    return df.agg(n_distinct(F.col(column), count_null).alias(name))


def distinct_per_group(df: DataFrame, keys: Sequence[str], column: str, name: str = "n") -> DataFrame:
    """Distinct non-null values per group."""
    return df.groupBy(*keys).agg(F.count_distinct(column).alias(name))


def distinct_users(
    df: DataFrame, user: str | Sequence[str], keys: Sequence[str], name: str = "n", drop_null_keys: bool = False
) -> DataFrame:
    """Distinct (user, keys) combinations counted per keys. A null user counts as one user.

    ``user`` may be several columns: user and day, say, for the days on which users were active.
    """
    users, keys = [user] if isinstance(user, str) else list(user), list(keys)
    rows = df.select(users + [k for k in keys if k not in users])
    if drop_null_keys:
        rows = rows.dropna("any", subset=keys)
    return group_count(rows.distinct(), *keys, name=name)


def group_sum(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Sum per group; nothing but nulls sums to zero."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))


def row_total(df: DataFrame, columns: Sequence[str], name: str = "total") -> DataFrame:
    return df.withColumn(name, row_sum(*columns).cast("long"))


def with_share(counts: DataFrame, column: str = "n", name: str = "share") -> DataFrame:
    """Each row's part of the grand total.

    The counts are computed once and kept; the total then is a one-value subquery over them.
    """
    counts = cut_lineage(counts)
    total = counts.agg(F.sum(column)).scalar()
    return counts.withColumn(name, F.col(column) / total)


def frequency_share(df: DataFrame, key: str) -> DataFrame:
    """One-way frequency with the share of all rows; a null value has its own row."""
    return with_share(group_count(df, key))


def crosstab_percent(
    df: DataFrame, row: str, column: str, values: Sequence[str] | None = None, digits: int = 1, other: str | None = None
) -> DataFrame:
    """Two-way table with a totals row, each cell as percent of the grand total with its count.

    ``values`` are the column headings in order, by default all values found. Rows whose
    ``column`` is null go under ``NA_``. With ``other`` rows of values that are not listed go
    under a column of that name; without it they are an error, so the cells always add up to all rows.
    """
    values = wide_values(df, column) if values is None else values
    rest = other or "__other"
    cells = df.groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(v) for v in values],
        F.count_if(F.col(column).isNull()).alias("NA_"),
        F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(list(values))).alias(rest),
        F.count(F.lit(1)).alias("__all"),
    )
    if other is None:
        unlisted = F.raise_error(F.lit(f"{column} has values that are not among the headings"))
        cells = cells.withColumn("__all", F.when(F.col(rest) > 0, unlisted.cast("long")).otherwise(F.col("__all"))).drop(rest)
    cells = cut_lineage(cells.withColumn(row, F.coalesce(F.col(row).cast("string"), F.lit("NA"))))
    headings = [*values, "NA_", *([other] if other else [])]
    totals = cells.agg(F.lit("Total").alias(row), *[F.sum(F.col(f"`{h}`")).alias(h) for h in headings])
    grand = cells.agg(F.sum("__all")).scalar()
    return cells.drop("__all").unionByName(totals).select(
        row,
        *[percent_with_count(F.col(f"`{h}`") / grand, F.col(f"`{h}`"), digits).alias(h) for h in headings],
    )


def distinct_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of every column in long form: ``column_name``, ``value``."""
    columns = list(columns or df.columns)
    as_text = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return as_text.unpivot([], columns, "column_name", "value").distinct()


def distinct_profile(df: DataFrame) -> DataFrame:
    """Distinct values per text column, null counted as one value, with the number of nulls."""
    long = df.unpivot([], text_columns(df), "column_name", "value")
    per_value = group_count(long, "column_name", "value")
    return per_value.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum(F.col("n") * null_flag("value")).alias("n_null"),
    )


def sketched_profile(df: DataFrame, columns: Sequence[str] | None = None, lg_k: int = LG_K, top: int = 3) -> DataFrame:
    """Per column ``n_rows, n_null, n_distinct, most_frequent``, from one aggregate that reads the input once.

    Distinct values come from a theta sketch: exact below ``2**lg_k`` values, beyond with a
    relative standard error of ``2**(-lg_k / 2)``. ``most_frequent`` lists the ``top`` values
    with the counts that a frequent-items sketch has of them, which are exact as long as a column
    has few thousand values. ``exact_profile`` is the exact form, which repeats every row once per column.
    """
    columns = list(columns or df.columns)
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    named = df.select(*[t.alias(f"c{i}") for i, t in enumerate(text.values())])
    found = []
    for i in range(len(columns)):
        top_k = F.expr(f"transform(approx_top_k(c{i}, {top}, 10000), x -> struct(x.item AS value, x.count AS n))")
        found.append(F.struct(
            F.lit(columns[i]).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(f"c{i}").isNull()).alias("n_null"),
            F.theta_sketch_estimate(F.theta_sketch_agg(f"c{i}", lg_k)).alias("n_distinct"), top_k.alias("most_frequent"),
        ).alias(f"p{i}"))
    profile = named.agg(*found)
    return profile.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(columns))])))


def exact_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 3) -> DataFrame:
    """Per column ``n_rows, n_null, n_distinct, most_frequent`` as in ``sketched_profile``, but exact for any number of values.

    Every row is repeated once per column and the values are counted map-side, so what is
    shuffled is the distinct values. Null is no value of ``n_distinct``, but may be among the
    ``top`` most frequent; of equally frequent values the smaller text comes first. A table
    without rows has a row per column too.
    """
    columns = list(columns or df.columns)
    text = []
    for i, c in enumerate(columns):
        value, kind = F.col(f"`{c}`"), df.select(F.col(f"`{c}`")).schema[0].dataType.typeName()
        if kind in ("float", "double"):
            value = value + F.lit(0.0).cast(kind)  # 0 and -0 are equal
        elif kind == "timestamp":
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")  # an hour may come twice
        text.append(value.cast("string").alias(f"c{i}"))
    long = df.select(*text).unpivot([], [f"c{i}" for i in range(len(columns))], "__column", "value")
    per_value = cut_lineage(group_count(long, "__column", "value"))
    totals = per_value.groupBy("__column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"),
    )
    place = F.row_number().over(Window.partitionBy("__column").orderBy(F.desc("n"), F.asc_nulls_last("value")))
    first = per_value.withColumn("place", place).where(F.col("place") <= top)
    first = first.groupBy("__column").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("found"))
    named = df.sparkSession.createDataFrame([(f"c{i}", c) for i, c in enumerate(columns)], "__column string, column_name string")
    found = named.join(totals, "__column", "left").join(first, "__column", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_rows", "n_null", "n_distinct")]
    listed = F.transform("found", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    return found.select("column_name", *zero, F.coalesce(listed, F.array().cast("array<struct<value:string,n:bigint>>")).alias("most_frequent"))


def monthly_counts(df: DataFrame, day: Column | str, name: str = "n") -> DataFrame:
    """Rows per calendar month."""
    day = F.col(day) if isinstance(day, str) else day
    return group_count(df.select(month_start(day).alias("month")), "month", name=name)
