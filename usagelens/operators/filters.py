"""Row filters. Ranges are half-open and sit on the bare column, so file scans can skip data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.nulls import any_present, null_count
from usagelens.functions.period import Period


def in_period(df: DataFrame, column: str, period: Period) -> DataFrame:
    return df.where(period.contains(column))


def in_days(df: DataFrame, column: str, first: dt.date, last: dt.date) -> DataFrame:
    """Rows from ``first`` to ``last``, both days whole."""
    stop = last + dt.timedelta(days=1)
    return df.where((F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(stop)))


def since(df: DataFrame, column: str, first: dt.date) -> DataFrame:
    return df.where(F.col(column) >= F.lit(first))


def with_any(df: DataFrame, columns: list[str]) -> DataFrame:
    """At least one column is present."""
    return df.where(any_present(*columns))


def with_all(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna("any", subset=columns)


def with_fewer_nulls(df: DataFrame, columns: list[str], limit: int, name: str = "num_na") -> DataFrame:
    """Count the nulls of each row in ``name`` and keep rows with fewer than ``limit``."""
    return df.withColumn(name, null_count(*columns)).where(F.col(name) < limit)
