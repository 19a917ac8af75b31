"""Null rules that decide the counts; each is spelled out instead of left to three-valued logic."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _columns(cols: Iterable[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def not_in(col: Column, values: Iterable) -> Column:
    """NOT IN that keeps null rows."""
    return col.isNull() | ~col.isin(list(values))


def in_or_null(col: Column, values: Iterable) -> Column:
    return col.isNull() | col.isin(list(values))


def null_flag(col: Column | str) -> Column:
    (col,) = _columns([col])
    return col.isNull().cast("int")


def null_count(*cols: Column | str) -> Column:
    """How many of the columns are null."""
    return reduce(add, [null_flag(c) for c in cols])


def any_present(*cols: Column | str) -> Column:
    """At least one of the columns is not null."""
    return reduce(or_, [c.isNotNull() for c in _columns(cols)])


def has_text(col: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(col, F.lit("")) != ""


def row_sum(*cols: Column | str) -> Column:
    """Sum across columns with null as zero."""
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in _columns(cols)])


def n_distinct(col: Column, count_null: bool = False) -> Column:
    """Distinct values in a group; ``count_null`` counts null as one more value."""
    counted = F.count_distinct(col)
    return counted + F.max(null_flag(col)) if count_null else counted


def n_distinct_when(cond: Column, col: Column, count_null: bool = False) -> Column:
    """Distinct values of the rows that meet ``cond``.

    ``count_null`` adds one when a row with an unknown condition, or a null value that meets it, exists.
    """
    counted = F.count_distinct(F.when(cond, col))
    if not count_null:
        return counted
    return counted + F.max((cond.isNull() | (cond & col.isNull())).cast("int"))
