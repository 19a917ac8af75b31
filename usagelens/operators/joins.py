"""Equi-joins with explicit null-key matching and clash checks.

Spark splits a skewed side of an inner, left or anti join at run time, but never of a full
outer join. Where the right side has one row per key, ``keyed_join`` writes a full join as a
left join and an anti join, which it can split; both are lazy, and the plan is the same for
any data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RIGHT = "__right_"


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str | tuple[str, str]],
    how: str = "inner",
    null_match: bool = True,
    right_unique: bool = False,
) -> DataFrame:
    """Join on ``on``: a name, or a list of names or ``(left, right)`` pairs.

    Key columns come out once, under the left name. ``null_match`` pairs null keys with null
    keys. Other columns with equal names are an error: rename them by role first
    (``select.with_role``). Say ``right_unique`` of a full join whose right side has one row per
    key at most: it then is a left join, whose left side Spark can split, and the right rows
    without partner.
    """
    pairs = [(p, p) if isinstance(p, str) else tuple(p) for p in ([on] if isinstance(on, str) else on)]
    keys = [lk for lk, _ in pairs]
    right = right.withColumnsRenamed({rk: _RIGHT + lk for lk, rk in pairs})
    if how not in ("left_semi", "left_anti"):
        clash = sorted(set(left.columns) & set(right.columns))
        if clash:
            raise ValueError(f"columns on both sides: {clash}; rename them by role first")
    match = _match(keys, null_match)
    if how == "full" and right_unique:
        matched = _tidy(left.join(right, match, "left"), keys, "left")
        alone = right.join(left.select(keys), match, "left_anti").withColumnsRenamed({_RIGHT + k: k for k in keys})
        return matched.unionByName(alone, allowMissingColumns=True)
    return _tidy(left.join(right, match, how), keys, how)


def unmatched(left: DataFrame, right: DataFrame, on, null_match: bool = True) -> DataFrame:
    """Rows of ``left`` without partner. Only the key columns of the right side are read."""
    pairs = [(p, p) if isinstance(p, str) else tuple(p) for p in ([on] if isinstance(on, str) else on)]
    return keyed_join(left, right.select([rk for _, rk in pairs]), pairs, "left_anti", null_match)


def lookup(df: DataFrame, table: DataFrame, on, columns: Sequence[str]) -> DataFrame:
    """Left join to a mapping. Repeated mapping rows are removed first, so they add no rows.

    Whether the mapping is broadcast is left to its measured size.
    """
    pairs = [(p, p) if isinstance(p, str) else tuple(p) for p in ([on] if isinstance(on, str) else on)]
    mapping = table.select([rk for _, rk in pairs] + list(columns)).distinct()
    return keyed_join(df, mapping, pairs, "left", null_match=False)


def value_grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row with every combination of the given short value lists."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def _match(keys: list[str], null_match: bool) -> Column:
    if null_match:
        return reduce(and_, [F.col(k).eqNullSafe(F.col(_RIGHT + k)) for k in keys])
    return reduce(and_, [F.col(k) == F.col(_RIGHT + k) for k in keys])


def _tidy(joined: DataFrame, keys: list[str], how: str) -> DataFrame:
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "right":
        joined = joined.withColumns({k: F.col(_RIGHT + k) for k in keys})
    elif how == "full":
        joined = joined.withColumns({k: F.coalesce(k, _RIGHT + k) for k in keys})
    return joined.drop(*[_RIGHT + k for k in keys])
