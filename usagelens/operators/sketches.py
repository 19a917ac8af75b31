"""Distinct counts that merge: a sketch of the users per group and period, united over any periods later.

A theta sketch keeps up to ``2**lg_k`` hashes. Below that many distinct values it counts
exactly; beyond, its estimate has a relative standard error of ``1 / sqrt(2**lg_k)``, 0.8 % by
default, whatever the number of rows. A sketch's size is bounded, so sketches of a month are
small beside its base table, and a quarter or a year never reads the base again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes of a sketch, as a power of two.
LG_K = 14


def user_sketches(df: DataFrame, user: str, keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """One row per group: ``keys, users`` (a sketch), ``no_user`` (whether a row has none). Reduced map-side; a null key is a group."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(user, lg_k).alias("users"), F.max(F.col(user).isNull()).alias("no_user"))


def united(sketches: DataFrame, keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Sketches of finer groups united to those of ``keys``; again sketches, so unions go on merging."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("users", lg_k).alias("users"), F.max("no_user").alias("no_user"))


def estimated(sketches: DataFrame, name: str = "n") -> DataFrame:
    """The sketches as counts; rows without a user count as one user, as in ``counts.distinct_users``."""
    rest = [c for c in sketches.columns if c not in ("users", "no_user")]
    return sketches.select(*rest, (F.theta_sketch_estimate("users") + F.col("no_user").cast("long")).alias(name))


def returning(sketches: DataFrame, later: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Users in both of two sketches per group: those of one period who come back in another. Users without id are not followed."""
    both = sketches.select(*[F.col(k).alias(k) for k in keys], F.col("users").alias("__first")).join(
        later.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("users").alias("__later")),
        _same(keys), "inner",
    )
    return both.select(*keys, F.theta_sketch_estimate(F.theta_intersection("__first", "__later")).alias(name))


def _same(keys: Sequence[str]):
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return match


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate beyond ``2**lg_k`` distinct values."""
    return 2 ** (-lg_k / 2)
