"""Bitmaps of activity: one number per user, product and month or year, whose bits are its days or months.

A window inside the month is a mask, and because a bitmap stands for one user, users in a
window are plain counts: no distinct aggregate, and the logins are read once for all windows.
Counts are exact at any size, and bitmaps of finer groups merge to those of coarser ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.period import Period


def day_bitmaps(df: DataFrame, keys: Sequence[str], day: str, period: Period, name: str = "days") -> DataFrame:
    """One row per ``keys`` with activity in the month; bit d - 1 says whether day d has any. Null keys are groups."""
    rows = df.where(period.contains(day))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth(day) - 1)
    return rows.groupBy(*keys).agg(F.bit_or(bit).alias(name))


def mask(first: int, last: int) -> int:
    """The bits of days ``first`` to ``last`` of a month."""
    return ((1 << last) - 1) & ~((1 << (first - 1)) - 1)


def active_between(first: int, last: int, name: str = "days") -> Column:
    """Whether a bitmap has activity on days ``first`` to ``last``."""
    return F.col(name).bitwiseAND(F.lit(mask(first, last))) != 0


def days_active(first: int = 1, last: int = 31, name: str = "days") -> Column:
    """Number of days with activity from ``first`` to ``last``."""
    return F.bit_count(F.col(name).bitwiseAND(F.lit(mask(first, last))))


def users_in_windows(bitmaps: DataFrame, keys: Sequence[str], windows: Sequence[tuple[int, int]], name: str = "users") -> DataFrame:
    """``keys, first_day, last_day`` and the users active in each window, all windows from one pass. A null user counts as one user.

    ``bitmaps`` has a row per user and ``keys``. Windows without users have no row. Every bitmap
    gives a row per window that it meets, which are reduced to one per window and group before
    the shuffle.
    """
    listed = F.array(*[F.struct(F.lit(a).alias("first_day"), F.lit(b).alias("last_day"), F.lit(mask(a, b)).alias("mask")) for a, b in windows])
    met = F.filter(listed, lambda w: F.col("days").bitwiseAND(w["mask"]) != 0)
    rows = bitmaps.select(*keys, F.explode(met).alias("w"))
    return rows.groupBy(*keys, "w.first_day", "w.last_day").agg(F.count(F.lit(1)).alias(name))


def all_windows(days: int) -> list[tuple[int, int]]:
    """Every window inside a month of so many days."""
    return [(a, b) for a in range(1, days + 1) for b in range(a, days + 1)]


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str], name: str = "days") -> DataFrame:
    """Bitmaps of finer groups as those of ``keys``: of users over all products, say."""
    return bitmaps.groupBy(*keys).agg(F.bit_or(name).alias(name))


def month_bitmaps(df: DataFrame, keys: Sequence[str], day: str, name: str = "months") -> DataFrame:
    """One row per ``keys`` and ``year`` with activity; bit m - 1 says whether month m has any. Null keys are groups; rows without a day are of a null year, with a null bitmap."""
    bit = F.call_function("shiftleft", F.lit(1), F.month(day) - 1)
    return df.groupBy(*keys, F.year(day).alias("year")).agg(F.bit_or(bit).alias(name))


def active_in(bitmaps: DataFrame, months: int, name: str = "months") -> DataFrame:
    """The bitmaps with activity in any part of the year of so many months, a row per such ``part`` (from 1): 1, 3 or 12 months, say.

    A user has one row per part, so users per part are plain counts. A null bitmap has a row of null part.
    """
    parts = F.array(*[F.struct(F.lit(i + 1).alias("part"), F.lit(((1 << months) - 1) << (months * i)).alias("mask")) for i in range(12 // months)])
    met = F.filter(parts, lambda p: F.col(name).bitwiseAND(p["mask"]) != 0)
    rest = [c for c in bitmaps.columns if c != name]
    return bitmaps.select(*rest, F.explode_outer(met["part"]).alias("part"))


def returning(bitmaps: DataFrame, user: str, keys: Sequence[str], name: str = "n") -> DataFrame:
    """``keys, year, month`` and the users of that month who are back in the next one; groups without any row in the next month are left out.

    ``bitmaps`` are those of ``month_bitmaps`` by user and keys. A January is the thirteenth
    month of the year before. Rows without a user are not followed; null keys are groups.
    """
    own = [user, *keys, "year"]
    earlier = bitmaps.where(F.col("months").bitwiseAND(1) != 0).select(user, *keys, (F.col("year") - 1).alias("year"), F.lit(1 << 12).alias("months"))
    long = merge_bitmaps(bitmaps.select(*own, "months").unionByName(earlier), own, "months")
    has = lambda m: F.col("months").bitwiseAND(F.call_function("shiftleft", F.lit(1), m)) != 0
    seen = long.select(user, *keys, "year", "months", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("at")).where(has(F.col("at")))
    back = seen.groupBy(*keys, "year", "at").agg(F.count_if(has(F.col("at") + 1) & F.col(user).isNotNull()).alias(name))
    months = active_in(bitmaps, 1).groupBy(*keys, "year", "part").agg(F.lit(True).alias("__there"))
    number = F.col("year") * 12 + F.col("part") - 2
    later = months.select(*[F.col(k).alias(f"__{k}") for k in keys], number.alias("__number"))
    same = F.col("year") * 12 + F.col("at") == F.col("__number")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return back.join(later, same, "left_semi").select(*keys, "year", (F.col("at") + 1).alias("month"), name)
