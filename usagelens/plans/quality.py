"""Data-quality reports: unmatched accounts, duplicates, table versions and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators.counts import distinct_profile
from usagelens.operators.filters import with_fewer_nulls
from usagelens.operators.joins import keyed_join, unmatched
from usagelens.operators.windows import repeats
from usagelens.plans.base import DATES


def unmatched_accounts(report: DataFrame, contacts: DataFrame, key: str = "net_id") -> DataFrame:
    """Report rows without a contact; none is the good result."""
    return unmatched(report, contacts.where(F.col(key).isNotNull()), key)


def duplicate_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that repeat ``keys`` of an earlier row, in the order of all columns."""
    return repeats(table, keys, [F.col(c).asc_nulls_last() for c in table.columns])


def reconcile(
    current: DataFrame, earlier: DataFrame, keys: Sequence[str], first_by: str | None = None
) -> DataFrame:
    """Dates of an earlier table version attached to the rows of the current one.

    With ``first_by`` the earlier version keeps one row per value of that column. Rows without
    any date are left out, and one row per ``keys`` remains: the first in the order of the
    other columns. That row is picked before the join, so both sides have one row per key.
    """
    keys = list(keys)
    rest = [c for c in earlier.columns if c not in keys]
    if first_by:
        earlier = _least_row(earlier, [first_by], keys + rest)
    dated = with_fewer_nulls(earlier, DATES, limit=len(DATES))
    first = _least_row(dated, keys, rest)
    return keyed_join(first, current.select(keys), keys, "left_semi")


def _least_row(table: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per ``keys`` in the order of other columns, nulls last, by a partial aggregate."""
    others = [c for c in dict.fromkeys([*order, *table.columns]) if c not in keys]
    place = F.struct(*[x for c in others for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    rows = table.groupBy(*keys).agg(F.min(place).alias("__first"))
    return rows.select(*[F.col(c) if c in keys else F.col(f"__first.`{c}`").alias(c) for c in table.columns])


def table_profile(table: DataFrame) -> DataFrame:
    return distinct_profile(table)
