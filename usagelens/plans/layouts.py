"""One row per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators.joins import keyed_join
from usagelens.operators.reshape import ordinal_wide, value_as_marker
from usagelens.operators.select import drop_named, move_before
from usagelens.sources.workspace import cut_lineage

USER_COLUMNS = ["user_key", "user_name", "mc_name", "created", "profile_name", "parent_organization"]


def product_users_wide(long: DataFrame, products: Sequence[str] | None = None) -> DataFrame:
    """Products as columns, the name taken from the user or else the account, and put first."""
    wide = value_as_marker(long.select(*USER_COLUMNS, "product").distinct(), USER_COLUMNS, "product", products)
    named = wide.withColumn("name", F.coalesce("user_name", "mc_name"))
    return move_before(drop_named(named, ["user_name", "mc_name"]), ["name"]).distinct()


def with_parent_organizations(wide: DataFrame, width: int | None = None) -> DataFrame:
    """Replace the one parent organisation per row by all of the user's, side by side.

    The table is measured, listed and joined, so it is computed once and kept. Both parts have
    the same users, which makes the full join of the definition a left join.
    """
    wide = cut_lineage(wide)
    parents = ordinal_wide(wide, "user_key", "parent_organization", "parent_org", width)
    rest = wide.drop("parent_organization").distinct()
    return keyed_join(rest, parents, "user_key", "left")
