"""A monthly run from extracts to written reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from usagelens.functions.period import Period
from usagelens.operators.counts import distinct_users
from usagelens.plans import base as bases
from usagelens.plans import latency, layouts, quality, tables
from usagelens.settings import KpiSettings
from usagelens.sources.readers import read_snapshot, read_snapshot_set
from usagelens.sources.writers import snapshot, snapshot_set, write_tables


def freeze(extracts: bases.Extracts, out: str, period: Period) -> bases.Extracts:
    """Write every extract as it is now, as one set, and return the frozen copies, to make a run repeatable.

    The copies are those of the latest set that was finished, so a run that was cut short
    between two tables is never read.
    """
    tables = {f.name: getattr(extracts, f.name) for f in fields(extracts) if getattr(extracts, f.name) is not None}
    snapshot_set(tables, f"{out.rstrip('/')}/extracts", period)
    return frozen(extracts.users.sparkSession, out, period)


def frozen(spark: SparkSession, out: str, period: Period) -> bases.Extracts:
    """The extracts of a period that was frozen before."""
    found = read_snapshot_set(spark, f"{out.rstrip('/')}/extracts", period)
    return bases.Extracts(**{f.name: found.get(f.name) for f in fields(bases.Extracts)})


def rerun_reports(spark: SparkSession, out: str, period: Period, settings: KpiSettings, fmt: str = "csv") -> dict[str, str]:
    """The report tables of a period anew from its base table as it was written, without any extract."""
    base = read_snapshot(spark, out, "activity_base", period)
    reports = {**tables.monthly_report(base, settings), "month_activity": tables.month_activity(base), "unit_first_month": tables.unit_first_month(base)}
    return write_tables(reports, out, period, fmt)


def run_entitlement(
    extracts: bases.Extracts, period: Period, settings: KpiSettings, out: str, two_systems: bool = False,
    products: Sequence[str] | None = None, fmt: str = "csv",
) -> dict[str, str]:
    """Write the entitlement base, its counts and both layouts of it. Returns the paths by table name.

    The long layout is the base itself, one row per user and product; the wide ones have a row per
    user, with products as columns, and with ``two_systems`` then a user's organisations too.
    Each table is written from the frozen base.
    """
    base_path = snapshot(bases.entitlement_base(extracts, settings, two_systems), out, "entitlement_base", period)
    base = read_snapshot(extracts.users.sparkSession, out, "entitlement_base", period)
    found = {
        "entitled_users": base,
        "entitled_users_by_product": distinct_users(base, "user_key", ["product"], name="users"),
        "entitled_users_by_profile": distinct_users(base, "user_key", ["profile_name", "product"], name="users"),
        "entitled_users_by_unit": distinct_users(base, "user_key", ["parent_organization"], name="users"),
        "users_without_unit": base.where(F.col("parent_organization").isNull()).select("user_key", "product").distinct(),
    }
    if two_systems:
        wide = layouts.product_users_wide(base, products)
        found |= {"product_users_wide": wide, "product_users_with_organizations": layouts.with_parent_organizations(wide)}
    return {"entitlement_base": base_path, **write_tables(found, out, period, fmt)}


def run_month(
    extracts: bases.Extracts, period: Period, settings: KpiSettings, out: str, created_since: dt.date, fmt: str = "csv"
) -> dict[str, str]:
    """Write the base table, then every report of the month from it. Returns the paths by table name."""
    base_path = snapshot(bases.activity_base(extracts, period, settings), out, "activity_base", period)
    base = read_snapshot(extracts.users.sparkSession, out, "activity_base", period)
    users = bases.base_users(bases.users_with_login(extracts.users, extracts.login_history, period), settings)
    accounts = latency.first_logins(users, extracts.login_history, created_since)
    reports = {
        **tables.monthly_report(base, settings),
        "month_activity": tables.month_activity(base),
        "unit_first_month": tables.unit_first_month(base),
        "days_to_login_by_month": latency.mean_days(accounts),
        "days_to_login_by_profile": latency.mean_days(accounts, ["profile_name"]),
        "days_to_login_by_unit": latency.mean_days(accounts, ["unit_token"]),
        "marketing_without_contact": quality.unmatched_accounts(extracts.marketing, extracts.contacts),
        "social_without_contact": quality.unmatched_accounts(extracts.social, extracts.contacts),
    }
    return {"activity_base": base_path, **write_tables(reports, out, period, fmt)}
