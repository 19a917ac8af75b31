"""Base tables: one row per person, product and unit, login-based or entitlement-based.

The definition is a full outer chain of contacts, marketing report, social report and product
users on one person key, followed by a filter that drops persons with contact data only. So
the contact table, by far the largest of them, is joined as a left join; the two reports are
folded into one row per key by an aggregate; a single full outer join is left. The chain has
one row per user: products and permissions are attached to a user at the end, and so cross
the network once instead of once per join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.dates import parse_report_date
from usagelens.functions.nulls import any_present, not_in
from usagelens.functions.period import Period
from usagelens.functions.rules import fill_by_rules, replace_values
from usagelens.functions.text import key_from_email
from usagelens.operators.joins import keyed_join, lookup
from usagelens.settings import MARKETING_LABEL, SOCIAL_LABEL, KpiSettings
from usagelens.sources.workspace import cut_lineage

DATES = ["mc_last_login", "social_last_login", "sf_last_login"]
PRODUCTS = ["mc_profile", "social_profile", "sf_product"]
#: Assignments whose rows one task makes distinct, about.
PART_ROWS = 1 << 18
REPORT_COLUMNS = ["email", "primary_department", *PRODUCTS, "parent_organization", "account_name"]


@dataclass(frozen=True)
class Extracts:
    """The source tables of one run. Column names are those of ``sources.schemas``."""

    contacts: DataFrame
    users: DataFrame
    login_history: DataFrame
    affiliations: DataFrame
    assignments: DataFrame
    mapping: DataFrame
    marketing: DataFrame
    social: DataFrame


def _report_rows(report: DataFrame, key: str, prefix: str, period: Period | None) -> DataFrame:
    """Key, a mark and the day of each report row, in the month when ``period`` is given."""
    day = parse_report_date(F.col("max_timestamp")) if "max_timestamp" in report.columns else F.lit(None).cast("date")
    named = [c for c in ("mc_name",) if c in report.columns]
    rows = report.select(key, *named, F.lit(True).alias(f"{prefix}_used"), day.alias(f"{prefix}_last_login"))
    return rows if period is None else rows.where(period.contains(f"{prefix}_last_login"))


def _fold(rows: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """One row per key with the profile label and last login of each report."""
    folded = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in keys])
    columns = list(keys)
    for prefix, label in labels.items():
        columns += [F.when(F.col(f"{prefix}_used"), label).alias(f"{prefix}_profile"), f"{prefix}_last_login"]
    return folded.select(columns)


def report_logins(
    marketing: DataFrame, social: DataFrame | None, period: Period | None, key: str = "net_id"
) -> DataFrame:
    """The login reports as one row per person key: profile label and last login of each.

    The null key is one row too, so it can meet any number of users without a person id and
    add no rows. Without ``period`` every report row counts, dated or not. Account names of
    the marketing report, where it has any, stay apart as ``mc_name``.
    """
    keys, labels = [key], {"mc": MARKETING_LABEL}
    if "name" in marketing.columns:
        marketing = marketing.withColumn("mc_name", F.when(F.col(key).isNotNull(), F.col("name")))
        keys.append("mc_name")
    rows = _report_rows(marketing, key, "mc", period)
    if social is not None:
        rows = rows.unionByName(_report_rows(social, key, "social", period), allowMissingColumns=True)
        labels["social"] = SOCIAL_LABEL
    return _fold(rows, keys, labels)


def users_with_login(users: DataFrame, login_history: DataFrame, period: Period) -> DataFrame:
    """Users with a login in the month. The logins shrink to distinct user ids first."""
    seen = login_history.where(period.contains("login_ts")).select(F.col("user_id").alias("id")).distinct()
    return keyed_join(users, seen, "id", "left_semi", null_match=False)


def users_with_last_login(users: DataFrame, period: Period) -> DataFrame:
    """Users whose last login is in the month."""
    return users.where(period.contains("last_login_ts"))


def licensed_users(
    users: DataFrame, licensed: DataFrame, on: tuple[str, str] = ("email", "username"), how: str = "inner"
) -> DataFrame:
    """Users with the licence report attached, its other columns prefixed ``licence_``.

    The runs differ in ``how``: inner, right (all licences) or full, and match on email and
    username or on the user id.
    """
    licences = licensed.withColumnsRenamed({c: f"licence_{c}" for c in licensed.columns if c != on[1]})
    return keyed_join(users, licences, [on], how).distinct()


def base_users(users: DataFrame, settings: KpiSettings) -> DataFrame:
    """Users of the base profiles, with corrected person ids."""
    kept = users.where(F.col("profile_name").isin(list(settings.base_profiles)))
    return kept.withColumn("net_id", replace_values(F.col("net_id"), settings.net_id_overrides))


def user_products(users: DataFrame, assignments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Users whose permissions grant a product, with the list of those products.

    Only assignments of the given users are looked up; equal products of one user merge in one
    aggregation, before users are joined. A list is no longer than the product catalogue.
    """
    chosen = assignments.select("assignee_id", "permission_name")
    chosen = keyed_join(chosen, users.select("sf_user_id"), [("assignee_id", "sf_user_id")], "left_semi", null_match=False)
    granted = lookup(chosen, mapping, "permission_name", ["product"]).where(F.col("product").isNotNull())
    per_user = granted.groupBy("assignee_id").agg(F.collect_set("product").alias("sf_products"))
    return keyed_join(users, per_user, [("sf_user_id", "assignee_id")], "inner", null_match=False)


def person_chain(reports: DataFrame, users: DataFrame, contacts: DataFrame, unique: bool = True) -> DataFrame:
    """Users full-joined to report rows on the person id, then contacts attached.

    ``unique`` says that the reports have one row per id. The users are read twice, so give
    them written.
    """
    known = contacts.where(F.col("net_id").isNotNull())
    active = keyed_join(users, reports, "net_id", "full", right_unique=unique)
    return keyed_join(active, known, "net_id", "left", null_match=False)


def primary_units(affiliations: DataFrame) -> DataFrame:
    return (
        affiliations.where("is_primary")
        .select("contact_id", "parent_organization", "account_name")
        .distinct()
    )


def activity_base(extracts: Extracts, period: Period, settings: KpiSettings) -> DataFrame:
    """Login-based base table: who used what in the month, with dates and unit."""
    users = base_users(users_with_login(extracts.users, extracts.login_history, period), settings)
    return activity_base_of(users, extracts, period, settings)


def activity_base_of(users: DataFrame, extracts: Extracts, period: Period, settings: KpiSettings) -> DataFrame:
    """The same for users chosen in another way (``users_with_last_login``, ``licensed_users``)."""
    reports = report_logins(extracts.marketing, extracts.social, period)
    product_users = cut_lineage(product_users_of(users, extracts, settings))
    chain = person_chain(reports, product_users, contact_columns(extracts.contacts))
    return with_units(chain, extracts, settings)


def activity_base_by_email(extracts: Extracts, period: Period, settings: KpiSettings) -> DataFrame:
    """Variant for a marketing report keyed on ``email``: it meets contacts on the email first.

    Accounts without a contact have no person id. They are kept, and not paired with users
    who lack one.
    """
    users = base_users(users_with_login(extracts.users, extracts.login_history, period), settings)
    marketing = _fold(_report_rows(extracts.marketing, "email", "mc", period), ["email"], {"mc": MARKETING_LABEL})
    social = _fold(_report_rows(extracts.social, "net_id", "social", period), ["net_id"], {"social": SOCIAL_LABEL})
    contacts = contact_columns(extracts.contacts).where(F.col("net_id").isNotNull())
    known = keyed_join(contacts, marketing, "email", "full", right_unique=True)
    active = keyed_join(cut_lineage(product_users_of(users, extracts, settings)), social, "net_id", "full", right_unique=True)
    chain = keyed_join(active, known, "net_id", "full", null_match=False)
    return with_units(chain, extracts, settings)


def product_users_of(users: DataFrame, extracts: Extracts, settings: KpiSettings) -> DataFrame:
    users = users.where(F.col("profile_name") != settings.admin_profile).select(
        F.col("id").alias("sf_user_id"), "net_id", F.col("profile_name").alias("sf_profile"),
        F.col("created_ts").cast("date").alias("sf_created"),
        F.col("last_login_ts").cast("date").alias("sf_last_login"),
    )
    return user_products(users, extracts.assignments, extracts.mapping)


def contact_columns(contacts: DataFrame) -> DataFrame:
    return contacts.select("net_id", F.col("id").alias("contact_id"), "email", "primary_department")


def with_units(chain: DataFrame, extracts: Extracts, settings: KpiSettings) -> DataFrame:
    active = chain.where(any_present(*DATES)).where(not_in(F.col("net_id"), settings.excluded_net_ids))
    placed = keyed_join(active, primary_units(extracts.affiliations), "contact_id", "left")
    others = [c for c in placed.columns if c != "sf_products"]
    return placed.select(*others, F.explode_outer("sf_products").alias("sf_product")).distinct()


def reporting_table(base: DataFrame) -> DataFrame:
    """The distinct rows, without ids and dates, that all user counts are taken from."""
    return base.select(REPORT_COLUMNS).distinct()


def entitlement_base(extracts: Extracts, settings: KpiSettings, two_systems: bool = False) -> DataFrame:
    """Base table without login filter: who may use what, in long form.

    Products missing after the mapping are filled by the default rules. ``user_key`` is the
    person id, or else the user's name. With ``two_systems`` there is no social report, the
    marketing report is a list of accounts with ``email`` and ``name``, and ``user_key`` falls
    back on the user id.

    Assignments are written once, and their number says into how many parts they, and the rows
    that come of them, are dealt to be made distinct: a part has about ``PART_ROWS`` of them at
    any size. They stream past their users' rows, of which a task holds its own, and are not sorted.
    """
    assignments = extracts.assignments.select("assignee_id", "permission_name").where(F.col("assignee_id").isNotNull())
    assignments = cut_lineage(assignments)
    parts = max(1, math.ceil(assignments.count() / PART_ROWS))
    users = extracts.users.select(
        F.col("id").alias("sf_user_id"), "net_id", F.col("name").alias("user_name"), "role_name",
        "profile_name", F.col("created_ts").cast("date").alias("created"),
    ).distinct()
    assigned = assignments.select(F.col("assignee_id").alias("sf_user_id")).distinct()
    users = cut_lineage(keyed_join(users, assigned, "sf_user_id", "left_semi", null_match=False))
    contacts = extracts.contacts.select("net_id", F.col("id").alias("contact_id"))
    if two_systems:
        accounts = extracts.marketing.select(key_from_email(F.col("email")).alias("net_id"), "name")
        reports, labels = report_logins(accounts, None, None), ["mc_profile"]
        fallback, kept = "sf_user_id", ["sf_user_id", "mc_name"]
    else:
        reports, labels = report_logins(extracts.marketing, extracts.social, None), ["mc_profile", "social_profile"]
        fallback, kept = "user_name", []
    chain = person_chain(reports.drop(*DATES), users, contacts, unique=not two_systems)
    chain = chain.where(not_in(F.col("profile_name"), settings.excluded_profiles))
    chain = chain.withColumn("user_key", F.coalesce(F.col("net_id"), F.col(fallback).cast("string")))
    if settings.excluded_user_keys:
        chain = chain.where(~F.col("user_key").isin(list(settings.excluded_user_keys)))
    persons = cut_lineage(keyed_join(chain, primary_units(extracts.affiliations), "contact_id", "left"))

    granted = assignments.repartition(parts, "assignee_id", "permission_name").distinct()
    granted = lookup(granted, extracts.mapping, "permission_name", ["product"])
    # An inner join can split a user with very many permissions; a left join could not. Persons
    # known from a report only have none, and would all be one key.
    known = persons.where(F.col("sf_user_id").isNotNull()).hint("shuffle_hash")
    rows = keyed_join(known, granted, [("sf_user_id", "assignee_id")], "inner", null_match=False)
    rows = rows.unionByName(persons.where(F.col("sf_user_id").isNull()), allowMissingColumns=True)
    rows = rows.withColumn("product", fill_by_rules(F.col("product"), settings.default_rules))

    ids = [
        "user_key", "net_id", *kept, "user_name", "role_name", "profile_name", "permission_name", "created",
        "parent_organization", "account_name",
    ]
    used = rows.unpivot(ids, [*labels, "product"], "product_column", "used_product")
    used = used.where(F.col("used_product").isNotNull()).withColumnRenamed("used_product", "product")
    used = used.drop("product_column")
    return used.repartition(parts, *used.columns).distinct()
