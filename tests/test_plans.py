"""Pipelines on a hand-made set of extracts, and invariants on the driver tables."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.roles import PERIOD, SETTINGS, Roles
from usagelens.functions.period import Period
from usagelens.functions.rules import DefaultRule
from usagelens.plans import base as bases
from usagelens.plans import latency, layouts, monthly, quality, tables
from usagelens.settings import KpiSettings

JANUARY = Period(2022, 1)
MINE = KpiSettings(
    excluded_profiles=("Marketing User", "System Administrator", "System User"), excluded_net_ids=("staff1",), net_id_overrides={"Ann": "ann"}, excluded_user_keys=("robot",),
    default_rules=(DefaultRule("role_name", ("Analyst",), "Reports"), DefaultRule("profile_name", ("Advising Base",), "Notes")),
)


@pytest.fixture(scope="module")
def extracts(spark):
    make = spark.createDataFrame
    day = dt.datetime
    return bases.Extracts(
        contacts=make(
            [("c1", "ann@x", "ann", "D1"), ("c2", "bob@x", "bob", "D1"), ("c3", "cy@x", "cy", "D2"),
             ("c4", "st@x", "staff1", "D2"), ("c5", "no@x", None, "D3"), ("c6", "idle@x", "idle", "D3")],
            "id string, email string, net_id string, primary_department string"),
        users=make(
            [(1, "Ann", "Ann A", "Analyst team", "Salesforce Base", day(2021, 3, 1), day(2022, 1, 5), "ann@x"),
             (2, "bob", "Bob B", "Other", "Advising Base", day(2021, 4, 1), day(2022, 1, 6), "bob@x"),
             (3, None, "Nobody", "Other", "Service Desk Base", day(2021, 5, 1), day(2022, 1, 7), None),
             (4, "adm", "Admin", "Other", "System Administrator", day(2021, 1, 1), day(2022, 1, 7), "adm@x"),
             (5, "idle", "Idle", "Analyst", "Advising Base", day(2021, 6, 1), None, "idle@x"),
             (6, "staff1", "Staff", "Other", "Advising Base", day(2021, 6, 1), day(2022, 1, 9), "st@x")],
            "id int, net_id string, name string, role_name string, profile_name string, created_ts timestamp_ntz, "
            "last_login_ts timestamp_ntz, email string"),
        login_history=make(
            [(1, day(2022, 1, 5)), (1, day(2022, 1, 6)), (2, day(2022, 1, 31, 23)), (3, day(2022, 1, 7)),
             (4, day(2022, 1, 7)), (5, day(2021, 12, 31)), (6, day(2022, 1, 9))],
            "user_id int, login_ts timestamp_ntz"),
        affiliations=make(
            [("c1", True, "Acc1", "Org1"), ("c1", True, "Acc1", "Org1"), ("c2", True, "Acc2", "Org1"),
             ("c2", False, "Acc9", "Org9"), ("c3", True, "Acc3", "Org2")],
            "contact_id string, is_primary boolean, account_name string, parent_organization string"),
        assignments=make(
            [(1, "p1"), (1, "p1"), (1, "p2"), (2, "p1"), (2, "none"), (3, "p2"), (4, "p1"), (5, "p1"), (5, "none"), (6, "p2")],
            "assignee_id int, permission_name string"),
        mapping=make([("p1", "Events"), ("p1", "Events"), ("p2", "Service Desk"), ("p3", None)], "permission_name string, product string"),
        marketing=make([("ann", "1/10/2022"), ("cy", "1/11/2022"), ("idle", "12/31/2021"), (None, "1/2/2022"), ("bob", "bad")],
                       "net_id string, max_timestamp string"),
        social=make([("cy", "1/12/2022"), ("ghost", "1/15/2022")], "net_id string, max_timestamp string"),
    )


def test_activity_base(extracts, rows):
    base = bases.activity_base(extracts, JANUARY, MINE)
    got = rows(base, "net_id", "email", "mc_profile", "social_profile", "sf_product", "parent_organization")
    assert got == [
        ("ann", "ann@x", "MC", None, "Events", "Org1"),
        ("ann", "ann@x", "MC", None, "Service Desk", "Org1"),
        ("bob", "bob@x", None, None, "Events", "Org1"),
        ("cy", "cy@x", "MC", "Social", None, "Org2"),
        ("ghost", None, None, "Social", None, None),
        (None, None, "MC", None, "Service Desk", None),
    ]


def test_scans_stay_few_once_the_product_users_are_written(extracts):
    base = bases.activity_base(extracts, JANUARY, MINE)
    plan = base._jdf.queryExecution().optimizedPlan().toString()
    # The written users and the reports twice, contacts and affiliations once or twice; users, logins, assignments and mapping not at all.
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") + plan.count("Relation [") <= 10


def test_many_null_ids_stay_one_row_each(extracts, spark, rows):
    more = spark.createDataFrame([(None, f"1/{d}/2022") for d in range(3, 28)], "net_id string, max_timestamp string")
    extracts = dataclasses.replace(extracts, marketing=extracts.marketing.unionByName(more))
    base = bases.activity_base(extracts, JANUARY, MINE).where("net_id IS NULL")
    assert [str(r["mc_last_login"]) for r in base.collect()] == ["2022-01-27"]


def test_kpi_tables(extracts, rows):
    table = bases.reporting_table(bases.activity_base(extracts, JANUARY, MINE))
    assert rows(tables.users_by_product(table)) == [("Events", 2, 2), ("MC", 4, 2), ("Service Desk", 2, 1), ("Social", 2, 1)]
    assert rows(tables.users_by_product_and_unit(table)) == [
        ("Events", "Org1", 2, 2), ("MC", "Org1", 2, 1), ("MC", "Org2", 1, 1), ("Service Desk", "Org1", 1, 1), ("Social", "Org2", 1, 1),
    ]
    # Two products in one unit count a person twice in total_users, once in distinct_users.
    assert rows(tables.users_by_unit(table)) == [("Org1", 5, 2), ("Org2", 2, 1)]
    assert rows(tables.products_by_unit(table)) == [("Org1", 3), ("Org2", 2)]
    assert rows(tables.units_per_product(table, {"MC": "counter.MC"})) == [
        ("Events", 1), ("Service Desk", 1), ("Social", 1), ("counter.MC", 2),
    ]


def test_wide_total_covers_the_configured_products_only(extracts, rows):
    table = bases.reporting_table(bases.activity_base(extracts, JANUARY, MINE))
    wide = tables.products_by_unit_wide(table, ["Service Desk", "Scheduling/Notes", "Events"])
    assert wide.columns == ["unit", "events", "mc", "service_desk", "social", "scheduling_notes", "total"]
    assert rows(wide, "unit", "service_desk", "scheduling_notes", "total") == [("Org1", 1, None, 2), ("Org2", None, None, 0)]


def test_first_month_leaves_out_units_without_dates(extracts, rows):
    base = bases.activity_base(extracts, JANUARY, MINE)
    assert rows(tables.unit_first_month(base)) == [("Org1", 3, 2021), (None, 5, 2021)]


def test_entitlement_base(extracts, rows):
    base = bases.entitlement_base(extracts, MINE)
    got = rows(base, "user_key", "profile_name", "product")
    assert ("Nobody", "Service Desk Base", "Service Desk") in got and ("Nobody", "Service Desk Base", "MC") in got
    assert ("idle", "Advising Base", "Reports") in got, "the first rule that fits wins"
    assert ("bob", "Advising Base", "Notes") in got
    assert ("cy", None, "Social") in got, "rows without a profile stay"
    assert not [r for r in got if r[1] == "System Administrator"]


def test_entitlement_rows_are_made_distinct_in_parts_that_grow_with_the_assignments(extracts, rows, monkeypatch):
    usual = bases.entitlement_base(extracts, MINE)
    monkeypatch.setattr(bases, "PART_ROWS", 1)
    base = bases.entitlement_base(extracts, MINE)
    assert rows(base, *usual.columns) == rows(usual, *usual.columns)
    # As many as there are assignments, which the session's eight partitions do not bound, and no aggregate before they are dealt.
    assert base.rdd.getNumPartitions() == 10
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "HashAggregate" not in plan[plan.index("Exchange"):plan.index("Expand")]


def test_two_system_layouts(extracts, spark, rows):
    accounts = spark.createDataFrame([("ann@x", "Ann Account"), ("cy@x", "Cy Account"), ("nokey", "Lost")], "email string, name string")
    users = extracts.users.withColumn("net_id", F.when(F.col("net_id") == "Ann", "ann").otherwise(F.col("net_id")))
    extracts = dataclasses.replace(extracts, marketing=accounts, social=None, users=users)
    long = bases.entitlement_base(extracts, MINE, two_systems=True)
    wide = layouts.product_users_wide(long)
    assert wide.columns[:2] == ["name", "user_key"]
    got = {(r["name"], r["user_key"]): r for r in wide.collect()}
    assert got[("Ann A", "ann")]["MC"] == "MC" and got[("Ann A", "ann")]["Events"] == "Events"
    assert got[("Cy Account", "cy")]["MC"] == "MC"
    assert got[("Nobody", "3")]["Service Desk"] == "Service Desk"
    spread = layouts.with_parent_organizations(wide)
    assert "parent_org_1" in spread.columns and "parent_organization" not in spread.columns


def test_first_login_latency(extracts, rows):
    accounts = latency.first_logins(extracts.users, extracts.login_history, dt.date(2021, 3, 1))
    days = dict(rows(accounts, "email", "days"))
    assert days["ann@x"] == (dt.date(2022, 1, 5) - dt.date(2021, 3, 1)).days and "adm@x" not in days
    means = latency.mean_days(accounts, ["unit_token"])
    assert means.columns == ["unit_token", "create_month", "create_year", "avg_days"]


def test_users_without_login_do_not_weigh_on_the_mean(spark, rows):
    users = spark.createDataFrame(
        [(1, "a", dt.datetime(2021, 1, 1), "P", "R x"), (2, "b", dt.datetime(2021, 1, 1), "P", "R x")],
        "id int, email string, created_ts timestamp_ntz, profile_name string, role_name string")
    logins = spark.createDataFrame([(1, dt.datetime(2021, 1, 5)), (1, dt.datetime(2021, 1, 3))], "user_id int, login_ts timestamp_ntz")
    accounts = latency.first_logins(users, logins, dt.date(2021, 1, 1))
    assert rows(latency.mean_days(accounts)) == [(1, 2021, 2.0)]


def test_unmatched_accounts(extracts, rows):
    assert rows(quality.unmatched_accounts(extracts.social, extracts.contacts), "net_id") == [("ghost",)]


def test_a_month_from_frozen_extracts_to_files(extracts, spark, rows, tmp_path):
    out = str(tmp_path)
    frozen = monthly.freeze(extracts, out, JANUARY)
    assert rows(frozen.users) == rows(extracts.users)
    paths = monthly.run_month(frozen, JANUARY, MINE, out, dt.date(2021, 3, 1))
    assert len(paths) == 13 and all("period=2022-01" in p for p in paths.values())
    table = bases.reporting_table(bases.activity_base(extracts, JANUARY, MINE))
    written = spark.read.csv(paths["users_by_unit"], header=True, schema="unit string, total_users long, distinct_users long")
    assert rows(written) == rows(tables.users_by_unit(table))
    ghosts = spark.read.csv(paths["social_without_contact"], header=True)
    assert [r["net_id"] for r in ghosts.collect()] == ["ghost"]


def test_ways_to_choose_users(extracts, spark, rows):
    assert rows(bases.users_with_last_login(extracts.users, JANUARY), "id") == [(1,), (2,), (3,), (4,), (6,)]
    licences = spark.createDataFrame([("ann@x", "5"), ("zz@x", "6")], "username string, profile string")
    assert rows(bases.licensed_users(extracts.users, licences, how="right"), "id", "email", "licence_profile") == [
        (1, "ann@x", "5"), (None, "zz@x", "6"),
    ]


# ---- invariants on the driver tables


@pytest.fixture(scope="module")
def table(spark, folder):
    return bases.reporting_table(bases.activity_base(Roles(spark, folder).extracts(), PERIOD, SETTINGS)).cache()


def test_unit_totals_are_sums_of_cells(table, rows):
    cells = tables.users_by_product_and_unit(table)
    sums = cells.groupBy("unit").agg(F.sum("total_users"))
    assert rows(tables.users_by_unit(table), "unit", "total_users") == rows(sums)
    assert rows(tables.products_by_unit(table)) == rows(cells.groupBy("unit").count())
    assert rows(tables.units_per_product(table)) == rows(cells.groupBy("product").agg(F.count_distinct("unit")))


def test_wide_cells_are_the_cells(table, rows):
    cells = tables.users_by_product_and_unit(table)
    wide = tables.products_by_unit_wide(table, SETTINGS.matrix_products)
    names = [c for c in wide.columns if c not in ("unit", "total")]
    long = wide.unpivot(["unit"], names, "product", "mark").where("mark = 1").select("unit", "product")
    assert rows(long) == rows(cells.selectExpr("unit", "lower(product) AS product"))


def test_monthly_report_has_five_tables(table):
    report = tables.monthly_report(table, SETTINGS)
    assert len(report) == 5 and all(df.count() for df in report.values())
