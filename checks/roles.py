"""The driver tables in the role of the source tables of ``usagelens.sources.schemas``.

Invented ids and gaps: every tenth customer is a user without person id, and its contact is
another person; every seventeenth contact has no person id, every twenty-fifth report row neither, and every third report user was last
seen a month earlier. ``checks.oracles`` states the same views in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.period import Period
from usagelens.functions.rules import DefaultRule
from usagelens.plans.base import Extracts
from usagelens.settings import KpiSettings

PERIOD = Period(2024, 1)
WINDOW = (dt.date(2024, 1, 28), dt.date(2024, 1, 30))
CREATED_SINCE = dt.date(1995, 2, 1)
PRODUCTS = ["ECONOMY", "LARGE", "MC", "MEDIUM", "PROMO", "SMALL", "STANDARD", "Social"]

SETTINGS = KpiSettings(
    base_profiles=("BUILDING", "MACHINERY", "HOUSEHOLD"),
    admin_profile="AUTOMOBILE",
    excluded_profiles=("FURNITURE", "AUTOMOBILE"),
    excluded_net_ids=("u7", "u21"),
    excluded_user_keys=("u13",),
    net_id_overrides={"u33": "u34", "u52": "u53"},
    matrix_products=("ECONOMY", "PROMO", "SMALL", "STANDARD", "MC", "Social"),
    default_rules=(
        DefaultRule("role_name", ("NATION_3 team",), "Reports"),
        DefaultRule("role_name", ("NATION_5 team", "NATION_8 team"), "Field"),
        DefaultRule("profile_name", ("BUILDING",), "Scheduling"),
        DefaultRule("profile_name", ("MACHINERY",), "Desk"),
        DefaultRule("role_name", ("NATION_9 team",), "Marketing"),
    ),
)


class Roles:
    """Role views over the Parquet files of one folder. Views are plans; nothing is computed here."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def people(self) -> DataFrame:
        """Customers with their nation and region: a lookup along a two-step path."""
        places = self.table("nation").join(self.table("region"), F.expr("n_regionkey = r_regionkey"), "left")
        return self.table("customer").join(places, F.expr("c_nationkey = n_nationkey"), "left")

    def users(self) -> DataFrame:
        nations = self.table("nation").select("n_nationkey", "n_name")
        users = self.table("customer").join(nations, F.expr("c_nationkey = n_nationkey"), "left").selectExpr(
            "c_custkey AS id",
            "CASE WHEN c_custkey % 10 <> 0 THEN concat('u', c_custkey) END AS net_id",
            """CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN concat('u', c_custkey)
                    ELSE concat('u', c_custkey, '@example.com') END AS email""",
            "c_name AS name",
            "c_mktsegment AS profile_name",
            "concat(n_name, ' team') AS role_name",
            "c_acctbal > 0 AS is_active",
        )
        dates = self.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created_ts"))
        seen = self.table("events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_login_ts"))
        return users.join(dates, "id", "left").join(seen, "id", "left")

    def contacts(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey * 10 + 1 AS id",
            "c_custkey AS user_id",
            "CASE WHEN c_custkey % 17 <> 0 THEN concat(if(c_custkey % 10 <> 0, 'u', 'c'), c_custkey) END AS net_id",
            "CASE WHEN c_custkey % 13 <> 0 THEN concat(if(c_custkey % 10 <> 0, 'u', 'c'), c_custkey, '@example.com') END AS email",
            "concat('Dept ', c_custkey % 12) AS primary_department",
            "CASE WHEN c_custkey % 4 = 0 THEN 'staff' WHEN c_custkey % 4 = 1 THEN 'student' END AS primary_type",
        )

    def login_history(self) -> DataFrame:
        return self.table("events").selectExpr("user_id", "ts AS login_ts", "event_type AS login_type")

    def report(self, event_type: str, key: str = "net_id") -> DataFrame:
        """Last day per person as text, one row per person id or, with ``key="email"``, per email."""
        domain = "" if key == "net_id" else ", '@example.com'"
        return (
            self.table("events")
            .where(F.col("event_type") == event_type)
            .selectExpr(
                f"CASE WHEN user_id % 25 <> 0 THEN concat('u', user_id{domain}) END AS {key}",
                "CASE WHEN user_id % 3 = 0 THEN add_months(date(ts), -1) ELSE date(ts) END AS day",
            )
            .groupBy(key)
            .agg(F.max("day").alias("day"))
            .selectExpr(key, "date_format(day, 'M/d/yyyy') AS max_timestamp")
        )

    def marketing_accounts(self) -> DataFrame:
        """Accounts by email, every ninth without a domain, some without a user."""
        rows = self.table("events").where("event_type = 'click'")
        return rows.select("user_id").distinct().selectExpr(
            """CASE WHEN user_id % 9 = 0 THEN concat(if(user_id % 2 = 0, 'u', 'v'), user_id)
                    ELSE concat(if(user_id % 2 = 0, 'u', 'v'), user_id, '@mail.example.com') END AS email""",
            "concat('Account ', user_id) AS name",
        )

    def assignments(self) -> DataFrame:
        items = self.table("lineitem").select("l_orderkey", "l_partkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        joined = orders.join(items, F.expr("o_orderkey = l_orderkey"))
        return joined.selectExpr("o_custkey AS assignee_id", "l_partkey AS permission_name")

    def mapping(self) -> DataFrame:
        return self.table("part").selectExpr(
            "if(p_size <= 25, p_partkey, -p_partkey) AS permission_name",
            "CASE WHEN p_size % 9 <> 0 THEN CAST(p_size AS bigint) END AS n",
            "p_type AS product",
        )

    def affiliations(self) -> DataFrame:
        return self.people().selectExpr(
            "c_custkey * 10 + 1 AS contact_id",
            "c_custkey % 7 <> 0 AS is_primary",
            "n_name AS account_name",
            "r_name AS parent_organization",
        )

    def licensed(self) -> DataFrame:
        """A licence for each customer, two of three of them of other people, with text dates."""
        spans = self.table("orders").groupBy("o_custkey").agg(
            F.max("o_orderdate").alias("last"), F.min("o_orderdate").alias("first")
        )
        return self.table("customer").join(spans, F.expr("c_custkey = o_custkey"), "left").selectExpr(
            "concat(if(c_custkey % 3 = 0, 'u', 'l'), c_custkey, '@example.com') AS username",
            "if(c_custkey % 3 = 0, c_custkey, -c_custkey) AS user_id",
            "c_mktsegment AS profile",
            "date_format(last, 'M/d/yyyy H:mm') AS last_login",
            "date_format(first, 'M/d/yyyy H:mm') AS created_date",
        )

    def user_organizations(self) -> DataFrame:
        """Several organisations per user."""
        return self.table("orders").selectExpr("o_custkey AS user_key", "o_orderpriority AS parent_organization")

    def extracts(self) -> Extracts:
        return Extracts(
            contacts=self.contacts(),
            users=self.users(),
            login_history=self.login_history(),
            affiliations=self.affiliations(),
            assignments=self.assignments(),
            mapping=self.mapping(),
            marketing=self.report("click"),
            social=self.report("signup"),
        )
