"""Single operators: selection, filters, joins, windows, reshaping, functions, readers and writers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import query
from checks.roles import PERIOD, SETTINGS
from usagelens.functions import dates, nulls, text
from usagelens.functions import period as months
from usagelens.functions.rules import replace_values
from usagelens.operators import counts, filters, joins, reshape, select, windows
from usagelens.plans import base as bases
from usagelens.plans import tables
from usagelens.sources import readers, schemas, writers
from usagelens.sources.workspace import fresh_path

# ---- filters


@query(
    "P9 P10 F16 F1",
    """SELECT id, profile_name, strftime(last_login_ts, '%Y-%m-%d') AS last_login FROM users
       WHERE month(last_login_ts) = 1 AND year(last_login_ts) = 2024
         AND profile_name IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""",
    "users",
)
def calendar_month_filter(r):
    users = filters.in_period(r.users(), "last_login_ts", PERIOD)
    users = users.where(F.col("profile_name").isin(list(SETTINGS.base_profiles)))
    return users.select("id", "profile_name", F.date_format("last_login_ts", "yyyy-MM-dd").alias("last_login"))


@query(
    "P18 S4",
    """SELECT user_id, event_type AS login_type, count(*) AS n FROM events
       WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY user_id, event_type""",
)
def logins_since(r):
    recent = filters.since(r.login_history(), "login_ts", dt.date(2024, 1, 10))
    return counts.group_count(recent, "user_id", "login_type")


@query(
    "P11 P12 P13 P16 P19 N2 N3",
    """SELECT id, net_id, email, primary_department, primary_type FROM contacts
       WHERE (net_id IS NULL OR net_id NOT IN ('u7', 'u21', 'u33')) AND (net_id IS NOT NULL OR email IS NOT NULL)
         AND primary_type IS NOT NULL AND primary_department <> 'Dept 5' AND coalesce(email, '') <> ''""",
    "contacts",
)
def not_in_keep_nulls(r):
    contacts = r.contacts().drop("user_id").where(nulls.not_in(F.col("net_id"), ["u7", "u21", "u33"]))
    contacts = filters.with_any(contacts, ["net_id", "email"]).where(F.col("primary_type").isNotNull())
    return contacts.where((F.col("primary_department") != "Dept 5") & nulls.has_text(F.col("email")))


@query(
    "P12 N2",
    """SELECT primary_type, count(*) AS n, count(net_id) AS with_id FROM contacts
       WHERE primary_type IS NULL OR primary_type IN ('staff') GROUP BY primary_type""",
    "contacts",
)
def null_or_listed(r):
    kept = r.contacts().where(nulls.in_or_null(F.col("primary_type"), ["staff"]))
    return kept.groupBy("primary_type").agg(F.count(F.lit(1)).alias("n"), F.count("net_id").alias("with_id"))


@query(
    "P12",
    "SELECT id, net_id, email FROM contacts WHERE net_id IS NOT NULL AND email IS NOT NULL AND primary_type IS NOT NULL",
    "contacts",
)
def all_present(r):
    return filters.with_all(r.contacts(), ["net_id", "email", "primary_type"]).select("id", "net_id", "email")


@query(
    "P20 N8 P23",
    """SELECT id, CASE net_id WHEN 'u33' THEN 'u34' WHEN 'u52' THEN 'u53' ELSE net_id END AS net_id,
              CASE profile_name WHEN 'BUILDING' THEN 'Base' WHEN 'MACHINERY' THEN 'Desk' ELSE profile_name END AS profile
       FROM users""",
    "users",
)
def key_override(r):
    return r.users().select(
        "id",
        replace_values(F.col("net_id"), SETTINGS.net_id_overrides).alias("net_id"),
        replace_values(F.col("profile_name"), {"BUILDING": "Base", "MACHINERY": "Desk"}).alias("profile"),
    )


# ---- columns


@query(
    "P1 P2 P3 P4 P6 P7 P8 J10 F12 F13",
    """SELECT 'crm' AS source, id AS crm_id, name AS crm_name, net_id || '/' || profile_name AS crm_label,
              CAST(CASE WHEN net_id IS NULL THEN 1 ELSE 0 END + CASE WHEN email IS NULL THEN 1 ELSE 0 END AS INTEGER) AS crm_missing
       FROM users""",
    "users",
)
def column_ops(r):
    users = select.keep_existing(r.users(), ["id", "name", "net_id", "email", "profile_name", "no_such_column"])
    users = users.withColumn("label", F.concat("net_id", F.lit("/"), "profile_name"))
    users = users.withColumn("null_flags", nulls.null_count("net_id", "email"))
    users = select.rename(users, {"null_flags": "missing"})
    users = select.drop_named(users, ["net_id", "email", "profile_name"])
    return select.move_before(select.tag(select.with_role(users, "crm"), source="crm"), ["source"])


@query(
    "P3 P5",
    "SELECT c_name, c_mktsegment FROM customer",
)
def text_columns_without_keys(r):
    customer = select.drop_suffix(r.table("customer"), "key")
    return select.select_text(customer)


# ---- joins


@query(
    "J1",
    """SELECT u.id, u.profile_name, l.login_type, strftime(l.login_ts, '%Y-%m-%d %H:%M:%S') AS login_time
       FROM users u JOIN login_history l ON u.id = l.user_id""",
    "users login_history",
)
def inner_join_users_logins(r):
    joined = joins.keyed_join(r.users(), r.login_history(), [("id", "user_id")], null_match=False)
    return joined.select("id", "profile_name", "login_type", F.date_format("login_ts", "yyyy-MM-dd HH:mm:ss").alias("login_time"))


@query(
    "J2",
    """SELECT u.id, u.email, l.user_id AS licence_user_id, l.last_login AS licence_last_login
       FROM users u JOIN licensed l ON u.email = l.username""",
    "users licensed",
)
def inner_join_email(r):
    joined = bases.licensed_users(r.users(), r.licensed())
    return joined.select("id", "email", "licence_user_id", "licence_last_login")


@query(
    "J5",
    """SELECT u.id, l.username AS email, l.profile AS licence_profile, l.created_date AS licence_created_date
       FROM users u RIGHT JOIN licensed l ON u.email = l.username""",
    "users licensed",
)
def right_join_licensed(r):
    joined = bases.licensed_users(r.users(), r.licensed(), how="right")
    return joined.select("id", "email", "licence_profile", "licence_created_date")


@query(
    "J6",
    """SELECT coalesce(u.id, l.user_id) AS id, u.profile_name, l.profile AS licence_profile, l.username AS licence_username
       FROM users u FULL JOIN licensed l ON u.id = l.user_id""",
    "users licensed",
)
def full_join_licensed(r):
    joined = bases.licensed_users(r.users(), r.licensed(), on=("id", "user_id"), how="full")
    return joined.select("id", "profile_name", "licence_profile", "licence_username")


@query(
    "J6 N1",
    """SELECT coalesce(c.net_id, m.net_id) AS net_id, c.id, m.max_timestamp
       FROM contacts c FULL JOIN marketing m ON c.net_id IS NOT DISTINCT FROM m.net_id""",
    "contacts marketing",
)
def full_join_null_keys(r):
    contacts, report = r.contacts().select("net_id", "id"), r.report("click")
    return joins.keyed_join(contacts, report, "net_id", "full")


@query(
    "J6 N1",
    """SELECT coalesce(c.net_id, m.net_id) AS net_id, c.id, m.max_timestamp
       FROM contacts c FULL JOIN marketing m ON c.net_id IS NOT DISTINCT FROM m.net_id""",
    "contacts marketing",
)
def full_join_split_keys(r):
    """The same join in the form whose left side Spark can split: the report has one row per key, the null key too."""
    contacts, report = r.contacts().select("net_id", "id"), r.report("click")
    return joins.keyed_join(contacts, report, "net_id", "full", right_unique=True)


@query(
    "J4",
    """SELECT u.id, u.name, c.primary_department, c.primary_type
       FROM users u LEFT JOIN contacts c ON c.user_id = u.id""",
    "users contacts",
)
def users_with_contact(r):
    contacts = r.contacts().select("user_id", "primary_department", "primary_type")
    joined = joins.keyed_join(r.users().select("id", "name"), contacts, [("id", "user_id")], "left")
    return joined


@query(
    "J3 S3 A1 N5",
    """SELECT m.product, count(*) AS n FROM assignments a
       LEFT JOIN (SELECT DISTINCT permission_name, product FROM mapping) m ON m.permission_name = a.permission_name
       GROUP BY m.product""",
    "assignments mapping",
)
def mapping_broadcast(r):
    mapped = joins.lookup(r.assignments(), r.mapping(), "permission_name", ["product"])
    return counts.group_count(mapped, "product")


@query(
    "J11",
    """SELECT c_custkey AS id, n_name AS account_name, r_name AS parent_organization
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def lookup_path(r):
    return r.people().selectExpr("c_custkey AS id", "n_name AS account_name", "r_name AS parent_organization")


@query(
    "J12",
    """SELECT p.profile_name, p.users, CAST(m.mean AS INTEGER) AS mean, CAST(s.sd AS INTEGER) AS sd
       FROM (SELECT c_mktsegment AS profile_name, count(*) AS users FROM customer GROUP BY c_mktsegment) p,
            range(1, 4) m(mean), range(1, 4) s(sd)""",
)
def grid_cross(r):
    groups = counts.group_count(r.users(), "profile_name", name="users")
    return joins.value_grid(groups, mean=[1, 2, 3], sd=[1, 2, 3])


# ---- counts


@query(
    "A1 N5",
    "SELECT net_id IS NULL AS no_id, primary_type, count(*) AS n FROM contacts GROUP BY net_id IS NULL, primary_type",
    "contacts",
)
def count_nulls_kept(r):
    flagged = r.contacts().withColumn("no_id", F.col("net_id").isNull())
    return counts.group_count(flagged, "no_id", "primary_type")


@query(
    "A3 A4 N5",
    """SELECT primary_type, primary_department, count(*) AS n FROM contacts
       WHERE primary_type IS NOT NULL AND primary_department IS NOT NULL GROUP BY primary_type, primary_department""",
    "contacts",
)
def frequency_drops_nulls(r):
    return counts.frequency(r.contacts(), "primary_type", "primary_department")


@query(
    "A10 N7",
    """SELECT count(DISTINCT net_id) AS ids, count(DISTINCT net_id) + 1 AS ids_and_null
       FROM contacts""",
    "contacts",
)
def count_distinct_null(r):
    ids = F.col("net_id")
    return r.contacts().agg(
        nulls.n_distinct(ids).alias("ids"), nulls.n_distinct(ids, count_null=True).cast("long").alias("ids_and_null")
    )


@query(
    "S10 A10",
    "SELECT count(DISTINCT coalesce(net_id, name)) AS users FROM users",
    "users",
)
def sql_distinct_users(r):
    keyed = r.users().withColumn("user_key", F.coalesce("net_id", "name"))
    return readers.run_sql(r.spark, "SELECT count(DISTINCT user_key) AS users FROM {people}", people=keyed)


# ---- windows


@query(
    "W6 F17",
    """SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type), 4) AS mean_value,
              round(value - avg(value) OVER (PARTITION BY event_type), 4) AS deviation
       FROM events""",
)
def group_deviation(r):
    events = r.table("events").select("event_id", "event_type", "value")
    with_mean = windows.with_group_stats(events, ["event_type"], mean_value=F.avg("value"))
    return with_mean.select(
        "event_id", "event_type", F.round("mean_value", 4).alias("mean_value"),
        F.round(F.col("value") - F.col("mean_value"), 4).alias("deviation"),
    )


@query(
    "W7 W5",
    """SELECT o_custkey, o_orderkey, n FROM (
         SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
       WHERE place = 1""",
)
def group_size_keep_first(r):
    orders = r.table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    first = windows.first_per_key(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    sizes = counts.group_count(r.table("orders"), "o_custkey")
    return joins.keyed_join(first, sizes, "o_custkey").select("o_custkey", "o_orderkey", "n")


@query(
    "W2",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events""",
)
def number_logins(r):
    events = r.table("events").select("user_id", "event_id", "ts")
    numbered = windows.number_rows(events, ["user_id"], ["ts", "event_id"], slice_by=F.to_date("ts"))
    return numbered.select("user_id", "event_id", "ordinal")


@query(
    "W4 U2",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS place
         FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))
       WHERE place > 1""",
)
def duplicate_lines(r):
    lines = r.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return windows.repeats(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(
    "W5 U2",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS place
         FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))
       WHERE place = 1""",
)
def first_line_per_key(r):
    lines = r.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return windows.first_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query(
    "W8",
    """SELECT p_type, p_partkey, p_size FROM (
         SELECT *, rank() OVER (PARTITION BY p_type ORDER BY p_size) AS place FROM part) WHERE place <= 1""",
)
def lowest_n_per_group(r):
    parts = r.table("part").select("p_type", "p_partkey", "p_size")
    return windows.lowest_per_group(parts, ["p_type"], F.col("p_size"))


@query(
    "W9",
    "SELECT event_type, least(count(*), 5) AS n, 0 AS strangers FROM events GROUP BY event_type",
)
def sample_rows_per_group(r):
    events = r.table("events").select("event_id", "event_type")
    drawn = windows.sample_rows(events, ["event_type"], 5, seed=7)
    known = events.withColumn("known", F.lit(True))
    found = joins.keyed_join(drawn, known, ["event_id", "event_type"], "left")
    return found.groupBy("event_type").agg(
        F.count_distinct("event_id").alias("n"), F.sum(nulls.null_flag("known")).cast("int").alias("strangers")
    )


@query(
    "W10",
    "SELECT 3 AS n_groups, CAST(0 AS BIGINT) AS incomplete_groups",
)
def sample_groups(r):
    events = r.table("events").select("event_id", "event_type")
    drawn = counts.group_count(windows.sample_groups(events, ["event_type"], 3, seed=7), "event_type", name="drawn")
    whole = counts.group_count(events, "event_type", name="whole")
    return joins.keyed_join(drawn, whole, "event_type").agg(
        F.count(F.lit(1)).cast("int").alias("n_groups"),
        F.count_if(F.col("drawn") != F.col("whole")).alias("incomplete_groups"),
    )


# ---- shape


@query(
    "U1 U2",
    """SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier""",
)
def union_by_name(r):
    return reshape.stack(
        r.table("nation").selectExpr("n_name AS name"),
        r.table("region").selectExpr("r_name AS name"),
        r.table("supplier").selectExpr("s_name AS name"),
    )


@query(
    "U3",
    """SELECT DISTINCT primary_department, column_name, value FROM (
         SELECT primary_department, 'primary_type' AS column_name, primary_type AS value FROM contacts
         UNION ALL SELECT primary_department, 'net_id', net_id FROM contacts)
       WHERE value IS NOT NULL""",
    "contacts",
)
def wide_to_long(r):
    return reshape.to_long(r.contacts(), ["primary_department"], ["primary_type", "net_id"], "column_name", "value")


@query(
    "U5 W2",
    """SELECT o_custkey AS user_key, max(CASE WHEN place = 1 THEN o_orderpriority END) AS org_1,
              max(CASE WHEN place = 2 THEN o_orderpriority END) AS org_2,
              coalesce(string_agg(CASE WHEN place > 2 THEN o_orderpriority END, '; ' ORDER BY place), '') AS org_more
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS place
             FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders))
       GROUP BY o_custkey""",
)
def ordinal_columns(r):
    wide = reshape.ordinal_wide(r.user_organizations(), "user_key", "parent_organization", "org", width=2)
    return wide.withColumn("org_more", F.concat_ws("; ", "org_more"))


@query("U7", "SELECT event_type, event_id, value FROM events")
def nest_unnest(r):
    events = r.table("events").select("event_type", "event_id", "value")
    nested = reshape.nest(events, ["event_type"], parts=16)
    return reshape.unnest(nested, ["event_type"])


@query(
    "U7 W8",
    """SELECT event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY event_type""",
)
def nested_group_sizes(r):
    nested = reshape.nest(r.table("events").select("event_type", "event_id"), ["event_type"], parts=16)
    return nested.groupBy("event_type").agg(
        F.sum(F.size("rows")).alias("n"), F.min(F.array_min("rows.event_id")).alias("first_event")
    )


@query(
    "F18",
    "SELECT event_type, CAST(1000 AS BIGINT) AS n, true AS mean_fits, true AS sd_fits FROM events GROUP BY event_type",
)
def normal_draws(r):
    groups = r.table("events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"))
    drawn = reshape.normal_draws(groups, F.col("mean"), F.col("sd"), 1000, seed=11)
    return drawn.groupBy("event_type").agg(
        F.count("value").alias("n"),
        (F.abs(F.avg("value") - F.max("mean")) < F.max("sd") * 0.2).alias("mean_fits"),
        (F.abs(F.stddev("value") / F.max("sd") - 1) < 0.2).alias("sd_fits"),
    )


@query(
    "O1 O2",
    """SELECT net_id, email, name FROM users ORDER BY net_id NULLS LAST, email NULLS LAST, name NULLS LAST LIMIT 6""",
    "users",
)
def sorted_head(r):
    return windows.sorted_head(r.users().select("net_id", "email", "name"), ["net_id", "email", "name"], 6)


# ---- functions


@query(
    "F3 F4 F5 N14",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS from_mdy,
              strftime(o_orderdate, '%Y-%m-%d %H:%M') AS from_mdy_hm,
              strftime(o_orderdate + INTERVAL 7 SECOND, '%Y-%m-%d %H:%M:%S') AS from_mdy_hms,
              CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS from_ymd_hms,
              CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day
       FROM orders""",
)
def parse_dates(r):
    written = r.table("orders").selectExpr(
        "o_orderkey",
        "o_orderdate",
        "date_format(o_orderdate, 'M/d/yyyy') AS mdy",
        "date_format(o_orderdate, 'M/d/yyyy H:mm') AS mdy_hm",
        "date_format(o_orderdate + INTERVAL 7 SECOND, 'M/d/yyyy H:mm:ss') AS mdy_hms",
        "CASE WHEN o_orderkey % 5 <> 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') ELSE 'bad' END AS ymd_hms",
    )
    return written.select(
        "o_orderkey",
        dates.parse_mdy(F.col("mdy")).cast("string").alias("from_mdy"),
        F.date_format(dates.parse_mdy_hm(F.col("mdy_hm")), "yyyy-MM-dd HH:mm").alias("from_mdy_hm"),
        F.date_format(dates.parse_mdy_hms(F.col("mdy_hms")), "yyyy-MM-dd HH:mm:ss").alias("from_mdy_hms"),
        F.date_format(dates.parse_ymd_hms(F.col("ymd_hms")), "yyyy-MM-dd HH:mm:ss").alias("from_ymd_hms"),
        F.to_date("o_orderdate").cast("string").alias("day"),
    )


@query(
    "F1 F2 F6 F7 F8 F9 N16",
    """SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
              CAST(month(o_orderdate) AS BIGINT) AS month, CAST(year(o_orderdate) AS BIGINT) AS year,
              strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
              strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m-%d') AS previous_month,
              CAST(year(o_orderdate) - 1 AS BIGINT) AS previous_year,
              strftime(o_orderdate, '%B %d %Y') AS long_date, strftime(o_orderdate, '%B') AS month_name,
              CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-01-01') AS BIGINT) AS days_to_report
       FROM orders""",
)
def date_math(r):
    day = F.col("o_orderdate")
    return r.table("orders").select(
        F.to_date(day).cast("string").alias("day"),
        F.month(day).cast("long").alias("month"),
        F.year(day).cast("long").alias("year"),
        months.month_start(day).cast("string").alias("month_start"),
        months.previous_month(day).cast("string").alias("previous_month"),
        months.previous_year(day).cast("long").alias("previous_year"),
        months.long_date(day).alias("long_date"),
        months.month_name(day).alias("month_name"),
        dates.days_between(F.lit(PERIOD.start), day).cast("long").alias("days_to_report"),
    ).distinct()


@query(
    "F10 F11 F19 N15",
    """SELECT id, CASE WHEN strpos(email, '@') > 0 THEN split_part(email, '@', 1) END AS email_key,
              CASE WHEN split_part(email, '@', -1) = 'example.com'
                   THEN split_part(email, '@', 1) || '@mail.example.com' ELSE email END AS moved_email,
              split_part(role_name, ' ', 1) AS unit_token
       FROM users""",
    "users",
)
def email_to_key(r):
    email = F.col("email")
    return r.users().select(
        "id",
        text.key_from_email(email).alias("email_key"),
        text.rewrite_domain(email, "example.com", "mail.example.com").alias("moved_email"),
        text.first_token(F.col("role_name")).alias("unit_token"),
    )


@query(
    "F14 F13",
    """SELECT id, net_id IS NULL OR email IS NULL AS any_null, primary_type = 'staff' AND net_id IS NOT NULL AS staff_with_id,
              NOT (primary_type = 'staff') AS not_staff, primary_type <> 'staff' OR net_id IS NULL AS either,
              CASE WHEN primary_type = 'staff' THEN 'S' ELSE 'other' END AS label
       FROM contacts""",
    "contacts",
)
def null_logic(r):
    staff, no_id = F.col("primary_type") == "staff", F.col("net_id").isNull()
    return r.contacts().select(
        "id",
        (no_id | F.col("email").isNull()).alias("any_null"),
        (staff & ~no_id).alias("staff_with_id"),
        (~staff).alias("not_staff"),
        ((F.col("primary_type") != "staff") | no_id).alias("either"),
        F.when(staff, "S").otherwise("other").alias("label"),
    )


# ---- readers and writers, through the shared folder


@query(
    "S1 S2 S7 N10 N11",
    """SELECT 'null' AS mode, id, CASE WHEN id % 10 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 THEN net_id END AS net_id, profile_name
       FROM users
       UNION ALL
       SELECT 'keep', id, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 10 = 0 OR id % 17 = 0 THEN '' ELSE net_id END, profile_name
       FROM users""",
    "users",
)
def csv_roundtrip(r):
    spark = r.spark
    written = r.users().selectExpr(
        "id AS Id",
        "CASE WHEN id % 13 = 0 THEN 'NA' WHEN id % 17 = 0 THEN '' ELSE net_id END AS NetID__c",
        "profile_name AS `Profile.Name`",
    )
    path = writers.write_table(written, fresh_path(spark, "csv"), "users", PERIOD)
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("net_id", T.StringType()), T.StructField("profile_name", T.StringType()),
    ])
    read = {
        mode: readers.read_csv(spark, path, schema, schemas.ALIASES["users"], empty_as_null=mode == "null")
        for mode in ("null", "keep")
    }
    return reshape.stack(*[df.select(F.lit(mode).alias("mode"), "*") for mode, df in read.items()])


@query(
    "S4 S8 S9",
    "SELECT contact_id, is_primary, account_name, parent_organization FROM affiliations",
    "affiliations",
)
def snapshot_roundtrip(r):
    root = fresh_path(r.spark, "snapshots")
    writers.snapshot(r.affiliations(), root, "affiliations", PERIOD.previous)
    writers.snapshot(r.affiliations(), root, "affiliations", PERIOD)
    return readers.read_snapshot(r.spark, root, "affiliations", PERIOD)


@query(
    "S5 S6 S8 F12",
    """SELECT net_id, max_timestamp, strftime(strptime(max_timestamp, '%m/%d/%Y'), '%Y-%m') AS report_month
       FROM marketing""",
    "marketing",
)
def monthly_glob(r):
    root = fresh_path(r.spark, "reports")
    report = r.report("click")
    for period in (PERIOD.previous, PERIOD):
        rows = report.where(period.contains(dates.parse_mdy(F.col("max_timestamp"))))
        rows.write.option("header", True).csv(readers.report_path(root, "last_login", period))
    read = readers.read_reports(r.spark, root, "last_login", "marketing_logins")
    return read.drop("source_file")


@query(
    "S4 P18",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'""",
)
def extract_scan(r):
    recent = F.col("o_orderdate") >= F.lit(dt.date(1999, 1, 1))
    return readers.read_extract(r.spark, f"{r.folder}/orders.parquet", ["o_orderkey", "o_custkey"], recent)


@query(
    "S7 S8 K3",
    """SELECT product, count(*) AS total_users, count(DISTINCT email) AS distinct_users FROM used GROUP BY src, product""",
    "used",
)
def written_report(r):
    """The base table frozen first, then counted, and the report read back from its file."""
    root = fresh_path(r.spark, "kpi")
    base = bases.activity_base(r.extracts(), PERIOD, SETTINGS)
    writers.snapshot(base, root, "base", PERIOD)
    frozen = readers.read_snapshot(r.spark, root, "base", PERIOD)
    report = tables.monthly_report(frozen, SETTINGS)["user_counts_by_product"]
    path = writers.write_table(report, root, "user_counts_by_product", PERIOD)
    schema = T.StructType([
        T.StructField("product", T.StringType()), T.StructField("total_users", T.LongType()),
        T.StructField("distinct_users", T.LongType()),
    ])
    return readers.read_csv(r.spark, path, schema)


@query(
    "A1 S7",
    "SELECT permission_name, count(*) AS n FROM assignments GROUP BY permission_name",
    "assignments",
)
def permission_tally(r):
    """Assignments per permission, written and read back."""
    tally = counts.group_count(r.assignments(), "permission_name")
    path = writers.write_table(tally, fresh_path(r.spark, "tally"), "permissions", PERIOD)
    schema = T.StructType([T.StructField("permission_name", T.LongType()), T.StructField("n", T.LongType())])
    return readers.read_csv(r.spark, path, schema)
