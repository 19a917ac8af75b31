"""KPI tables, K1 to K25."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query
from checks.roles import CREATED_SINCE, PERIOD, PRODUCTS, SETTINGS, WINDOW, Roles
from usagelens.functions import dates
from usagelens.functions.nulls import any_present, n_distinct_when
from usagelens.functions.period import month_start
from usagelens.operators import counts
from usagelens.operators.filters import in_days, with_fewer_nulls
from usagelens.operators.select import keep_existing
from usagelens.plans import base as bases
from usagelens.plans import latency, layouts, quality, tables
from usagelens.sources.workspace import cut_lineage


def _base(r: Roles) -> DataFrame:
    return bases.activity_base(r.extracts(), PERIOD, SETTINGS)


def _entitled(r: Roles) -> DataFrame:
    return bases.entitlement_base(r.extracts(), SETTINGS)


def _two_systems(r: Roles) -> DataFrame:
    extracts = replace(r.extracts(), marketing=r.marketing_accounts(), social=None)
    return bases.entitlement_base(extracts, SETTINGS, two_systems=True)


def _table(r: Roles) -> DataFrame:
    return bases.reporting_table(_base(r))


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if f.dataType.typeName() == "date"})


@query(
    "K1 J1 J3 J4 J6 P9 P10 P11 P12 P13 P15 P20 U2 N1",
    """SELECT net_id, contact_id, email, primary_department, mc_profile, CAST(mc_last_login AS VARCHAR) AS mc_last_login,
              social_profile, CAST(social_last_login AS VARCHAR) AS social_last_login, sf_user_id, sf_profile,
              CAST(sf_created AS VARCHAR) AS sf_created, CAST(sf_last_login AS VARCHAR) AS sf_last_login, sf_product,
              parent_organization, account_name
       FROM base""",
    "base",
)
def activity_base(r):
    return _dates_as_text(_base(r))


@query(
    "K3 A3 U1",
    """SELECT product, count(*) AS total_users, count(DISTINCT email) AS distinct_users
       FROM used GROUP BY src, product""",
    "used",
)
def user_counts_by_product(r):
    return tables.users_by_product(_table(r))


@query(
    "K4 K1 A4 J6 U3",
    "SELECT product, unit, freq AS total_users, emails AS distinct_users FROM cells",
    "cells",
)
def user_counts_by_product_unit(r):
    return tables.users_by_product_and_unit(_table(r))


@query(
    "K5 A5",
    """SELECT c.unit, c.total_users, u.distinct_users
       FROM (SELECT unit, CAST(sum(freq) AS BIGINT) AS total_users FROM cells GROUP BY unit) c
       JOIN (SELECT unit, count(DISTINCT email) AS distinct_users FROM used GROUP BY unit) u ON c.unit = u.unit""",
    "cells",
)
def users_by_unit(r):
    return tables.users_by_unit(_table(r))


@query(
    "A5",
    """SELECT product, CAST(sum(freq) AS BIGINT) AS total_users FROM cells GROUP BY product""",
    "cells",
)
def product_totals_from_cells(r):
    cells = tables.users_by_product_and_unit(_table(r))
    return counts.group_sum(cells, ["product"], "total_users", "total_users")


@query("K6 A6", "SELECT unit, count(*) AS total_products FROM cells GROUP BY unit", "cells")
def products_by_unit(r):
    return tables.products_by_unit(_table(r))


_WIDE = ", ".join(f"CAST(max(CASE WHEN product = '{p}' THEN 1 END) AS INTEGER) AS {p.lower()}" for p in PRODUCTS)


@query(
    "K7 U6 A18 P6",
    f"""SELECT *, CAST(coalesce(economy, 0) + coalesce(promo, 0) + coalesce(small, 0) + coalesce(standard, 0)
                       + coalesce(mc, 0) + coalesce(social, 0) AS BIGINT) AS total
        FROM (SELECT unit, {_WIDE} FROM cells GROUP BY unit)""",
    "cells",
)
def products_by_unit_wide(r):
    return tables.products_by_unit_wide(_table(r), SETTINGS.matrix_products, PRODUCTS)


@query(
    "K8 A12 P23",
    """SELECT CASE product WHEN 'MC' THEN 'marketing' WHEN 'Social' THEN 'social' ELSE product END AS product,
              count(DISTINCT unit) AS n_units
       FROM cells GROUP BY product""",
    "cells",
)
def units_per_product(r):
    return tables.units_per_product(_table(r), {"MC": "marketing", "Social": "social"})


@query(
    "K9 A7 F1 P12",
    """SELECT parent_organization AS unit, month(min(sf_created)) AS first_month, year(min(sf_created)) AS first_year
       FROM base GROUP BY parent_organization HAVING min(sf_created) IS NOT NULL""",
    "base",
)
def unit_first_month(r):
    first = tables.unit_first_month(_base(r))
    return first.withColumns({c: F.col(c).cast("long") for c in ("first_month", "first_year")})


def _mean_days(r: Roles, *keys: str) -> DataFrame:
    accounts = latency.first_logins(r.users(), r.login_history(), CREATED_SINCE)
    means = latency.mean_days(accounts, keys)
    return means.withColumns({
        "create_month": F.col("create_month").cast("long"),
        "create_year": F.col("create_year").cast("long"),
        "avg_days": F.round("avg_days", 4),
    })


def _mean_sql(*keys: str) -> str:
    names = "".join(k + ", " for k in keys)
    return f"""SELECT {names}create_month, create_year, round(avg(days), 4) AS avg_days
               FROM first_logins GROUP BY {names}create_month, create_year"""


@query("K10 A8 A9 F6 J4 P18", _mean_sql(), "first_logins")
def time_to_first_login_month(r):
    return _mean_days(r)


@query("K10 A8 A9", _mean_sql("profile_name"), "first_logins")
def time_to_first_login_profile(r):
    return _mean_days(r, "profile_name")


@query("K10 A8 A9 F10", _mean_sql("unit_token"), "first_logins")
def time_to_first_login_unit(r):
    return _mean_days(r, "unit_token")


@query(
    "K11 F2 P3 P14 U2",
    """SELECT DISTINCT email, primary_department, mc_profile, social_profile, sf_product, parent_organization,
              account_name, strftime(mc_last_login, '%Y-%m') AS mc_login_month,
              strftime(sf_last_login, '%Y-%m') AS sf_login_month,
              strftime(social_last_login, '%Y-%m') AS social_login_month
       FROM base
       WHERE mc_last_login IS NOT NULL OR sf_last_login IS NOT NULL OR social_last_login IS NOT NULL""",
    "base",
)
def month_activity(r):
    dated = _base(r).select(*bases.REPORT_COLUMNS, *bases.DATES)
    months = tables.month_activity(dated)
    as_text = {c: F.date_format(c, "yyyy-MM") for c in months.columns if c.endswith("_login_month")}
    return months.withColumns(as_text)


@query(
    "K12 A13",
    "SELECT sf_product, count(*) AS n FROM (SELECT DISTINCT email, sf_product FROM base) GROUP BY sf_product",
    "base",
)
def distinct_users_by_pair(r):
    return counts.distinct_users(_base(r), "email", ["sf_product"])


@query(
    "K12 A14",
    """SELECT mc_profile, social_profile, count(*) AS n
       FROM (SELECT DISTINCT email, mc_profile, social_profile FROM base) GROUP BY mc_profile, social_profile""",
    "base",
)
def distinct_users_by_triple(r):
    return counts.distinct_users(_base(r), "email", ["mc_profile", "social_profile"])


@query(
    "K13 P17 N13",
    """SELECT sf_product, count(*) AS users
       FROM (SELECT DISTINCT email, sf_product FROM base
             WHERE sf_last_login >= DATE '2024-01-28' AND sf_last_login < DATE '2024-01-31')
       GROUP BY sf_product""",
    "base",
)
def active_users_in_window(r):
    return tables.active_users_in_window(_base(r), *WINDOW)


@query(
    "K14 J7",
    """SELECT net_id, max_timestamp FROM marketing m
       WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE c.net_id = m.net_id)""",
    "marketing contacts",
)
def unmatched_accounts(r):
    return quality.unmatched_accounts(r.report("click"), r.contacts())


_KEYS7 = ", ".join(f"c.{c}" for c in bases.REPORT_COLUMNS)
_ON7 = " AND ".join(f"c.{c} IS NOT DISTINCT FROM e.{c}" for c in bases.REPORT_COLUMNS)


@query(
    "K15 J9 W5 P14",
    f"""SELECT {_KEYS7.replace("c.", "")}, CAST(sf_last_login AS VARCHAR) AS sf_last_login,
               CAST(mc_last_login AS VARCHAR) AS mc_last_login, CAST(social_last_login AS VARCHAR) AS social_last_login, num_na
        FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS7.replace("c.", "")}
                                         ORDER BY sf_last_login NULLS LAST, mc_last_login NULLS LAST,
                                                  social_last_login NULLS LAST) AS place
              FROM (SELECT {_KEYS7}, e.sf_last_login, e.mc_last_login, e.social_last_login,
                           CAST((e.sf_last_login IS NULL)::INT + (e.mc_last_login IS NULL)::INT
                                + (e.social_last_login IS NULL)::INT AS INTEGER) AS num_na
                    FROM fortable c
                    LEFT JOIN (SELECT * FROM (
                        SELECT email, primary_department, mc_profile, social_profile, sf_product, parent_organization,
                               account_name, sf_last_login, mc_last_login, social_last_login,
                               row_number() OVER (PARTITION BY sf_last_login
                                 ORDER BY email NULLS LAST, primary_department NULLS LAST, mc_profile NULLS LAST,
                                          social_profile NULLS LAST, sf_product NULLS LAST,
                                          parent_organization NULLS LAST, account_name NULLS LAST,
                                          sf_last_login NULLS LAST, mc_last_login NULLS LAST,
                                          social_last_login NULLS LAST) AS rn
                        FROM base) WHERE rn = 1) e ON {_ON7})
              WHERE num_na < 3)
        WHERE place = 1""",
    "fortable",
)
def reconcile_versions(r):
    base = cut_lineage(_base(r))
    earlier = base.select(*bases.REPORT_COLUMNS, "sf_last_login", "mc_last_login", "social_last_login")
    current = bases.reporting_table(base)
    return _dates_as_text(quality.reconcile(current, earlier, bases.REPORT_COLUMNS, first_by="sf_last_login"))


_PER_USER = """
    SELECT email, sf_product AS product FROM base
    WHERE sf_last_login >= DATE '2024-01-28' AND sf_last_login < DATE '2024-01-31' GROUP BY email, sf_product
    UNION ALL SELECT email, mc_profile FROM base GROUP BY email, mc_profile
    UNION ALL SELECT email, social_profile FROM base GROUP BY email, social_profile"""


@query(
    "K16 J8 P3 A6 U1",
    f"""SELECT p.email, p.product, t.primary_department, t.mc_profile, t.social_profile, t.sf_product,
               t.parent_organization, t.account_name
        FROM ({_PER_USER}) p LEFT JOIN fortable t ON p.email IS NOT DISTINCT FROM t.email""",
    "fortable",
)
def user_product_enriched(r):
    base = cut_lineage(_base(r))
    per_user = tables.user_product_table(base, *WINDOW)
    return tables.enrich(per_user, bases.reporting_table(base))


@query(
    "A6 K16",
    """SELECT email, sf_product AS product, count(*) AS total FROM base
       WHERE sf_last_login >= DATE '2024-01-28' AND sf_last_login < DATE '2024-01-31' GROUP BY email, sf_product
       UNION ALL SELECT email, mc_profile, count(*) FROM base GROUP BY email, mc_profile
       UNION ALL SELECT email, social_profile, count(*) FROM base GROUP BY email, social_profile""",
    "base",
)
def user_product_totals(r):
    return tables.user_product_table(_base(r), *WINDOW)


_WIDE_PRODUCTS = ["Desk", "ECONOMY", "Field", "LARGE", "MC", "MEDIUM", "Marketing", "PROMO", "Reports", "SMALL", "STANDARD", "Scheduling"]
_WIDE_SQL = ", ".join(f"""max(CASE WHEN product = '{p}' THEN product END) AS "{p}\"""" for p in _WIDE_PRODUCTS)
_USERS_WIDE = f"""
    SELECT DISTINCT coalesce(user_name, mc_name) AS name, user_key, created, profile_name, parent_organization,
           {", ".join(f'"{p}"' for p in _WIDE_PRODUCTS)}
    FROM (SELECT user_key, user_name, mc_name, created, profile_name, parent_organization, {_WIDE_SQL}
          FROM two_systems GROUP BY user_key, user_name, mc_name, created, profile_name, parent_organization)"""


@query(
    "K17 U4 P22 P7 F11",
    f"SELECT * REPLACE (CAST(created AS VARCHAR) AS created) FROM ({_USERS_WIDE})",
    "two_systems",
)
def product_users_wide(r):
    return _dates_as_text(layouts.product_users_wide(_two_systems(r), _WIDE_PRODUCTS))


@query(
    "K18 W4",
    """SELECT user_key, parent_organization, status
       FROM (SELECT o_custkey AS user_key, o_orderpriority AS parent_organization, o_orderstatus AS status,
                    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderstatus) AS place
             FROM (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders))
       WHERE place > 1""",
)
def duplicate_users(r):
    rows = r.table("orders").select(
        F.col("o_custkey").alias("user_key"),
        F.col("o_orderpriority").alias("parent_organization"),
        F.col("o_orderstatus").alias("status"),
    )
    return quality.duplicate_rows(rows.distinct(), ["user_key", "parent_organization"])


_PARENTS = ", ".join(
    f"max(CASE WHEN place = {i} THEN parent_organization END) AS parent_org_{i}" for i in range(1, 6)
)


@query(
    "K19 W2 U5 J6 O1",
    f"""SELECT user_key, name, {", ".join(f"parent_org_{i}" for i in range(1, 6))}
        FROM (SELECT o_custkey AS key, {_PARENTS.replace("parent_organization", "o_orderpriority")}
              FROM (SELECT o_custkey, o_orderpriority,
                           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS place
                    FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders))
              GROUP BY o_custkey)
        JOIN (SELECT c_custkey AS user_key, c_name AS name FROM customer) ON key = user_key""",
)
def parent_orgs_wide(r):
    names = r.users().select(F.col("id").alias("user_key"), "name")
    rows = r.user_organizations().distinct().join(names, "user_key")
    return layouts.with_parent_organizations(rows)


_TOTAL = "(SELECT count(*) FROM fortable)"


def _cell(n: str, heading: str) -> str:
    return f"format('{{:.1f}}%', round_even({n} * 100.0 / {_TOTAL}, 1)) || ' (' || {n} || ')' AS \"{heading}\""


@query(
    "K20 A17 F15",
    f"""SELECT mc_profile, {_cell("s", "Social")}, {_cell("n", "NA_")}
        FROM (SELECT coalesce(mc_profile, 'NA') AS mc_profile, count(social_profile) AS s,
                     count(*) - count(social_profile) AS n
              FROM fortable GROUP BY mc_profile
              UNION ALL
              SELECT 'Total', count(social_profile), count(*) - count(social_profile) FROM fortable)""",
    "fortable",
)
def system_crosstab_pct(r):
    return counts.crosstab_percent(_table(r), "mc_profile", "social_profile", ["Social"])


@query(
    "K21 W3 A16",
    """SELECT sf_product, email, n, round(n / sum(n) OVER (PARTITION BY sf_product), 6) AS share
       FROM (SELECT sf_product, email, count(DISTINCT sf_product) AS n FROM base WHERE sf_product IS NOT NULL
             GROUP BY sf_product, email)""",
    "base",
)
def product_share(r):
    return tables.product_share(_base(r)).withColumn("share", F.round("share", 6))


@query(
    "A16",
    """SELECT sf_product, count(*) AS n, round(count(*) / (SELECT count(*) FROM fortable), 6) AS share
       FROM fortable GROUP BY sf_product""",
    "fortable",
)
def product_frequency_share(r):
    return counts.frequency_share(_table(r), "sf_product").withColumn("share", F.round("share", 6))


_TEXT_COLUMNS = ["account_name", "email", "mc_profile", "net_id", "parent_organization", "sf_product", "social_profile"]
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct,
               count(*) - count({c}) AS n_null FROM base"""
    for c in _TEXT_COLUMNS
)


@query(
    "K22 A20 P5 N7",
    f"SELECT column_name, CAST(n_distinct AS BIGINT) AS n_distinct, n_null FROM ({_PROFILE_SQL})",
    "base",
)
def table_profile(r):
    base = _base(r)
    return quality.table_profile(keep_existing(base, [*_TEXT_COLUMNS, "sf_user_id", "sf_last_login"]))


@query(
    "K22 A19",
    " UNION ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM fortable" for c in bases.REPORT_COLUMNS),
    "fortable",
)
def distinct_values_per_column(r):
    return counts.distinct_values(_table(r))


@query(
    "K23 W1 W7",
    """SELECT permission_name, n, product, count(n) OVER (PARTITION BY product) AS occurrence,
              CAST(coalesce(sum(n) OVER (PARTITION BY product), 0) AS BIGINT) AS total,
              count(*) OVER (PARTITION BY product) AS group_size
       FROM mapping""",
    "mapping",
)
def mapping_stats(r):
    return tables.mapping_stats(r.mapping())


@query(
    "K24 A2 P15",
    """SELECT primary_department, sf_profile, count(*) AS n FROM base WHERE sf_product = 'PROMO'
       GROUP BY primary_department, sf_profile""",
    "base",
)
def dept_breakdown(r):
    return tables.department_breakdown(_base(r), "PROMO")


@query(
    "K25 A21 F2",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')",
)
def monthly_activity(r):
    monthly = counts.monthly_counts(r.table("orders"), "o_orderdate")
    return monthly.withColumn("month", F.date_format("month", "yyyy-MM"))


@query(
    "K2 P11 P16 P21 P22 U3 J3 J4",
    "SELECT * REPLACE (CAST(created AS VARCHAR) AS created) FROM entitled",
    "entitled",
)
def entitlement_base(r):
    return _dates_as_text(_entitled(r))


@query(
    "K2 K12 A13 P16",
    """SELECT product, count(*) AS n
       FROM (SELECT DISTINCT user_key, product FROM entitled WHERE account_name <> 'NATION_4') GROUP BY product""",
    "entitled",
)
def entitled_users_by_product(r):
    rows = _entitled(r)
    return counts.distinct_users(rows.where(F.col("account_name") != "NATION_4"), "user_key", ["product"])


@query(
    "A10 A11 N6",
    """SELECT count(DISTINCT CASE WHEN mc_profile = 'MC' THEN email END) AS mc_users,
              count(DISTINCT CASE WHEN social_profile = 'Social' THEN email END) AS social_users,
              count(DISTINCT CASE WHEN mc_profile = 'MC' THEN email END)
              + max(CASE WHEN mc_profile IS NULL OR email IS NULL THEN 1 ELSE 0 END) AS mc_users_with_null
       FROM base""",
    "base",
)
def count_distinct_cond(r):
    mc, social = F.col("mc_profile") == "MC", F.col("social_profile") == "Social"
    return _base(r).agg(
        n_distinct_when(mc, F.col("email")).alias("mc_users"),
        n_distinct_when(social, F.col("email")).alias("social_users"),
        n_distinct_when(mc, F.col("email"), count_null=True).cast("long").alias("mc_users_with_null"),
    )


@query(
    "A15 P12",
    """SELECT sf_product, count(*) AS freq
       FROM (SELECT DISTINCT email, sf_product FROM base WHERE sf_product IS NOT NULL) GROUP BY sf_product""",
    "base",
)
def non_null_users(r):
    return counts.distinct_users(_base(r), "email", ["sf_product"], name="freq", drop_null_keys=True)


@query(
    "K12 P13 P14",
    """SELECT mc_profile, social_profile, num_na, count(*) AS n
       FROM (SELECT mc_profile, social_profile,
                    (mc_profile IS NULL)::INT + (social_profile IS NULL)::INT + (sf_product IS NULL)::INT AS num_na
             FROM fortable)
       WHERE num_na < 3 GROUP BY mc_profile, social_profile, num_na""",
    "fortable",
)
def null_count_filter(r):
    kept = with_fewer_nulls(_table(r), bases.PRODUCTS, limit=3).where(any_present(*bases.PRODUCTS))
    return counts.group_count(kept, "mc_profile", "social_profile", "num_na")


@query(
    "K1 P9 J1",
    """SELECT sf_profile, sf_product, count(DISTINCT sf_user_id) AS users FROM (
         SELECT u.id AS sf_user_id, u.profile_name AS sf_profile, m.product AS sf_product
         FROM users u JOIN assignments a ON a.assignee_id = u.id
              JOIN mapping m ON m.permission_name = a.permission_name
         WHERE CAST(u.last_login_ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'
           AND u.profile_name IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))
       GROUP BY sf_profile, sf_product""",
    "users assignments mapping",
)
def last_login_users_by_product(r):
    users = bases.base_users(bases.users_with_last_login(r.users(), PERIOD), SETTINGS)
    users = users.select(F.col("id").alias("sf_user_id"), F.col("profile_name").alias("sf_profile"))
    products = bases.user_products(users, r.assignments(), r.mapping())
    products = products.withColumn("sf_product", F.explode("sf_products"))
    return counts.distinct_per_group(products, ["sf_profile", "sf_product"], "sf_user_id", name="users")


@query(
    "K1 J6 K12",
    """SELECT mc_profile, social_profile, sf_product, count(*) AS n
       FROM (SELECT DISTINCT email, mc_profile, social_profile, sf_product FROM email_base)
       GROUP BY mc_profile, social_profile, sf_product""",
    "email_base",
)
def users_by_email_key(r):
    extracts = replace(r.extracts(), marketing=r.report("click", key="email"))
    base = bases.activity_base_by_email(extracts, PERIOD, SETTINGS)
    return counts.distinct_users(base, "email", bases.PRODUCTS)


@query(
    "K12 A13 P17",
    """SELECT sf_product, count(*) AS user_days
       FROM (SELECT DISTINCT contact_id, sf_product, sf_last_login FROM base
             WHERE sf_last_login >= DATE '2024-01-28' AND sf_last_login < DATE '2024-01-31')
       GROUP BY sf_product""",
    "base",
)
def user_days_in_window(r):
    recent = in_days(_base(r), "sf_last_login", *WINDOW)
    return counts.distinct_users(recent, ["contact_id", "sf_last_login"], ["sf_product"], name="user_days")


@query(
    "K12 A13",
    """SELECT parent_organization, count(*) AS n
       FROM (SELECT DISTINCT user_key, profile_name, parent_organization FROM two_systems) GROUP BY parent_organization""",
    "two_systems",
)
def entitled_profiles_by_unit(r):
    return counts.distinct_users(_two_systems(r), ["user_key", "profile_name"], ["parent_organization"])


@query(
    "K12 A13 A10",
    "SELECT profile_name, count(*) AS n FROM (SELECT DISTINCT user_key, profile_name FROM entitled) GROUP BY profile_name",
    "entitled",
)
def entitled_users_by_profile(r):
    return counts.distinct_users(_entitled(r), "user_key", ["profile_name"])


@query(
    "K11 F2 F4 F5",
    """SELECT user_id, strftime(strptime(last_login, '%m/%d/%Y %H:%M'), '%Y-%m') AS login_month,
              strftime(strptime(created_date, '%m/%d/%Y %H:%M'), '%Y-%m') AS created_month
       FROM licensed""",
    "licensed",
)
def month_floors_from_text(r):
    floors = {
        name: month_start(dates.parse_mdy_hm(F.col(text)))
        for name, text in (("login_month", "last_login"), ("created_month", "created_date"))
    }
    return r.licensed().select("user_id", *[F.date_format(c, "yyyy-MM").alias(n) for n, c in floors.items()])


@query(
    "K9 A7 F5",
    """SELECT unit, CAST(month(first) AS BIGINT) AS first_month, CAST(year(first) AS BIGINT) AS first_year
       FROM (SELECT profile AS unit, min(strptime(created_date, '%m/%d/%Y %H:%M')) AS first FROM licensed GROUP BY profile)
       WHERE first IS NOT NULL""",
    "licensed",
)
def first_month_from_text(r):
    created = dates.parse_mdy_hm(F.col("created_date")).cast("date")
    base = r.licensed().select(F.col("profile").alias("parent_organization"), created.alias("sf_created"))
    first = tables.unit_first_month(base)
    return first.withColumns({c: F.col(c).cast("long") for c in ("first_month", "first_year")})
