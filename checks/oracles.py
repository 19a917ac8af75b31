"""The role views and every registered query as SQL over the driver tables.

The SQL follows the definition step by step (full outer chain, windows, plain distinct counts),
not the Spark plan, so that the two check each other.
"""

from __future__ import annotations

VIEWS = {
    "users": """
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 10 <> 0 THEN 'u' || c_custkey END AS net_id,
               CASE WHEN c_custkey % 10 = 0 THEN NULL
                    WHEN c_custkey % 11 = 0 THEN 'u' || c_custkey
                    ELSE 'u' || c_custkey || '@example.com' END AS email,
               c_name AS name, c_mktsegment AS profile_name, n_name || ' team' AS role_name,
               c_acctbal > 0 AS is_active,
               (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS created_ts,
               (SELECT max(ts) FROM events WHERE user_id = c_custkey) AS last_login_ts
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "contacts": """
        SELECT c_custkey * 10 + 1 AS id, c_custkey AS user_id,
               CASE WHEN c_custkey % 17 <> 0 THEN if(c_custkey % 10 <> 0, 'u', 'c') || c_custkey END AS net_id,
               CASE WHEN c_custkey % 13 <> 0 THEN if(c_custkey % 10 <> 0, 'u', 'c') || c_custkey || '@example.com' END AS email,
               'Dept ' || (c_custkey % 12) AS primary_department,
               CASE WHEN c_custkey % 4 = 0 THEN 'staff' WHEN c_custkey % 4 = 1 THEN 'student' END AS primary_type
        FROM customer""",
    "login_history": "SELECT user_id, ts AS login_ts, event_type AS login_type FROM events",
    "seen": """
        SELECT event_type, user_id,
               CASE WHEN user_id % 25 <> 0 THEN 'u' || user_id END AS net_id,
               CASE WHEN user_id % 3 = 0 THEN CAST(CAST(ts AS DATE) - INTERVAL 1 MONTH AS DATE)
                    ELSE CAST(ts AS DATE) END AS day
        FROM events""",
    "marketing": """
        SELECT net_id, strftime(max(day), '%-m/%-d/%Y') AS max_timestamp
        FROM seen WHERE event_type = 'click' GROUP BY net_id""",
    "social": """
        SELECT net_id, strftime(max(day), '%-m/%-d/%Y') AS max_timestamp
        FROM seen WHERE event_type = 'signup' GROUP BY net_id""",
    "marketing_accounts": """
        SELECT DISTINCT CASE WHEN user_id % 9 = 0 THEN if(user_id % 2 = 0, 'u', 'v') || user_id
                             ELSE if(user_id % 2 = 0, 'u', 'v') || user_id || '@mail.example.com' END AS email,
               'Account ' || user_id AS name
        FROM events WHERE event_type = 'click'""",
    "assignments": """
        SELECT o_custkey AS assignee_id, l_partkey AS permission_name
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "mapping": """
        SELECT if(p_size <= 25, p_partkey, -p_partkey) AS permission_name, CASE WHEN p_size % 9 <> 0 THEN CAST(p_size AS BIGINT) END AS n,
               p_type AS product
        FROM part""",
    "affiliations": """
        SELECT c_custkey * 10 + 1 AS contact_id, c_custkey % 7 <> 0 AS is_primary, n_name AS account_name,
               r_name AS parent_organization
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
                      LEFT JOIN region ON n_regionkey = r_regionkey""",
    "units": """
        SELECT DISTINCT contact_id, parent_organization, account_name FROM affiliations WHERE is_primary""",
    "licensed": """
        SELECT if(c_custkey % 3 = 0, 'u', 'l') || c_custkey || '@example.com' AS username,
               if(c_custkey % 3 = 0, c_custkey, -c_custkey) AS user_id, c_mktsegment AS profile,
               strftime(max(o_orderdate), '%-m/%-d/%Y %-H:%M') AS last_login,
               strftime(min(o_orderdate), '%-m/%-d/%Y %-H:%M') AS created_date
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey
        GROUP BY c_custkey, c_mktsegment""",
    "mc": """
        SELECT net_id, 'MC' AS mc_profile, CAST(strptime(max_timestamp, '%m/%d/%Y') AS DATE) AS mc_last_login
        FROM marketing
        WHERE month(strptime(max_timestamp, '%m/%d/%Y')) = 1 AND year(strptime(max_timestamp, '%m/%d/%Y')) = 2024""",
    "so": """
        SELECT net_id, 'Social' AS social_profile, CAST(strptime(max_timestamp, '%m/%d/%Y') AS DATE) AS social_last_login
        FROM social
        WHERE month(strptime(max_timestamp, '%m/%d/%Y')) = 1 AND year(strptime(max_timestamp, '%m/%d/%Y')) = 2024""",
    "active_users": """
        SELECT DISTINCT u.id, u.email,
               CASE u.net_id WHEN 'u33' THEN 'u34' WHEN 'u52' THEN 'u53' ELSE u.net_id END AS net_id,
               u.profile_name, CAST(u.created_ts AS DATE) AS sf_created, CAST(u.last_login_ts AS DATE) AS sf_last_login
        FROM users u JOIN login_history l ON l.user_id = u.id
        WHERE month(l.login_ts) = 1 AND year(l.login_ts) = 2024
          AND u.profile_name IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""",
    "upp": """
        SELECT DISTINCT u.id AS sf_user_id, u.net_id, u.profile_name AS sf_profile, u.sf_created, u.sf_last_login,
               m.product AS sf_product
        FROM active_users u JOIN assignments a ON a.assignee_id = u.id
             LEFT JOIN mapping m ON m.permission_name = a.permission_name
        WHERE u.profile_name <> 'AUTOMOBILE' AND m.product IS NOT NULL""",
    "person": """
        SELECT coalesce(cm.net_id, s.net_id) AS net_id, contact_id, email, primary_department,
               mc_profile, mc_last_login, social_profile, social_last_login
        FROM (SELECT coalesce(c.net_id, m.net_id) AS net_id, c.id AS contact_id, c.email, c.primary_department,
                     m.mc_profile, m.mc_last_login
              FROM (SELECT * FROM contacts WHERE net_id IS NOT NULL) c
                   FULL JOIN mc m ON c.net_id IS NOT DISTINCT FROM m.net_id) cm
             FULL JOIN so s ON cm.net_id IS NOT DISTINCT FROM s.net_id""",
    "person_products": """
        SELECT coalesce(p.net_id, u.net_id) AS net_id, p.contact_id, p.email, p.primary_department, p.mc_profile,
               p.mc_last_login, p.social_profile, p.social_last_login, u.sf_user_id, u.sf_profile, u.sf_created,
               u.sf_last_login, u.sf_product
        FROM person p FULL JOIN upp u ON p.net_id IS NOT DISTINCT FROM u.net_id""",
    "base": """
        SELECT DISTINCT p.*, d.parent_organization, d.account_name
        FROM person_products p LEFT JOIN units d ON p.contact_id IS NOT DISTINCT FROM d.contact_id
        WHERE (p.sf_last_login IS NOT NULL OR p.social_last_login IS NOT NULL OR p.mc_last_login IS NOT NULL)
          AND (p.net_id IS NULL OR p.net_id NOT IN ('u7', 'u21'))""",
    "fortable": """
        SELECT DISTINCT email, primary_department, mc_profile, social_profile, sf_product, parent_organization,
               account_name
        FROM base""",
    "used": """
        SELECT 1 AS src, sf_product AS product, parent_organization AS unit, email FROM fortable WHERE sf_product IS NOT NULL
        UNION ALL
        SELECT 2, mc_profile, parent_organization, email FROM fortable WHERE mc_profile IS NOT NULL
        UNION ALL
        SELECT 3, social_profile, parent_organization, email FROM fortable WHERE social_profile IS NOT NULL""",
    "cells": """
        SELECT src, product, unit, count(*) AS freq, count(DISTINCT email) AS emails
        FROM used WHERE unit IS NOT NULL GROUP BY src, product, unit""",
    "email_mc": """
        SELECT CASE WHEN net_id IS NOT NULL THEN net_id || '@example.com' END AS email, 'MC' AS mc_profile,
               mc_last_login
        FROM mc""",
    "email_base": """
        SELECT coalesce(p.net_id, a.net_id) AS net_id, p.email, p.mc_profile, p.mc_last_login, a.social_profile,
               a.social_last_login, a.sf_product, a.sf_last_login
        FROM (SELECT c.net_id, coalesce(c.email, m.email) AS email, m.mc_profile, m.mc_last_login
              FROM (SELECT * FROM contacts WHERE net_id IS NOT NULL) c
                   FULL JOIN email_mc m ON c.email IS NOT DISTINCT FROM m.email) p
             FULL JOIN (SELECT coalesce(s.net_id, u.net_id) AS net_id, s.social_profile, s.social_last_login,
                               u.sf_product, u.sf_last_login
                        FROM so s FULL JOIN upp u ON s.net_id IS NOT DISTINCT FROM u.net_id) a
             ON p.net_id = a.net_id
        WHERE (p.mc_last_login IS NOT NULL OR a.social_last_login IS NOT NULL OR a.sf_last_login IS NOT NULL)
          AND (coalesce(p.net_id, a.net_id) IS NULL OR coalesce(p.net_id, a.net_id) NOT IN ('u7', 'u21'))""",
    "upp_all": """
        SELECT DISTINCT u.id AS sf_user_id, u.net_id, u.name AS user_name, u.role_name, u.profile_name,
               CAST(u.created_ts AS DATE) AS created, a.permission_name,
               CASE WHEN m.product IS NOT NULL THEN m.product
                    WHEN u.role_name = 'NATION_3 team' THEN 'Reports'
                    WHEN u.role_name = 'NATION_5 team' OR u.role_name = 'NATION_8 team' THEN 'Field'
                    WHEN u.profile_name = 'BUILDING' THEN 'Scheduling'
                    WHEN u.profile_name = 'MACHINERY' THEN 'Desk'
                    WHEN u.role_name = 'NATION_9 team' THEN 'Marketing' END AS product
        FROM users u JOIN assignments a ON a.assignee_id = u.id
             LEFT JOIN mapping m ON m.permission_name = a.permission_name""",
    "all_person": """
        SELECT coalesce(cm.net_id, s.net_id) AS net_id, contact_id, mc_profile, social_profile
        FROM (SELECT coalesce(c.net_id, m.net_id) AS net_id, c.id AS contact_id, m.mc_profile
              FROM (SELECT * FROM contacts WHERE net_id IS NOT NULL) c
                   FULL JOIN (SELECT net_id, 'MC' AS mc_profile FROM marketing) m
                   ON c.net_id IS NOT DISTINCT FROM m.net_id) cm
             FULL JOIN (SELECT net_id, 'Social' AS social_profile FROM social) s
             ON cm.net_id IS NOT DISTINCT FROM s.net_id""",
    "entitled_chain": """
        SELECT coalesce(p.net_id, u.net_id) AS net_id, p.contact_id, p.mc_profile, p.social_profile,
               u.sf_user_id, u.user_name, u.role_name, u.profile_name, u.created, u.permission_name, u.product
        FROM all_person p FULL JOIN upp_all u ON p.net_id IS NOT DISTINCT FROM u.net_id""",
    "entitled_long": """
        SELECT DISTINCT net_id, contact_id, user_name, role_name, profile_name, created, permission_name, used AS product
        FROM (SELECT *, product AS used FROM entitled_chain UNION ALL
              SELECT *, mc_profile FROM entitled_chain UNION ALL
              SELECT *, social_profile FROM entitled_chain)
        WHERE used IS NOT NULL""",
    "entitled": """
        SELECT DISTINCT coalesce(e.net_id, e.user_name) AS user_key, e.net_id, e.user_name, e.role_name,
               e.profile_name, e.product, e.permission_name, e.created, d.parent_organization, d.account_name
        FROM entitled_long e LEFT JOIN units d ON e.contact_id IS NOT DISTINCT FROM d.contact_id
        WHERE (e.profile_name IS NULL OR e.profile_name NOT IN ('FURNITURE', 'AUTOMOBILE'))
          AND coalesce(e.net_id, e.user_name) <> 'u13'""",
    "accounts": """
        SELECT DISTINCT CASE WHEN strpos(email, '@') > 0 THEN split_part(email, '@', 1) END AS net_id,
               CASE WHEN strpos(email, '@') > 0 THEN name END AS mc_name, 'MC' AS mc_profile
        FROM marketing_accounts""",
    "two_chain": """
        SELECT coalesce(p.net_id, u.net_id) AS net_id, p.contact_id, p.mc_name, p.mc_profile, u.sf_user_id,
               u.user_name, u.role_name, u.profile_name, u.created, u.permission_name, u.product
        FROM (SELECT coalesce(c.net_id, m.net_id) AS net_id, c.id AS contact_id, m.mc_name, m.mc_profile
              FROM (SELECT * FROM contacts WHERE net_id IS NOT NULL) c
                   FULL JOIN accounts m ON c.net_id IS NOT DISTINCT FROM m.net_id) p
             FULL JOIN upp_all u ON p.net_id IS NOT DISTINCT FROM u.net_id""",
    "two_long": """
        SELECT DISTINCT net_id, contact_id, sf_user_id, mc_name, user_name, role_name, profile_name, created,
               permission_name, used AS product
        FROM (SELECT *, product AS used FROM two_chain UNION ALL SELECT *, mc_profile FROM two_chain)
        WHERE used IS NOT NULL""",
    "two_systems": """
        SELECT DISTINCT coalesce(e.net_id, CAST(e.sf_user_id AS VARCHAR)) AS user_key, e.net_id, e.sf_user_id,
               e.mc_name, e.user_name, e.role_name, e.profile_name, e.product, e.permission_name, e.created,
               d.parent_organization, d.account_name
        FROM two_long e LEFT JOIN units d ON e.contact_id IS NOT DISTINCT FROM d.contact_id
        WHERE (e.profile_name IS NULL OR e.profile_name NOT IN ('FURNITURE', 'AUTOMOBILE'))
          AND coalesce(e.net_id, CAST(e.sf_user_id AS VARCHAR)) <> 'u13'""",
    "first_logins": """
        SELECT u.email, u.created_ts, u.profile_name, u.role_name,
               CAST(date_diff('day', CAST(u.created_ts AS DATE), CAST(min(l.login_ts) AS DATE)) AS DOUBLE) AS days,
               CAST(month(u.created_ts) AS BIGINT) AS create_month, CAST(year(u.created_ts) AS BIGINT) AS create_year,
               split_part(u.role_name, ' ', 1) AS unit_token
        FROM users u LEFT JOIN login_history l ON l.user_id = u.id
        WHERE u.created_ts >= DATE '1995-02-01'
        GROUP BY u.email, u.created_ts, u.profile_name, u.role_name""",
}

# Which earlier views each view reads.
USES = {
    "marketing": ["seen"], "social": ["seen"],
    "units": ["affiliations"],
    "mc": ["marketing"], "so": ["social"],
    "active_users": ["users", "login_history"],
    "upp": ["active_users", "assignments", "mapping"],
    "person": ["contacts", "mc", "so"],
    "person_products": ["person", "upp"],
    "base": ["person_products", "units"],
    "fortable": ["base"], "used": ["fortable"], "cells": ["used"],
    "email_mc": ["mc"],
    "email_base": ["contacts", "email_mc", "so", "upp"],
    "upp_all": ["users", "assignments", "mapping"],
    "all_person": ["contacts", "marketing", "social"],
    "entitled_chain": ["all_person", "upp_all"],
    "entitled_long": ["entitled_chain"],
    "entitled": ["entitled_long", "units"],
    "accounts": ["marketing_accounts"],
    "two_chain": ["contacts", "accounts", "upp_all"],
    "two_long": ["two_chain"], "two_systems": ["two_long", "units"],
    "first_logins": ["users", "login_history"],
}


def with_views(body: str, *views: str) -> str:
    """``body`` preceded by the views it needs, each after those it reads."""
    needed: list[str] = []

    def need(view: str) -> None:
        for used in USES.get(view, []):
            need(used)
        if view not in needed:
            needed.append(view)

    for view in views:
        need(view)
    if not needed:
        return body.strip()
    parts = ",\n".join(f"{view} AS ({VIEWS[view].strip()})" for view in needed)
    return f"WITH {parts}\n{body.strip()}"
