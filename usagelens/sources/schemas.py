"""Declared columns of every source table, and the headers they may arrive under."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _B, _L = T.StringType(), T.TimestampType(), T.BooleanType(), T.LongType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS = {
    "contacts": _table(
        id=_S, emplid=_S, email=_S, user_id=_S, primary_department=_S, net_id=_S,
        primary_organization=_S, primary_type=_S,
    ),
    "users": _table(
        id=_S, email=_S, user_type=_S, name=_S, net_id=_S, profile_name=_S, contact_id=_S,
        created_ts=_TS, department=_S, profile_id=_S, user_role_id=_S, role_name=_S, title=_S,
        username=_S, last_login_ts=_TS, is_active=_B,
    ),
    "login_history": _table(
        user_id=_S, browser=_S, login_ts=_TS, login_type=_S, platform=_S, status=_S,
    ),
    "affiliations": _table(
        contact_id=_S, academic_department=_S, affiliation_type=_S, is_primary=_B,
        account_name=_S, parent_organization=_S,
    ),
    "permission_assignments": _table(
        assignee_id=_S, permission_name=_S, permission_type=_S, permission_profile_id=_S,
        permission_group_id=_S,
    ),
    "perm_to_product": _table(permission_name=_S, n=_L, product=_S),
    "marketing_logins": _table(net_id=_S, max_timestamp=_S),
    "marketing_accounts": _table(email=_S, id=_S, name=_S, created_date=_S),
    "social_logins": _table(net_id=_S, max_timestamp=_S),
    "licensed_users": _table(
        username=_S, user_id=_S, profile=_S, last_login=_S, created_date=_S,
    ),
}

# CRM field names after normalising, with the column each one fills.
ALIASES = {
    "contacts": {
        "emplid_c": "emplid",
        "user_c": "user_id",
        "primary_department_r_name": "primary_department",
        "net_id_c": "net_id",
        "hed_primary_organization_c": "primary_organization",
        "mdm_primary_type_c": "primary_type",
    },
    "users": {
        "net_id_c": "net_id",
        "created_date": "created_ts",
        "user_role_name": "role_name",
        "last_login_date": "last_login_ts",
    },
    "login_history": {"login_time": "login_ts"},
    "affiliations": {
        "academic_department_c": "academic_department",
        "hed_affiliation_type_c": "affiliation_type",
        "hed_contact_c": "contact_id",
        "hed_primary_c": "is_primary",
        "hed_account_r_name": "account_name",
        "parent_organization_c": "parent_organization",
    },
    "permission_assignments": {
        "permission_set_name": "permission_name",
        "permission_set_type": "permission_type",
        "permission_set_profile_id": "permission_profile_id",
        "permission_set_group_id": "permission_group_id",
    },
    "perm_to_product": {"permission_set_name": "permission_name"},
    "marketing_logins": {
        "net_id_c": "net_id",
        "netid": "net_id",
        "user": "net_id",
        "last_login": "max_timestamp",
        "lastlogindatetime": "max_timestamp",
    },
    "social_logins": {
        "net_id_c": "net_id",
        "netid": "net_id",
        "user": "net_id",
        "last_login": "max_timestamp",
        "lastlogindatetime": "max_timestamp",
    },
}

#: What a finished set of snapshots is known by: a row per table, written when all tables are.
MANIFEST = "period string, written long, name string, path string"
MANIFEST_FOLDER = "_sets"
