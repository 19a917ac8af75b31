"""Days from account creation to first login."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.dates import days_between
from usagelens.functions.text import first_token
from usagelens.operators.filters import since
from usagelens.operators.joins import keyed_join

ACCOUNT = ["email", "created_ts", "profile_name", "role_name"]


def first_logins(users: DataFrame, login_history: DataFrame, created_since: dt.date) -> DataFrame:
    """First login per account. The history shrinks to one row per user before the join.

    Accounts that never logged in have no days; they do not weigh on a mean.
    """
    first = login_history.groupBy(F.col("user_id").alias("id")).agg(F.min("login_ts").alias("first_login"))
    recent = since(users, "created_ts", created_since).select("id", *ACCOUNT)
    accounts = (
        keyed_join(recent, first, "id", "left", null_match=False)
        .groupBy(*ACCOUNT)
        .agg(F.min("first_login").alias("first_login"))
    )
    return accounts.withColumns({
        "days": days_between(F.col("first_login"), F.col("created_ts")),
        "create_month": F.month("created_ts"),
        "create_year": F.year("created_ts"),
        "unit_token": first_token(F.col("role_name")),
    })


def mean_days(accounts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean days per creation month, also by ``profile_name`` or ``unit_token``."""
    return accounts.groupBy(*keys, "create_month", "create_year").agg(F.avg("days").alias("avg_days"))
