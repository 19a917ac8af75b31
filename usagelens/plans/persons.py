"""The person tables of a run, frozen bucketed and sorted by person key, so that the chain of joins over them shuffles nothing.

The key is never null: it is empty for rows without person id, and the id behind an equals sign
for the others, so null ids meet each other by plain equality where the reports want that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.period import Period
from usagelens.plans import base as bases
from usagelens.settings import KpiSettings
from usagelens.sources.bucketed import write_bucketed

KEY = "person_key"


@dataclass(frozen=True)
class PersonTables:
    """``users`` with their products (a row per user), ``reports`` (a row per key) and ``contacts``, all bucketed by ``KEY``."""

    users: DataFrame
    reports: DataFrame
    contacts: DataFrame


def person_key(net_id: str = "net_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(net_id)), F.lit(""))


def freeze_persons(extracts: bases.Extracts, period: Period, settings: KpiSettings, buckets: int | None = None) -> PersonTables:
    """Write the three person tables of a month. Each is dealt by key once, here; every later run over them joins in place."""
    users = bases.base_users(bases.users_with_login(extracts.users, extracts.login_history, period), settings)
    tables = {
        "users": bases.product_users_of(users, extracts, settings),
        "reports": bases.report_logins(extracts.marketing, extracts.social, period),
        "contacts": bases.contact_columns(extracts.contacts).where(F.col("net_id").isNotNull()),
    }
    buckets = buckets or int(extracts.users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = {name: table.withColumn(KEY, person_key()).repartition(buckets, KEY) for name, table in tables.items()}
    return PersonTables(**{name: write_bucketed(table, [KEY], buckets, name=f"person_{name}") for name, table in keyed.items()})


def bucketed_chain(persons: PersonTables) -> DataFrame:
    """The rows of ``bases.person_chain``, by joins of buckets: users and reports in full, then contacts by id."""
    reports = persons.reports.withColumnRenamed("net_id", "__report_id")
    matched = persons.users.join(reports, KEY, "left").drop("__report_id")
    alone = persons.reports.join(persons.users.select(KEY), KEY, "left_anti")
    known = persons.contacts.drop("net_id")
    # Joined before they are united: a union has no buckets. Contacts all have an id, so an empty key meets none.
    parts = [part.join(known, KEY, "left") for part in (matched, alone)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).drop(KEY)


def activity_base(persons: PersonTables, extracts: bases.Extracts, settings: KpiSettings) -> DataFrame:
    """The login-based base table from frozen person tables; rows and columns as ``bases.activity_base`` gives them."""
    chain = bucketed_chain(persons)
    return bases.with_units(chain, extracts, settings)
