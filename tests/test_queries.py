"""Every registered query against its SQL on the driver tables."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import differences
from checks.registry import QUERIES

QUERY_NAMES = sorted(QUERIES)


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_query_equals_sql(spark, folder, oracle, name):
    df = entry.queries()[name](spark, folder)
    assert differences(df, oracle, entry.oracle_sql()[name]) == []


def test_the_comparison_notices_differences(spark, folder, oracle):
    df = entry.queries()["user_counts_by_product"](spark, folder)
    sql = entry.oracle_sql()["user_counts_by_product"]
    assert differences(df, oracle, f"SELECT product, total_users + 1 AS total_users, distinct_users FROM ({sql})")
    assert differences(df, oracle, f"SELECT product, total_users FROM ({sql})")
    assert differences(df, oracle, f"SELECT product, CAST(total_users AS INTEGER) AS total_users, distinct_users FROM ({sql})")


def test_flagship(spark):
    assert entry.entry(spark).columns == ["product", "unit", "total_users", "distinct_users"]


def test_every_inventory_row_is_covered():
    covered = {row for q in QUERIES.values() for row in q.covers}
    wanted = {f"{letter}{i}" for letter, last in
              {"S": 10, "P": 23, "J": 12, "A": 21, "W": 10, "O": 2, "U": 7, "F": 19, "K": 25}.items() for i in range(1, last + 1)}
    assert wanted - covered == set()


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_plans_have_no_cross_join_and_no_python(spark, folder, name):
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEvalPython|MapInPandas", plan)
    assert found == []
