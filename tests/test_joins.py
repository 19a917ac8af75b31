import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import joins



@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(5)
    keys = ["hot"] * 40 + [None] * 25 + ["only_left"] * 12 + list("abcdefgh")
    left = [(draw.choice(keys), i) for i in range(300)] + [("only_left", -1), (None, -2)]
    keys = ["hot"] * 4 + [None] * 30 + ["big_right"] * 40 + list("efghijkl")
    right = [(draw.choice(keys), i) for i in range(150)] + [("big_right", -1)]
    return (
        spark.createDataFrame(left, "k string, v int"),
        spark.createDataFrame(right, "key string, w int"),
    )


def test_null_keys_pair_or_stay_apart(spark, rows):
    left = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20), ("z", 30)], "k string, w int")
    assert joins.keyed_join(left, right, "k", "full").count() == 4
    assert joins.keyed_join(left, right, "k", "full", null_match=False).count() == 5
    assert rows(joins.keyed_join(left, right, "k", "right"), "k", "v", "w") == [
        ("a", 1, 10), ("z", None, 30), (None, 2, 20), (None, 3, 20),
    ]


@pytest.mark.parametrize("null_match", [True, False])
def test_full_join_on_a_unique_right_side_equals_the_plain_one(sides, rows, null_match):
    left, right = sides
    right = right.groupBy("key").agg(F.max("w").alias("w"))
    plain = joins.keyed_join(left, right, [("k", "key")], "full", null_match)
    other = joins.keyed_join(left, right, [("k", "key")], "full", null_match, right_unique=True)
    assert other.columns == plain.columns
    assert rows(other) == rows(plain)
    assert "FullOuter" not in other._jdf.queryExecution().optimizedPlan().toString()



def test_composite_keys_match_null_with_null(spark, rows):
    left = spark.createDataFrame([("a", None, 1), ("a", "b", 2)], "x string, y string, v int")
    right = spark.createDataFrame([("a", None, 7)], "x string, y string, w int")
    assert rows(joins.keyed_join(left, right, ["x", "y"], "left"), "v", "w") == [(1, 7), (2, None)]


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="v"):
        joins.keyed_join(df, df, "k")


def test_repeated_mapping_rows_add_nothing(spark, rows):
    granted = spark.createDataFrame([(1, "p"), (2, "q")], "u int, perm string")
    mapping = spark.createDataFrame([("p", "X"), ("p", "X")], "perm string, product string")
    assert rows(joins.lookup(granted, mapping, "perm", ["product"]), "u", "product") == [(1, "X"), (2, None)]


def test_unmatched_keeps_null_keys(spark, rows):
    report = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    contacts = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows(joins.unmatched(report, contacts, "k"), "v") == [(2,), (3,)]
    with_null = contacts.unionByName(spark.createDataFrame([(None,)], "k string"))
    assert rows(joins.unmatched(report, with_null, "k"), "v") == [(2,)]


def test_value_grid(spark):
    df = spark.createDataFrame([("g",), ("h",)], "g string")
    grid = joins.value_grid(df, mean=[1, 2, 3], sd=[1, 2])
    assert grid.distinct().count() == 12
    assert "CartesianProduct" not in grid._jdf.queryExecution().toString()
