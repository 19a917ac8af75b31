import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from usagelens.operators import windows


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    data = [(draw.choice(["hot"] * 6 + [None, "a", "b", "c"]), draw.randrange(5), i % 40) for i in range(400)]
    return spark.createDataFrame(data, "g string, x int, id int")


def test_group_stats_equal_window(table, rows):
    got = windows.with_group_stats(table, ["g"], total=F.sum("x"), n=F.count(F.lit(1)))
    place = Window.partitionBy("g")
    want = table.withColumns({"total": F.sum("x").over(place), "n": F.count(F.lit(1)).over(place)})
    assert rows(got, "g", "x", "id", "total", "n") == rows(want)


def test_numbering_by_slices_equals_window(table, rows):
    data = table.distinct()
    got = windows.number_rows(data, ["g"], ["x", "id"], slice_by=F.col("x"))
    want = data.withColumn("ordinal", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")))
    assert rows(got, "g", "x", "id", "ordinal") == rows(want)


def test_numbering_in_order_equals_window(table, rows):
    data = table.distinct()
    got = windows.number_in_order(data, ["g"], ["x", F.col("id").desc()], unique_order=True)
    want = data.withColumn("ordinal", F.row_number().over(Window.partitionBy("g").orderBy("x", F.col("id").desc())))
    assert rows(got, "g", "x", "id", "ordinal") == rows(want)


def test_one_group_of_ties_is_numbered_by_many_ranges(spark):
    data = spark.range(0, 20_000, 1, 8).select(F.lit(None).cast("string").alias("g"), F.lit(1).alias("x"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = windows.number_in_order(data, ["g"], ["x"])
        assert got.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first() == (20_000, 1, 20_000)
        dealt = data.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("g", "x", "tie")
        largest = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest < 6_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_numbering_without_keys_and_of_no_rows(spark, table):
    assert [r["ordinal"] for r in windows.number_in_order(table, [], ["id"]).orderBy("ordinal").collect()] == list(range(1, 401))
    assert windows.number_in_order(table.limit(0), ["g"], ["id"]).count() == 0


def test_first_and_repeats_are_the_whole_table(table, rows):
    first = windows.first_per_key(table, ["g", "x"], ["id"])
    again = windows.repeats(table, ["g", "x"], ["id"])
    assert first.count() == table.select("g", "x").distinct().count()
    assert rows(first.unionByName(again)) == rows(table)


def test_identical_rows_repeat_once_less(spark):
    copies = spark.createDataFrame([("k", 1)] * 7, "k string, v int")
    assert windows.repeats(copies, ["k"], ["v"]).count() == 6


def test_lowest_keeps_ties(spark, rows):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 5, 4)], "g string, x int, id int")
    assert rows(windows.lowest_per_group(df, ["g"], F.col("x"), 1), "id") == [(1,), (2,), (4,)]


def test_samples(table):
    data = table.distinct()
    drawn = windows.sample_rows(data, ["g"], 3, seed=1)
    assert {r["count"] for r in drawn.groupBy("g").count().collect()} == {3}
    assert sorted(map(str, drawn.collect())) == sorted(map(str, windows.sample_rows(data.repartition(5), ["g"], 3, seed=1).collect()))
    groups = windows.sample_groups(data, ["g"], 2, seed=1)
    assert groups.select("g").distinct().count() == 2
    for row in groups.groupBy("g").count().collect():
        assert row["count"] == data.where(F.col("g").eqNullSafe(row["g"])).count()


def test_nulls_sort_last(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",)], "k string")
    assert [r[0] for r in windows.sorted_head(df, ["k"]).collect()] == ["a", "b", None]
    assert windows.sorted_head(df, ["k"], 2).count() == 2


def test_groups_are_trimmed_before_the_shuffle(table):
    for df in (
        windows.first_per_key(table, ["g"], ["id"]),
        windows.lowest_per_group(table, ["g"], F.col("x"), 1),
        windows.sample_rows(table, ["g"], 5),
    ):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
