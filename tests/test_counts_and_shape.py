import pytest
from pyspark.sql import functions as F

from usagelens.operators import counts, filters, reshape, select


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([("X", 1), ("X", 2), (None, 3)], "product string, id int")


def test_frequency_drops_null_group_count_keeps_it(products, rows):
    assert rows(counts.frequency(products, "product")) == [("X", 2)]
    assert rows(counts.group_count(products, "product")) == [("X", 2), (None, 1)]


def test_distinct_users_count_null_user_as_one(spark, rows):
    df = spark.createDataFrame([("u", "p"), ("u", "p"), (None, "p"), (None, "p"), ("v", None)], "user string, p string")
    assert rows(counts.distinct_users(df, "user", ["p"])) == [("p", 2), (None, 1)]
    assert rows(counts.distinct_users(df, "user", ["p"], drop_null_keys=True)) == [("p", 2)]
    assert rows(counts.distinct_per_group(df, ["p"], "user")) == [("p", 1), (None, 1)]


def test_sum_of_nothing_is_zero(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", 2)], "g string, x int")
    assert rows(counts.group_sum(df, ["g"], "x", "s")) == [("a", 0), ("b", 2)]


def test_crosstab(spark, rows):
    df = spark.createDataFrame([("MC", "So"), ("MC", None), (None, "So"), (None, None), ("MC", "So")], "a string, b string")
    assert rows(counts.crosstab_percent(df, "a", "b")) == [
        ("MC", "40.0% (2)", "20.0% (1)"), ("NA", "20.0% (1)", "20.0% (1)"), ("Total", "60.0% (3)", "40.0% (2)"),
    ]


def test_share_adds_up(products, rows):
    got = counts.frequency_share(products, "product").withColumn("share", F.round("share", 4))
    assert rows(got) == [("X", 2, 0.6667), (None, 1, 0.3333)]


def test_profile_counts_null_as_a_value(spark, rows):
    df = spark.createDataFrame([("x", None, 1), ("y", None, 2), ("x", "z", 3)], "a string, b string, n int")
    assert rows(counts.distinct_profile(df)) == [("a", 2, 0), ("b", 2, 2)]
    assert rows(counts.distinct_values(df, ["a", "n"])) == [("a", "x"), ("a", "y"), ("n", "1"), ("n", "2"), ("n", "3")]


def test_long_and_back(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c"), (3, None, None)], "id int, x string, y string")
    long = reshape.to_long(df, ["id"], ["x", "y"], "name", "value")
    assert rows(long) == [(1, "x", "a"), (2, "x", "b"), (2, "y", "c")]
    back = long.groupBy("id").pivot("name", ["x", "y"]).agg(F.first("value"))
    assert rows(back) == [(1, "a", None), (2, "b", "c")]


def test_markers(spark, rows):
    df = spark.createDataFrame([("u", "P"), ("u", "Q"), ("v", "Q"), ("v", None)], "unit string, p string")
    assert rows(reshape.marker_matrix(df, "unit", "p")) == [("u", 1, 1), ("v", None, 1)]
    assert rows(reshape.value_as_marker(df, ["unit"], "p", ["Q", "P"])) == [("u", "Q", "P"), ("v", "Q", None)]


def test_ordinals_after_distinct(spark, rows):
    df = spark.createDataFrame([("u", "b"), ("u", "a"), ("u", "b"), ("u", "c"), ("v", None)], "u string, org string")
    assert rows(reshape.ordinal_wide(df, "u", "org", "org")) == [("u", "a", "b", "c"), ("v", None, None, None)]
    narrow = reshape.ordinal_wide(df, "u", "org", "org", width=1).withColumn("org_more", F.concat_ws(";", "org_more"))
    assert rows(narrow) == [("u", "a", "b;c"), ("v", None, "")]


@pytest.mark.parametrize("size", [30, 3000])
def test_nest_has_one_layout_at_any_size(spark, rows, size):
    df = spark.range(size).selectExpr("id % 3 AS g", "id", "CAST(id AS string) AS t")
    whole, parted = reshape.nest(df, ["g"]), reshape.nest(df, ["g"], parts=4)
    assert whole.columns == parted.columns == ["g", "part", "rows"]
    assert whole.count() == 3 and parted.agg(F.max("part")).first()[0] <= 3
    assert rows(reshape.unnest(whole, ["g"])) == rows(reshape.unnest(parted, ["g"])) == rows(df)


def test_nest_keeps_equal_rows(spark, rows):
    df = spark.createDataFrame([("g", "x")] * 5 + [(None, "x"), (None, None)], "g string, t string")
    nested = reshape.nest(df, ["g"])
    assert sorted(len(r["rows"]) for r in nested.collect()) == [2, 5]
    assert rows(reshape.unnest(nested, ["g"])) == rows(df)


def test_draws(spark):
    grid = spark.createDataFrame([(0.0, 1.0), (100.0, 0.5)], "m double, s double")
    drawn = reshape.normal_draws(grid, F.col("m"), F.col("s"), 500, seed=1)
    means = {r["m"]: r["a"] for r in drawn.groupBy("m").agg(F.avg("value").alias("a")).collect()}
    assert drawn.count() == 1000 and abs(means[0.0]) < 0.3 and abs(means[100.0] - 100) < 0.2


def test_columns(spark):
    df = spark.createDataFrame([(1, "x", 2)], "a int, b string, c_date int")
    assert select.keep_existing(df, ["b", "zz", "a"]).columns == ["a", "b"]
    assert select.drop_named(df, ["a", "zz"]).columns == ["b", "c_date"]
    assert select.drop_suffix(df, "_date").columns == ["a", "b"]
    assert select.text_columns(df) == ["b"]
    assert select.move_before(df, ["c_date"], "b").columns == ["a", "c_date", "b"]
    assert select.with_role(df, "mc", keep=["a"]).columns == ["a", "mc_b", "mc_c_date"]
    assert select.tag(df, profile="MC").first()["profile"] == "MC"
    with pytest.raises(ValueError):
        select.rename(df, {"zz": "y"})
    with pytest.raises(ValueError):
        select.normalise_names(df.selectExpr("a AS `Last Login`", "b AS `Last.Login`"))


def test_null_count_filter(spark, rows):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    assert rows(filters.with_fewer_nulls(df, ["a", "b"], 2)) == [(1, None, 1)]
    assert rows(filters.with_any(df, ["a", "b"])) == [(1, None)]
    assert filters.with_all(df, ["a", "b"]).count() == 0


def test_stack_goes_by_name(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "n int, t string"), spark.createDataFrame([("y", 2)], "t string, n int")
    assert rows(reshape.stack(a, b)) == [(1, "x"), (2, "y")]
