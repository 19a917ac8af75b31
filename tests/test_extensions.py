"""Merging counts, bitmaps, buckets, grouping sets, versions, split groups, rejects and snapshot sets, on small tables and as plans."""

import datetime as dt
import random
import re

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__  # noqa: F401
from checks.compare import differences
from checks.registry import QUERIES
from checks.roles import PERIOD, SETTINGS, Roles
from usagelens.functions.period import Period
from usagelens.operators import bitmaps, counts, reshape, sketches, windows
from usagelens.plans import base as bases
from usagelens.plans import monthly, persons, tables, versions
from usagelens.sources import readers, rejects, workspace, writers

JANUARY = Period(2024, 1)


def plan_of(df, formatted=False):
    return df._jdf.queryExecution().executedPlan().toString() if not formatted else df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# ---- sketches


def test_united_sketches_estimate_within_the_error(spark):
    """Three months of 60,000 users each, of whom a third are in two of them: beyond what a sketch holds exactly."""
    months = spark.range(3).withColumn("user", F.explode(F.sequence(F.lit(0), F.lit(59_999)))).select(
        F.col("id").alias("month"), (F.col("user") + F.col("id") * 40_000).alias("user"), F.lit("p").alias("product"))
    monthly_ones = workspace.cut_lineage(sketches.user_sketches(months, "user", ["month", "product"]))
    got = sketches.estimated(sketches.united(monthly_ones, ["product"])).first()["n"]
    exact = months.select("user").distinct().count()
    assert exact == 140_000 and abs(got / exact - 1) < 4 * sketches.standard_error()
    back = sketches.returning(monthly_ones, monthly_ones.withColumn("month", F.col("month") - 1), ["month", "product"])
    assert all(abs(r["n"] / 20_000 - 1) < 0.1 for r in back.collect()) and back.count() == 2


def test_sketches_below_their_size_are_exact_with_nulls(spark, rows):
    draw = random.Random(1)
    data = [(draw.choice(["a", None]), draw.choice([None, *range(40)]), i % 5) for i in range(300)]
    df = spark.createDataFrame(data, "k string, u int, m int")
    united = sketches.united(sketches.user_sketches(df, "u", ["k", "m"]), ["k"])
    assert rows(sketches.estimated(united)) == rows(counts.distinct_users(df, "u", ["k"]))
    assert sketches.estimated(sketches.user_sketches(df.limit(0), "u", ["k"])).count() == 0


# ---- bitmaps


def test_every_window_equals_a_distinct_count(spark, rows):
    draw = random.Random(2)
    data = [(draw.choice([None, "a", "b", "c", "d"]), draw.choice(["p", "q", None]), dt.datetime(2024, draw.choice([1, 1, 1, 2]), draw.randrange(1, 30), 5)) for _ in range(150)]
    df = spark.createDataFrame(data + [("z", "p", None), ("e", "p", dt.datetime(2024, 1, 31, 23, 59))], "u string, p string, ts timestamp")
    maps = bitmaps.day_bitmaps(df, ["u", "p"], "ts", JANUARY)
    got = {(r["p"], r["first_day"], r["last_day"]): r["users"] for r in bitmaps.users_in_windows(maps, ["p"], bitmaps.all_windows(31)).collect()}
    seen = {(u, p, ts.day) for u, p, ts in df.collect() if ts and ts.month == 1}
    want = {}
    for a, b in bitmaps.all_windows(31):
        for p in ("p", "q", None):
            n = len({u for u, q, d in seen if q == p and a <= d <= b})
            if n:
                want[p, a, b] = n
    assert got == want
    active = maps.where(bitmaps.active_between(31, 31)).select("u").collect()
    assert [r["u"] for r in active] == ["e"]
    days = {(r["u"], r["p"]): r["n"] for r in maps.select("u", "p", bitmaps.days_active(5, 20).alias("n")).collect()}
    assert days == {(u, p): len({d for v, q, d in seen if (v, q) == (u, p) and 5 <= d <= 20}) for u, p, _ in seen}


# ---- buckets


def test_person_chain_from_buckets_shuffles_nothing(spark, folder, rows):
    extracts = Roles(spark, folder).extracts()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chain = persons.bucketed_chain(persons.freeze_persons(extracts, PERIOD, SETTINGS, buckets=4))
        plan = plan_of(chain)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        product_users = workspace.cut_lineage(bases.product_users_of(bases.base_users(
            bases.users_with_login(extracts.users, extracts.login_history, PERIOD), SETTINGS), extracts, SETTINGS))
        reports = bases.report_logins(extracts.marketing, extracts.social, PERIOD)
        plain = bases.person_chain(reports, product_users, bases.contact_columns(extracts.contacts))
        sort_lists = lambda df: df.withColumn("sf_products", F.array_join(F.array_sort("sf_products"), "|"))
        assert rows(sort_lists(chain), *plain.columns) == rows(sort_lists(plain))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_tables_leave_no_names(spark, tmp_path, monkeypatch):
    from usagelens.sources.bucketed import write_bucketed

    monkeypatch.setattr(workspace, "_RUN", "work-of-this-test")
    table = write_bucketed(spark.range(50).withColumn("k", F.col("id") % 5), ["k"], 3, name="gone")
    assert table.count() == 50 and [t.name for t in spark.catalog.listTables() if t.name.startswith("gone_")]
    assert workspace.drop_work_files(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("gone_")]


# ---- one scan


def test_base_reads_assignments_once(spark, folder):
    """What the chain reads twice is written first, so the assignments are scanned once for it."""
    extracts = Roles(spark, folder).extracts()
    plan = plan_of(bases.activity_base(extracts, PERIOD, SETTINGS), formatted=True)
    assert "lineitem" not in plan


def test_month_from_one_expand(spark, folder, rows):
    table = bases.reporting_table(bases.activity_base(Roles(spark, folder).extracts(), PERIOD, SETTINGS))
    table = workspace.cut_lineage(table)
    cells = tables.monthly_cells(table)
    assert len(re.findall(r"FileScan parquet", plan_of(cells))) == 1
    report = tables.reports_of_cells(workspace.cut_lineage(cells), SETTINGS)
    single = {
        "user_counts_by_product": tables.users_by_product(table), "user_counts_by_product_unit": tables.users_by_product_and_unit(table),
        "users_by_unit": tables.users_by_unit(table), "products_by_unit": tables.products_by_unit(table),
        "products_by_unit_wide": tables.products_by_unit_wide(table, SETTINGS.matrix_products),
    }
    assert list(report) == list(single)
    for name, df in single.items():
        assert rows(report[name], *df.columns) == rows(df) and rows(df)


# ---- versions


def draw_table(spark, seed, n=400):
    draw = random.Random(seed)
    data = [(draw.choice([None, *range(60)]), draw.choice(["x", "y", "", None]), draw.choice([1.5, None, 2.0])) for _ in range(n)]
    return spark.createDataFrame(data, "k int, v string, w double")


def both_ways(current, earlier):
    found = [(s, r) for s, df in (("added", current.exceptAll(earlier)), ("removed", earlier.exceptAll(current))) for r in map(tuple, df.collect())]
    return sorted(found, key=str)


def test_changes_equal_except_all_both_ways(spark):
    current, earlier = draw_table(spark, 1), draw_table(spark, 2)
    got = versions.compare_versions(current, earlier.select("w", "k", "v"), ["k"]).collect()
    rows = sorted(((r["change"], (r["k"], r["v"], r["w"])) for r in got for _ in range(r["copies"])), key=str)
    assert rows == both_ways(current, earlier) and rows
    keys = {s: {r["k"] for r in df.collect()} for s, df in (("added", earlier), ("removed", current))}
    assert all(r["key_kept"] == (r["k"] in keys[r["change"]]) for r in got)


def test_only_ranges_that_differ_are_open(spark):
    current = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    earlier = current.where("k <> 5").withColumn("v", F.when(F.col("k") == 9, 99).otherwise(F.col("v")))
    now, then = versions.range_digests(current, ["k"]), versions.range_digests(earlier, ["k"])
    assert versions.differing_ranges(now, then).count() == 2
    got = {(r["change"], r["k"], r["key_kept"]) for r in versions.compare_versions(current, earlier, ["k"], now, then).collect()}
    assert got == {("added", 5, False), ("added", 9, True), ("removed", 9, True)}
    assert versions.compare_versions(current, current, ["k"]).count() == 0
    assert versions.compare_versions(current.limit(0), current.limit(3), ["k"]).count() == 3
    with pytest.raises(ValueError, match="v"):
        versions.compare_versions(current, current.drop("v"), ["k"])


# ---- split groups


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_lowest_of_groups_equals_rank(spark, rows, n):
    draw = random.Random(n)
    data = [(draw.choice(["hot"] * 8 + [None, "a"]), draw.choice([None, *range(12)]), i) for i in range(500)]
    df = spark.createDataFrame(data, "g string, x int, id int")
    want = df.withColumn("place", F.rank().over(Window.partitionBy("g").orderBy("x"))).where(f"place <= {n}").drop("place")
    assert rows(windows.lowest_per_group(df, ["g"], F.col("x"), n)) == rows(want)


def test_a_group_of_ties_is_one_value_before_the_shuffle(spark):
    df = spark.range(0, 50_000, 1, 8).select(F.lit("g").alias("g"), F.lit(1).alias("x"), "id")
    assert windows.lowest_per_group(df, ["g"], F.col("x"), 3).count() == 50_000
    # The rows themselves meet the group's threshold in a join; windows see one row for each distinct value.
    assert df.groupBy("g", "x").count().count() == 1


def test_large_samples_are_exact_in_size(spark):
    df = spark.range(5_000).select(F.when(F.col("id") < 4_500, "hot").alias("g"), "id")
    drawn = windows.sample_rows(df, ["g"], 1_200, seed=3)
    assert {r["g"]: r["count"] for r in drawn.groupBy("g").count().collect()} == {"hot": 1_200, None: 500}
    again = windows.sample_rows(df.repartition(7), ["g"], 1_200, seed=3)
    assert drawn.exceptAll(again).count() == 0 and drawn.distinct().count() == 1_700


def test_drawn_rows_are_those_of_least_hash(spark, rows):
    df = spark.range(300).select((F.col("id") % 4).alias("g"), "id")
    hashed = df.withColumn("h", F.xxhash64(F.lit(5), "g", "id")).collect()
    want = sorted((r["g"], r["id"]) for g in range(4) for r in sorted([x for x in hashed if x["g"] == g], key=lambda x: (x["h"], x["id"]))[:6])
    assert sorted(map(tuple, windows.sample_rows(df, ["g"], 6, seed=5).collect())) == want
    assert sorted(map(tuple, windows.sample_groups(df, ["g"], 2, seed=5).select("g", "id").collect()))[0][0] in range(4)
    drawn = windows.sample_groups(df, ["g"], 2, seed=5)
    chosen = sorted((r["h"], r["g"]) for r in df.select("g").distinct().withColumn("h", F.xxhash64(F.lit(5), "g")).collect())[:2]
    assert {r["g"] for r in drawn.collect()} == {g for _, g in chosen} and drawn.count() == 150


def test_draws_have_mean_and_spread(spark):
    grid = spark.createDataFrame([(10.0, 2.0), (-5.0, 0.5)], "m double, s double")
    drawn = reshape.normal_draws(grid, F.col("m"), F.col("s"), 4_000, seed=1)
    for r in drawn.groupBy("m", "s").agg(F.avg("value").alias("a"), F.stddev("value").alias("d"), F.count_distinct("value").alias("n")).collect():
        assert abs(r["a"] - r["m"]) < 0.1 * r["s"] and abs(r["d"] / r["s"] - 1) < 0.1 and r["n"] == 4_000


# ---- headings


def test_values_beyond_the_headings_are_told(spark, rows, monkeypatch):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", None)], "r string, c string")
    with pytest.raises(Exception, match="not among the headings"):
        counts.crosstab_percent(df, "r", "c", ["x"]).collect()
    got = rows(counts.crosstab_percent(df, "r", "c", ["x", "y"], other="others"))
    assert got == [("Total", "25.0% (1)", "25.0% (1)", "25.0% (1)", "25.0% (1)"), ("a", "25.0% (1)", "25.0% (1)", "0.0% (0)", "0.0% (0)"), ("b", "0.0% (0)", "0.0% (0)", "25.0% (1)", "25.0% (1)")]
    assert rows(reshape.value_as_marker(df, ["r"], "c", ["x"], other="n_other")) == [("a", "x", 1), ("b", None, 1)]
    monkeypatch.setattr(reshape, "MAX_HEADINGS", 2)
    with pytest.raises(ValueError, match="too many"):
        reshape.wide_values(df, "c")


# ---- profile


def test_profile_reads_once(spark, tmp_path):
    df = spark.range(3_000).select((F.col("id") % 50).alias("a"), F.when(F.col("id") % 3 == 0, "z").alias("b"), F.lit(None).cast("string").alias("odd name"))
    df.write.parquet(str(tmp_path / "t"))
    profile = counts.sketched_profile(spark.read.parquet(str(tmp_path / "t")), top=2)
    assert len(re.findall("FileScan parquet", plan_of(profile))) == 1 and "Generate" not in plan_of(profile).split("Aggregate")[-1]
    got = {r["column_name"]: r for r in profile.collect()}
    assert (got["a"]["n_rows"], got["a"]["n_null"], got["a"]["n_distinct"]) == (3_000, 0, 50)
    assert (got["b"]["n_null"], got["b"]["n_distinct"], got["odd name"]["n_null"], got["odd name"]["n_distinct"]) == (2_000, 1, 3_000, 0)
    assert {"value": "z", "n": 1_000} in [x.asDict() for x in got["b"]["most_frequent"]]


def test_profile_error_is_bounded(spark):
    df = spark.range(200_000).select("id")
    n = counts.sketched_profile(df).first()["n_distinct"]
    assert abs(n / 200_000 - 1) < 4 * sketches.standard_error()


# ---- rejects


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.DateType()), T.StructField("note", T.StringType())])


@pytest.mark.parametrize("multi_line", [True, False])
def test_bad_cells_and_records_are_counted_and_kept_aside(spark, tmp_path, multi_line):
    path = tmp_path / "a.csv"
    path.write_text("Note,ID,Day\nok,1,2024-01-02\nbad day,2,soon\nboth,x1,31/12\nempty,,NA\nlong,3,2024-02-03,more\nshort,4\n")
    df = readers.read_csv(spark, str(path), SCHEMA, multi_line=multi_line, rejected="rejected")
    assert df.columns == ["id", "day", "note", "rejected"]
    landed = rejects.land(df, str(tmp_path), "t", JANUARY)
    assert (landed.rows, landed.rejected_rows, landed.rejected_cells, landed.rejected_records) == (6, 4, 3, 2)
    kept = {r["note"]: (r["id"], str(r["day"])) for r in spark.read.parquet(landed.path).collect()}
    assert kept["ok"] == (1, "2024-01-02") and kept["bad day"] == (2, "None") and kept["both"] == (None, "None") and kept["empty"] == (None, "None")
    aside = sorted((str(r["column_name"]), r["text"]) for r in spark.read.parquet(landed.rejects_path).collect())
    assert aside == [("None", "long,3,2024-02-03,more"), ("None", "short,4"), ("day", "31/12"), ("day", "soon"), ("id", "x1")]
    good = rejects.land(df.where(F.size("rejected") == 0), str(tmp_path), "u", JANUARY)
    assert (good.rows, good.rejected_rows) == (2, 0) and spark.read.parquet(good.rejects_path).count() == 0
    whole = rejects.land(df, str(tmp_path), "w", JANUARY, keep_records=False)
    assert spark.read.parquet(whole.path).count() == 4 and whole.rows == 6


def test_reports_can_be_read_in_parts(spark, tmp_path):
    folder = tmp_path / "2024 Reports" / "January 2024"
    folder.mkdir(parents=True)
    (folder / "marketing-2024-02-01.csv").write_text("NetID,max_timestamp\na,1/5/2024\nb,never\n")
    df = readers.read_reports(spark, str(tmp_path), "marketing", "marketing_logins", multi_line=False, rejected="lost")
    assert sorted((r["net_id"], r["report_month"], len(r["lost"])) for r in df.collect()) == [("a", "2024-01", 0), ("b", "2024-01", 0)]
    assert "multiLine" not in plan_of(df)


# ---- snapshot sets and runs


def test_a_set_that_was_cut_short_is_never_read(spark, tmp_path, monkeypatch):
    one, two = spark.range(3), spark.range(5)
    writers.snapshot_set({"a": one, "b": one}, str(tmp_path), JANUARY)
    broken = two.select(F.raise_error(F.lit("cut")).alias("id"))
    with pytest.raises(Exception, match="cut"):
        writers.snapshot_set({"a": two, "b": broken}, str(tmp_path), JANUARY)
    found = readers.read_snapshot_set(spark, str(tmp_path), JANUARY)
    assert {name: df.count() for name, df in found.items()} == {"a": 3, "b": 3}
    held = found["a"]
    writers.snapshot_set({"a": two, "b": two}, str(tmp_path), JANUARY)
    assert readers.read_snapshot_set(spark, str(tmp_path), JANUARY)["a"].count() == 5 and held.count() == 3
    with pytest.raises(ValueError, match="2024-02"):
        readers.read_snapshot_set(spark, str(tmp_path), Period(2024, 2))


def test_entitlement_run_writes_its_files(spark, folder, rows, tmp_path):
    roles, out = Roles(spark, folder), str(tmp_path)
    extracts = roles.extracts()
    paths = monthly.run_entitlement(extracts, PERIOD, SETTINGS, out)
    assert set(paths) == {"entitlement_base", "entitled_users", "entitled_users_by_product", "entitled_users_by_profile", "entitled_users_by_unit", "users_without_unit"}
    base = bases.entitlement_base(extracts, SETTINGS)
    by_unit = spark.read.csv(paths["entitled_users_by_unit"], header=True, schema="unit string, users long")
    assert rows(by_unit) == rows(counts.distinct_users(base, "user_key", ["parent_organization"]))
    assert spark.read.csv(paths["entitled_users"], header=True).count() == base.count()


def test_two_system_run_writes_both_layouts(spark, folder, tmp_path):
    import dataclasses

    roles = Roles(spark, folder)
    extracts = dataclasses.replace(roles.extracts(), marketing=roles.marketing_accounts(), social=None)
    paths = monthly.run_entitlement(extracts, PERIOD, SETTINGS, str(tmp_path), two_systems=True)
    wide = spark.read.csv(paths["product_users_wide"], header=True)
    spread = spark.read.csv(paths["product_users_with_organizations"], header=True)
    assert wide.columns[:2] == ["name", "user_key"] and "parent_org_1" in spread.columns
    assert 0 < spread.count() <= wide.count()


def test_reports_again_from_a_frozen_base(spark, folder, rows, tmp_path):
    out, extracts = str(tmp_path), Roles(spark, folder).extracts()
    paths = monthly.run_month(extracts, PERIOD, SETTINGS, out, dt.date(1995, 1, 1))
    first = {name: rows(spark.read.csv(paths[name], header=True)) for name in ("users_by_unit", "month_activity")}
    again = monthly.rerun_reports(spark, out, PERIOD, SETTINGS)
    assert {name: rows(spark.read.csv(again[name], header=True)) for name in first} == first


def test_frozen_extracts_can_be_taken_up_again(spark, folder, rows, tmp_path):
    extracts = Roles(spark, folder).extracts()
    kept = monthly.freeze(extracts, str(tmp_path), PERIOD)
    again = monthly.frozen(spark, str(tmp_path), PERIOD)
    assert rows(again.users) == rows(kept.users) and again.social is not None


# ---- exact counts that merge


def _orders_folder(path, spark, orders):
    """A folder whose only table is ``orders``."""
    orders.write.parquet(f"{path}/orders.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/orders.parquet/*.parquet'")
    return connection


def test_profile_of_more_values_than_a_sketch_holds_is_exact(spark, tmp_path):
    many = spark.range(40_000).select(
        F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).cast("int").alias("c_nationkey"),
        F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    for name, rows in (("many", many), ("none", many.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/customer.parquet")
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/{name}/customer.parquet/*.parquet'")
        assert differences(QUERIES["profile_from_sketches"](spark, f"{tmp_path}/{name}"), connection, QUERIES["profile_from_sketches"].sql) == []


def test_users_over_periods_beyond_a_sketch_are_exact(spark, tmp_path):
    day = F.when(F.col("id") % 1_000 != 0, F.timestamp_seconds(F.lit(820_454_400) + (F.col("id") % 5) * 7_776_000))
    orders = spark.range(100_000).select(
        F.when(F.col("id") % 997 != 0, F.col("id") % 45_000).alias("o_custkey"), day.cast("timestamp_ntz").alias("o_orderdate"),
        F.when(F.col("id") % 501 != 0, F.lit("p")).alias("o_orderpriority"))
    connection = _orders_folder(tmp_path, spark, orders)
    assert differences(QUERIES["users_over_periods_from_sketches"](spark, str(tmp_path)), connection, QUERIES["users_over_periods_from_sketches"].sql) == []


def test_returning_users_beyond_a_sketch_are_exact(spark, tmp_path):
    """Over the turn of a year, with a month without any row and one nobody comes back in."""
    months = ["1996-11-05", "1996-12-30", "1997-01-01", "1997-03-02", "1997-04-03", None]
    orders = spark.range(6).withColumn("user", F.explode(F.sequence(F.lit(0), F.lit(29_999)))).select(
        F.when(F.col("user") % 999 != 0, F.col("user") + F.when(F.col("id") == 4, 50_000).otherwise(F.col("id") * 10_000)).alias("o_custkey"),
        F.element_at(F.array(*[F.lit(m) for m in months]), (F.col("id") + 1).cast("int")).cast("timestamp_ntz").alias("o_orderdate"),
        F.when(F.col("user") % 501 != 0, F.lit("p")).alias("o_orderpriority"))
    orders = orders.unionByName(orders.limit(100))
    connection = _orders_folder(tmp_path, spark, orders)
    assert differences(QUERIES["returning_users_from_sketches"](spark, str(tmp_path)), connection, QUERIES["returning_users_from_sketches"].sql) == []


def test_versions_are_counted_in_parts_that_grow_with_them(spark, rows, monkeypatch):
    monkeypatch.setattr(versions, "PART_ROWS", 20)
    current = spark.range(1_000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"), (F.col("id") % 3).alias("v"))
    earlier = current.unionByName(current.where("k % 10 = 1")).withColumn("v", F.when(F.col("k") % 10 == 3, -1).otherwise(F.col("v")))
    changed = versions.compare_versions(current, earlier, ["k"])
    added, removed = current.exceptAll(earlier).count(), earlier.exceptAll(current).count()
    assert {r["change"]: r["n"] for r in changed.groupBy("change").agg(F.sum("copies").alias("n")).collect()} == {"added": added, "removed": removed}
    assert changed.where("NOT key_kept").count() == 0
    # As many tasks as the rows of ranges that differ ask for, which the session's eight partitions do not bound.
    assert changed.rdd.getNumPartitions() > 8
