from pyspark.sql import functions as F

from usagelens.functions import dates, nulls, text
from usagelens.functions.rules import DefaultRule, fill_by_rules, replace_values


def test_not_in_keeps_null(spark, rows):
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    assert rows(ids.where(nulls.not_in(F.col("id"), ["a"]))) == [("b",), (None,)]
    assert rows(ids.where(nulls.in_or_null(F.col("id"), ["a"]))) == [("a",), (None,)]


def test_plain_inequality_drops_null(spark, rows):
    profiles = spark.createDataFrame([("admin",), ("base",), (None,)], "p string")
    assert rows(profiles.where(F.col("p") != "admin")) == [("base",)]


def test_distinct_count_under_condition(spark, rows):
    df = spark.createDataFrame([(1, "MC"), (1, "MC"), (None, "MC"), (2, None)], "id int, flag string")
    cond = F.col("flag") == "MC"
    assert rows(df.agg(nulls.n_distinct_when(cond, F.col("id")))) == [(1,)]
    assert rows(df.agg(nulls.n_distinct_when(cond, F.col("id"), count_null=True))) == [(2,)]
    assert rows(df.agg(nulls.n_distinct(F.col("id")), nulls.n_distinct(F.col("id"), True))) == [(2, 3)]


def test_row_helpers(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "")], "a int, b int, t string")
    got = df.select(
        nulls.null_count("a", "b"), nulls.any_present("a", "b"), nulls.row_sum("a", "b"), nulls.has_text(F.col("t"))
    )
    assert rows(got) == [(1, True, 1, True), (2, False, 0, False)]


def test_bad_dates_are_null_not_errors(spark, rows):
    df = spark.createDataFrame([("4/30/2021 12:05",), ("bad",), (None,)], "t string")
    got = df.select(F.date_format(dates.parse_mdy_hm(F.col("t")), "yyyy-MM-dd HH:mm"))
    assert rows(got) == [("2021-04-30 12:05",), (None,), (None,)]


def test_report_dates_with_and_without_time(spark, rows):
    df = spark.createDataFrame([("4/30/2021",), ("04/30/2021 9:05",), ("2021-04-30 09:05:01",), ("13/45/2021",)], "t string")
    got = df.select(dates.parse_report_date(F.col("t")).cast("string"))
    assert rows(got) == [("2021-04-30",)] * 3 + [(None,)]
    assert rows(df.select(dates.parse_mdy(F.col("t")).cast("string"))) == [("2021-04-30",)] + [(None,)] * 3


def test_email_keys(spark, rows):
    df = spark.createDataFrame([("u@x.org",), ("a@b@c",), ("nope",), (None,)], "e string")
    keyed = [tuple(r) for r in df.select("e", text.key_from_email(F.col("e"))).collect()]
    assert keyed == [("u@x.org", "u"), ("a@b@c", "a"), ("nope", None), (None, None)]
    moved = df.select(text.rewrite_domain(F.col("e"), "x.org", "y.org"))
    assert rows(moved) == [("a@b@c",), ("nope",), ("u@y.org",), (None,)]


def test_first_token(spark, rows):
    df = spark.createDataFrame([("Arts Staff",), ("One",), ("",), (None,)], "r string")
    assert rows(df.select(text.first_token(F.col("r")))) == [("Arts",), ("One",), (None,), (None,)]


def test_percent_rounds_half_to_even(spark, rows):
    df = spark.createDataFrame([(0.0025, 1), (0.0035, 2), (1.0, 3)], "s double, n int")
    got = [r[0] for r in df.select(text.percent_with_count(F.col("s"), F.col("n"))).collect()]
    assert got == ["0.2% (1)", "0.4% (2)", "100.0% (3)"]


def test_header_names():
    headers = {
        "Last Login": "last_login", "Last.Login": "last_login", "MC-Social-SFProduct": "mc_social_sf_product",
        "hed__Account__r.Name": "hed_account_r_name", "max(timestamp)": "max_timestamp", "NetID__c": "net_id_c",
        "LastLoginDate": "last_login_date",
    }
    assert {h: text.snake_case(h) for h in headers} == headers


def test_first_default_rule_wins_and_present_values_stay(spark, rows):
    rules = [DefaultRule("role", ("Analyst",), "Reports"), DefaultRule("profile", ("Base",), "Desk")]
    df = spark.createDataFrame(
        [(None, "Analyst", "Base"), (None, "x", "Base"), ("Own", "Analyst", "Base"), (None, None, None)],
        "product string, role string, profile string",
    )
    got = [r[0] for r in df.select(fill_by_rules(F.col("product"), rules)).collect()]
    assert got == ["Reports", "Desk", "Own", None]


def test_replace_values_leaves_others_and_null(spark):
    df = spark.createDataFrame([("A",), ("b",), (None,)], "k string")
    got = [r[0] for r in df.select(replace_values(F.col("k"), {"A": "a"})).collect()]
    assert got == ["a", "b", None]
