import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.period import Period
from usagelens.sources import readers, schemas, workspace, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


SCHEMA = T.StructType([
    T.StructField("last_login", T.StringType()), T.StructField("note", T.StringType()), T.StructField("n", T.IntegerType()),
])


def test_empty_text_modes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Last Login,Note,N\nNA,x,1\n,"",bad\n"",y,\n')
    as_null = [tuple(r) for r in readers.read_csv(spark, path, SCHEMA).collect()]
    assert as_null == [(None, "x", 1), (None, None, None), (None, "y", None)]
    kept = [tuple(r) for r in readers.read_csv(spark, path, SCHEMA, empty_as_null=False).collect()]
    assert kept == [(None, "x", 1), ("", "", None), ("", "y", None)]


def test_columns_are_found_by_header_not_by_position(spark, tmp_path):
    path = write(tmp_path / "b.csv", "N,Other,Note,Last.Login\n5,o,x,y\n")
    assert tuple(readers.read_csv(spark, path, SCHEMA).first()) == ("y", "x", 5)
    with pytest.raises(ValueError, match="note"):
        readers.read_csv(spark, write(tmp_path / "c.csv", "N,Last Login\n1,x\n"), SCHEMA)


def test_source_tables_under_their_original_headers(spark, tmp_path):
    path = write(
        tmp_path / "aff.csv",
        "Academic_Department__c,hed__Affiliation_Type__c,hed__Contact__c,hed__Primary__c,hed__Account__r.Name,Parent_Organization__c\n"
        "D,T,c1,true,Acc,Org\n",
    )
    row = readers.read_source(spark, "affiliations", path).first()
    assert row.asDict() == {
        "contact_id": "c1", "academic_department": "D", "affiliation_type": "T", "is_primary": True,
        "account_name": "Acc", "parent_organization": "Org",
    }
    users = write(
        tmp_path / "users.csv",
        "Id,Email,UserType,Name,NetID__c,Profile.Name,ContactId,CreatedDate,Department,ProfileId,UserRoleId,"
        "UserRole.Name,Title,Username,LastLoginDate,IsActive\n"
        "1,e,t,n,k,p,c,2022-01-02 03:04:05,d,pi,ri,rn,ti,un,bad,TRUE\n",
    )
    row = readers.read_source(spark, "users", users).first()
    assert (row.net_id, row.role_name, str(row.created_ts), row.last_login_ts, row.is_active) == (
        "k", "rn", "2022-01-02 03:04:05", None, True,
    )


def test_report_path_has_two_digit_months():
    path = readers.report_path("/r", "last_login", Period(2022, 9))
    assert path == "/r/2022 Reports/September 2022/last_login-2022-10-01.csv"
    assert readers.report_path("/r", "x", Period(2021, 12)).endswith("December 2021/x-2022-01-01.csv")


def test_monthly_files(spark, tmp_path, rows):
    for period in (Period(2021, 12), Period(2022, 1)):
        path = readers.report_path(str(tmp_path), "last_login", period)
        write(tmp_path / path[len(str(tmp_path)) + 1:], f"NetID,max(timestamp)\nu1,{period.month}/5/{period.year}\n")
    got = readers.read_reports(spark, str(tmp_path), "last_login", "marketing_logins")
    assert rows(got, "net_id", "max_timestamp", "report_month") == [("u1", "1/5/2022", "2022-01"), ("u1", "12/5/2021", "2021-12")]
    assert got.where(F.col("source_file").endswith("last_login-2022-01-01.csv")).count() == 1


def test_report_headers_of_other_runs(spark, tmp_path):
    path = write(tmp_path / "r.csv", "user,lastlogindatetime\nu1,1/5/2022\n")
    assert tuple(readers.read_source(spark, "social_logins", path).first()) == ("u1", "1/5/2022")


def test_files_with_other_column_order_are_refused(spark, tmp_path):
    write(tmp_path / "one.csv", "A,B\n1,2\n")
    write(tmp_path / "two.csv", "B,A\n1,2\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path / "*.csv"), schema).collect()


def test_snapshots_prune_and_replace_one_period(spark, tmp_path, rows):
    root, first, second = str(tmp_path), Period(2022, 1), Period(2022, 2)
    df = spark.range(3)
    writers.snapshot(df, root, "t", first)
    writers.snapshot(df.where("id > 0"), root, "t", second)
    writers.snapshot(df.where("id > 1"), root, "t", second)
    assert rows(readers.read_snapshot(spark, root, "t", first)) == [(0,), (1,), (2,)]
    again = readers.read_snapshot(spark, root, "t", second)
    assert rows(again) == [(2,)]
    assert "PartitionFilters: [isnotnull(period" in again._jdf.queryExecution().executedPlan().toString()


def test_extract_pushes_filter_and_columns(spark, folder):
    recent = F.col("o_orderdate") >= F.lit("1999-01-01").cast("date")
    df = readers.read_extract(spark, f"{folder}/orders.parquet", ["o_orderkey"], recent)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp" in plan


def test_sql_over_tables(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert readers.run_sql(spark, "SELECT count(DISTINCT k) AS n FROM {t}", t=df).first()[0] == 1


def test_shared_folder_is_the_one_the_session_names(tmp_path):
    script = f"""
from pyspark.sql import SparkSession
from usagelens.sources import workspace
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "{tmp_path}").getOrCreate())
print("FOLDER", workspace.shared_folder(spark), workspace.fresh_path(spark, "x"))
print("FILES", workspace.cut_lineage(spark.range(5)).inputFiles()[0])
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)
    assert f"FOLDER {tmp_path} {tmp_path}/work-" in done.stdout, done.stderr
    assert f"FILES file://{tmp_path}/work-" in done.stdout and "/kept-" in done.stdout


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    names = ['Ann "A", B', "two\nlines", "plain", 'a "quoted" word']
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id string, name string")
    path = writers.write_table(df.coalesce(1), str(tmp_path), "people", Period(2022, 1))
    back = readers.read_csv(spark, path, df.schema)
    assert sorted(r["name"] for r in back.collect()) == sorted(names)
    found = duckdb.sql(f"SELECT name FROM read_csv('{path}/*.csv', header = true, all_varchar = true)").fetchall()
    assert sorted(n for n, in found) == sorted(names)


def test_reports_of_any_day_and_names_without_a_date(spark, tmp_path):
    folder = tmp_path / "2022 Reports" / "January 2022"
    folder.mkdir(parents=True)
    schema = schemas.SCHEMAS["social_logins"]
    line = ",".join(schema.fieldNames()) + "\n" + ",".join("x" for _ in schema.fields) + "\n"
    for name in ("social-2022-02-25.csv", "social-old.csv"):
        (folder / name).write_text(line)
    months = {r["report_month"] for r in readers.read_reports(spark, str(tmp_path), "social", "social_logins").collect()}
    assert months == {"2022-01", None}


def test_lineage_is_cut_in_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert workspace.shared_folder(spark) == named if named else "usagelens-work" in workspace.shared_folder(spark)
    kept = workspace.cut_lineage(spark.range(5).selectExpr("id * 2 AS n"))
    assert kept.count() == 5 and "Range" not in kept._jdf.queryExecution().toString()


def test_declared_tables():
    assert {"contacts", "users", "login_history", "affiliations", "permission_assignments", "perm_to_product",
            "marketing_logins", "social_logins", "licensed_users"} <= set(schemas.SCHEMAS)
    for table, names in schemas.ALIASES.items():
        assert set(names.values()) <= set(schemas.SCHEMAS[table].names)


def test_work_files_on_the_way_to_a_table_go_when_it_is_written(spark):
    folder = workspace.fresh_path(spark, "probe").rpartition("/")[0].removeprefix("file:")
    files = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = files()

    def doubled():
        first = workspace.cut_lineage(spark.range(10))
        second = workspace.written_alone(lambda: workspace.cut_lineage(first.where("id > 3")).where("id > 5"))
        assert len(files() - before) == 2
        return second.unionByName(second)

    twice = workspace.written_alone(doubled)
    assert len(files() - before) == 1 and twice.count() == 8
    beside = workspace.cut_lineage(twice)
    assert len(files() - before) == 2 and beside.count() == 8
