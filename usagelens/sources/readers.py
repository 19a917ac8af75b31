"""Typed reads of CSV and Parquet extracts, monthly report files and period snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.period import Period
from usagelens.operators.select import normalise_names
from usagelens.sources.schemas import ALIASES, MANIFEST, MANIFEST_FOLDER, SCHEMAS

# Where monthly reports are filed.
REPORT_LAYOUT = "{year} Reports/{month_name} {year}/{report}-{run}-01.csv"
REPORT_PATTERN = "* Reports/*/{report}-*.csv"

#: Column in which Spark leaves a record that does not fit the header.
_RECORD = "__record"


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType, aliases: dict[str, str] | None = None,
    empty_as_null: bool = True, source_file: str | None = None, multi_line: bool = True, rejected: str | None = None,
) -> DataFrame:
    """Read by header name into ``schema``; text that does not parse becomes null.

    ``rejected`` names a column that tells what was lost of a row: an array of ``column, text``,
    one for each cell that did not parse, and one without column for a record with too many or
    too few cells; empty for good rows. ``sources.rejects`` takes them aside.

    With ``empty_as_null`` empty text is null. Without it empty text stays empty and only
    ``NA`` is null. ``source_file`` names a column for the path of the file a row came from.
    Quotes inside quoted text are doubled. ``multi_line`` allows line breaks in it, for which a
    file is read by one task: turn it off, or land Parquet, where files are large.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", multi_line)
    raw = reader.csv(path)
    if rejected:
        with_record = T.StructType([*raw.schema.fields, T.StructField(_RECORD, T.StringType())])
        raw = reader.option("columnNameOfCorruptRecord", _RECORD).schema(with_record).csv(path)
    named = normalise_names(raw.drop(_RECORD))
    if rejected:
        # The order is that of the file, so the record's column stays behind the renamed ones.
        named = raw.toDF(*named.columns, _RECORD)
    named = named.withColumnsRenamed(
        {old: new for old, new in (aliases or {}).items() if old in named.columns and new not in named.columns}
    )
    missing = [f.name for f in schema.fields if f.name not in named.columns]
    if missing:
        raise ValueError(f"{path}: columns {missing} not found among {named.columns}")
    columns = [_typed(f, empty_as_null).alias(f.name) for f in schema.fields]
    if rejected:
        columns.append(_lost(schema).alias(rejected))
    if source_file:
        columns.append(F.col("_metadata.file_path").alias(source_file))
    return named.select(columns)


def _typed(field: T.StructField, empty_as_null: bool) -> Column:
    text = F.col(field.name)
    text = F.when(text != "NA", text)
    if isinstance(field.dataType, T.StringType):
        if empty_as_null:
            return F.when(text != "", text)
        return F.when(F.col(field.name).isNull(), F.lit("")).otherwise(text)
    return text.try_cast(field.dataType)


def _lost(schema: T.StructType) -> Column:
    """What ``_typed`` cannot keep of a row, and the record itself where it does not fit the header."""
    kind = "struct<column:string,text:string>"
    cells = [F.struct(F.lit(None).cast("string").alias("column"), F.col(_RECORD).alias("text")).cast(kind)]
    kept = [F.col(_RECORD).isNotNull()]
    for field in schema.fields:
        if not isinstance(field.dataType, T.StringType):
            text = F.col(field.name)
            cells.append(F.struct(F.lit(field.name).alias("column"), text.alias("text")).cast(kind))
            kept.append(F.coalesce(~text.isin("NA", "") & text.try_cast(field.dataType).isNull(), F.lit(False)))
    return F.filter(F.array(*[F.when(k, c) for k, c in zip(kept, cells)]), lambda c: c.isNotNull())


def read_source(
    spark: SparkSession, table: str, path: str | list[str], fmt: str = "csv", empty_as_null: bool = True,
    multi_line: bool = True, rejected: str | None = None,
) -> DataFrame:
    """One of the declared source tables; the further arguments are those of ``read_csv``, and bear on CSV files only."""
    if fmt == "csv":
        return read_csv(spark, path, SCHEMAS[table], ALIASES.get(table), empty_as_null, multi_line=multi_line, rejected=rejected)
    return spark.read.format(fmt).schema(SCHEMAS[table]).load(path)


def read_extract(
    spark: SparkSession, path: str, columns: Sequence[str], condition: Column | None = None
) -> DataFrame:
    """A landed Parquet extract with projection and predicate; both reach the scan."""
    df = spark.read.parquet(path)
    return (df if condition is None else df.where(condition)).select(*columns)


def report_path(root: str, report: str, period: Period, layout: str = REPORT_LAYOUT) -> str:
    """Path of a monthly report, filed under its month and dated the first of the next one."""
    part = layout.format(
        year=period.year, month_name=period.month_name, period=period.key, run=period.next.key, report=report
    )
    return f"{root.rstrip('/')}/{part}"


def read_reports(
    spark: SparkSession, root: str, report: str, table: str, pattern: str = REPORT_PATTERN,
    multi_line: bool = True, rejected: str | None = None,
) -> DataFrame:
    """All months of one report as a declared table, with ``source_file`` and ``report_month``.

    The report month is the one before the run month in the file name, on whatever day of it
    the report is stamped; null for a name without a date. Files whose columns differ from the
    declared ones are to be read by ``read_source`` one by one.
    """
    path = f"{root.rstrip('/')}/{pattern.format(report=report)}"
    df = read_csv(spark, path, SCHEMAS[table], ALIASES.get(table), source_file="source_file", multi_line=multi_line, rejected=rejected)
    run = F.regexp_extract("source_file", r"-(\d{4}-\d{2})-\d{2}\.csv(?:/|$)", 1)
    month = F.add_months(F.try_to_timestamp(F.concat(run, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"), -1)
    return df.withColumn("report_month", F.date_format(month, "yyyy-MM"))


def read_snapshot_set(spark: SparkSession, root: str, period: Period) -> dict[str, DataFrame]:
    """The tables of the latest whole set that ``writers.snapshot_set`` finished for a period, by name."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/{MANIFEST_FOLDER}").where(F.col("period") == period.key)
    last = manifest.agg(F.max("written")).first()[0]
    if last is None:
        raise ValueError(f"no finished set of {period.key} under {root}")
    return {row["name"]: spark.read.parquet(f"{root.rstrip('/')}/{row['path']}") for row in manifest.where(F.col("written") == last).collect()}


def read_snapshot(spark: SparkSession, root: str, table: str, period: Period) -> DataFrame:
    """A frozen table of one period; the other periods' folders are not touched."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{table}")
    return df.where(F.col("period") == period.key).drop("period")


def run_sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """SQL text over named tables."""
    return spark.sql(query, **tables)
