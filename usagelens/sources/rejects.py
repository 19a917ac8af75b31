"""What a read could not keep: rejected cells and records beside the good rows, counted during the write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from usagelens.functions.period import Period
from usagelens.sources.writers import table_path


@dataclass(frozen=True)
class Landed:
    """Paths and counts of one landed table."""

    path: str
    rejects_path: str
    rows: int
    rejected_rows: int
    rejected_cells: int
    rejected_records: int


def rejected_cells(df: DataFrame, rejected: str = "rejected") -> DataFrame:
    """One row per rejected cell or record: ``column_name`` (null for a record), ``text`` and the other columns of the row."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != rejected]
    return df.select(F.explode(rejected).alias("__lost"), *rest).select(
        F.col("__lost.column").alias("column_name"), F.col("__lost.text").alias("text"), *rest)


def land(df: DataFrame, root: str, name: str, period: Period, rejected: str = "rejected", keep_records: bool = True) -> Landed:
    """Write a table read with a ``rejected`` column as one period's Parquet, and what was lost under ``<name>_rejects``.

    The counts are metrics of the write itself, so the files are parsed once for the rows and,
    only if anything was lost, once more for the rejects. Rows with a rejected cell stay, with
    null there; without ``keep_records`` rows of records that do not fit the header do not.
    """
    record = F.exists(rejected, lambda c: c["column"].isNull())
    broken = F.aggregate(rejected, F.lit(0), lambda n, c: n + c["column"].isNull().cast("int"))
    seen = Observation()
    observed = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(rejected) > 0).alias("rejected_rows"),
        F.coalesce(F.sum(F.size(rejected) - broken), F.lit(0)).alias("cells"), F.coalesce(F.sum(broken), F.lit(0)).alias("records"),
    )
    path, aside = table_path(root, name, period), table_path(root, f"{name}_rejects", period)
    (observed if keep_records else observed.where(~record)).drop(rejected).write.mode("overwrite").parquet(path)
    found = seen.get
    lost = rejected_cells(df.where(F.size(rejected) > 0), rejected) if found["rejected_rows"] else rejected_cells(df, rejected).limit(0)
    lost.write.mode("overwrite").parquet(aside)
    return Landed(path, aside, found["rows"], found["rejected_rows"], found["cells"], found["records"])
