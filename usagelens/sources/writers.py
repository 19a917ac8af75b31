"""Writes named by table and period."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame

from usagelens.functions.period import Period
from usagelens.sources.schemas import MANIFEST, MANIFEST_FOLDER


def table_path(root: str, name: str, period: Period) -> str:
    return f"{root.rstrip('/')}/{name}/period={period.key}"


def write_table(df: DataFrame, root: str, name: str, period: Period, fmt: str = "csv") -> str:
    """Write one period of a table, replacing that period only. Returns the path."""
    path = table_path(root, name, period)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
    return path


def write_tables(tables: dict[str, DataFrame], root: str, period: Period, fmt: str = "csv") -> dict[str, str]:
    return {name: write_table(df, root, name, period, fmt) for name, df in tables.items()}


def snapshot(df: DataFrame, root: str, name: str, period: Period) -> str:
    """Freeze a table for one period as Parquet; read it back with ``read_snapshot``."""
    return write_table(df, root, name, period, "parquet")


def snapshot_set(tables: dict[str, DataFrame], root: str, period: Period) -> str:
    """Freeze several tables of a period as one set; read them back with ``readers.read_snapshot_set``.

    Every set has a folder of its own, and the list of its tables is written last, by one task,
    whose file appears when that task commits. A run that is cut short leaves the earlier set in
    force, and nothing that a reader holds is overwritten. Returns the set's folder.
    """
    spark = next(iter(tables.values())).sparkSession
    root, written = root.rstrip("/"), time.time_ns()
    folder = f"set-{period.key}-{written}-{uuid.uuid4().hex[:8]}"
    for name, table in tables.items():
        table.write.parquet(f"{root}/{folder}/{name}")
    rows = [(period.key, written, name, f"{folder}/{name}") for name in tables]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST_FOLDER}")
    return f"{root}/{folder}"
