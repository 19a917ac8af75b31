"""Work tables bucketed by key and read through the catalogue: joins on the key need no exchange of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from usagelens.sources.workspace import fresh_path, named_table


def write_bucketed(df: DataFrame, keys: Sequence[str], buckets: int | None = None, name: str = "bucketed", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the rows in ``buckets`` by ``keys``, sorted by these, in the shared work folder, and go on from the table.

    Tables of equal buckets join on their keys where they lie. ``buckets`` is the session's
    number of shuffle partitions if not given, so what is not bucketed is dealt to match. Rows
    are not shuffled before the write: a task writes a file per bucket it has rows of, so deal
    many tasks by the keys first (``repartition(buckets, *keys)``). The table's name goes with
    ``workspace.drop_work_files``.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = named_table(name)
    writer = df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", fresh_path(spark, name))
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    return spark.table(table)
