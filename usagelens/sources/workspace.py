"""The shared folder for work files: the one the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: All work files of one application lie in one folder, which ``drop_work_files`` removes.
_RUN = f"work-{uuid.uuid4().hex}"
_tables: list[str] = []
#: What ``cut_lineage`` has written since the innermost ``written_alone`` began.
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names, as its setting or its checkpoint directory; only a local session may have none."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    # A local master is one process, whose executors all see its temporary folder.
    context.setCheckpointDir(f"{context._jvm.System.getProperty('java.io.tmpdir').rstrip('/')}/usagelens-work")
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{_RUN}/{name}-{uuid.uuid4().hex}"


def named_table(name: str) -> str:
    """A name in the catalogue for a work table of this application, which ``drop_work_files`` removes again."""
    _tables.append(f"{name}_{uuid.uuid4().hex}")
    return _tables[-1]


def drop_work_files(spark: SparkSession) -> bool:
    """Remove the work files of this application and the names of its work tables; tables read from them are then gone."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    return _remove(spark, f"{shared_folder(spark).rstrip('/')}/{_RUN}")


def _remove(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder, and go on from the written table.

    The table's size is known from then on, so small ones are broadcast without a hint.
    """
    path = fresh_path(df.sparkSession, "kept")
    df.write.parquet(path)
    written = _on_the_way.get()
    if written is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` plans, written as by ``cut_lineage``; what it wrote on the way there is removed.

    Nothing else that is planned inside may be used afterwards. Bucketed tables stay.
    """
    written: list[str] = []
    outer = _on_the_way.set(written)
    try:
        result = cut_lineage(make())
    finally:
        _on_the_way.reset(outer)
    *gone, last = written
    for path in gone:
        _remove(result.sparkSession, path)
    if _on_the_way.get() is not None:
        _on_the_way.get().append(last)
    return result
