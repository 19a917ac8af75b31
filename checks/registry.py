"""Registration of a query together with the inventory rows it covers and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from checks.oracles import with_views
from checks.roles import Roles


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Roles], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Roles(spark, folder))


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, views: str = ""):
    """Register the decorated builder under its function name."""

    def register(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        text = None if sql is None else with_views(sql, *views.split())
        QUERIES[build.__name__] = Query(build.__name__, tuple(covers.split()), build, text)
        return build

    return register
