"""Column selection by name. Nothing here depends on column positions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.text import snake_case


def drop_named(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def keep_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The columns of ``names`` that the table has, in table order."""
    wanted = set(names)
    return df.select([c for c in df.columns if c in wanted])


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([c for c in df.columns if not c.endswith(suffix)])


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def select_text(df: DataFrame) -> DataFrame:
    return df.select(text_columns(df))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename ``{old: new}``; a name the table does not have is an error, not a no-op."""
    missing = sorted(set(mapping) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(dict(mapping))


def move_before(df: DataFrame, names: Iterable[str], before: str | None = None) -> DataFrame:
    """Move columns in front of ``before``, or to the front of the table."""
    names = list(names)
    rest = [c for c in df.columns if c not in names]
    at = rest.index(before) if before else 0
    return df.select(rest[:at] + names + rest[at:])


def tag(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def with_role(df: DataFrame, role: str, keep: Iterable[str] = ()) -> DataFrame:
    """Prefix every column but ``keep`` with ``role_``, so that joined tables never collide."""
    keep = set(keep)
    return df.withColumnsRenamed({c: f"{role}_{c}" for c in df.columns if c not in keep})


def normalise_names(df: DataFrame) -> DataFrame:
    """All names to snake_case; two headers that end up equal are an error."""
    names = [snake_case(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"headers collide after normalising: {df.columns}")
    return df.toDF(*names)
