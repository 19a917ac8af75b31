"""Value rules: defaults, corrections and recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DefaultRule:
    """Give ``product`` to rows without one whose ``column`` holds one of ``values``."""

    column: str
    values: tuple[str, ...]
    product: str


def fill_by_rules(col: Column, rules: Sequence[DefaultRule]) -> Column:
    """Keep present values; fill null ones by the first rule that fits."""
    if not rules:
        return col
    first, *rest = rules
    filled = F.when(F.col(first.column).isin(list(first.values)), F.lit(first.product))
    for rule in rest:
        filled = filled.when(F.col(rule.column).isin(list(rule.values)), F.lit(rule.product))
    return F.coalesce(col, filled)


def replace_values(col: Column, mapping: Mapping) -> Column:
    """Swap the listed values, leave every other value and null alone."""
    if not mapping:
        return col
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.when(col.isNotNull(), F.coalesce(pairs[col], col))
