"""Text expressions and the column-name normaliser."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_token(text: Column) -> Column:
    """Text before the first blank; null for null or empty text."""
    return F.when(text != "", F.split_part(text, F.lit(" "), F.lit(1)))


def key_from_email(email: Column) -> Column:
    """Text before the first ``@``; null when there is none."""
    return F.when(F.instr(email, "@") > 0, F.substring_index(email, "@", 1))


def rewrite_domain(email: Column, old: str, new: str) -> Column:
    """Replace the part after ``@`` when it is exactly ``old``."""
    moved = F.concat(F.substring_index(email, "@", 1), F.lit("@" + new))
    return F.when(F.substring_index(email, "@", -1) == old, moved).otherwise(email)


def percent_text(share: Column, digits: int = 1) -> Column:
    """``0.1234`` as ``12.3%``, halves rounded to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(share * 100, digits))


def percent_with_count(share: Column, n: Column, digits: int = 1) -> Column:
    """``12.3% (45)``."""
    return F.concat(percent_text(share, digits), F.lit(" ("), n.cast("string"), F.lit(")"))


def snake_case(name: str) -> str:
    """``LastLoginDate``, ``Last Login`` and ``Last.Login`` style headers as snake_case."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip().strip("﻿"))
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")
