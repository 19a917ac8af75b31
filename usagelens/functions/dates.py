"""Date parsing that gives null on bad text instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text layouts found in the monthly reports.
MDY = "M/d/yyyy"
MDY_HM = "M/d/yyyy H:mm"
MDY_HMS = "M/d/yyyy H:mm:ss"
YMD_HMS = "yyyy-MM-dd HH:mm:ss"


def parse_ts(text: Column, *layouts: str) -> Column:
    """First layout that fits, else null."""
    tries = [F.try_to_timestamp(text, F.lit(layout)) for layout in layouts]
    return tries[0] if len(tries) == 1 else F.coalesce(*tries)


def parse_mdy(text: Column) -> Column:
    return parse_ts(text, MDY).cast("date")


def parse_mdy_hm(text: Column) -> Column:
    return parse_ts(text, MDY_HM)


def parse_mdy_hms(text: Column) -> Column:
    return parse_ts(text, MDY_HMS)


def parse_ymd_hms(text: Column) -> Column:
    return parse_ts(text, YMD_HMS)


def parse_report_date(text: Column) -> Column:
    """Date part of a report column that may or may not carry a time of day."""
    return parse_ts(text, MDY, MDY_HM, MDY_HMS, YMD_HMS).cast("date")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(F.to_date(later), F.to_date(earlier))
