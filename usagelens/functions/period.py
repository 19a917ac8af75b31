"""The reporting month, and the column arithmetic that goes with it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


@dataclass(frozen=True, order=True)
class Period:
    """One calendar month. Every report takes it as an argument instead of reading the clock."""

    year: int
    month: int

    def __post_init__(self):
        dt.date(self.year, self.month, 1)

    @classmethod
    def parse(cls, key: str) -> Period:
        year, month = key.split("-")
        return cls(int(year), int(month))

    @classmethod
    def of(cls, day: dt.date) -> Period:
        return cls(day.year, day.month)

    @classmethod
    def before(cls, run_date: dt.date) -> Period:
        """The month a run on ``run_date`` reports on. January reports on last December."""
        return cls.of(run_date).shift(-1)

    def shift(self, months: int) -> Period:
        index = self.year * 12 + self.month - 1 + months
        return Period(index // 12, index % 12 + 1)

    @property
    def next(self) -> Period:
        return self.shift(1)

    @property
    def previous(self) -> Period:
        return self.shift(-1)

    @property
    def start(self) -> dt.date:
        return dt.date(self.year, self.month, 1)

    @property
    def stop(self) -> dt.date:
        """First day after the month, so that ranges are half-open."""
        return self.next.start

    @property
    def key(self) -> str:
        return f"{self.year:04d}-{self.month:02d}"

    @property
    def month_name(self) -> str:
        return MONTH_NAMES[self.month - 1]

    @property
    def label(self) -> str:
        return f"{self.month_name} {self.year}"

    def contains(self, day: Column | str) -> Column:
        """Month membership as a range on the bare column, so that it reaches the file scan."""
        day = F.col(day) if isinstance(day, str) else day
        return (day >= F.lit(self.start)) & (day < F.lit(self.stop))


def month_start(day: Column) -> Column:
    return F.trunc(F.to_date(day), "month")


def previous_month(day: Column) -> Column:
    """First day of the month before; clamps where plain month subtraction would give no date."""
    return F.add_months(month_start(day), -1)


def previous_year(day: Column) -> Column:
    return F.year(F.add_months(F.to_date(day), -12))


def long_date(day: Column) -> Column:
    """Text such as ``March 05 2022``."""
    return F.date_format(day, "MMMM dd yyyy")


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")
