import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usagelens.functions import period as months
from usagelens.functions.period import Period


def test_january_reports_on_december_of_the_year_before():
    assert Period.before(dt.date(2022, 1, 31)) == Period(2021, 12)


def test_last_day_of_march_reports_on_february():
    assert Period.before(dt.date(2022, 3, 31)) == Period(2022, 2)


def test_bounds_names_and_keys():
    period = Period.parse("2021-12")
    assert (period.start, period.stop) == (dt.date(2021, 12, 1), dt.date(2022, 1, 1))
    assert (period.key, period.label, period.next.key) == ("2021-12", "December 2021", "2022-01")


def test_bad_month_is_refused():
    with pytest.raises(ValueError):
        Period(2022, 13)


@given(st.integers(1990, 2100), st.integers(1, 12), st.integers(-500, 500))
def test_shift_goes_there_and_back(year, month, months_away):
    period = Period(year, month)
    assert period.shift(months_away).shift(-months_away) == period
    assert period.next.previous == period


def test_membership_is_half_open_and_null_is_out(spark, rows):
    df = spark.sql(
        """SELECT * FROM VALUES (TIMESTAMP_NTZ '2022-01-31 23:59:59'), (TIMESTAMP_NTZ '2022-02-01 00:00:00'),
           (TIMESTAMP_NTZ '2022-02-28 10:00:00'), (TIMESTAMP_NTZ '2022-03-01 00:00:00'), (NULL) AS t(ts)"""
    )
    kept = df.where(Period(2022, 2).contains("ts")).select(F.date_format("ts", "MM-dd HH").alias("ts"))
    assert rows(kept) == [("02-01 00",), ("02-28 10",)]


def test_column_arithmetic_clamps(spark, rows):
    df = spark.sql("SELECT DATE '2022-03-31' AS day")
    day = F.col("day")
    got = df.select(
        months.previous_month(day).cast("string"), months.previous_year(day), months.long_date(day),
        months.month_name(day), months.month_start(day).cast("string"),
    )
    assert rows(got) == [("2022-02-01", 2021, "March 31 2022", "March", "2022-03-01")]
