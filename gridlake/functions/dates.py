"""Ordinal dates: day of year, year and day as yyyyddd, and sequences of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_of_year(month: Column, day: Column, year: Column) -> Column:
    return F.dayofyear(F.make_date(year.cast("int"), month.cast("int"), day.cast("int")))


def from_ordinal(year: Column, day: Column) -> Column:
    """The date of a day of a year; day 366 of a common year is the next 1 January."""
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (day - 1).cast("int"))


def yyyyddd(date: Column) -> Column:
    return F.year(date) * 1000 + F.dayofyear(date)


def ordinal_date(code: Column) -> Column:
    """The date of a yyyyddd number."""
    return from_ordinal(F.floor(code / 1000), code % 1000)


def ordinal_text(code: Column) -> Column:
    """yyyy-ddd of a yyyyddd number, rolled over where the year is too short."""
    d = ordinal_date(code)
    return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(F.dayofyear(d).cast("string"), 3, "0"))


def months(code: Column) -> Column:
    """yyyymmm of a yyyyddd number, the month padded with zeros to three digits."""
    d = ordinal_date(code)
    return F.concat(F.year(d).cast("string"), F.lpad(F.month(d).cast("string"), 3, "0"))


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year.cast("int"), F.lit(12), F.lit(31)))


def steps(start: Column, stop: Column, days: int) -> Column:
    """yyyyddd numbers from ``start`` to ``stop`` every so many days, across years."""
    return F.transform(F.sequence(ordinal_date(start), ordinal_date(stop), F.make_interval(days=F.lit(days))), lambda d: yyyyddd(d))


def running_days(df: DataFrame, code: str, order: str, partition: str, counter: int = 0, out: str = "day") -> DataFrame:
    """Days since each partition's first yyyyddd number, plus ``counter``."""
    w = Window.partitionBy(partition).orderBy(order)
    first = F.first(ordinal_date(F.col(code))).over(w)
    return df.withColumn(out, F.datediff(ordinal_date(F.col(code)), first) + counter)


def sun_distance_squared(day: Column) -> Column:
    """Squared distance of the sun in astronomical units on a day of the year."""
    return F.pow(1 - 0.01672 * F.cos(F.radians(0.9856 * (day - 4))), F.lit(2.0))
