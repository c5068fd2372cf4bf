"""Dates: local wall clocks, parsing, sentinels, the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/Sao_Paulo"
#: Month names of the calendar (fixed values).
MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()


def local_clock(instant: Column, zone: str = ZONE) -> Column:
    """Wall clock of an instant in a zone; the session's zone is UTC."""
    return F.from_utc_timestamp(instant, zone)


def local_date(instant: Column, zone: str = ZONE) -> Column:
    return local_clock(instant, zone).cast("date")


def day_month_year(x: Column) -> Column:
    return F.try_to_timestamp(x, F.lit("dd/MM/yyyy")).cast("date")


def iso_instant(x: Column, offset: str = "-03:00") -> tuple[Column, Column]:
    """Instant of ISO 8601 text, and whether its offset was missing and taken to be `offset`."""
    missing = ~x.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.try_to_timestamp(F.when(missing, F.concat(x, F.lit(offset))).otherwise(x)), missing


def not_sentinel(x: Column, sentinel: str = "1900-01-01") -> Column:
    return F.when(x.cast("date") != F.lit(sentinel).cast("date"), x)


def not_before(x: Column, start: Column) -> Column:
    """Null where x lies before start."""
    return F.when(x >= start, x)


def side_of(day: Column, cut: str, end: str) -> Column:
    """0 up to the cut, 1 up to the end of the target window, 2 beyond."""
    return F.when(day <= F.lit(cut).cast("date"), 0).when(day <= F.lit(end).cast("date"), 1).otherwise(2)


def near_midnight(clock: Column) -> Column:
    """Whether a wall clock shows 20:00 to 03:59, where another time zone may show another day."""
    return (F.hour(clock) >= 20) | (F.hour(clock) < 4)


def hours_fit_days(hours: Column, days: Column) -> Column:
    """Whether a duration in hours is coherent with one in days: less than a day away from it."""
    return (hours > 24 * (days - 1)) & (hours < 24 * (days + 1))


def calendar(spark: SparkSession, first: str = "2022-12-01", last: str = "2026-03-31") -> DataFrame:
    """One row a day: day, year, quarter, month, month_name, day_of_month, iso_weekday, weekend."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    iso = F.weekday("day") + 1
    return days.select(
        "day",
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        F.month("day").alias("month"),
        F.element_at(F.array(*map(F.lit, MONTHS)), F.month("day")).alias("month_name"),
        F.dayofmonth("day").alias("day_of_month"),
        iso.alias("iso_weekday"),
        (iso >= 6).alias("weekend"),
    )
