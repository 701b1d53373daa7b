"""Days, buckets, wall-clock instants and the default ranges of jobs."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = ("daily", "weekly", "monthly")


def parse_day(value: str | Date, label: str = "date") -> Date:
    """A date from ``YYYY-MM-DD``; ValueError names the argument."""
    if isinstance(value, Date):
        return value
    try:
        return Date.fromisoformat(value)
    except (TypeError, ValueError):
        raise ValueError(f"{label} {value!r} is no date like 2024-01-31") from None


def check_range(start: str | Date, end: str | Date) -> tuple[Date, Date]:
    first, last = parse_day(start, "start"), parse_day(end, "end")
    if first > last:
        raise ValueError(f"start {first} lies after end {last}")
    return first, last


def bucket_label(day: Column, bucket: str) -> Column:
    """The day itself, the Monday of its ISO week, or YYYY-MM, as text."""
    if bucket == "weekly":
        return F.date_format(F.trunc(day, "week"), "yyyy-MM-dd")
    return F.date_format(day, "yyyy-MM" if bucket == "monthly" else "yyyy-MM-dd")


def days_between(spark: SparkSession, start: str | Date, end: str | Date) -> DataFrame:
    """One row per day of the closed range."""
    first, last = check_range(start, end)
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date"))


def local_millis(ms: Column) -> Column:
    """Milliseconds of a local wall clock since 1970 as a timestamp without zone, to the second."""
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.floor(ms / 1000).cast("decimal(18,6)"))


def device_seconds(seconds: Column) -> Column:
    """Seconds of a device clock, which begins on 1989-12-31."""
    return F.expr("TIMESTAMP_NTZ '1989-12-31 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def day_in_name(name: Column) -> Column:
    """The first YYYY-MM-DD in a text, else null."""
    found = F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0)
    return F.to_date(F.when(found != "", found))


def yesterday(instant: Column, zone: str) -> Column:
    """The last full day in a time zone, seen from a UTC instant."""
    return F.date_sub(F.to_date(F.from_utc_timestamp(instant, zone)), 1)


def trailing(end: Column, days: int) -> Column:
    """First day of a window of ``days`` days that ends on ``end``."""
    return F.date_sub(end, days - 1)
