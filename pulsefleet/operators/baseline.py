"""Personal bands: mean and spread of a trailing window, and where the latest value lies."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions.calendar import parse_day, trailing
from pulsefleet.functions.moments import in_order, mean_and_spread
from pulsefleet.functions.rounding import half_even
from pulsefleet.plans.registry import DEFAULT_METRICS, resolve

from .series import Warehouse, metric_values


def latest_days(warehouse: Warehouse, tables: Sequence[str]) -> DataFrame:
    """(user_id, end): the last day with any row in the tables, whatever its values; from ``latest`` where the warehouse keeps it."""
    if "latest" in warehouse:
        return warehouse["latest"].filter(F.col("table").isin(list(tables))).groupBy("user_id").agg(F.max("last").alias("end"))
    per_table = [warehouse[t].groupBy("user_id").agg(F.max("date").alias("end")) for t in tables]
    return reduce(DataFrame.unionByName, per_table).groupBy("user_id").agg(F.max("end").alias("end")).filter("end is not null")


def months_of(ranges: DataFrame) -> list[str]:
    """The months that any of the ranges (start, end) touches, as many as the calendar has."""
    first, last = F.trunc("start", "month"), F.trunc("end", "month")
    months = ranges.select(first.alias("a"), last.alias("b")).distinct().select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return sorted(r[0] for r in months.select(F.date_format("m", "yyyy-MM")).distinct().collect())


def baselines(warehouse: Warehouse, metrics: Sequence[str] | None = None, window_days: int = 28, end: str | Date | None = None) -> DataFrame:
    """user_id, start, end, metric, mean, sd, band_low, band_high, current, vs_band, n.

    The window ends on ``end`` or, per user, on the latest day of the metrics' tables. A metric
    without values has a row of nulls with n = 0. The latest value is compared unrounded with the rounded band.
    """
    if window_days < 2:
        raise ValueError("window_days must be 2 or more")
    found = resolve(metrics or DEFAULT_METRICS, "a baseline", numeric=True)
    tables = list(dict.fromkeys(m.table for m in found))
    last = None if end is None else parse_day(end, "end")
    users = latest_days(warehouse, tables)
    if last is not None:
        users = users.withColumn("end", F.lit(last))
    users = users.withColumn("start", trailing(F.col("end"), window_days))
    # Users end on different days: of tables kept by month only the months that some user's window touches are read.
    months = months_of(users) if last is None and any("month" in warehouse[t].columns for t in tables) else None
    values = metric_values(warehouse, found, None if last is None else last - timedelta(days=window_days - 1), last, months).join(users, "user_id").filter(F.col("date").between(F.col("start"), F.col("end")))
    held = values.groupBy("user_id", "metric").agg(in_order("date", value="value").alias("xs"), F.max_by("value", "date").alias("current"), F.count("value").alias("n"))
    bands = held.withColumn("stats", mean_and_spread(F.col("xs"))).select("user_id", "metric", F.col("stats.mean").alias("m"), F.col("stats.sd").alias("s"), "current", "n")
    low, high = half_even(F.col("m") - F.col("s")), half_even(F.col("m") + F.col("s"))
    bands = bands.withColumns({"band_low": low, "band_high": high})
    wanted = users.withColumn("metric", F.explode(F.array(*[F.lit(m.name) for m in found])))
    place = F.when(F.col("current") < F.col("band_low"), "below").when(F.col("current") > F.col("band_high"), "above").when(F.col("current").isNotNull(), "in")
    return wanted.join(bands, ["user_id", "metric"], "left").select("user_id", "start", "end", "metric", half_even("m").alias("mean"), half_even("s").alias("sd"), "band_low", "band_high", "current", place.alias("vs_band"), F.coalesce("n", F.lit(0)).alias("n"))
