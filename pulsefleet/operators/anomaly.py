"""Outlying days and sustained streaks against the mean of a range."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.functions.calendar import check_range
from pulsefleet.functions.moments import in_order, mean_and_spread
from pulsefleet.functions.rounding import half_even
from pulsefleet.plans.registry import DEFAULT_METRICS, resolve

from .series import Warehouse, metric_values

MIN_STREAK = 5


def against_mean(warehouse: Warehouse, metrics: Sequence[str] | None, start: str | Date, end: str | Date) -> DataFrame:
    """Values with mean and sd of their user's metric, but for constant series; dealt by user and metric once."""
    found = resolve(metrics or DEFAULT_METRICS, "anomaly search", numeric=True)
    first, last = check_range(start, end)
    grouped = metric_values(warehouse, found, first, last).groupBy("user_id", "metric").agg(in_order("date", value="value").alias("xs"), F.min("value").alias("least"), F.max("value").alias("most"))
    known = grouped.filter("least < most").withColumn("s", mean_and_spread(F.col("xs")))
    return known.select("user_id", "metric", "s.mean", "s.sd", F.inline("xs")).withColumnRenamed("at", "date")


def anomalies(warehouse: Warehouse, metrics: Sequence[str] | None, start: str | Date, end: str | Date, z: float = 2.0) -> DataFrame:
    """user_id, date, metric, value, z, direction of days at least ``z`` deviations off; constant series have none."""
    if z <= 0:
        raise ValueError("z must be above 0")
    score = F.try_divide(F.col("value") - F.col("mean"), F.col("sd"))
    found = against_mean(warehouse, metrics, start, end).withColumn("score", score).filter(F.abs("score") >= z)
    return found.select("user_id", "date", "metric", "value", half_even("score").alias("z"), F.when(F.col("score") > 0, "high").otherwise("low").alias("direction"))


def streaks(warehouse: Warehouse, metrics: Sequence[str] | None, start: str | Date, end: str | Date) -> DataFrame:
    """user_id, metric, kind, start, end, len of at least MIN_STREAK successive days on one side of the mean."""
    kind = F.when(F.col("value") > F.col("mean"), "above_mean").when(F.col("value") < F.col("mean"), "below_mean")
    sided = against_mean(warehouse, metrics, start, end).withColumn("kind", kind).filter("kind is not null")
    # Successive days of one side share date minus rank.
    rank = F.row_number().over(Window.partitionBy("user_id", "metric", "kind").orderBy("date"))
    runs = sided.withColumn("island", F.date_sub("date", rank))
    return runs.groupBy("user_id", "metric", "kind", "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("len")).filter(F.col("len") >= MIN_STREAK).drop("island")
