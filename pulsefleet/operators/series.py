"""Metric series in long form, their alignment, buckets and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date as Date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions.calendar import BUCKETS, bucket_label, check_range
from pulsefleet.functions.moments import in_order, mean_and_spread
from pulsefleet.functions.rounding import half_even, mean
from pulsefleet.plans.registry import Metric, resolve

Warehouse = Mapping[str, DataFrame]


def in_range(df: DataFrame, start: Date | None, end: Date | None) -> DataFrame:
    """Rows of a range; where the table still has its partition column ``month``, only the range's months are read."""
    whole = "month" in df.columns
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
        df = df.filter(F.col("month") >= f"{start:%Y-%m}") if whole else df
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end))
        df = df.filter(F.col("month") <= f"{end:%Y-%m}") if whole else df
    return df


def metric_values(warehouse: Warehouse, metrics: Sequence[Metric], start: Date | None = None, end: Date | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """(user_id, date, metric, value, category): one row per observation; nulls are none. ``months``: read no others, where the table is kept by month.

    Every source table is scanned once, with its needed columns only. Activities are added up per
    day first; a day without activities has no row.
    """
    parts = []
    for table in dict.fromkeys(m.table for m in metrics):
        own = [m for m in metrics if m.table == table]
        rows = in_range(warehouse[table], start, end).filter(F.col("date").isNotNull())
        if months is not None and "month" in rows.columns:
            rows = rows.filter(F.col("month").isin(list(months)))
        if table == "activities":
            rows = rows.groupBy("user_id", "date").agg(*[m.expr().alias(m.name) for m in own])
        else:
            rows = rows.select("user_id", "date", *[m.expr().alias(m.name) for m in own])
        cells = [F.struct(F.lit(m.name).alias("metric"), (F.col(m.name).cast("double") if m.numeric else F.lit(None).cast("double")).alias("value"), (F.lit(None) if m.numeric else F.col(m.name)).cast("string").alias("category")) for m in own]
        long = rows.select("user_id", "date", F.inline(F.array(*cells)))
        parts.append(long.filter(F.col("value").isNotNull() | F.col("category").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def bucketed(values: DataFrame, metrics: Sequence[Metric], bucket: str) -> DataFrame:
    """(user_id, label, metric, value, category); weeks and months average, additive metrics add up, rounded to 2."""
    labelled = values.withColumn("label", bucket_label(F.col("date"), bucket))
    if bucket == "daily":
        return labelled.drop("date")
    added = [m.name for m in metrics if m.additive]
    value = F.when(F.col("metric").isin(added), F.sum("value")).otherwise(mean("value")) if added else mean("value")
    return labelled.groupBy("user_id", "label", "metric").agg(half_even(value).alias("value"), F.lit(None).cast("string").alias("category"))


def checked(metrics: Sequence[str], aggregate: str) -> list[Metric]:
    if aggregate not in BUCKETS:
        raise ValueError(f"aggregate is one of {', '.join(BUCKETS)}, not {aggregate!r}")
    return resolve(metrics, f"aggregate={aggregate!r}", numeric=aggregate != "daily")


def query_metrics(warehouse: Warehouse, metrics: Sequence[str], start: str | Date, end: str | Date, aggregate: str = "daily") -> DataFrame:
    """user_id, date (bucket label), one column per metric; a label exists if any metric has a value there.

    One aggregation per table; only several tables meet in a second, small one.
    """
    found = checked(metrics, aggregate)
    first, last = check_range(start, end)
    parts = []
    for table in dict.fromkeys(m.table for m in found):
        own = [m for m in found if m.table == table]
        rows = in_range(warehouse[table], first, last).filter(F.col("date").isNotNull())
        if table == "activities" and (aggregate == "daily" or not all(m.additive for m in own)):
            rows = rows.groupBy("user_id", "date").agg(*[m.expr().alias(m.name) for m in own])
            cells = {m.name: F.col(m.name) for m in own}
        else:  # what adds up over days adds up over the bucket at once
            cells = {m.name: m.expr() for m in own}
        label = bucket_label(F.col("date"), aggregate).alias("label")
        if aggregate != "daily":
            direct = table == "activities" and all(m.additive for m in own)
            value = lambda m: cells[m.name] if direct else (F.sum if m.additive else mean)(cells[m.name])
            rows = rows.groupBy("user_id", label).agg(*[half_even(value(m)).alias(m.name) for m in own])
        else:
            rows = rows.select("user_id", label, *[cells[m.name].cast("double" if m.numeric else "string").alias(m.name) for m in own])
        parts.append(rows.filter(reduce(Column.__or__, [F.col(m.name).isNotNull() for m in own])))
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumnRenamed("label", "date")
    if len(parts) == 1:
        return wide.select("user_id", "date", *metrics)
    return wide.groupBy("user_id", "date").agg(*[F.max(m).alias(m) for m in metrics])


def metric_stats(warehouse: Warehouse, metrics: Sequence[str], start: str | Date, end: str | Date, aggregate: str = "daily") -> DataFrame:
    """user_id, metric, mean, min, max, sd over the values query_metrics shows; nulls where a user has none."""
    found = checked(metrics, aggregate)
    first, last = check_range(start, end)
    values = metric_values(warehouse, found, first, last)
    numeric = [m.name for m in found if m.numeric]
    long = bucketed(values, found, aggregate).filter(F.col("metric").isin(numeric))
    grouped = long.groupBy("user_id", "metric").agg(in_order("label", value="value").alias("xs"), F.min("value").alias("min"), F.max("value").alias("max"))
    stats = grouped.withColumn("s", mean_and_spread(F.col("xs"))).select("user_id", "metric", half_even("s.mean").alias("mean"), "min", "max", half_even("s.sd").alias("sd"))
    users = values.select("user_id").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, numeric))))
    return users.join(stats, ["user_id", "metric"], "left")
