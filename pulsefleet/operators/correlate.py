"""Correlation of two metrics, with a lag and over a range of lags, per user.

All lags come from one window over (user, day): a range frame of the single day at distance k, so no
join per lag. Rows are dealt by user once; the pairing, the frames and the ranks reuse that. Coefficients
are taken over a user's pairs in the order of days, so that equal lags stay equal whatever the partitions.
"""

from __future__ import annotations

from datetime import date as Date
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.functions.calendar import check_range
from pulsefleet.functions.moments import in_order, pearson
from pulsefleet.functions.rounding import half_even
from pulsefleet.plans.registry import resolve

from .series import Warehouse, metric_values

MIN_PAIRS = 5
SCAN = range(-7, 8)


def average_rank(value: str) -> Column:
    """Rank within the user's pairs; ties share their mean rank."""
    ordered, same = Window.partitionBy("user_id").orderBy(value), Window.partitionBy("user_id", value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / 2


def correlate(warehouse: Warehouse, metric_a: str, metric_b: str, start: str | Date, end: str | Date, lag_days: int = 0, scan_lags: bool = False) -> DataFrame:
    """user_id, n, pearson_r, spearman_rho, lag_days, best_lag, best_r, note.

    A positive lag pairs ``metric_a`` on a day with ``metric_b`` that many days later. With
    ``scan_lags`` lags from -7 to 7 are tried in order; a lag replaces the best so far if its
    coefficient is larger in size than the best one's rounded to 3 digits.
    """
    a = resolve([metric_a], "correlation", numeric=True)
    b = resolve([metric_b], "correlation", numeric=True)
    first, last = check_range(start, end)
    lags = sorted({lag_days, *(SCAN if scan_lags else ())})
    left = metric_values(warehouse, a, first, last).select("user_id", "date", F.col("value").alias("a"), F.lit(None).cast("double").alias("b"))
    right = metric_values(warehouse, b, first + timedelta(days=lags[0]), last + timedelta(days=lags[-1])).select("user_id", "date", F.lit(None).cast("double").alias("a"), F.col("value").alias("b"))
    days = left.unionByName(right).repartition("user_id").groupBy("user_id", "date").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    numbered = days.withColumn("day", F.unix_date("date"))
    by_day = Window.partitionBy("user_id").orderBy("day")
    paired = numbered.withColumns({f"b_{i}": F.max("b").over(by_day.rangeBetween(k, k)) for i, k in enumerate(lags)})
    main = lags.index(lag_days)
    paired = paired.withColumn("y", F.when(F.col("a").isNotNull(), F.col(f"b_{main}"))).withColumn("x", F.when(F.col("y").isNotNull(), F.col("a")))
    scan = [i for i, k in enumerate(lags) if scan_lags and k in SCAN]
    held = paired.groupBy("user_id").agg(
        F.count("x").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct(F.col("day").alias("at"), F.col("a"), F.array(*[F.col(f"b_{i}") for i in range(len(lags))]).alias("b"))))).alias("rows"),
    )
    of_lag = lambda i: F.transform(F.filter("rows", lambda r: r["b"][i].isNotNull()), lambda r: F.struct(r["a"].alias("x"), r["b"][i].alias("y")))
    pairs = held.select("user_id", "n", of_lag(main).alias("main"), F.array(*[F.struct(F.lit(lags[i]).alias("lag"), of_lag(i).alias("pairs")) for i in scan]).alias("lags"))
    none_found = F.array().cast("array<struct<lag:int,r:double>>")
    found = F.transform("lags", lambda x: F.struct(x["lag"].alias("lag"), pearson(x["pairs"], MIN_PAIRS).alias("r"))) if scan else none_found
    totals = pairs.select("user_id", "n", pearson(F.col("main"), MIN_PAIRS).alias("r"), found.alias("scan"))
    none = F.struct(F.lit(None).cast("int").alias("lag"), F.lit(None).cast("double").alias("r"))
    better = lambda best, x: F.when(x.r.isNotNull() & (best.r.isNull() | (F.abs(x.r) > F.abs(best.r))), F.struct(x.lag.alias("lag"), half_even(x.r, 3).alias("r"))).otherwise(best)
    totals = totals.withColumn("best", F.aggregate("scan", none, better))
    ranked = paired.filter(F.col("x").isNotNull()).select("user_id", "day", average_rank("x").alias("rx"), average_rank("y").alias("ry"))
    ranks = ranked.groupBy("user_id").agg(in_order("day", x="rx", y="ry").alias("pairs")).select("user_id", pearson(F.col("pairs"), MIN_PAIRS).alias("rho"))
    note = F.when(F.col("n") < MIN_PAIRS, F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(f" overlapping days; need at least {MIN_PAIRS}"))).when(F.col("r").isNull(), "one of the series is constant over this range")
    return totals.join(ranks, "user_id", "left").select("user_id", "n", half_even("r", 3).alias("pearson_r"), half_even("rho", 3).alias("spearman_rho"), F.lit(lag_days).alias("lag_days"), F.col("best.lag").alias("best_lag"), F.col("best.r").alias("best_r"), note.alias("note"))
