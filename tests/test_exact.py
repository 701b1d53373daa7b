"""Rounding, spreads and coefficients: the same as plain Python's, whatever the partitions."""

import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from pulsefleet.functions.moments import in_order, mean_and_spread, pearson
from pulsefleet.functions.rounding import half_even
from pulsefleet.operators import correlate, series
from pulsefleet.sources.schemas import TABLES

from .planted import FIRST, day


def spread(values):
    m = sum(values) / len(values)
    return m, math.sqrt(sum((v - m) * (v - m) for v in values) / len(values))


def coefficient(xs, ys):
    (mx, _), (my, _) = spread(xs), spread(ys)
    both = lambda p, mp, q, mq: sum((a - mp) * (b - mq) for a, b in zip(p, q, strict=True))
    return both(xs, mx, ys, my) / math.sqrt(both(xs, mx, xs, mx) * both(ys, my, ys, my))


def test_rounding_equals_pythons(spark):
    r = random.Random(1)
    cases = [k / 10000 for k in range(-20000, 20001)] + [k / 8 for k in range(-500, 500)] + [r.uniform(-1e3, 1e3) for _ in range(5000)]
    cases += [r.uniform(-1, 1) * 10.0 ** r.randint(-12, 18) for _ in range(5000)] + [r.randrange(2**42, 2**46) / 1000 + 0.0005 for _ in range(5000)]
    cases += [(r.randrange(2**42, 2**43) + 0.5) / 1024 for _ in range(2000)] + [(2 * r.randrange(10**6) + 1) * 5 * 10.0**-d for d in (2, 3, 4) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in cases], "x double")
    for d in range(4):
        wrong = [(x, got) for x, got in df.select("x", half_even("x", d).alias("y")).collect() if round(x, d) != got]
        assert not wrong, (d, wrong[:5])
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (None,)], "x double").select(half_even("x").alias("y")).collect()
    assert math.isnan(odd[0]["y"]) and odd[1]["y"] == math.inf and odd[2]["y"] is None


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_spread_has_the_same_bits_whatever_the_partitions(spark, parts):
    r = random.Random(2)
    groups = {0: [10.67, 40.0], 1: [0.1] * 7, 2: [r.uniform(-1, 1) * 10.0 ** r.randint(-8, 8) for _ in range(300)], 3: [1e16, 1.0, -1e16, 3.0], 4: [5.5]}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, x double").repartition(parts)
    got = df.groupBy("g").agg(in_order("i", value="x").alias("xs")).select("g", mean_and_spread(F.col("xs")).alias("s"), pearson(F.transform("xs", lambda v: F.struct(v["at"].cast("double").alias("x"), v["value"].alias("y"))), 5).alias("r")).collect()
    assert {x["g"]: (x["s"]["mean"], x["s"]["sd"]) for x in got} == {g: spread(xs) for g, xs in groups.items()}
    assert round(next(x["s"]["sd"] for x in got if x["g"] == 0), 2) == 14.67
    assert {x["g"]: x["r"] for x in got} == {0: None, 1: None, 2: coefficient([float(i) for i in range(300)], groups[2]), 3: None, 4: None}


def table_of(spark, name, rows, schema):
    return {t: spark.createDataFrame(rows if t == name else [], schema if t == name else s) for t, s in TABLES.items()}


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_lags_that_tie_keep_the_first(spark, parts):
    """Steps repeat every other day, so all lags are as good as each other, odd ones with -1: -7 is the first of them."""
    rows = [(1, day(i), 3000 + 1000 * (i % 2), 20 + 7 * (i % 2)) for i in range(30)]
    wh = table_of(spark, "daily_wellness", rows, "user_id long, date date, steps int, stress_avg int")
    wh["daily_wellness"] = wh["daily_wellness"].repartition(parts)
    got = correlate.correlate(wh, "steps", "stress_avg", FIRST + timedelta(days=8), day(21), scan_lags=True).collect()[0]
    assert (got["best_lag"], got["best_r"], got["pearson_r"], got["spearman_rho"]) == (-7, -1.0, 1.0, 1.0)


def test_weekly_spread_rounds_as_plain_python(spark):
    rows = [(1, day(0), 10.67), (1, day(7), 40.0)]
    wh = table_of(spark, "daily_wellness", rows, "user_id long, date date, distance_m double")
    assert series.metric_stats(wh, ["distance_m"], FIRST, day(13), "weekly").collect()[0]["sd"] == 14.67
