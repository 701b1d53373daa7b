"""Device bundles: decoded messages aggregated to one row per bundle, flags, and rows for the tables.

Messages: see ``schemas.DEVICE``; ``u`` holds the numbered fields. Message order is (file, seq). All
totals come from one aggregation in two levels, so the per-minute samples shrink before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.functions.calendar import day_in_name, device_seconds
from pulsefleet.functions.rounding import half_even, whole

KEY = ["user_id", "bundle"]
# Fixed values of the message format.
SLEEP_STAGES = {1: "awake", 2: "light", 3: "deep", 4: "rem"}
HRV_STATUS = {0: "none", 1: "poor", 2: "low", 3: "unbalanced", 4: "balanced"}
SLEEP_EVENT = 74
PLAUSIBLE_HR = (30, 120)
RHR_MARGIN = 10
SPARSE_GAP_MIN = 45


def lookup(code: Column, names: dict[int, str]) -> Column:
    pairs = [F.lit(x) for k, v in names.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), code)


def field(n: int) -> Column:
    return F.try_element_at("u", F.lit(f"unknown_{n}"))


def named(name: str, value: Column) -> Column:
    return F.when(F.col("name") == name, value)


def first_seen_mode(messages: DataFrame, name: str, value: Column, low: int, high: int, out: str) -> DataFrame:
    """(bundle, out): the most frequent whole value of the range, the one seen first among equals."""
    votes = messages.filter(F.col("name") == name).select(*KEY, "order", value.try_cast("int").alias("v")).filter(F.col("v").between(low, high))
    counted = votes.groupBy(*KEY, "v").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("seen"))
    # Later first sightings sort lower: compare (n, -file rank) through min_by on (-n, seen).
    return counted.groupBy(*KEY).agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("seen"))).alias(out))


def ordered(messages: DataFrame) -> DataFrame:
    return messages.withColumn("order", F.struct("file", "seq"))


def summary(messages: DataFrame) -> DataFrame:
    """Heart rate, stress, counters, sleep window, offset, last HRV and skin message, modes, last sample: one pass.

    Messages are added up per activity type and per vote first, where tasks shrink them, then per bundle.
    """
    hr = named("monitoring", F.when(F.col("heart_rate") > 0, F.col("heart_rate")))
    stress = named("stress_level", F.when(F.col("stress_level_value").between(0, 100), F.col("stress_level_value")))
    marker = (F.col("name") == "event") & (F.col("event") == SLEEP_EVENT) & F.col("ts").isNotNull()
    begins = F.coalesce(F.col("event_type") == "start", F.lit(False))
    offset = named("timestamp_correlation", whole(F.expr("timestampdiff(SECOND, ts, local_ts)") / 60))
    score, rate = named("unknown_521", field(1).try_cast("int")), named("unknown_281", field(9).try_cast("int"))
    vote = F.coalesce(F.when(score.between(0, 100), score), F.when(rate.between(*PLAUSIBLE_HR), rate))
    at = F.col("order")
    hrv, skin = (F.when(F.col("name") == n, at) for n in ("unknown_370", "unknown_398"))
    kind = F.col("name").isin("monitoring", "unknown_521", "unknown_281")
    parts = ordered(messages).withColumns({"kind": F.when(kind, F.col("name")), "type": named("monitoring", F.col("activity_type")), "vote": vote}).groupBy(*KEY, "kind", "type", "vote").agg(
        F.min(hr).alias("hr_min"), F.max(hr).alias("hr_max"), F.sum(hr).alias("hr_sum"), F.count(hr).alias("hr_n"),
        F.sum(stress).alias("stress_sum"), F.count(stress).alias("stress_n"), F.max(stress).alias("stress_max"),
        F.max("steps").alias("steps"), F.max("distance").alias("distance"), F.min(F.when(F.col("distance").isNotNull(), at)).alias("distance_at"),
        F.min(F.when(marker & begins, F.col("ts"))).alias("sleep_start"), F.max(F.when(marker & ~begins, F.col("ts"))).alias("sleep_stop"),
        F.min(F.when(offset.isNotNull(), F.struct(at.alias("at"), offset.alias("offset")))).alias("offset"),
        F.max(named("monitoring", F.col("ts"))).alias("last_seen"),
        F.max(hrv).alias("hrv_at"), F.max_by("u", hrv).alias("hrv"), F.max(skin).alias("skin_at"), F.max_by("u", skin).alias("skin"),
        F.count(F.lit(1)).alias("n"), F.min("order").alias("seen"),
    )
    of = lambda name, column: F.when(F.col("kind") == name, F.col(column))
    steps = F.sum(F.greatest(of("monitoring", "steps"), F.when(of("monitoring", "steps").isNotNull(), F.lit(0).cast("long"))))
    # Types' distances are added up in the order in which the bundle's messages first give them, as rounding depends on it.
    types = F.when(of("monitoring", "distance").isNotNull(), F.struct(F.col("distance_at").alias("at"), F.greatest("distance", F.lit(0.0)).alias("d")))
    distance = lambda found: F.when(F.size(found) > 0, F.aggregate(F.array_sort(found), F.lit(0.0), lambda total, x: total + x.d))
    # The most frequent vote, the one seen first among equals.
    mode = lambda name: F.min_by("vote", F.when((F.col("kind") == name) & F.col("vote").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("seen"))))
    return parts.groupBy(*KEY).agg(
        F.min("hr_min").alias("hr_min"),
        whole(F.try_divide(F.sum("hr_sum"), F.sum("hr_n"))).alias("hr_avg"),
        F.max("hr_max").alias("hr_max"),
        F.sum("hr_n").alias("hr_samples"),
        steps.alias("steps"),
        F.collect_list(types).alias("distances"),
        whole(F.try_divide(F.sum("stress_sum"), F.sum("stress_n"))).alias("stress_avg"),
        F.max("stress_max").alias("stress_max"),
        F.min("sleep_start").alias("sleep_start"),
        F.max("sleep_stop").alias("sleep_stop"),
        F.coalesce(F.min("offset")["offset"], F.lit(0)).alias("offset_min"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("hrv", "hrv_at").alias("hrv"),
        F.max_by("skin", "skin_at").alias("skin"),
        mode("unknown_521").alias("sleep_score"),
        mode("unknown_281").alias("rhr_on_device"),
    ).withColumn("distance_sum", distance(F.col("distances"))).withColumn("distance_m", half_even("distance_sum", 1)).drop("distances", "distance_sum")


def stages(messages: DataFrame) -> DataFrame:
    """Minutes per sleep stage and the largest logging gap; a record holds until the next one; two records at least."""
    rows = messages.filter("name = 'unknown_275'").select(*KEY, field(253).try_cast("long").alias("at"), field(0).try_cast("int").alias("stage")).filter("at is not null and stage is not null")
    until = F.lead("at").over(Window.partitionBy(*KEY).orderBy("at", "stage"))
    held = rows.withColumn("held", until - F.col("at")).filter("held is not null")
    name = F.coalesce(lookup(F.col("stage"), SLEEP_STAGES), F.lit("other"))
    minutes = [F.floor(F.sum(F.when(name == s, F.col("held")).otherwise(0)) / 60).cast("int").alias(f"{s}_min") for s in ("deep", "light", "rem", "awake")]
    return held.groupBy(*KEY).agg(*minutes, whole(F.max("held") / 60).alias("max_logging_gap_min"))


def naps(messages: DataFrame) -> DataFrame:
    """(bundle, recorded, nap_min): naps in order, start and end in device seconds, the nap's own offset."""
    rows = messages.filter("name = 'unknown_412'").select(*KEY, field(0).try_cast("long").alias("a"), field(2).try_cast("long").alias("b"), field(1).try_cast("long").alias("own")).filter("b > a")
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("a", "b", "own"))).alias("recorded"), F.sum(whole((F.col("b") - F.col("a")) / 60)).cast("int").alias("nap_min"))


def local_naps(recorded: str, offset: str) -> Column:
    """Naps by the wall clock, in the nap's own or else the bundle's offset; an empty list without any."""
    at = lambda seconds, own: device_seconds(seconds + F.coalesce(own, F.col(offset)) * 60)
    nap = lambda x: F.struct(at(x.a, x.own).alias("start"), at(x.b, x.own).alias("end"), whole((x.b - x.a) / 60).alias("duration_min"))
    return F.coalesce(F.transform(recorded, nap), F.array().cast("array<struct<start:timestamp_ntz,end:timestamp_ntz,duration_min:int>>"))


def decode_bundles(messages: DataFrame) -> DataFrame:
    """One row per bundle with all sections; what has no data is null, naps are an empty list.

    Three aggregations of the messages (all totals, stages, naps), joined where they already lie by bundle.
    """
    local = lambda c: F.col(c) + F.make_dt_interval(mins=F.col("offset_min"))
    asleep = F.col("sleep_stop") > F.col("sleep_start")
    part = lambda n: F.try_element_at("hrv", F.lit(f"unknown_{n}"))
    heat = lambda n: F.try_element_at("skin", F.lit(f"unknown_{n}"))
    status = part(6)
    joined = summary(messages).join(stages(messages), KEY, "left").join(naps(messages), KEY, "left")
    joined = joined.withColumns({f"heat_{n}": heat(n) for n in (1, 2, 4)})  # looked up once each, however often rounding asks
    out = joined.select(
        *KEY, "hr_min", "hr_avg", "hr_max", "hr_samples", "steps", "distance_m", "stress_avg", "stress_max",
        F.when(asleep, local("sleep_start")).alias("sleep_start"),
        F.when(asleep, local("sleep_stop")).alias("sleep_end"),
        F.when(asleep, whole(F.expr("timestampdiff(SECOND, sleep_start, sleep_stop)") / 60)).alias("sleep_min"),
        "deep_min", "light_min", "rem_min", "awake_min", "max_logging_gap_min", "sleep_score",
        whole(part(1) / 128).alias("last_night_avg"),
        whole(part(0) / 128).alias("weekly_avg"),
        whole(part(2) / 128).alias("high_5min"),
        F.coalesce(lookup(status.try_cast("int"), HRV_STATUS), status.try_cast("bigint").cast("string")).alias("hrv_status"),
        whole(part(4) / 128).alias("baseline_low"),
        whole(part(5) / 128).alias("baseline_high"),
        half_even("heat_4", 1).alias("skin_nightly_c"),
        half_even("heat_1", 2).alias("skin_deviation_c"),
        half_even("heat_2", 3).alias("skin_avg_dev_7d"),
        "rhr_on_device",
        local_naps("recorded", "offset_min").alias("naps"),
        "nap_min",
        local("last_seen").alias("last_local"),
    )
    return out.withColumn("date", F.coalesce(day_in_name(F.col("bundle")), F.to_date("sleep_end"), F.to_date("last_local"))).withColumn("flags", quality_flags()).drop("last_local")


def quality_flags() -> Column:
    """Flags of a decoded bundle: a resting rate far above the lowest one seen; sparse stage logging."""
    far = F.col("rhr_on_device") > F.col("hr_min") + RHR_MARGIN
    sparse = F.col("max_logging_gap_min") >= SPARSE_GAP_MIN
    return F.filter(F.array(F.when(far, "rhr_far_above_hr_floor"), F.when(sparse, "sparse_sleep_stage_logging")), lambda f: f.isNotNull())


def device_rows(decoded: DataFrame, carry: Sequence[str] = ("bundle",)) -> dict[str, DataFrame]:
    """Rows for sleep, hrv and daily_wellness, source ``fit``; a flagged resting rate is withheld.

    Rows without any value are left out, bundles without a date too (see ``undated``).
    """
    dated = decoded.filter("date is not null")
    key = ["user_id", "date", *carry]
    flags = F.when(F.size("flags") > 0, F.col("flags"))
    parts = {
        "sleep": [F.col("sleep_score").alias("score"), F.col("sleep_min").cast("double").alias("duration_min"), "deep_min", "light_min", "rem_min", "awake_min", F.col("sleep_start").alias("start_ts"), F.col("sleep_end").alias("end_ts"), "nap_min", flags.alias("quality_flags")],
        "hrv": ["last_night_avg", "weekly_avg", "high_5min", F.col("hrv_status").alias("status"), "baseline_low", "baseline_high"],
        "daily_wellness": [F.when(~F.array_contains("flags", "rhr_far_above_hr_floor"), F.col("rhr_on_device")).alias("resting_hr"), F.col("hr_min").alias("min_hr"), F.col("hr_max").alias("max_hr"), F.col("steps").cast("int").alias("steps"), "distance_m", "stress_avg", "stress_max", F.col("skin_deviation_c").alias("skin_temp_dev_c")],
    }
    out = {}
    for table, cells in parts.items():
        rows = dated.select(*key, *cells)
        some = F.coalesce(*[F.col(c).cast("string") for c in rows.columns if c not in key]).isNotNull()
        out[table] = rows.filter(some).withColumn("source", F.lit("fit"))
    return out


def undated(decoded: DataFrame) -> DataFrame:
    """Bundles that no date can be found for: rejected from import."""
    return decoded.filter("date is null").select(*KEY)
