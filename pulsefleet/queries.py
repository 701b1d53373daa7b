"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Binding: ``events`` of the types view, purchase and signup are the days of daily_wellness, sleep and hrv,
``orders`` are activities, all ``events`` are the log of ingest attempts and the messages of devices,
``documents`` are raw snapshots; vendor payloads are written as JSON from orders and events and parsed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefleet.functions.rounding import half_even
from pulsefleet.operators import anomaly, baseline, correlate, device, ledger, merge, parse, readout, series, views
from pulsefleet.plans import device_import as device_import_plan
from pulsefleet.plans import rebuild
from pulsefleet.sources import snapshots, store, tables
from pulsefleet.sources import snapshot_files as snapshot_tree
from pulsefleet.sources import warehouse as stored
from pulsefleet.sources.schemas import columns
from pulsefleet.streaming import ingest

START, END = "2024-01-03", "2024-01-28"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(rows: DataFrame, table: str) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns(table)])


def warehouse(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events, orders = read(spark, sf_dir, "events"), read(spark, sf_dir, "orders")
    money = F.col("value").cast("decimal(18,2)")
    days = lambda kind: events.filter((F.col("event_type") == kind) & F.col("user_id").isNotNull()).groupBy("user_id", F.to_date("ts").alias("date"))
    wellness = days("view").agg(
        F.floor(F.min(money)).cast("int").alias("resting_hr"),
        F.count(F.lit(1)).cast("int").alias("steps"),
        F.sum(money).cast("double").alias("distance_m"),
        F.floor(F.max(money)).cast("int").alias("stress_avg"),
        F.lit("api").alias("source"),
    )
    sleep = days("purchase").agg(
        F.floor(F.max(money)).cast("int").alias("score"),
        F.sum(money).cast("double").alias("duration_min"),
        F.count(F.lit(1)).cast("int").alias("deep_min"),
        F.array(F.lit("short_sleep")).alias("quality_flags"),
        F.lit("api").alias("source"),
    )
    hrv = days("signup").agg(
        F.floor(F.min(money)).cast("int").alias("last_night_avg"),
        F.floor(F.max(money)).cast("int").alias("weekly_avg"),
        F.when(F.count(F.lit(1)) > 1, "balanced").otherwise("low").alias("status"),
    )
    training = days("click").agg(F.sum(money).cast("double").alias("acute_load"))
    acts = orders.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("activity_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("start_ts"),
        F.col("o_orderstatus").alias("name"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("distance_m"),
        F.lit(1800.0).alias("duration_s"),
    )
    found = {"daily_wellness": wellness, "sleep": sleep, "hrv": hrv, "training_status": training, "activities": acts}
    return {name: typed(rows, name) for name, rows in found.items()}


def wellness_activities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """As warehouse, with the last type of events as activities, so that they fall into the same month."""
    out = warehouse(spark, sf_dir)
    events = read(spark, sf_dir, "events").filter("event_type = 'error' and user_id is not null")
    acts = events.select("user_id", F.col("event_id").alias("activity_id"), F.to_date("ts").alias("date"), F.col("ts").cast("timestamp_ntz").alias("start_ts"), F.col("event_type").alias("type"), F.col("value").cast("decimal(18,2)").cast("double").alias("distance_m"))
    return out | {"activities": typed(acts, "activities")}


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest log: every event is an attempt; errors are the events of that type and every tenth event."""
    e = read(spark, sf_dir, "events").filter("user_id is not null")
    status = F.when((F.col("event_type") == "error") | (F.col("event_id") % 10 == 3), "error").when(F.col("event_id") % 10 == 5, "empty").otherwise("ok")
    return e.select("user_id", F.col("event_type").alias("endpoint"), F.to_date("ts").alias("date"), F.col("event_id").alias("seq"), status.alias("status"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"), F.col("ts").cast("timestamp").alias("at"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device messages: each event gives one of the eleven kinds, by its number; a bundle is a user's day.

    Folders of every third user have no date in their names. The clocks' offset changes from message to message.
    """
    e = read(spark, sf_dir, "events").filter("user_id is not null")
    kinds = ("monitoring", "monitoring", "stress_level", "event", "timestamp_correlation", "unknown_275", "unknown_281", "unknown_370", "unknown_412", "unknown_521")
    name = F.when(F.col("event_id") % 20 == 11, "unknown_398").otherwise(F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 10 + 1).cast("int")))
    v = F.floor("value").cast("int")
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    u = F.when(name == "unknown_275", F.create_map(F.lit("unknown_253"), secs.cast("double"), F.lit("unknown_0"), (v % 5).cast("double")))
    u = u.when(name == "unknown_281", F.create_map(F.lit("unknown_9"), (v % 150).cast("double")))
    u = u.when(name == "unknown_370", F.create_map(F.lit("unknown_0"), (v * 100).cast("double"), F.lit("unknown_1"), (v * 64).cast("double"), F.lit("unknown_2"), (v * 32).cast("double"), F.lit("unknown_4"), v * 10.0 + 1, F.lit("unknown_5"), v * 20.0 + 3, F.lit("unknown_6"), (v % 6).cast("double")))
    u = u.when(name == "unknown_398", F.create_map(F.lit("unknown_1"), v / 1000 - 0.25, F.lit("unknown_2"), v / 10000, F.lit("unknown_4"), 30 + v / 256))
    u = u.when(name == "unknown_412", F.create_map(F.lit("unknown_0"), (v * 1000).cast("double"), F.lit("unknown_2"), (v * 1000 + 1830).cast("double"), F.lit("unknown_1"), F.when(v % 2 == 0, 60.0)))
    u = u.when(name == "unknown_521", F.create_map(F.lit("unknown_1"), (v % 7).cast("double")))
    day = F.date_format("ts", "yyyy-MM-dd")
    bundle = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("export "), F.replace(day, F.lit("-"), F.lit("")))).otherwise(F.concat(F.lit("night-"), day))
    return e.select(
        "user_id",
        bundle.alias("bundle"),
        F.lit("a.fit").alias("file"),
        F.col("event_id").alias("seq"),
        name.alias("name"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("event_id") % 7 * 90).cast("int"))).alias("local_ts"),
        v.alias("heart_rate"),
        F.col("event_type").alias("activity_type"),
        v.cast("bigint").alias("steps"),
        F.col("value").alias("distance"),
        v.alias("stress_level_value"),
        F.lit(74).alias("event"),
        F.when(F.col("event_type") == "view", "start").otherwise("stop").alias("event_type"),
        u.cast("map<string,double>").alias("u"),
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.lit(1).cast("long").alias("user_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"), F.col("source").alias("endpoint"), F.timestamp_seconds("doc_id").alias("fetched_at"), F.col("text").alias("content"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor payloads as JSON: activities from orders, the daily endpoints from events' user-days."""
    o = read(spark, sf_dir, "orders")
    item = F.struct(F.col("o_orderkey").alias("activityId"), F.col("o_orderstatus").alias("activityName"), F.struct(F.col("o_orderpriority").alias("typeKey")).alias("activityType"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("startTimeLocal"), F.col("o_totalprice").alias("distance"), (F.col("o_custkey") * 10).cast("double").alias("duration"), (F.col("o_custkey") % 200 + 0.5).alias("averageHR"))
    acts = o.groupBy(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date")).agg(F.to_json(F.collect_list(item)).alias("content")).withColumn("endpoint", F.lit("activities"))
    e = read(spark, sf_dir, "events").filter("user_id is not null")
    money = F.col("value").cast("decimal(18,2)")
    days = e.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum(money).cast("double").alias("s"), F.min(money).cast("double").alias("lo"), F.max(money).cast("double").alias("hi"))
    summary = F.struct(F.col("n").alias("totalSteps"), F.col("s").alias("totalDistanceMeters"), F.col("lo").alias("restingHeartRate"), F.col("hi").alias("floorsAscended"), (F.col("n") * 1.5).alias("totalKilocalories"))
    stage = lambda c: F.struct(F.struct(F.struct(F.floor(c).alias("value")).alias("overall")).alias("sleepScores"), (F.col("n") * 3601).alias("sleepTimeSeconds"), (F.col("n") * 90).alias("deepSleepSeconds"), (F.col("n") * 30).alias("lightSleepSeconds"), F.lit(1704067200000).alias("sleepStartTimestampLocal"))
    sleep = F.struct(stage(F.col("hi")).alias("dailySleepDTO"), F.col("n").alias("restlessMomentsCount"), F.when(F.col("n") > 2, F.col("lo")).alias("avgSkinTempDeviationC"))
    hrv = F.struct(F.when(F.col("n") > 1, F.struct(F.col("n").alias("lastNightAvg"), F.lit("BALANCED").alias("status"), F.struct(F.floor("lo").alias("balancedLow"), F.floor("hi").alias("balancedUpper")).alias("baseline"))).alias("hrvSummary"))
    device_map = F.create_map(F.lit("d9"), F.struct(F.lit("PRODUCTIVE_1").alias("trainingStatusFeedbackPhrase"), F.struct(F.col("s").alias("dailyTrainingLoadAcute"), F.lit(1.1).alias("dailyAcuteChronicWorkloadRatio")).alias("acuteTrainingLoadDTO")), F.lit("d1"), F.struct(F.lit("OTHER").alias("trainingStatusFeedbackPhrase"), F.struct(F.lit(0.0).alias("dailyTrainingLoadAcute"), F.lit(0.0).alias("dailyAcuteChronicWorkloadRatio")).alias("acuteTrainingLoadDTO")))
    training = F.struct(F.struct(device_map.alias("latestTrainingStatusData")).alias("mostRecentTrainingStatus"), F.struct(F.struct(F.col("n").cast("double").alias("vo2MaxPreciseValue")).alias("generic")).alias("mostRecentVO2Max"))
    kinds = {"usersummary": summary, "sleep": sleep, "hrv": hrv, "training_status": training}
    rows = acts.select("user_id", "date", "endpoint", "content")
    for k, v in kinds.items():  # a branch each: a filter on the endpoint drops the others
        rows = rows.unionByName(days.select("user_id", "date", F.lit(k).alias("endpoint"), F.to_json(v).alias("content")))
    return rows.select("user_id", snapshots.daily_path(F.col("date"), F.col("endpoint")).alias("path"), "date", "endpoint", F.col("date").cast("timestamp").alias("fetched_at"), "content")


def table_query(table: str, *names: str):
    return lambda spark, sf_dir: rebuild.rebuild(payloads(spark, sf_dir))[table].select(*names)


def trend(aggregate: str, *metrics: str):
    return lambda spark, sf_dir: series.query_metrics(wellness_activities(spark, sf_dir), metrics, START, END, aggregate)


TREND = ("resting_hr", "distance_m", "sleep_duration_min", "activity_count", "activity_distance_m")
VITALS = ("resting_hr", "hrv", "sleep_score", "skin_temp_dev_c", "stress_avg", "steps")


def partial_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers with different columns: views own heart rate and steps, purchases stress (null on
    odd days, a null that counts), signups the skin temperature; the highest event wins a column."""
    e = read(spark, sf_dir, "events").filter("user_id is not null")
    v = F.floor("value").cast("int")
    rows = e.select("user_id", F.to_date("ts").alias("date"), "event_id", "event_type", v.alias("v"))
    parts = [
        merge.contribution(rows.filter("event_type = 'view'").withColumns({"resting_hr": F.col("v"), "steps": F.col("v") * 10}), "daily_wellness", ["resting_hr", "steps"], "event_id"),
        merge.contribution(rows.filter("event_type = 'purchase'").withColumn("stress_avg", F.when(F.col("event_id") % 2 == 0, F.col("v"))), "daily_wellness", ["stress_avg"], "event_id"),
        merge.contribution(rows.filter("event_type = 'signup'").withColumns({"skin_temp_dev_c": F.col("v") / 4, "steps": F.col("v")}), "daily_wellness", ["skin_temp_dev_c", "steps"], "event_id"),
    ]
    return merge.fold(parts[0].unionByName(parts[1]).unionByName(parts[2]), "daily_wellness").select("user_id", "date", "resting_hr", "steps", "stress_avg", "skin_temp_dev_c")


def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views write as ``fit``, purchases as ``api``, signups without a source; which rows are admitted, and the result."""
    e = read(spark, sf_dir, "events").filter("user_id is not null and event_type in ('view', 'purchase', 'signup')")
    src = F.when(F.col("event_type") == "view", "fit").when(F.col("event_type") == "purchase", "api")
    rows = e.select("user_id", F.to_date("ts").alias("date"), "event_id", src.alias("source"), F.floor("value").cast("int").alias("resting_hr"), F.when(F.col("event_type") == "signup", F.col("value")).alias("skin_temp_dev_c"))
    full = merge.contribution(rows.filter("source is not null"), "daily_wellness", ["resting_hr", "source"], "event_id")
    skin = merge.contribution(rows.filter("source is null"), "daily_wellness", ["skin_temp_dev_c"], "event_id")
    admitted = merge.admit(full.unionByName(skin), "daily_wellness")
    out = merge.fold(admitted.filter("admitted"), "daily_wellness")
    blocked = admitted.groupBy("user_id", "date").agg(F.count_if(~F.col("admitted")).alias("blocked"))
    return out.join(blocked, ["user_id", "date"]).select("user_id", "date", "resting_hr", "skin_temp_dev_c", "source", "blocked")


def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device bundles imported on top of api sleep rows: what came in, what was skipped."""
    report = device_import_plan.import_bundles(messages(spark, sf_dir), {"sleep": warehouse(spark, sf_dir)["sleep"]}).report
    return report.select("user_id", "bundle", "date", F.array_join("imported", ",").alias("imported"), F.array_join("skipped", ",").alias("skipped"), F.array_join("flags", ",").alias("flags"))


def snapshot_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by number modulo 333, so that many rows fall on one path; those of source src0 exist already."""
    raw = raw_documents(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), (F.unix_timestamp("fetched_at") % 333).cast("string")))
    new = snapshots.new_snapshots(raw.filter("endpoint <> 'src0'"), raw.filter("endpoint = 'src0'"))
    return new.select("path", "endpoint", F.octet_length("content").cast("long").alias("bytes"), F.unix_timestamp("fetched_at").alias("fetched"))


def snapshot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_index(raw_documents(spark, sf_dir)).select("path", "date", "endpoint", "bytes", "sha256")


def activity_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshots.activity_snapshots(payloads(spark, sf_dir))
    return found.select("user_id", "path", "date", F.get_json_object("content", "$.distance").cast("double").alias("distance"))


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = attempts(spark, sf_dir)
    plan = ledger.sync_plan(ledger.fold_attempts(log), log, START, END, endpoints=("view", "purchase", "signup"))
    return plan.select("user_id", "date", "endpoint", F.col("turn").cast("int").alias("turn"))


def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = attempts(spark, sf_dir)
    folded = ledger.fold_attempts(log)
    return ledger.sync_report(folded, ledger.sync_plan(folded, log, START, END, force=True, endpoints=("view", "purchase", "signup")))


def ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fold_attempts(attempts(spark, sf_dir)).select("user_id", "endpoint", "date", "status", "attempts", "last_error", F.unix_timestamp("updated_at").alias("updated"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.coverage(warehouse(spark, sf_dir))


def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.sync_state_summary(ledger.fold_attempts(attempts(spark, sf_dir)))
    return out.select("user_id", F.unix_timestamp("last_sync").alias("last_sync"), "errors")


def day_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.day_views(wellness_activities(spark, sf_dir), START, END)
    return v.select("user_id", "date", F.get_json_object("wellness", "$.resting_hr").cast("int").alias("resting_hr"), F.get_json_object("wellness", "$.source").alias("source"), F.get_json_object("sleep", "$.duration_min").cast("double").alias("duration_min"), F.get_json_object("hrv", "$.status").alias("hrv_status"), F.get_json_object("training", "$.acute_load").cast("double").alias("acute_load"), F.array_join(F.transform("activities", lambda a: a.activity_id.cast("string")), ",").alias("activities"), F.array_join("flags", ",").alias("flags"))


def list_activities(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    rows = views.list_activities(warehouse(spark, sf_dir), **filters)
    return rows.select("user_id", "activity_id", "date", "name", "type", "distance_m", "rank", "n", "truncated")


def get_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("activity_id")).distinct()
    acts = warehouse(spark, sf_dir)["activities"]
    keys = keys.join(acts.select("user_id", "activity_id"), "activity_id")
    return views.get_activities({"activities": acts}, keys).select("user_id", "activity_id", "date", "name", "type", "distance_m")


def device_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = device.decode_bundles(messages(spark, sf_dir))
    return d.select("user_id", "bundle", "date", "hr_min", "hr_avg", "hr_max", "hr_samples", "steps", "distance_m", "stress_avg", "stress_max", "sleep_min", "last_night_avg", "weekly_avg", "hrv_status", "skin_nightly_c", "skin_deviation_c", "skin_avg_dev_7d", F.array_join("flags", ",").alias("flags"))


def device_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return device.stages(messages(spark, sf_dir))


def device_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = device.ordered(messages(spark, sf_dir))
    score = device.first_seen_mode(m, "unknown_521", device.field(1), 0, 100, "sleep_score")
    rate = device.first_seen_mode(m, "unknown_281", device.field(9), 30, 120, "rhr_on_device")
    return score.join(rate, ["user_id", "bundle"], "full")


def device_naps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = device.decode_bundles(messages(spark, sf_dir)).filter(F.size("naps") > 0)
    return n.select("user_id", "bundle", F.size("naps").cast("long").alias("naps"), "nap_min", F.date_format(F.col("naps")[0]["start"], "yyyy-MM-dd HH:mm:ss").alias("first_start"))


def device_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = device.device_rows(device.decode_bundles(messages(spark, sf_dir)))["daily_wellness"]
    return w.select("user_id", "bundle", "date", "resting_hr", "min_hr", "max_hr", "steps", "distance_m", "stress_avg", "skin_temp_dev_c", "source")


def clock(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def device_sleep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = device.device_rows(device.decode_bundles(messages(spark, sf_dir)))["sleep"]
    return w.select("user_id", "bundle", "date", "score", "duration_min", "deep_min", "light_min", "rem_min", "awake_min", clock("start_ts"), clock("end_ts"), "nap_min", F.array_join("quality_flags", ",").alias("quality_flags"), "source")


def device_hrv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = device.device_rows(device.decode_bundles(messages(spark, sf_dir)))["hrv"]
    return w.select("user_id", "bundle", "date", "last_night_avg", "weekly_avg", "high_5min", "status", "baseline_low", "baseline_high", "source")


def device_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sleep table after an import of all bundles on top of what the vendor gave."""
    api = warehouse(spark, sf_dir)["sleep"]
    done = device_import_plan.import_bundles(messages(spark, sf_dir), {"sleep": api})
    return done.tables["sleep"].select("user_id", "date", "score", "duration_min", "deep_min", "nap_min", "source")


def unknown_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.unknown_endpoints(raw_documents(spark, sf_dir))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.gaps(warehouse(spark, sf_dir), START, END)


def gaps_default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.gaps_by_user_range(warehouse(spark, sf_dir), ledger.fold_attempts(attempts(spark, sf_dir)), END)


def lag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.correlate(warehouse(spark, sf_dir), "distance_m", "sleep_duration_min", START, END, lag_days=1, scan_lags=True)


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.correlate(warehouse(spark, sf_dir), "distance_m", "sleep_duration_min", START, END, lag_days=1).drop("best_lag", "best_r")


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.baselines(warehouse(spark, sf_dir), VITALS, 14)


def baselines_fixed_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.baselines(warehouse(spark, sf_dir), None, 7, "2024-01-20")


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.anomalies(warehouse(spark, sf_dir), ("distance_m", "sleep_duration_min", "hrv"), START, END, 2.0)


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.streaks(warehouse(spark, sf_dir), ("distance_m", "sleep_duration_min", "stress_avg", "steps", "acute_load"), START, END)


def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.metric_stats(wellness_activities(spark, sf_dir), TREND, START, END, "weekly")


def categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.query_metrics(warehouse(spark, sf_dir), ("hrv", "hrv_status"), START, END)


def rebuild_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild.rebuild_counts(rebuild.rebuild(payloads(spark, sf_dir)))


def rebuilt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rebuild.rebuilt_ledger(payloads(spark, sf_dir))
    return rows.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("n"))


def table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sleep table after a first write and a second one that replaces its months."""
    folder, rows = tables.scratch_folder(spark, "sink"), warehouse(spark, sf_dir)["sleep"]
    tables.write_table(rows.withColumn("score", F.lit(0)).filter("user_id % 2 = 0"), "sleep", folder)
    tables.write_table(rows, "sleep", folder)
    held = spark.read.parquet(f"{folder}/sleep")
    return held.select("user_id", "date", "score", "duration_min", "source")


def device_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as a source holds them, and read again."""
    folder = tables.scratch_folder(spark, "messages")
    messages(spark, sf_dir).write.parquet(folder)
    return tables.device_messages(spark, folder).groupBy("bundle", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("heart_rate").alias("heart_rate"), F.min("seq").alias("first_seq"))


def ingested_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payloads taken in by ingest in two batches, even users first."""
    root, rows = tables.scratch_folder(spark, "ingest"), payloads(spark, sf_dir)
    for turn in (0, 1):
        ingest.ingest_batch(rows.filter(F.col("user_id") % 2 == turn), root)
    held = ingest.tables(spark, root)["activities"]
    return held.select("user_id", "activity_id", "date", clock("start_ts"), "name", "type", "duration_s", "distance_m", "avg_hr", half_even("avg_pace_s_per_km", 4).alias("pace"), "raw_path")


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as snapshot files (each user's daily ones and single activities), and the tree read by tasks."""
    root, d = tables.scratch_folder(spark, "snapshots"), read(spark, sf_dir, "documents")
    day, number = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("activities/"), number, F.lit(".json"))).otherwise(snapshots.daily_path(day, F.concat("source", F.lit("-"), number)))
    snapshot_tree.write_snapshot_tree(d.select((F.col("doc_id") % 7).alias("user_id"), path.alias("path"), F.col("text").alias("content")), root).write.parquet(f"{root}-log")
    held = snapshot_tree.read_snapshot_tree(spark, root)
    return snapshots.snapshot_index(held).select("user_id", "path", "date", "endpoint", "bytes", "sha256")


def stored_warehouse(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The warehouse written to a store and read from it, with its months and last days."""
    root = tables.scratch_folder(spark, "warehouse")
    batch = store.Store(spark, root).begin()
    stored.write_stored(batch, warehouse(spark, sf_dir))
    batch.publish()
    return stored.read_stored(store.Store(spark, root))


def stored_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.baselines(stored_warehouse(spark, sf_dir), VITALS, 14)


def stored_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sleep table after an import of all bundles into a store that held the vendor's rows."""
    root = tables.scratch_folder(spark, "import")
    batch = store.Store(spark, root).begin()
    stored.write_stored(batch, {"sleep": warehouse(spark, sf_dir)["sleep"]})
    batch.publish()
    device_import_plan.import_into(messages(spark, sf_dir), root)
    return stored.read_stored(store.Store(spark, root))["sleep"].select("user_id", "date", "score", "duration_min", "deep_min", "nap_min", "source")


def series_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last three weeks, numbered in the order they are shown in."""
    weeks = series.query_metrics(wellness_activities(spark, sf_dir), TREND[:3], START, END, "weekly")
    return readout.read_out(weeks, "series", last=3)


def gaps_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap report written in order; every row with the number of rows before it in its user's part of the file."""
    folder = tables.scratch_folder(spark, "report")
    readout.write_in_order(gaps(spark, sf_dir), "gaps", folder)
    held = spark.read.parquet(folder).select("*", F.col("_metadata.row_index").alias("at"))
    first = Window.partitionBy("user_id")  # a user lies in one file
    return held.select("user_id", "table", "date", (F.col("at") - F.min("at").over(first)).alias("rows_before"))


def default_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, from the instant of the last event: yesterday in two zones and the ranges of a job that names none."""
    seen = read(spark, sf_dir, "events").filter("user_id is not null").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("now"))
    a, b = readout.default_range(F.col("now"), "Asia/Tokyo", 7), readout.default_range(F.col("now"), "America/Los_Angeles", 30)
    return seen.select("user_id", a.start.alias("start"), a.end.alias("end"), b.start.alias("long_start"), b.end.alias("long_end"))


def iso(query):
    """The query with its days as YYYY-MM-DD text, the form all engines print alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])

    return run


PLAIN = {
    "trend_daily": trend("daily", *TREND[:4]),
    "trend_weekly": trend("weekly", *TREND),
    "trend_monthly": trend("monthly", *TREND),
    "metric_stats_weekly": metric_stats,
    "categorical_daily": categorical,
    "correlate_lag": correlation,
    "correlate_lag_scan": lag_scan,
    "baselines_latest": baselines,
    "baselines_fixed_end": baselines_fixed_end,
    "anomalies": anomalies,
    "streaks": streaks,
    "day_views": day_views,
    "list_activities_newest": lambda s, d: list_activities(s, d, limit=5),
    "list_activities_filtered": lambda s, d: list_activities(s, d, type="1-URGENT", start="1996-01-01", end="1999-12-31", min_distance_m=100000.0, limit=3),
    "get_activities": get_activities,
    "gaps": gaps,
    "gaps_default_range": gaps_default_range,
    "coverage": coverage,
    "sync_summary": sync_summary,
    "recent_errors": lambda s, d: ledger.recent_errors(ledger.fold_attempts(attempts(s, d))),
    "errors_in_range": lambda s, d: ledger.errors_in_range(ledger.fold_attempts(attempts(s, d)), START, END),
    "ledger_fold": ledger_fold,
    "sync_plan": sync_plan,
    "sync_report": sync_report,
    "partial_upsert": partial_upsert,
    "source_precedence": source_precedence,
    "import_report": import_report,
    "snapshot_index": snapshot_index,
    "snapshot_write_once": snapshot_write_once,
    "activity_fan_out": activity_fan_out,
    "unknown_endpoints": unknown_endpoints,
    "parse_usersummary": table_query("daily_wellness", "user_id", "date", "resting_hr", "steps", "distance_m", "floors_up", "calories_total", "skin_temp_dev_c", "source"),
    "parse_sleep": lambda s, d: rebuild.rebuild(payloads(s, d))["sleep"].select("user_id", "date", "score", "duration_min", "deep_min", "light_min", "restless_moments", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "source"),
    "parse_hrv": table_query("hrv", "user_id", "date", "last_night_avg", "status", "baseline_low", "baseline_high", "source"),
    "parse_training_status": table_query("training_status", "user_id", "date", "status", "vo2max", "acute_load", "load_ratio"),
    "parse_activities": lambda s, d: rebuild.rebuild(payloads(s, d))["activities"].select("user_id", "activity_id", "date", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "name", "type", "duration_s", "distance_m", "avg_hr", half_even("avg_pace_s_per_km", 4).alias("pace"), "raw_path"),
    "rebuild_counts": rebuild_counts,
    "rebuilt_ledger": rebuilt_ledger,
    "device_decode": device_decode,
    "device_stages": device_stages,
    "device_modes": device_modes,
    "device_naps": device_naps,
    "device_rows": device_rows,
    "device_sleep_rows": device_sleep_rows,
    "device_hrv_rows": device_hrv_rows,
    "device_import": device_import,
    "table_sink": table_sink,
    "device_source": device_source,
    "ingested_activities": ingested_activities,
    "snapshot_files": snapshot_files,
    "stored_baselines": stored_baselines,
    "stored_import": stored_import,
    "series_in_order": series_in_order,
    "gaps_in_order": gaps_in_order,
    "default_ranges": default_ranges,
}

QUERIES = {name: iso(query) for name, query in PLAIN.items()}

__all__ = ["QUERIES", "warehouse"]
