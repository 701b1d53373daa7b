import json
from datetime import date, datetime
from functools import reduce
from itertools import permutations

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefleet.functions.rounding import half_even, whole
from pulsefleet.operators import device, merge, parse
from pulsefleet.plans import rebuild
from pulsefleet.plans.device_import import import_bundles, write_import
from pulsefleet.queries import typed
from pulsefleet.sources import snapshots
from pulsefleet.sources.schemas import DEVICE, RAW
from pulsefleet.sources.tables import device_messages, read_tables, write_table
from pulsefleet.sources import store as store_module
from pulsefleet.sources.store import Batch, Store
from pulsefleet.streaming.ingest import RAW_PARTS, index, ingest, ingest_batch, ledger
from pulsefleet.streaming.ingest import raw as raw_of
from pulsefleet.streaming.ingest import tables as warehouse_of

D = date(2026, 6, 1)
T = datetime(2026, 6, 2, 4)
SUMMARY = {"restingHeartRate": 51, "totalSteps": 9000, "floorsAscended": 12.62, "totalKilocalories": 2100.5, "averageSpo2": 95.5}
SLEEP = {
    "dailySleepDTO": {"sleepScores": {"overall": {"value": 82}}, "sleepTimeSeconds": 27330, "deepSleepSeconds": 5430, "sleepStartTimestampLocal": 1780351800000, "avgSleepStress": 17.5, "napTimeSeconds": None},
    "sleepHeartRate": [{"value": 50}] * 3,
    "restlessMomentsCount": 41,
    "avgSkinTempDeviationC": -0.3,
}
HRV = {"hrvSummary": {"lastNightAvg": 62, "status": "BALANCED", "baseline": {"balancedLow": 55, "balancedUpper": 70}}}
TRAINING = {"mostRecentTrainingStatus": {"latestTrainingStatusData": {"99": {"trainingStatusFeedbackPhrase": "PRODUCTIVE_3", "acuteTrainingLoadDTO": {"dailyTrainingLoadAcute": 410.0, "dailyAcuteChronicWorkloadRatio": 1.2}}, "11": {"trainingStatusFeedbackPhrase": "OTHER"}}}, "mostRecentVO2Max": {"generic": {"vo2MaxPreciseValue": 51.3}}}
ACTS = [{"activityId": 90000000001, "activityName": "Run", "activityType": {"typeKey": "running"}, "startTimeLocal": "2026-06-01 07:00:00", "duration": 1800.0, "distance": 5000.0, "averageHR": 150.5}, {"activityName": "no id"}, {"activityId": 2, "duration": 60.0, "distance": 0}]


def raw(spark, *rows):
    """rows: (endpoint, payload[, day])"""
    out = []
    for endpoint, payload, *day in rows:
        d = (day or [D])[0]
        path = f"activities/{payload['activityId']}.json" if endpoint == "activity" else f"daily/{d:%Y}/{d}/{endpoint}.json"
        out.append((1, path, None if endpoint == "activity" else d, endpoint, T, payload if payload is None or isinstance(payload, str) else json.dumps(payload)))
    return spark.createDataFrame(out, RAW)


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0].asDict()


def test_usersummary(spark):
    got = one(parse.parse_usersummary(raw(spark, ("usersummary", SUMMARY))))
    assert (got["resting_hr"], got["floors_up"], got["calories_total"], got["spo2_avg"], got["source"], got["max_hr"]) == (51, 13, 2100, 95.5, "api", None)


def test_sleep_and_side_output(spark):
    rows = raw(spark, ("sleep", SLEEP))
    got = one(parse.parse_sleep(rows))
    assert (got["score"], got["duration_min"], got["deep_min"], got["avg_stress"], got["restless_moments"], got["nap_min"]) == (82, 455.5, 90, 18, 41, None)
    assert got["start_ts"] == datetime(2026, 6, 1, 22, 10)
    assert one(parse.parse_skin_temperature(rows)) == {"user_id": 1, "date": D, "skin_temp_dev_c": -0.3}
    # No sleep row, no skin temperature.
    assert parse.parse_skin_temperature(raw(spark, ("sleep", {"avgSkinTempDeviationC": 1.0}))).count() == 0


def test_hrv_and_training(spark):
    assert one(parse.parse_hrv(raw(spark, ("hrv", HRV))))["status"] == "balanced"
    got = one(parse.parse_training_status(raw(spark, ("training_status", TRAINING))))
    assert (got["status"], got["vo2max"], got["acute_load"], got["load_ratio"]) == ("productive_3", 51.3, 410.0, 1.2)


def test_activities(spark):
    got = {r["activity_id"]: r for r in parse.parse_activities(raw(spark, ("activities", ACTS))).collect()}
    run, bare = got[90000000001], got[2]
    assert (run["avg_pace_s_per_km"], run["avg_hr"], run["type"], run["start_ts"], run["raw_path"]) == (360.0, 150, "running", datetime(2026, 6, 1, 7), "activities/90000000001.json")
    assert bare["avg_pace_s_per_km"] is None and bare["date"] == D and len(got) == 2


@pytest.mark.parametrize("endpoint", ["usersummary", "sleep", "hrv", "training_status", "activities"])
@pytest.mark.parametrize("payload", ["null", "{}", "[]", "", "not json", '"text"', "3"])
def test_empty_payloads_give_no_rows(spark, endpoint, payload):
    for _, parser in parse.ROUTES[endpoint]:
        assert parser(raw(spark, (endpoint, payload))).count() == 0


def test_upsert_overwrites_owned_columns_only_in_any_order(spark):
    a = spark.createDataFrame([(1, D, 50, 100, 1)], "user_id long, date date, resting_hr int, steps int, seq int")
    b = spark.createDataFrame([(1, D, None, 2)], "user_id long, date date, steps int, seq int")
    ca = merge.contribution(a, "daily_wellness", ["resting_hr", "steps"], "seq")
    cb = merge.contribution(b, "daily_wellness", ["steps"], "seq")
    for parts in (ca.unionByName(cb), cb.unionByName(ca)):
        got = one(merge.fold(parts, "daily_wellness"))
        assert (got["resting_hr"], got["steps"]) == (50, None)  # the later null counts, the absent column does not
    stored = merge.fold(ca, "daily_wellness")
    assert one(merge.upsert(stored, cb, "daily_wellness")) == one(merge.fold(ca.unionByName(cb), "daily_wellness"))


def test_source_precedence(spark):
    rows = spark.createDataFrame([(1, D, "api", 50, 1), (1, D, "fit", 70, 2), (2, D, None, None, 1), (2, D, "fit", 60, 2)], "user_id long, date date, source string, resting_hr int, seq int")
    parts = merge.contribution(rows, "daily_wellness", ["source", "resting_hr"], "seq")
    held = {r["user_id"]: r["resting_hr"] for r in merge.fold(merge.admit(parts, "daily_wellness").filter("admitted"), "daily_wellness").collect()}
    forced = {r["user_id"]: r["resting_hr"] for r in merge.fold(merge.admit(parts, "daily_wellness", force=True).filter("admitted"), "daily_wellness").collect()}
    assert held == {1: 50, 2: 60} and forced == {1: 70, 2: 60}


def bundle(spark, *messages, name="2026-06-01"):
    out = []
    for seq, (kind, fields) in enumerate(messages):
        f = dict(fields)
        u = f.pop("u", None)
        out.append((1, name, "a.fit", seq, kind, f.get("ts"), f.get("local_ts"), f.get("heart_rate"), f.get("activity_type"), f.get("steps"), f.get("distance"), f.get("stress"), f.get("event"), f.get("event_type"), None if u is None else {f"unknown_{k}": float(v) for k, v in u.items()}))
    return spark.createDataFrame(out, DEVICE)


def test_bundle_totals(spark):
    t0, t1 = datetime(2026, 5, 31, 20), datetime(2026, 6, 1, 4)
    got = one(
        device.decode_bundles(
            bundle(
                spark,
                ("timestamp_correlation", {"ts": t0, "local_ts": datetime(2026, 5, 31, 22)}),
                ("monitoring", {"heart_rate": 48, "activity_type": "walk", "steps": 100, "distance": 80.04}),
                ("monitoring", {"heart_rate": 0, "activity_type": "walk", "steps": 90}),
                ("monitoring", {"heart_rate": 61, "activity_type": None, "steps": 7, "distance": 3.0}),
                ("stress_level", {"stress": -1}),
                ("stress_level", {"stress": 25}),
                ("event", {"event": 74, "event_type": "start", "ts": t0}),
                ("event", {"event": 74, "event_type": "stop", "ts": t1}),
                ("unknown_275", {"u": {253: 0, 0: 2}}),
                ("unknown_275", {"u": {253: 2700, 0: 3}}),
                ("unknown_275", {"u": {253: 3000, 0: 9}}),
                ("unknown_521", {"u": {1: 5}}),
                ("unknown_521", {"u": {1: 3}}),
                ("unknown_521", {"u": {1: 3}}),
                ("unknown_521", {"u": {1: 5}}),
                ("unknown_281", {"u": {9: 59}}),
                ("unknown_281", {"u": {9: 121}}),
                ("unknown_370", {"u": {0: 7680, 1: 7808, 6: 4}}),
                ("unknown_398", {"u": {1: -0.256, 2: 0.12345, 4: 33.27}}),
                ("unknown_412", {"u": {0: 1000, 2: 2830}}),
            )
        )
    )
    assert (got["hr_min"], got["hr_avg"], got["hr_max"], got["hr_samples"]) == (48, 54, 61, 2)
    assert (got["steps"], got["distance_m"], got["stress_avg"], got["sleep_min"]) == (107, 83.0, 25, 480)
    assert got["sleep_start"] == datetime(2026, 5, 31, 22) and (got["light_min"], got["deep_min"], got["max_logging_gap_min"]) == (45, 5, 45)
    assert (got["sleep_score"], got["rhr_on_device"], got["hrv_status"], got["last_night_avg"], got["weekly_avg"]) == (5, 59, "balanced", 61, 60)
    assert (got["skin_nightly_c"], got["skin_deviation_c"], got["skin_avg_dev_7d"], got["nap_min"]) == (33.3, -0.26, 0.123, 30)
    assert got["flags"] == ["rhr_far_above_hr_floor", "sparse_sleep_stage_logging"] and got["date"] == D
    rows = device.device_rows(device.decode_bundles(bundle(spark, ("monitoring", {"heart_rate": 48}), ("unknown_281", {"u": {9: 58}}))))
    assert one(rows["daily_wellness"])["resting_hr"] == 58 and rows["hrv"].count() == 0


def test_distances_are_added_in_the_order_their_types_are_seen(spark):
    """These three give 162.65 or the double below it, so 162.7 or 162.6, depending on the order of addition."""
    days = list(permutations([("walk", 30.6), ("run", 58.75), (None, 73.3)]))
    want = {f"night-{n}": round(day[0][1] + day[1][1] + day[2][1], 1) for n, day in enumerate(days)}
    seen = [bundle(spark, ("monitoring", {"activity_type": "swim"}), *(("monitoring", {"activity_type": t, "distance": d}) for t, d in day), ("monitoring", {"activity_type": day[2][0], "distance": 1.0}), name=f"night-{n}") for n, day in enumerate(days)]
    messages = reduce(DataFrame.unionByName, seen)
    for cut in (messages, messages.orderBy("distance").coalesce(1), messages.repartition(7, "distance")):
        assert {r["bundle"]: r["distance_m"] for r in device.decode_bundles(cut).collect()} == want
    assert set(want.values()) == {162.6, 162.7}


def test_thresholds(spark):
    def flags(rate, gap):
        return one(device.decode_bundles(bundle(spark, ("monitoring", {"heart_rate": 48}), ("unknown_281", {"u": {9: rate}}), ("unknown_275", {"u": {253: 0, 0: 2}}), ("unknown_275", {"u": {253: gap * 60, 0: 2}}))))["flags"]

    assert flags(58, 44) == [] and flags(59, 45) == ["rhr_far_above_hr_floor", "sparse_sleep_stage_logging"]


def test_undated_bundle_is_rejected(spark):
    decoded = device.decode_bundles(bundle(spark, ("stress_level", {"stress": 5}), name="export"))
    assert device.undated(decoded).count() == 1 and device.device_rows(decoded)["daily_wellness"].count() == 0


ALL = (("usersummary", SUMMARY), ("sleep", SLEEP), ("hrv", HRV), ("training_status", TRAINING), ("activities", ACTS), ("activity", {"activityId": 2, "activityName": "Named later"}), ("weather", {}))


def test_rebuild_and_index(spark):
    rows = raw(spark, *ALL)
    tables = rebuild.rebuild(rows)
    w = one(tables["daily_wellness"])
    assert w["skin_temp_dev_c"] == -0.3 and w["resting_hr"] == 51 and w["source"] == "api"
    named = one(tables["activities"].filter("activity_id = 2"))
    assert named["name"] == "Named later" and named["date"] == D
    assert {(r["endpoint"], r["status"]) for r in rebuild.rebuilt_ledger(raw(spark, ("hrv", {}), ("sleep", SLEEP))).collect()} == {("hrv", "empty"), ("sleep", "ok")}
    assert one(parse.unknown_endpoints(rows)) == {"endpoint": "weather", "n": 1}
    index = snapshots.snapshot_index(rows)
    assert index.count() == 7 and index.filter("length(sha256) = 64 and bytes > 0").count() == 7


def test_write_once_and_fan_out(spark):
    old, new = raw(spark, ("hrv", HRV)), raw(spark, ("hrv", {}), ("sleep", SLEEP))
    assert [r["endpoint"] for r in snapshots.new_snapshots(new, old).collect()] == ["sleep"]
    assert snapshots.new_snapshots(new, old, force=True).count() == 2
    fanned = snapshots.activity_snapshots(raw(spark, ("activities", ACTS))).orderBy("path").collect()
    assert [r["path"] for r in fanned] == ["activities/2.json", "activities/90000000001.json"] and json.loads(fanned[0]["content"])["activityId"] == 2


def test_snapshot_files(spark, tmp_path):
    for path, content in (("daily/2026/2026-06-01/hrv.json", HRV), ("activities/5.json", {"activityId": 5}), ("other/x.json", {})):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(content))
    got = {r["path"]: r for r in snapshots.read_snapshot_files(spark, str(tmp_path), 7).collect()}
    assert set(got) == {"daily/2026/2026-06-01/hrv.json", "activities/5.json"}
    assert got["daily/2026/2026-06-01/hrv.json"]["date"] == D and got["activities/5.json"]["endpoint"] == "activity"


def test_users_come_from_the_folders_of_a_fleet(spark, tmp_path):
    for path in ("user=3/daily/2026/2026-06-01/hrv.json", "user=41/activities/5.json", "daily/2026/2026-06-01/hrv.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("{}")
    got = {(r["user_id"], r["path"]) for r in snapshots.read_snapshot_files(spark, str(tmp_path)).collect()}
    assert got == {(3, "daily/2026/2026-06-01/hrv.json"), (41, "activities/5.json")}


def test_device_source_skips_what_it_cannot_read(spark, tmp_path):
    bundle(spark, ("monitoring", {"heart_rate": 50}), ("stress_level", {"stress": 9})).write.parquet(f"{tmp_path}/m")
    (tmp_path / "m" / "broken.parquet").write_bytes(b"no parquet at all")
    rows = device_messages(spark, f"{tmp_path}/m")
    assert rows.count() == 2 and one(device.decode_bundles(rows))["hr_min"] == 50


def test_import_of_bundles(spark, tmp_path):
    one_day = bundle(spark, ("monitoring", {"heart_rate": 48}), ("unknown_521", {"u": {1: 70}}))
    lost = bundle(spark, ("stress_level", {"stress": 5}), name="export")
    held = typed(spark.createDataFrame([(1, D, 81, "api"), (1, date(2026, 5, 1), 60, "api")], "user_id long, date date, score int, source string"), "sleep")
    done = import_bundles(one_day.unionByName(lost), {"sleep": held})
    assert {(r["date"], r["score"], r["source"]) for r in done.tables["sleep"].collect()} == {(D, 81, "api"), (date(2026, 5, 1), 60, "api")}
    assert one(done.tables["daily_wellness"])["min_hr"] == 48 and one(done.rejected)["bundle"] == "export"
    report = one(done.report)
    assert (report["imported"], report["skipped"], report["date"]) == (["daily_wellness"], ["sleep"], D)
    forced = import_bundles(one_day, {"sleep": held}, force=True)
    assert {(r["date"], r["score"], r["source"]) for r in forced.tables["sleep"].collect()} == {(D, 70, "fit"), (date(2026, 5, 1), 60, "api")}
    write_import(forced, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/sleep").count() == 2 and one(import_bundles(one_day, {"sleep": forced.tables["sleep"]}).report)["skipped"] == []


def test_days_of_bundles_and_first_offset(spark):
    late = datetime(2026, 6, 1, 23, 30)
    clock = ("timestamp_correlation", {"ts": late, "local_ts": datetime(2026, 6, 2, 1, 30)})
    other = ("timestamp_correlation", {"ts": late, "local_ts": late})
    assert one(device.decode_bundles(bundle(spark, clock, other, ("monitoring", {"ts": late}), name="export")))["date"] == date(2026, 6, 2)
    assert one(device.decode_bundles(bundle(spark, other, clock, ("monitoring", {"ts": late}), name="export")))["date"] == D
    slept = [("event", {"event": 74, "event_type": "start", "ts": datetime(2026, 6, 3, 20)}), ("event", {"event": 74, "event_type": "stop", "ts": datetime(2026, 6, 4, 4)})]
    assert one(device.decode_bundles(bundle(spark, ("monitoring", {"ts": late}), *slept, name="export")))["date"] == date(2026, 6, 4)


def test_table_sink_replaces_touched_months_only(spark, tmp_path):
    tables = rebuild.rebuild(raw(spark, ("hrv", HRV), ("hrv", HRV, date(2026, 7, 1))))
    write_table(tables["hrv"], "hrv", str(tmp_path))
    july = rebuild.rebuild(raw(spark, ("hrv", {"hrvSummary": {"lastNightAvg": 1}}, date(2026, 7, 1))))["hrv"]
    write_table(july, "hrv", str(tmp_path))
    got = {r["date"]: r["last_night_avg"] for r in spark.read.parquet(f"{tmp_path}/hrv").collect()}
    assert got == {D: 62, date(2026, 7, 1): 1}


def same_tables(spark, root, want):
    got = warehouse_of(spark, root)
    for name, rows in want.items():
        columns = [c for c in rows.columns if c != "fetched_at"]
        assert sorted(map(str, got[name].select(*columns).collect())) == sorted(map(str, rows.select(*columns).collect())), name


def test_streaming_ingest_equals_rebuild_and_is_idempotent(spark, tmp_path):
    incoming, root, cp = (f"{tmp_path}/{x}" for x in ("in", "root", "cp"))
    first, second = raw(spark, *ALL[:3]), raw(spark, *ALL[3:5], ("hrv", {"hrvSummary": {"lastNightAvg": 5}}))
    for part in (first, second):
        part.write.mode("append").parquet(incoming)
        ingest(spark, incoming, root, cp).awaitTermination()
    ingest(spark, incoming, root, f"{tmp_path}/cp2").awaitTermination()  # a replay of everything
    same_tables(spark, root, rebuild.rebuild(raw(spark, *ALL[:5])))
    want = {("usersummary", "ok"), ("sleep", "ok"), ("hrv", "ok"), ("training_status", "ok"), ("activities", "ok")}
    assert {(r["endpoint"], r["status"]) for r in ledger(spark, root).collect()} == want
    assert {r["attempts"] for r in ledger(spark, root).collect()} == {1}
    assert index(spark, root).count() == 7 == raw_of(spark, root).count()


@pytest.mark.parametrize("turn", [1, -1])
def test_activities_months_away_from_their_lists(spark, tmp_path, turn):
    """A list of May holds an activity of January; another batch touches January, in both orders and after a replay."""
    may = [{"activityId": 1, "startTimeLocal": "2024-01-12 08:00:00"}, {"activityId": 3, "startTimeLocal": "2024-05-09 08:00:00"}]
    january = [{"activityId": 2, "startTimeLocal": "2024-01-20 08:00:00"}]
    lists = [("activities", may, date(2024, 5, 10)), ("activities", january, date(2024, 1, 21)), ("activity", {"activityId": 2, "activityName": "own"})]
    incoming, root = f"{tmp_path}/in", f"{tmp_path}/root"
    for part in lists[::turn]:
        raw(spark, part).write.mode("append").parquet(incoming)
        ingest(spark, incoming, root, f"{tmp_path}/cp").awaitTermination()
    held = warehouse_of(spark, root)["activities"]
    assert sorted(r["activity_id"] for r in held.collect()) == [1, 2, 3]
    ingest(spark, incoming, root, f"{tmp_path}/cp2").awaitTermination()
    stored = raw_of(spark, root)
    same_tables(spark, root, {"activities": rebuild.rebuild(stored)["activities"]})


def test_forced_snapshots_move_an_activity(spark, tmp_path):
    root = str(tmp_path)
    ingest_batch(raw(spark, ("activities", [{"activityId": 1, "startTimeLocal": "2024-01-12 08:00:00"}], date(2024, 1, 13)), ("hrv", None, D)), root)
    later = raw(spark, ("activities", [{"activityId": 1, "startTimeLocal": "2024-03-02 08:00:00"}], date(2024, 1, 13)), ("hrv", HRV, D)).withColumn("fetched_at", F.timestamp_add("day", F.lit(1), "fetched_at"))
    ingest_batch(later, root)  # the path is taken
    assert one(warehouse_of(spark, root)["activities"])["date"] == date(2024, 1, 12)
    ingest_batch(later, root, force=True)
    ingest_batch(later, root, force=True)
    assert one(warehouse_of(spark, root)["activities"])["date"] == date(2024, 3, 2)
    states = {r["endpoint"]: (r["status"], r["attempts"], r["last_error"]) for r in ledger(spark, root).collect()}
    assert states == {"activities": ("ok", 2, None), "hrv": ("ok", 2, None)}
    assert raw_of(spark, root).filter("endpoint = 'activities'").count() == 2


def test_a_batch_reads_the_parts_it_touches(spark, tmp_path):
    root = str(tmp_path)
    ingest_batch(raw(spark, ("hrv", HRV), ("hrv", HRV, date(2026, 7, 1)), ("sleep", SLEEP)), root)
    rows = Store(spark, root).read("raw", RAW_PARTS, ["endpoint=hrv/part=2026-06"])
    assert len(rows.collect()) == 1 and len(rows.inputFiles()) == 1


def test_a_batch_keeps_nothing_when_it_ends(spark, tmp_path):
    """What a batch kept of its snapshots' texts stayed in the executors' memory for the rest of the session."""
    spark.catalog.clearCache()
    root = f"file://{tmp_path}/w"
    for _ in range(2):  # new paths, then known ones
        ingest_batch(raw(spark, *ALL[:5]), root)
        assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    ingest_batch(raw(spark, *ALL[:3]), root, force=True)
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty() and index(spark, root).count() == raw_of(spark, root).count()


@pytest.mark.parametrize("table", ["activities", "daily_wellness", "sleep"])
def test_columns_owned_together_fold_as_alone(spark, table):
    item = {"activityId": 7, "activityName": "a", "duration": 60.0}
    rows = raw(spark, *ALL, ("activities", [item, item | {"activityName": None, "duration": 90.0}], date(2026, 6, 3)), ("activity", item | {"activityName": "b", "startTimeLocal": None}), ("sleep", SLEEP, date(2026, 6, 3)), ("usersummary", {"totalSteps": 1}, date(2026, 6, 3)))
    parts = rebuild.contributions(rows, [table])[table]
    each, joint = merge.fold(parts, table), merge.fold(parts, table, rebuild.ALONE.get(table, []))
    assert each.columns == joint.columns and each.count() and sorted(map(str, each.collect())) == sorted(map(str, joint.collect()))
    plan = rebuild.rebuild(rows, [table])[table]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by(") <= 2  # not one place in time for each column


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A batch that dies between tables leaves the old version readable; its replay publishes the new one."""
    root = str(tmp_path)
    ingest_batch(raw(spark, *ALL[:2]), root)
    before = {t: rows.count() for t, rows in warehouse_of(spark, root).items()}
    whole, done = Batch.replace, []

    def dies(batch, dataset, *rest, **more):
        whole(batch, dataset, *rest, **more)
        done.append(dataset)
        if len(done) == 3:
            raise RuntimeError("lost")

    monkeypatch.setattr(Batch, "replace", dies)
    with pytest.raises(RuntimeError):
        ingest_batch(raw(spark, *ALL[:5]), root)
    assert {t: rows.count() for t, rows in warehouse_of(spark, root).items()} == before
    assert raw_of(spark, root).count() == 2 == index(spark, root).count() == ledger(spark, root).count()
    monkeypatch.setattr(Batch, "replace", whole)
    ingest_batch(raw(spark, *ALL[:5]), root)
    same_tables(spark, root, rebuild.rebuild(raw(spark, *ALL[:5])))
    assert store_module.vacuum(spark, root, keep=1) > 0
    same_tables(spark, root, rebuild.rebuild(raw(spark, *ALL[:5])))
    assert ledger(spark, root).count() == 5


def test_folders_of_a_place_stay_bounded_and_buckets_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST", 3)
    monkeypatch.setattr(store_module, "BUCKETS", 1)
    monkeypatch.setattr(store_module, "BUCKET_ROWS", 3)
    root, turns = str(tmp_path), 4
    for i in range(turns):
        ingest_batch(raw(spark, ("activities", [{"activityId": i, "startTimeLocal": f"2024-01-{10 + i} 08:00:00"}], date(2024, 1, 10 + i))), root)
        held = Store(spark, root)
        assert max(len(parts) for d in ("raw", "index", "attempts", "places") for parts in held.places(d).values()) < 3
    assert held.buckets("places") > 1 and held.buckets("raw") > 1 and held.buckets("index") == held.buckets("raw")
    assert sorted(r["activity_id"] for r in warehouse_of(spark, root)["activities"].collect()) == list(range(turns))
    assert raw_of(spark, root).count() == 2 * turns == index(spark, root).count()
    ingest_batch(raw_of(spark, root), root)  # a replay after the buckets were cut anew
    assert raw_of(spark, root).count() == 2 * turns


def test_the_last_day_is_kept_beside_the_tables(spark, tmp_path):
    root = str(tmp_path)
    ingest_batch(raw(spark, ("hrv", HRV), ("hrv", HRV, date(2026, 7, 1)), ("sleep", SLEEP)), root)
    last = {(r["table"], r["month"]): r["last"] for r in warehouse_of(spark, root)["latest"].collect()}
    assert last == {("hrv", "2026-06"): D, ("hrv", "2026-07"): date(2026, 7, 1), ("sleep", "2026-06"): D, ("daily_wellness", "2026-06"): D}
    gone = raw(spark, ("hrv", {}, date(2026, 7, 1))).withColumn("fetched_at", F.timestamp_add("day", F.lit(1), "fetched_at"))
    ingest_batch(gone, root, force=True)
    assert not warehouse_of(spark, root)["latest"].filter("table = 'hrv' and month = '2026-07'").count() or warehouse_of(spark, root)["hrv"].filter("month = '2026-07'").count()


def test_a_bad_number_is_null_in_its_cell_only(spark):
    rows = raw(spark, ("usersummary", {"totalSteps": 1e12, "restingHeartRate": 50}), ("usersummary", {"totalSteps": 1e40, "minHeartRate": 40}, date(2026, 6, 2)), ("usersummary", {"totalSteps": 7}, date(2026, 6, 3)))
    got = {r["date"]: (r["steps"], r["resting_hr"], r["min_hr"]) for r in parse.parse_usersummary(rows).collect()}
    assert got == {D: (None, 50, None), date(2026, 6, 2): (None, None, 40), date(2026, 6, 3): (7, None, None)}


def test_rounding_follows_the_binary_value(spark):
    cases = [2.675, 1.005, 0.125, -2.675, 2.5, 3.5, 1e22, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x double")
    got = df.select("i", half_even("x").alias("a"), whole("x").alias("b")).orderBy("i").collect()
    assert [r["a"] for r in got] == [None if x is None else round(x, 2) for x in cases]
    assert [r["b"] for r in got] == [3, 1, 0, -3, 2, 4, None, None]
