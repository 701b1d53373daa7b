"""Plans and reads of what is stored: gaps, last days, imports, snapshot trees, results in order."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from pulsefleet.functions.bloom import filters_of, maybe_held
from pulsefleet.operators import baseline, device, readout, views
from pulsefleet.operators.parse import ROUTES, gives_rows, parse_once
from pulsefleet.plans import device_import
from pulsefleet.sources import snapshots
from pulsefleet.sources.schemas import DEVICE, ENDPOINTS, TABLES
from pulsefleet.sources.snapshot_files import read_snapshot_tree, write_snapshot_tree
from pulsefleet.sources.store import Store
from pulsefleet.sources.warehouse import read_stored, write_stored

from .test_ingest import ACTS, HRV, SLEEP, SUMMARY, TRAINING, raw


def hrv_rows(spark, rows):
    return spark.createDataFrame(rows, "user_id long, date date, last_night_avg int").select("user_id", "date", "last_night_avg", *[F.lit(None).cast(t).alias(c) for c, t in (x.strip().split(" ") for x in TABLES["hrv"].split(", ")[3:])])


def test_gaps_over_blocks_of_days_equal_a_calendar(spark):
    r = random.Random(4)
    first, last = date(1969, 10, 20), date(1970, 6, 2)
    have = {(u, date(1969, 9, 1) + timedelta(days=r.randrange(300))) for u in (1, 2) for _ in range(200)} | {(3, date(1980, 1, 1))}
    wh = {"hrv": hrv_rows(spark, [(u, d, 50) for u, d in have])}
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    found = views.gaps(wh, first, last, ["hrv"])
    assert {(x["user_id"], x["date"]) for x in found.collect()} == {(u, d) for u in (1, 2, 3) for d in days if (u, d) not in have}
    log = spark.createDataFrame([(2, date(1970, 1, 30)), (2, date(1970, 3, 1)), (9, date(1970, 5, 30))], "user_id long, date date")
    by_user = views.gaps_by_user_range(wh, log, last, ["hrv"])
    want = {(2, d) for d in days if d >= date(1970, 1, 30) and (2, d) not in have} | {(9, d) for d in days if d >= date(1970, 5, 30)}
    assert {(x["user_id"], x["date"]) for x in by_user.collect()} == want
    for df in (found, by_user):  # what makes days of the calendar stands above all that is dealt by a key
        plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        days_made = [n for n, line in enumerate(plan) if "explode(flatten" in line]
        met = [n for n, line in enumerate(plan) if "Aggregate" in line or "Join" in line]
        assert days_made and max(days_made) < min(met)


def test_baselines_read_the_months_of_their_windows(spark, tmp_path):
    rows = [(u, date(2023, 1, 1) + timedelta(days=i), 40 + i % 7) for u, n in ((1, 500), (2, 300)) for i in range(n)]
    batch = Store(spark, str(tmp_path)).begin()
    write_stored(batch, {"hrv": hrv_rows(spark, rows)})
    batch.publish()
    held = read_stored(Store(spark, str(tmp_path)))
    assert baseline.months_of(baseline.latest_days(held, ["hrv"]).withColumn("start", F.date_sub("end", 13))) == ["2023-10", "2024-05"]
    got = baseline.baselines(held, ["hrv"], 14)
    plain = baseline.baselines({"hrv": hrv_rows(spark, rows)}, ["hrv"], 14)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "month#" in plan and "IN (2023-10,2024-05)" in plan and plan.count("data/hrv") <= plan.count("PartitionFilters: [month")


def test_an_import_writes_the_months_it_touches(spark, tmp_path):
    root = str(tmp_path)
    batch = Store(spark, root).begin()
    write_stored(batch, {"hrv": hrv_rows(spark, [(1, date(2026, 5, 3), 41), (1, date(2026, 6, 9), 42)]).withColumn("source", F.lit("api"))})
    batch.publish()
    before = {p: parts for p, parts in Store(spark, root).places("hrv").items()}
    rows = [(1, "night-2026-06-01", "a", 1, "unknown_370", None, None, None, None, None, None, None, None, None, {"unknown_1": 128.0 * 60})]
    done = device_import.import_into(spark.createDataFrame(rows, DEVICE), root)
    after = Store(spark, root).places("hrv")
    assert after["month=2026-05"] == before["month=2026-05"] and after["month=2026-06"] != before["month=2026-06"]
    held = read_stored(Store(spark, root))
    assert {(x["date"], x["last_night_avg"], x["source"]) for x in held["hrv"].collect()} == {(date(2026, 5, 3), 41, "api"), (date(2026, 6, 9), 42, "api"), (date(2026, 6, 1), 60, "fit")}
    assert [x["imported"] for x in done.report.collect()] == [["hrv"]] and device.undated(device.decode_bundles(spark.createDataFrame([], DEVICE))).count() == 0


def test_a_tree_of_ten_thousand_files_is_listed_by_tasks(spark, tmp_path):
    root = f"file://{tmp_path}/tree"
    day = F.date_add(F.lit("2024-12-20").cast("date"), (F.col("id") % 40).cast("int"))
    path = F.when(F.col("id") % 10 == 0, F.concat(F.lit("activities/"), F.col("id").cast("string"), F.lit(".json"))).otherwise(snapshots.daily_path(day, F.concat(F.lit("e"), F.col("id").cast("string"))))
    made = spark.range(10_000).select((F.col("id") % 13).alias("user_id"), path.alias("path"), F.concat(F.lit("{}"), F.col("id").cast("string")).alias("content"))
    assert write_snapshot_tree(made, root).filter("written").count() == 10_000
    assert write_snapshot_tree(made.withColumn("content", F.lit("other")), root).filter("written").count() == 0
    got = read_snapshot_tree(spark, root)
    keys = ["user_id", "path", "content"]
    assert got.select(keys).exceptAll(made.select(keys)).count() == 0 and got.count() == 10_000
    assert got.filter("endpoint = 'activity' and date is null").count() == 1000 and got.inputFiles() == []
    assert snapshots.read_snapshot_files(spark, root).select(keys).exceptAll(got.select(keys)).count() == 0


def test_results_are_written_in_order(spark, tmp_path):
    rows = [(u, t, date(2024, 1, d)) for u in range(40) for t in ("sleep", "hrv") for d in (3, 1, 2)]
    random.Random(1).shuffle(rows)
    readout.write_in_order(spark.createDataFrame(rows, "user_id long, table string, date date"), "gaps", f"{tmp_path}/out")
    files = sorted(str(p) for p in (tmp_path / "out").glob("part-*"))
    assert [tuple(r) for f in files for r in spark.read.parquet(f).collect()] == sorted(rows)


def test_the_ledger_sees_rows_where_the_parsers_give_them(spark):
    payloads = {"usersummary": [SUMMARY, {}, {"totalSteps": 1e12}, {"averageSpo2": 90.0}], "sleep": [SLEEP, {}, {"avgSkinTempDeviationC": 1.0}, {"dailySleepDTO": {"sleepTimeSeconds": 60}}, {"restlessMomentsCount": 3}], "hrv": [HRV, {}, {"hrvSummary": {}}, {"hrvSummary": {"status": "LOW"}}], "training_status": [TRAINING, {}, {"mostRecentVO2Max": {"generic": {"vo2MaxPreciseValue": 50.0}}}], "activities": [ACTS, [], [{"activityName": "x"}], {"activityId": 1}]}
    assert set(payloads) == set(ENDPOINTS)
    for endpoint, given in payloads.items():
        rows = raw(spark, *[(endpoint, p, date(2026, 6, 1 + i)) for i, p in enumerate(given)])
        told = {r["path"] for r in parse_once(rows).filter(gives_rows(endpoint)).collect()}
        made = {r["path"] for r in ROUTES[endpoint][0][1](rows, ("path",)).select("path").collect()}
        assert told == made, endpoint


def test_filters_tell_new_paths_from_known_ones(spark):
    held = spark.range(20_000).selectExpr("'hrv' as endpoint", "concat('m', id % 3) as part", "id % 50 as user_id", "concat('p', id) as path")
    more = spark.range(15_000, 40_000).selectExpr("'hrv' as endpoint", "concat('m', id % 3) as part", "id % 50 as user_id", "concat('p', id) as path", "id", "'x' as block")
    place, keys = ["endpoint", "part"], ["user_id", "path"]
    filters = filters_of(held.filter("user_id < 25"), place, keys).unionByName(filters_of(held.filter("user_id >= 25"), place, keys))
    got = maybe_held(more.drop("block"), filters, place, keys)
    assert got.filter("id < 20000 and not maybe").count() == 0 and got.filter("id >= 20000 and maybe").count() < 200
    assert got.count() == 25_000 and maybe_held(more.drop("block"), filters.limit(0), place, keys).filter("maybe").count() == 0
