from collections import defaultdict
from datetime import date
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from pulsefleet.operators import anomaly, baseline, correlate, ledger, readout, series, views

from . import planted
from .planted import ACTS, CALM, DAYS, FIRST, LAST, MISSING, N, PEAK, day


@pytest.fixture(scope="module")
def wh(spark):
    return planted.warehouse(spark)


def rows(df, user=11, *order):
    return [r.asDict() for r in df.filter(f"user_id = {user}").orderBy(*order or df.columns).collect()]


REST, STEPS, STRESS = ([d[k] for d in DAYS[11]] for k in range(3))
NIGHTS = [d[3] for d in DAYS[11]]


def by_week(values):
    """Week's Monday to mean; the first day is a Monday."""
    weeks = defaultdict(list)
    for i, x in enumerate(values):
        if x is not None:
            weeks[str(day(i - i % 7))].append(x)
    return {k: round(fmean(v), 2) for k, v in weeks.items()}


def test_daily_alignment_keeps_labels_of_any_metric(wh):
    got = rows(series.query_metrics(wh, ["sleep_score", "resting_hr"], FIRST, LAST), 11, "date")
    assert [(r["date"], r["resting_hr"], r["sleep_score"]) for r in got] == [(str(day(i)), float(REST[i]), NIGHTS[i] and float(NIGHTS[i][0])) for i in range(N)]
    assert sum(r["sleep_score"] is None for r in got) == len(MISSING)


def test_weekly_and_monthly_buckets(wh):
    got = rows(series.query_metrics(wh, ["resting_hr", "sleep_score"], FIRST, LAST, "weekly"), 11, "date")
    assert {r["date"]: r["resting_hr"] for r in got} == by_week(REST)
    assert {r["date"]: r["sleep_score"] for r in got} == by_week([n and n[0] for n in NIGHTS])
    acts = rows(series.query_metrics(wh, ["activity_count", "activity_distance_m"], FIRST, LAST, "weekly"), 11, "date")
    want = defaultdict(lambda: [0, 0])
    for u, _, d, _, _, _, _, metres, *_ in ACTS:
        if u == 11:
            week = want[str(day(d - d % 7))]
            week[0] += 1
            week[1] += metres
    assert {r["date"]: [r["activity_count"], r["activity_distance_m"]] for r in acts} == dict(want)
    assert [r["date"] for r in rows(series.query_metrics(wh, ["steps"], FIRST, LAST, "monthly"), 11, "date")] == ["2024-03", "2024-04"]
    # A week's label may lie before the range.
    assert rows(series.query_metrics(wh, ["steps"], day(2), day(3), "weekly"))[0]["date"] == str(FIRST)


def test_stats(wh):
    got = rows(series.metric_stats(wh, ["resting_hr"], FIRST, LAST))[0]
    assert (got["mean"], got["min"], got["max"], got["sd"]) == (round(fmean(REST), 2), min(REST), max(REST), pytest.approx(pstdev(REST), abs=0.006))


def test_categorical_is_daily_only(wh):
    got = rows(series.query_metrics(wh, ["hrv_status"], FIRST, LAST), 11, "date")
    assert [r["hrv_status"] for r in got] == ["unbalanced" if d[4] < 45 else "balanced" for d in DAYS[11]]
    with pytest.raises(ValueError, match="hrv_status"):
        series.query_metrics(wh, ["hrv_status"], FIRST, LAST, "weekly")
    with pytest.raises(ValueError, match="hrv_status"):
        correlate.correlate(wh, "hrv_status", "steps", FIRST, LAST)


@pytest.mark.parametrize(
    "call",
    [
        lambda w: series.query_metrics(w, ["nope"], FIRST, LAST),
        lambda w: series.query_metrics(w, [], FIRST, LAST),
        lambda w: series.query_metrics(w, ["steps", "steps"], FIRST, LAST),
        lambda w: series.query_metrics(w, ["steps"], LAST, FIRST),
        lambda w: series.query_metrics(w, ["steps"], "March", LAST),
        lambda w: series.query_metrics(w, ["steps"], FIRST, LAST, "yearly"),
        lambda w: baseline.baselines(w, None, 1),
        lambda w: anomaly.anomalies(w, None, FIRST, LAST, 0),
        lambda w: views.list_activities(w, limit=0),
    ],
)
def test_bad_arguments(wh, call):
    with pytest.raises(ValueError):
        call(wh)


def pearson(a, b):
    ma, mb = fmean(a), fmean(b)
    return sum((p - ma) * (q - mb) for p, q in zip(a, b)) / (sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b)) ** 0.5


def ranks(v):
    return [sum(a < b for a in v) + (sum(a == b for a in v) + 1) / 2 for b in v]


def pairs(x, y, lag):
    both = [(x[i], y[i + lag]) for i in range(N) if 0 <= i + lag < N and x[i] is not None and y[i + lag] is not None]
    return [p for p, _ in both], [q for _, q in both]


MINUTES = [n and n[1] for n in NIGHTS]


@pytest.mark.parametrize("lag", [0, 2, -3])
def test_lagged_correlation(wh, lag):
    got = rows(correlate.correlate(wh, "stress_avg", "sleep_duration_min", FIRST, LAST, lag_days=lag))[0]
    x, y = pairs(STRESS, MINUTES, lag)
    assert (got["n"], got["note"]) == (len(x), None)
    assert got["pearson_r"] == pytest.approx(pearson(x, y), abs=6e-4)
    assert got["spearman_rho"] == pytest.approx(pearson(ranks(x), ranks(y)), abs=6e-4)


def test_lag_scan_finds_the_planted_lag(wh):
    got = rows(correlate.correlate(wh, "stress_avg", "sleep_duration_min", FIRST, LAST, scan_lags=True))[0]
    assert got["best_lag"] == 2 and got["best_r"] == 1.0 and got["lag_days"] == 0


def test_constant_and_short_series(wh):
    df = correlate.correlate(wh, "resting_hr", "sleep_duration_min", FIRST, LAST)
    constant, short = rows(df, 13)[0], rows(df, 14)[0]
    assert constant["pearson_r"] is None and "constant" in constant["note"] and constant["n"] == N
    assert short["n"] == 4 and short["pearson_r"] is None and short["note"].startswith("only 4 ")


def test_baselines(wh):
    got = {r["metric"]: r for r in rows(baseline.baselines(wh, None, 28))}
    window = REST[N - 28 :]
    rest = got["resting_hr"]
    assert (rest["start"], rest["end"], rest["mean"], rest["current"]) == (day(N - 28), LAST, round(fmean(window), 2), window[-1])
    low, high = fmean(window) - pstdev(window), fmean(window) + pstdev(window)
    assert rest["band_low"] == pytest.approx(low, abs=0.006) and rest["vs_band"] == ("below" if window[-1] < round(low, 2) else "above" if window[-1] > round(high, 2) else "in")
    assert got["steps"]["vs_band"] == "above" and got["steps"]["n"] == 28
    assert got["skin_temp_dev_c"]["n"] == 0 and got["skin_temp_dev_c"]["mean"] is None and got["skin_temp_dev_c"]["vs_band"] is None
    # Users end on their own latest day.
    assert {r["end"] for r in rows(baseline.baselines(wh, None, 28), 14)} == {day(3)}
    assert {r["end"] for r in rows(baseline.baselines(wh, None, 7, "2024-03-13"))} == {date(2024, 3, 13)}


def test_a_fixed_end_prunes_the_scan(spark, wh, tmp_path):
    wh["daily_wellness"].write.parquet(f"{tmp_path}/w")
    read = dict(wh) | {"daily_wellness": spark.read.parquet(f"{tmp_path}/w")}
    plan = baseline.baselines(read, ["steps"], 7, "2024-03-13")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date,2024-03-07), LessThanOrEqual(date,2024-03-13)" in plan


def test_anomalies_and_streaks(wh):
    mean, sd = fmean(REST), pstdev(REST)
    found = rows(anomaly.anomalies(wh, ["resting_hr"], FIRST, LAST))
    assert [(r["date"], r["value"]) for r in found] == [(day(i), float(x)) for i, x in enumerate(REST) if abs(x - mean) >= 2 * sd]
    assert (day(PEAK), "high") in [(r["date"], r["direction"]) for r in found]
    runs = rows(anomaly.streaks(wh, ["resting_hr"], FIRST, LAST))
    want, i = [], 0
    while i < N:
        side, j = REST[i] > mean, i
        while j + 1 < N and (REST[j + 1] > mean) == side:
            j += 1
        if j - i + 1 >= 5:
            want.append(("above_mean" if side else "below_mean", day(i), day(j), j - i + 1))
        i = j + 1
    assert sorted((r["kind"], r["start"], r["end"], r["len"]) for r in runs) == sorted(want)
    assert any(r["start"] <= day(CALM[0]) and r["end"] >= day(CALM[-1]) for r in runs)
    assert rows(anomaly.anomalies(wh, ["resting_hr"], FIRST, LAST), 13) == []


def test_day_view(wh):
    got = {r["date"]: r for r in rows(views.day_views(wh, FIRST, day(6)))}
    assert [a["activity_id"] for a in got[day(6)]["activities"]] == [502, 503] and got[day(4)]["flags"] == ["sparse_sleep_stage_logging"]
    assert f'"resting_hr":{REST[0]}' in got[FIRST]["wellness"] and "fetched_at" not in got[FIRST]["wellness"] and got[FIRST]["training"] == "{}"


def test_activity_lists(wh):
    def ids(**kw):
        return [r["activity_id"] for r in rows(views.list_activities(wh, **kw), 11, "rank")]

    assert ids() == [505, 504, 503, 502, 501] and ids(type="swimming") == [505, 503, 501] and ids(min_distance_m=1500) == [504, 502, 501]
    two = rows(views.list_activities(wh, limit=2), 11, "rank")
    assert [r["activity_id"] for r in two] == [505, 504] and all(r["truncated"] and r["n"] == 2 for r in two)
    assert not rows(views.list_activities(wh, limit=5), 11, "rank")[0]["truncated"]
    assert views.get_activity(wh, 11, 502).first()["name"] == "Harbour loop"
    with pytest.raises(LookupError):
        views.get_activity(wh, 11, 99)


def test_gaps(wh, spark):
    got = rows(views.gaps(wh, FIRST, LAST))
    assert [(r["table"], r["date"]) for r in got] == [("sleep", day(i)) for i in MISSING]
    log = spark.createDataFrame([(11, "sleep", day(17), 1, "error", "timed out", None)], "user_id long, endpoint string, date date, seq long, status string, error string, at timestamp")
    errors = ledger.errors_in_range(ledger.fold_attempts(log), FIRST, LAST).collect()
    assert [(r["endpoint"], r["date"], r["last_error"]) for r in errors] == [("sleep", day(17), "timed out")]
    by_user = rows(views.gaps_by_user_range(wh, log, LAST))
    assert [(r["table"], r["date"]) for r in by_user] == [("sleep", day(i)) for i in MISSING]


def test_ledger(spark):
    log = spark.createDataFrame(
        [(1, "sleep", day(0), 1, "error", "x", None), (1, "sleep", day(0), 2, "ok", None, None), (1, "hrv", day(0), 3, "empty", None, None), (1, "hrv", day(1), 4, "error", "y", None)],
        "user_id long, endpoint string, date date, seq long, status string, error string, at timestamp",
    )
    led = ledger.fold_attempts(log)
    first = led.filter("endpoint = 'sleep'").first()
    assert (first["status"], first["attempts"], first["last_error"]) == ("ok", 2, None)
    plan = ledger.sync_plan(led, log, day(0), day(1), endpoints=("sleep", "hrv")).orderBy("date", "turn").collect()
    assert [(r["date"], r["endpoint"]) for r in plan] == [(day(1), "sleep"), (day(1), "hrv")]
    assert ledger.sync_plan(led, log, day(0), day(1), force=True, endpoints=("sleep", "hrv")).count() == 4
    assert [r["last_error"] for r in ledger.recent_errors(led).collect()] == ["y"]
    with pytest.raises(Exception, match="no status"):
        ledger.fold_attempts(log.replace("ok", "fine", ["status"])).collect()


def test_results_in_order(wh):
    weeks = series.query_metrics(wh, ["steps"], FIRST, LAST, "weekly")
    got = rows(readout.read_out(weeks, "series"), 11, "position")
    assert [r["position"] for r in got] == [1, 2, 3, 4, 5] and [r["date"] for r in got] == sorted(r["date"] for r in got)
    assert [r["date"] for r in rows(readout.read_out(weeks, "series", last=2), 11, "position")] == [got[3]["date"], got[4]["date"]]
    assert [r["date"] for r in rows(readout.read_out(weeks, "series", first=2), 11, "position")] == [got[0]["date"], got[1]["date"]]
    with pytest.raises(ValueError):
        readout.read_out(weeks, "series", first=0)


def test_yesterday_depends_on_the_zone(spark):
    df = spark.sql("select timestamp '2024-03-01 02:00:00' as now")
    tokyo, la = readout.default_range(F.col("now"), "Asia/Tokyo", 7), readout.default_range(F.col("now"), "America/Los_Angeles", 30)
    got = df.select(tokyo.start, tokyo.end, la.start, la.end).first()
    assert list(got) == [date(2024, 2, 23), date(2024, 2, 29), date(2024, 1, 30), date(2024, 2, 28)]


def test_pushdown_reaches_the_scan(spark, wh, tmp_path):
    wh["daily_wellness"].write.parquet(f"{tmp_path}/w")
    read = dict(wh) | {"daily_wellness": spark.read.parquet(f"{tmp_path}/w")}
    plan = series.query_metrics(read, ["steps"], day(3), day(5))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date,2024-03-07), LessThanOrEqual(date,2024-03-09)" in plan.partition("PushedFilters")[2]
    assert "ReadSchema: struct<user_id:bigint,date:date,steps:int>" in plan
