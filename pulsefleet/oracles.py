"""DuckDB SQL of the registered queries, straight from the driver's tables."""

from __future__ import annotations

START, END = "2024-01-03", "2024-01-28"


def h(x: str, digits: int = 2) -> str:
    """Half-even rounding of the double's binary value, as the library rounds."""
    return f"format('{{:.{digits}f}}', ({x})::double)::double"


def whole(x: str) -> str:
    return f"round_even(({x})::double, 0)::int"


def mean(x: str, over: str = "") -> str:
    return f"(sum(({x})::decimal(38,6)){over}::double / nullif(count({x}){over}, 0))"


MONEY = "value::decimal(18,2)"


def event_days(name: str, kind: str, cells: str) -> str:
    return f"{name} as (select user_id, ts::date as date, {cells} from events where event_type = '{kind}' and user_id is not null group by all)"


WELLNESS = event_days("wellness", "view", f"floor(min({MONEY}))::int as resting_hr, count(*)::int as steps, sum({MONEY})::double as distance_m, floor(max({MONEY}))::int as stress_avg")
SLEEP = event_days("sleep", "purchase", f"floor(max({MONEY}))::int as score, sum({MONEY})::double as duration_min")
HRV = event_days("hrv", "signup", f"floor(min({MONEY}))::int as last_night_avg, case when count(*) > 1 then 'balanced' else 'low' end as status")
TRAINING = event_days("training", "click", f"sum({MONEY})::double as acute_load")
ACTS = "acts as (select o_custkey as user_id, o_orderkey as activity_id, o_orderdate::date as date, o_orderdate as start_ts, o_orderstatus as name, o_orderpriority as type, o_totalprice::decimal(18,2)::double as distance_m from orders)"
EVENT_ACTS = f"eacts as (select user_id, event_id as activity_id, ts::date as date, ts as start_ts, {MONEY}::double as distance_m from events where event_type = 'error' and user_id is not null)"
IN = f"date between date '{START}' and date '{END}'"


def long(rows: dict[str, tuple[str, str]], where: str = IN) -> str:
    """mv: metric to (table, column); activities add up per day."""
    parts = []
    for metric, (source, column) in rows.items():
        if source == "eacts":
            parts.append(f"select user_id, date, '{metric}' as metric, {column}::double as v from eacts where {where} group by all")
        else:
            parts.append(f"select user_id, date, '{metric}' as metric, {column}::double as v from {source} where {where} and {column} is not null")
    return "mv as (" + " union all ".join(parts) + ")"


TREND = {"resting_hr": ("wellness", "resting_hr"), "distance_m": ("wellness", "distance_m"), "sleep_duration_min": ("sleep", "duration_min"), "activity_count": ("eacts", "count(*)"), "activity_distance_m": ("eacts", "sum(distance_m)")}


def labelled(bucket: str) -> str:
    label = {"weekly": "strftime(date_trunc('week', date), '%Y-%m-%d')", "monthly": "strftime(date, '%Y-%m')"}[bucket]
    return f"bucketed as (select user_id, {label} as label, metric, {h("case when starts_with(metric, 'activity_') then sum(v) else " + mean("v") + " end")} as v from mv group by 1, 2, 3)"


def trend(bucket: str) -> str:
    names = list(TREND)[: 4 if bucket == "daily" else 5]
    base = f"with {WELLNESS}, {SLEEP}, {EVENT_ACTS}, {long({n: TREND[n] for n in names})}"
    base += ", bucketed as (select user_id, strftime(date, '%Y-%m-%d') as label, metric, v from mv)" if bucket == "daily" else f", {labelled(bucket)}"
    cells = ", ".join(f"max(v) filter (metric = '{n}') as {n}" for n in names)
    return f"{base} select user_id, label as date, {cells} from bucketed group by 1, 2"


def total(xs: str) -> str:
    """Compensated sum of a list in its order."""
    add = "{'s': p.s + q.s, 'c': p.c + case when abs(p.s) >= abs(q.s) then (p.s - (p.s + q.s)) + q.s else (q.s - (p.s + q.s)) + p.s end}"
    folded = f"list_reduce(list_prepend({{'s': 0::double, 'c': 0::double}}, list_transform({xs}, lambda x: {{'s': x::double, 'c': 0::double}})), lambda p, q: {add})"
    return f"list_transform([{folded}], lambda r: r.s + r.c)[1]"


def sd(xs: str, m: str) -> str:
    return f"sqrt({total(f'list_transform({xs}, lambda v: (v - {m}) * (v - {m}))')} / len({xs}))"


STATS = f"""with {WELLNESS}, {SLEEP}, {EVENT_ACTS}, {long(TREND)}, {labelled("weekly")},
users as (select distinct user_id, unnest({list(TREND)}) as metric from mv),
g as (select user_id, metric, list(v order by label) as xs, min(v) as min, max(v) as max from bucketed group by 1, 2),
m as (select *, {total("xs")} / len(xs) as m from g)
select user_id, metric, {h("m")} as mean, min, max, {h(sd("xs", "m"))} as sd from users left join m using (user_id, metric)"""

CATEGORICAL = f"""with {HRV} select user_id, strftime(date, '%Y-%m-%d') as date, last_night_avg::double as hrv, status as hrv_status from hrv where {IN}"""


def means(*pairs: str) -> str:
    return ", ".join(f"{total(x)} / len({x}) as m{x}" for x in pairs)


def r_of(xs: str, ys: str) -> str:
    def both(p: str, q: str) -> str:
        return total(f"list_transform(range(1, len({p}) + 1), lambda i: ({p}[i] - m{p}) * ({q}[i] - m{q}))")

    varies = " and ".join(f"list_min({x}) < list_max({x})" for x in (xs, ys))
    return f"case when len({xs}) >= 5 and {varies} then {both(xs, ys)} / sqrt({both(xs, xs)} * {both(ys, ys)}) end"


def correlate(scan: bool) -> str:
    low, high = (-7, 7) if scan else (1, 1)
    best = f"""
lagged as (select a.user_id as user_id, l, list(a order by a.date) as xs, list(b order by a.date) as ys from a cross join (select unnest(range(-7, 8)) as l) join b on b.user_id = a.user_id and b.date = a.date + l::int group by 1, 2),
scan as (select user_id, l as lag, {r_of("xs", "ys")} as r from (select *, {means("xs", "ys")} from lagged)),
best as (select user_id, list_reduce(list_prepend({{'lag': null::int, 'r': null::double}}, list({{'lag': lag::int, 'r': r}} order by lag)),
  lambda x, y: case when y.r is not null and (x.r is null or abs(y.r) > abs(x.r)) then {{'lag': y.lag, 'r': {h("y.r", 3)}}} else x end) as best from scan group by 1),"""
    return f"""with {WELLNESS}, {SLEEP},
a as (select user_id, date, distance_m as a from wellness where {IN}),
b as (select user_id, date, duration_min as b from sleep where date between date '{START}' + {low} and date '{END}' + {high}),
p as (select a.user_id, a.date, a, b from a join b on b.user_id = a.user_id and b.date = a.date + 1),
k as (select user_id, date, a, b, rank() over (partition by user_id order by a) + (count(*) over (partition by user_id, a) - 1) / 2 as ra, rank() over (partition by user_id order by b) + (count(*) over (partition by user_id, b) - 1) / 2 as rb from p),
g as (select user_id, count(*) as n, {", ".join(f"list({x}::double order by date) as {x}s" for x in ("a", "b", "ra", "rb"))} from k group by 1),
t as (select user_id, n, {r_of("as_", "bs")} as r, {r_of("ras", "rbs")} as rho from (select *, {means("as_", "bs", "ras", "rbs")} from g)),{best if scan else ""}
users as (select user_id from a union select user_id from b)
select users.user_id, coalesce(n, 0)::bigint as n, {h("r", 3)} as pearson_r, {h("rho", 3)} as spearman_rho, 1::int as lag_days, {"best.best.lag as best_lag, best.best.r as best_r," if scan else ""}
case when coalesce(n, 0) < 5 then 'only ' || coalesce(n, 0) || ' overlapping days; need at least 5' when r is null then 'one of the series is constant over this range' end as note
from users left join t using (user_id){" left join best using (user_id)" if scan else ""}""".replace("as as,", "as as_,")


VITALS = {"resting_hr": ("wellness", "resting_hr"), "hrv": ("hrv", "last_night_avg"), "sleep_score": ("sleep", "score"), "stress_avg": ("wellness", "stress_avg"), "steps": ("wellness", "steps")}


def baselines(days: int, end: str | None) -> str:
    last = "max(date)" if end is None else f"date '{end}'"
    return f"""with {WELLNESS}, {SLEEP}, {HRV}, {long(VITALS, "true")},
ends as (select user_id, {last} as e from (select user_id, date from wellness union all select user_id, date from sleep union all select user_id, date from hrv) group by 1),
g as (select user_id, metric, list(v order by date) as xs, arg_max(v, date) as current, count(*) as n from mv join ends using (user_id) where date between e - {days - 1} and e group by 1, 2),
b as (select *, {sd("xs", "m")} as s from (select *, {total("xs")} / n as m from g)),
w as (select user_id, e, unnest(['resting_hr', 'hrv', 'sleep_score', 'skin_temp_dev_c', 'stress_avg', 'steps']) as metric from ends),
c as (select *, {h("m - s")} as band_low, {h("m + s")} as band_high from w left join b using (user_id, metric))
select user_id, (e - {days - 1})::date as start, e::date as "end", metric, {h("m")} as mean, {h("s")} as sd, band_low, band_high, current,
case when current < band_low then 'below' when current > band_high then 'above' when current is not null then 'in' end as vs_band, coalesce(n, 0)::bigint as n from c"""


ANOMALIES = f"""with {WELLNESS}, {SLEEP}, {HRV}, {long({"distance_m": ("wellness", "distance_m"), "sleep_duration_min": ("sleep", "duration_min"), "hrv": ("hrv", "last_night_avg")})},
g as (select user_id, metric, list(v order by date) as xs, min(v) as lo, max(v) as hi from mv group by 1, 2),
m as (select *, {sd("xs", "m")} as s from (select *, {total("xs")} / len(xs) as m from g)),
z as (select mv.*, lo, hi, (v - m) / nullif(s, 0) as z0 from mv join m using (user_id, metric))
select user_id, date, metric, v as value, {h("z0")} as z, case when z0 > 0 then 'high' else 'low' end as direction from z where lo < hi and abs(z0) >= 2"""

STREAKS = f"""with {WELLNESS}, {SLEEP}, {TRAINING}, {long({"distance_m": ("wellness", "distance_m"), "sleep_duration_min": ("sleep", "duration_min"), "stress_avg": ("wellness", "stress_avg"), "steps": ("wellness", "steps"), "acute_load": ("training", "acute_load")})},
g as (select user_id, metric, list(v order by date) as xs, min(v) as lo, max(v) as hi from mv group by 1, 2),
k as (select mv.*, lo, hi, m from mv join (select *, {total("xs")} / len(xs) as m from g) using (user_id, metric)),
s as (select user_id, metric, date, case when v > m then 'above_mean' when v < m then 'below_mean' end as kind from k where lo < hi),
i as (select *, date - row_number() over (partition by user_id, metric, kind order by date)::int as island from s where kind is not null)
select user_id, metric, kind, min(date) as start, max(date) as "end", count(*)::bigint as len from i group by user_id, metric, kind, island having count(*) >= 5"""

DAY_VIEWS = f"""with {WELLNESS}, {SLEEP}, {HRV}, {TRAINING}, {EVENT_ACTS},
a as (select user_id, date, string_agg(activity_id::varchar, ',' order by start_ts, activity_id) as ids from eacts where {IN} group by 1, 2),
d as (select user_id, date from wellness union select user_id, date from sleep union select user_id, date from hrv union select user_id, date from training union select user_id, date from a)
select user_id, date, resting_hr, case when w.user_id is not null then 'api' end as source, duration_min, status as hrv_status, acute_load, coalesce(ids, '') as activities, case when s.user_id is not null then 'short_sleep' else '' end as flags
from d left join wellness w using (user_id, date) left join sleep s using (user_id, date) left join hrv using (user_id, date) left join training using (user_id, date) left join a using (user_id, date) where {IN}"""


def newest(limit: int, where: str = "true") -> str:
    return f"""with {ACTS}, r as (select *, row_number() over (partition by user_id order by date desc, start_ts desc, activity_id desc)::int as rank, count(*) over (partition by user_id) as c from acts where {where})
select user_id, activity_id, date, name, type, distance_m, rank, least(c, {limit})::int as n, c > {limit} as truncated from r where rank <= {limit}"""


DAYS = f"select unnest(generate_series(date '{START}', date '{END}', interval 1 day))::date as date"
GAPS = f"""with {WELLNESS}, {SLEEP}, {HRV}, have as (select user_id, 'daily_wellness' as "table", date from wellness union all select user_id, 'sleep', date from sleep union all select user_id, 'hrv', date from hrv),
want as (select user_id, "table", date from (select distinct user_id from have), (select unnest(['daily_wellness', 'sleep', 'hrv']) as "table"), ({DAYS}))
select user_id, "table", date from want anti join have using (user_id, "table", date)"""

LOG = """log as (select user_id, event_type as endpoint, ts::date as date, event_id as seq, case when event_type = 'error' or event_id % 10 = 3 then 'error' when event_id % 10 = 5 then 'empty' else 'ok' end as status, 'e' || event_id as error, ts from events where user_id is not null),
led as (select user_id, endpoint, date, arg_max(status, seq) as status, count(*)::bigint as attempts, case when arg_max(status, seq) = 'error' then arg_max(error, seq) end as last_error, max(ts) as last_at from log group by 1, 2, 3)"""

GAPS_DEFAULT = f"""with {WELLNESS}, {SLEEP}, {HRV}, {LOG}, have as (select user_id, 'daily_wellness' as "table", date from wellness union all select user_id, 'sleep', date from sleep union all select user_id, 'hrv', date from hrv),
days as (select user_id, unnest(generate_series(f, date '{END}', interval 1 day))::date as date from (select user_id, min(date) as f from led group by 1) where f <= date '{END}'),
want as (select user_id, "table", date from days, (select unnest(['daily_wellness', 'sleep', 'hrv']) as "table"))
select user_id, "table", date from want anti join have using (user_id, "table", date)"""

COVERAGE = f"""with {WELLNESS}, {SLEEP}, {HRV}, {TRAINING}, {ACTS}, t as (select user_id, 'daily_wellness' as "table", date from wellness union all select user_id, 'sleep', date from sleep union all select user_id, 'hrv', date from hrv union all select user_id, 'training_status', date from training union all select user_id, 'activities', date from acts)
select user_id, "table", count(*)::bigint as rows, min(date) as first_date, max(date) as last_date from t group by 1, 2"""

THREE = "['view', 'purchase', 'signup']"
WANT = f"""want as (select user_id, date, endpoint, turn from (select distinct user_id from log), ({DAYS}), (select unnest({THREE}) as endpoint, unnest([0, 1, 2])::int as turn))"""
SYNC_PLAN = f"with {LOG}, {WANT} select user_id, date, endpoint, turn from want anti join (select * from led where status in ('ok', 'empty')) using (user_id, date, endpoint)"
SYNC_REPORT = f"""with {LOG}, {WANT}, s as (select endpoint, count(*) as skipped from want semi join (select * from led where status in ('ok', 'empty')) using (user_id, date, endpoint) group by 1)
select endpoint, count(*) filter (status = 'ok')::bigint as ok, count(*) filter (status = 'empty')::bigint as empty, count(*) filter (status = 'error')::bigint as error, sum(attempts)::bigint as attempts, coalesce(max(skipped), 0)::bigint as skipped from led left join s using (endpoint) group by 1"""

UPSERT = """with e as (select user_id, ts::date as date, event_id, event_type as k, floor(value)::int as v from events where user_id is not null and event_type in ('view', 'purchase', 'signup'))
select user_id, date, arg_max(v, event_id) filter (k = 'view') as resting_hr,
arg_max(case when k = 'view' then v * 10 else v end, event_id) filter (k in ('view', 'signup')) as steps,
max_by({'x': case when event_id % 2 = 0 then v end}, event_id) filter (k = 'purchase').x as stress_avg,
arg_max(v / 4, event_id) filter (k = 'signup') as skin_temp_dev_c from e group by 1, 2"""
UPSERT = UPSERT.replace("max_by({'x': case when event_id % 2 = 0 then v end}, event_id) filter (k = 'purchase').x as stress_avg", "struct_extract(arg_max({'x': case when event_id % 2 = 0 then v end}, event_id) filter (k = 'purchase'), 'x') as stress_avg")

PRECEDENCE = """with e as (select user_id, ts::date as date, event_id, event_type as k, floor(value)::int as v, value from events where user_id is not null and event_type in ('view', 'purchase', 'signup')),
a as (select *, not (k = 'view' and coalesce(bool_or(k = 'purchase') over (partition by user_id, date order by event_id rows between unbounded preceding and 1 preceding), false)) as ok from e)
select user_id, date, arg_max(v, event_id) filter (ok and k <> 'signup') as resting_hr, arg_max(value, event_id) filter (k = 'signup') as skin_temp_dev_c,
arg_max(case when k = 'view' then 'fit' else 'api' end, event_id) filter (ok and k <> 'signup') as source, count(*) filter (not ok)::bigint as blocked from a group by 1, 2"""

SNAPSHOTS = "select source || '/' || doc_id || '.json' as path, (date '2024-01-01' + (doc_id % 30)::int)::date as date, source as endpoint, octet_length(encode(text))::bigint as bytes, sha256(text) as sha256 from documents"
WRITE_ONCE = """with d as (select *, 'p' || (doc_id % 333) as path from documents),
f as (select *, row_number() over (partition by path order by doc_id) as nth from d where source <> 'src0')
select path, source as endpoint, octet_length(encode(text))::bigint as bytes, doc_id as fetched from f where nth = 1 and path not in (select path from d where source = 'src0')"""

EVENT_DAY = f"days as (select user_id, ts::date as date, count(*) as n, sum({MONEY})::double as s, min({MONEY})::double as lo, max({MONEY})::double as hi from events where user_id is not null group by 1, 2)"

# Messages of devices: kind number k, whole value v.
DEVICE = f"""m as (select user_id, case when user_id % 3 = 0 then 'export ' || strftime(ts, '%Y%m%d') else 'night-' || strftime(ts, '%Y-%m-%d') end as bundle, ts::date as day, event_id, case when event_id % 20 = 11 then 10 else event_id % 10 end as k, floor(value)::int as v, value, event_type, ts from events where user_id is not null),
steps as (select user_id, bundle, sum(greatest(s, 0))::bigint as steps, {h("sum(greatest(d, 0))", 1)} as distance_m from (select user_id, bundle, event_type, max(v) as s, max(value) as d from m where k in (0, 1) group by 1, 2, 3) group by 1, 2),
held as (select user_id, bundle, v % 5 as stage, lead(secs) over (partition by user_id, bundle order by secs, v % 5) - secs as held from (select *, floor(epoch(ts))::bigint as secs from m where k = 5)),
stages as (select user_id, bundle, (coalesce(sum(held) filter (stage = 3), 0) // 60)::int as deep_min, (coalesce(sum(held) filter (stage = 2), 0) // 60)::int as light_min, (coalesce(sum(held) filter (stage = 4), 0) // 60)::int as rem_min, (coalesce(sum(held) filter (stage = 1), 0) // 60)::int as awake_min, {whole("max(held) / 60")} as max_logging_gap_min from held where held is not null group by 1, 2),
votes as (select user_id, bundle, k, case when k = 9 then v % 7 else v % 150 end as x, count(*) as n, min(event_id) as seen from m where k = 9 or (k = 6 and v % 150 between 30 and 120) group by 1, 2, 3, 4),
modes as (select user_id, bundle, arg_min(x, (-n, seen)) filter (k = 9) as sleep_score, arg_min(x, (-n, seen)) filter (k = 6) as rhr_on_device from votes group by 1, 2),
naps as (select user_id, bundle, count(*)::bigint as naps, ({whole("1830 / 60")} * count(*))::int as nap_min, min(v) as v1 from m where k = 8 group by 1, 2),
tot as (select user_id, bundle, min(day) as day, coalesce(arg_min(event_id % 7 * 90, event_id) filter (k = 4), 0)::int as off, max(ts) filter (k in (0, 1)) as last_ts, min(v) filter (k in (0, 1) and v > 0) as hr_min, {whole(mean("v", " filter (k in (0, 1) and v > 0)"))} as hr_avg, max(v) filter (k in (0, 1) and v > 0) as hr_max, count(*) filter (k in (0, 1) and v > 0)::bigint as hr_samples,
  {whole(mean("v", " filter (k = 2 and v between 0 and 100)"))} as stress_avg, max(v) filter (k = 2 and v between 0 and 100) as stress_max,
  min(ts) filter (k = 3 and event_type = 'view') as a, max(ts) filter (k = 3 and event_type <> 'view') as b,
  arg_max(v, event_id) filter (k = 7) as hv, arg_max(v, event_id) filter (k = 10) as sv from m group by 1, 2),
dec as (select tot.*, case when user_id % 3 <> 0 then day else coalesce(case when b > a then (b + to_minutes(off))::date end, (last_ts + to_minutes(off))::date) end as date,
  case when b > a then strftime(a + to_minutes(off), '%Y-%m-%d %H:%M:%S') end as start_ts, case when b > a then strftime(b + to_minutes(off), '%Y-%m-%d %H:%M:%S') end as end_ts,
  {h("30 + sv / 256", 1)} as skin_nightly_c, {h("sv / 1000 - 0.25")} as skin_deviation_c, {h("sv / 10000", 3)} as skin_avg_dev_7d, steps, distance_m, case when b > a then {whole("date_sub('second', a, b) / 60")} end as sleep_min, {whole("hv * 64 / 128")} as last_night_avg, {whole("hv * 100 / 128")} as weekly_avg,
  case hv % 6 when 0 then 'none' when 1 then 'poor' when 2 then 'low' when 3 then 'unbalanced' when 4 then 'balanced' when 5 then '5' end as hrv_status,
  deep_min, light_min, rem_min, awake_min, sleep_score, rhr_on_device, nap_min, coalesce(rhr_on_device > hr_min + 10, false) as far, coalesce(max_logging_gap_min >= 45, false) as sparse
  from tot left join steps using (user_id, bundle) left join stages using (user_id, bundle) left join modes using (user_id, bundle) left join naps using (user_id, bundle))"""
FLAGS = "concat_ws(',', case when far then 'rhr_far_above_hr_floor' end, case when sparse then 'sparse_sleep_stage_logging' end)"

IMPORT = f"""with {DEVICE}, {SLEEP},
r as (
  select user_id, bundle, date, 'sleep' as t, {FLAGS} as f, exists (select 1 from sleep s where s.user_id = dec.user_id and s.date = dec.date) as blocked from dec where date is not null and (coalesce(sleep_score, sleep_min, deep_min, nap_min) is not null or far or sparse)
  union all select user_id, bundle, date, 'hrv', '', false from dec where hv is not null and date is not null
  union all select user_id, bundle, date, 'daily_wellness', '', false from dec where coalesce(case when not far then rhr_on_device end, hr_min, stress_avg, steps, skin_deviation_c) is not null and date is not null)
select user_id, bundle, max(date) as date, coalesce(string_agg(t, ',' order by t) filter (not blocked), '') as imported, coalesce(string_agg(t, ',' order by t) filter (blocked), '') as skipped, max(f) as flags from r group by 1, 2"""

def iso(sql: str, *days: str) -> str:
    """Days as YYYY-MM-DD text, as the registered queries give them."""
    cells = ", ".join(f"strftime(\"{d}\", '%Y-%m-%d') as \"{d}\"" for d in days)
    return f"select * replace ({cells}) from ({sql})"


#: Columns that are days, by query.
DAYS_OF = {
    "baselines_latest": ("start", "end"),
    "baselines_fixed_end": ("start", "end"),
    "stored_baselines": ("start", "end"),
    "streaks": ("start", "end"),
    "coverage": ("first_date", "last_date"),
    "default_ranges": ("start", "end", "long_start", "long_end"),
} | {
    name: ("date",)
    for name in "anomalies day_views list_activities_newest list_activities_filtered get_activities gaps gaps_in_order gaps_default_range recent_errors errors_in_range ledger_fold sync_plan partial_upsert source_precedence import_report snapshot_index snapshot_files stored_import activity_fan_out parse_usersummary parse_sleep parse_hrv parse_training_status parse_activities device_decode device_rows device_sleep_rows device_hrv_rows device_import table_sink ingested_activities".split()
}

PLAIN = {
    "trend_daily": trend("daily"),
    "trend_weekly": trend("weekly"),
    "trend_monthly": trend("monthly"),
    "metric_stats_weekly": STATS,
    "categorical_daily": CATEGORICAL,
    "correlate_lag": correlate(False),
    "correlate_lag_scan": correlate(True),
    "baselines_latest": baselines(14, None),
    "baselines_fixed_end": baselines(7, "2024-01-20"),
    "anomalies": ANOMALIES,
    "streaks": STREAKS,
    "day_views": DAY_VIEWS,
    "list_activities_newest": newest(5),
    "list_activities_filtered": newest(3, "type = '1-URGENT' and date between date '1996-01-01' and date '1999-12-31' and distance_m >= 100000"),
    "get_activities": f"with {ACTS} select user_id, activity_id, date, name, type, distance_m from acts where activity_id in (select l_orderkey from lineitem where l_quantity >= 49)",
    "gaps": GAPS,
    "gaps_default_range": GAPS_DEFAULT,
    "coverage": COVERAGE,
    "sync_summary": f"with {LOG} select user_id, floor(epoch(max(last_at)))::bigint as last_sync, count(*) filter (status = 'error')::bigint as errors from led group by 1",
    "recent_errors": f"with {LOG}, r as (select *, row_number() over (partition by user_id order by date desc, endpoint)::int as rank from led where status = 'error') select user_id, date, endpoint, last_error, rank from r where rank <= 10",
    "errors_in_range": f"with {LOG} select user_id, date, endpoint, last_error from led where status = 'error' and {IN}",
    "ledger_fold": f"with {LOG} select user_id, endpoint, date, status, attempts, last_error, floor(epoch(last_at))::bigint as updated from led",
    "sync_plan": SYNC_PLAN,
    "sync_report": SYNC_REPORT,
    "partial_upsert": UPSERT,
    "source_precedence": PRECEDENCE,
    "import_report": IMPORT,
    "snapshot_index": SNAPSHOTS,
    "snapshot_write_once": WRITE_ONCE,
    "activity_fan_out": "select o_custkey as user_id, 'activities/' || o_orderkey || '.json' as path, o_orderdate::date as date, o_totalprice as distance from orders",
    "unknown_endpoints": "select source as endpoint, count(*)::bigint as n from documents group by 1",
    "parse_usersummary": f"with {EVENT_DAY} select user_id, date, {whole('lo')} as resting_hr, n::int as steps, s as distance_m, {whole('hi')} as floors_up, {whole('n * 1.5')} as calories_total, case when n > 2 then lo end as skin_temp_dev_c, 'api' as source from days",
    "parse_sleep": f"with {EVENT_DAY} select user_id, date, floor(hi)::int as score, {h('n * 3601 / 60', 1)} as duration_min, {whole('n * 90 / 60')} as deep_min, {whole('n * 30 / 60')} as light_min, n::int as restless_moments, '2024-01-01 00:00:00' as start_ts, 'api' as source from days",
    "parse_hrv": f"with {EVENT_DAY} select user_id, date, n::int as last_night_avg, 'balanced' as status, floor(lo)::int as baseline_low, floor(hi)::int as baseline_high, 'api' as source from days where n > 1",
    "parse_training_status": f"with {EVENT_DAY} select user_id, date, 'productive_1' as status, n::double as vo2max, s as acute_load, 1.1::double as load_ratio from days",
    "parse_activities": f"select o_custkey as user_id, o_orderkey as activity_id, o_orderdate::date as date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as start_ts, o_orderstatus as name, o_orderpriority as type, o_custkey * 10.0::double as duration_s, o_totalprice as distance_m, {whole('o_custkey % 200 + 0.5')} as avg_hr, {h('o_custkey * 10.0::double / (o_totalprice / 1000)', 4)} as pace, 'activities/' || o_orderkey || '.json' as raw_path from orders",
    "rebuild_counts": f"with {EVENT_DAY} select 'daily_wellness' as \"table\", count(*)::bigint as rows from days union all select 'sleep', count(*) from days union all select 'hrv', count(*) from days where n > 1 union all select 'training_status', count(*) from days union all select 'activities', count(*) from orders",
    "rebuilt_ledger": f"with {EVENT_DAY}, l as (select unnest(['usersummary', 'sleep', 'training_status', 'hrv']) as endpoint, unnest(['ok', 'ok', 'ok', case when n > 1 then 'ok' else 'empty' end]) as status from days union all select 'activities', 'ok' from (select distinct o_custkey, o_orderdate::date from orders)) select endpoint, status, count(*)::bigint as n from l group by 1, 2",
    "device_decode": f"with {DEVICE} select user_id, bundle, date, hr_min, hr_avg, hr_max, hr_samples, steps, distance_m, stress_avg, stress_max, sleep_min, last_night_avg, weekly_avg, hrv_status, skin_nightly_c, skin_deviation_c, skin_avg_dev_7d, {FLAGS} as flags from dec",
    "device_stages": f"with {DEVICE} select * from stages",
    "device_modes": f"with {DEVICE} select * from modes",
    "device_naps": f"with {DEVICE} select user_id, bundle, naps, nap_min, strftime(timestamp '1989-12-31' + to_seconds(v1 * 1000 + 60 * case when v1 % 2 = 0 then 60 else off end), '%Y-%m-%d %H:%M:%S') as first_start from naps join tot using (user_id, bundle)",
    "device_rows": f"with {DEVICE} select user_id, bundle, date, case when not far then rhr_on_device end as resting_hr, hr_min as min_hr, hr_max as max_hr, steps::int as steps, distance_m, stress_avg, skin_deviation_c as skin_temp_dev_c, 'fit' as source from dec where coalesce(case when not far then rhr_on_device end, hr_min, stress_avg, steps, skin_deviation_c) is not null and date is not null",
    "device_sleep_rows": f"with {DEVICE} select user_id, bundle, date, sleep_score as score, sleep_min::double as duration_min, deep_min, light_min, rem_min, awake_min, start_ts, end_ts, nap_min, case when far or sparse then {FLAGS} end as quality_flags, 'fit' as source from dec where date is not null and (coalesce(sleep_score, sleep_min, deep_min, nap_min) is not null or far or sparse)",
    "device_hrv_rows": f"with {DEVICE} select user_id, bundle, date, last_night_avg, weekly_avg, {whole("hv * 32 / 128")} as high_5min, hrv_status as status, {whole("(hv * 10 + 1) / 128")} as baseline_low, {whole("(hv * 20 + 3) / 128")} as baseline_high, 'fit' as source from dec where hv is not null and date is not null",
    "device_import": f"""with {DEVICE}, {SLEEP},
f as (select user_id, date, bundle, sleep_score, sleep_min::double as duration_min, deep_min, nap_min from dec where date is not null and (coalesce(sleep_score, sleep_min, deep_min, nap_min) is not null or far or sparse)),
c as (select user_id, ts::date as date, count(*)::int as deep_min from events where event_type = 'purchase' and user_id is not null group by all)
select user_id, date, score, duration_min, deep_min, null::int as nap_min, 'api' as source from sleep join c using (user_id, date)
union all select user_id, date, sleep_score, duration_min, deep_min, nap_min, 'fit' from (select user_id, date, arg_max({{'s': sleep_score, 'd': duration_min, 'p': deep_min, 'n': nap_min}}, bundle) as x from f anti join sleep using (user_id, date) group by 1, 2), lateral (select x.s as sleep_score, x.d as duration_min, x.p as deep_min, x.n as nap_min)""",
    "table_sink": f"with {SLEEP} select user_id, date, score, duration_min, 'api' as source from sleep",
    "device_source": f"with {DEVICE}, k as (select *, ['monitoring', 'monitoring', 'stress_level', 'event', 'timestamp_correlation', 'unknown_275', 'unknown_281', 'unknown_370', 'unknown_412', 'unknown_521', 'unknown_398'][k + 1] as name from m) select bundle, name, count(*)::bigint as n, sum(v)::bigint as heart_rate, min(event_id) as first_seq from k group by 1, 2",
    "series_in_order": f"with {WELLNESS}, {SLEEP}, {EVENT_ACTS}, {long({n: TREND[n] for n in list(TREND)[:3]})}, {labelled('weekly')}, w as (select user_id, label as date, max(v) filter (metric = 'resting_hr') as resting_hr, max(v) filter (metric = 'distance_m') as distance_m, max(v) filter (metric = 'sleep_duration_min') as sleep_duration_min, row_number() over (partition by user_id order by label desc) as back from bucketed group by user_id, label) select * exclude (back), row_number() over (partition by user_id order by date)::int as position from w where back <= 3",
    "default_ranges": "with s as (select user_id, (timezone('Asia/Tokyo', timezone('UTC', max(ts)))::date - 1) as e1, (timezone('America/Los_Angeles', timezone('UTC', max(ts)))::date - 1) as e2 from events where user_id is not null group by 1) select user_id, e1 - 6 as start, e1 as \"end\", e2 - 29 as long_start, e2 as long_end from s",
}

PLAIN["ingested_activities"] = PLAIN["parse_activities"]
PLAIN["stored_baselines"] = PLAIN["baselines_latest"]
PLAIN["gaps_in_order"] = f"""select *, row_number() over (partition by user_id order by "table", date) - 1 as rows_before from ({GAPS})"""
PLAIN["stored_import"] = PLAIN["device_import"]
PLAIN["snapshot_files"] = """with d as (select *, (date '2024-01-01' + (doc_id % 30)::int)::date as day from documents where text is not null)
select doc_id % 7 as user_id, case when doc_id % 4 = 0 then 'activities/' || doc_id || '.json' else 'daily/2024/' || strftime(day, '%Y-%m-%d') || '/' || source || '-' || doc_id || '.json' end as path,
case when doc_id % 4 <> 0 then day end as date, case when doc_id % 4 = 0 then 'activity' else source || '-' || doc_id end as endpoint, octet_length(encode(text))::bigint as bytes, sha256(text) as sha256 from d"""

ORACLES = {name: iso(sql, *DAYS_OF[name]) if name in DAYS_OF else sql for name, sql in PLAIN.items()}
