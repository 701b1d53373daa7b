"""Table schemas, keys, and which columns each writer owns."""

from __future__ import annotations

TABLES = {
    "daily_wellness": "user_id bigint, date date, resting_hr int, min_hr int, max_hr int, steps int, distance_m double, floors_up int, stress_avg int, stress_max int, body_battery_high int, body_battery_low int, calories_total int, calories_active int, spo2_avg double, respiration_avg double, skin_temp_dev_c double, intensity_min_moderate int, intensity_min_vigorous int, source string, fetched_at timestamp",
    "sleep": "user_id bigint, date date, score int, duration_min double, deep_min int, light_min int, rem_min int, awake_min int, start_ts timestamp_ntz, end_ts timestamp_ntz, avg_spo2 double, avg_respiration double, avg_stress int, restless_moments int, nap_min int, quality_flags array<string>, source string, fetched_at timestamp",
    "hrv": "user_id bigint, date date, last_night_avg int, weekly_avg int, high_5min int, status string, baseline_low int, baseline_high int, source string, fetched_at timestamp",
    "training_status": "user_id bigint, date date, status string, vo2max double, acute_load double, load_ratio double, fetched_at timestamp",
    "activities": "user_id bigint, activity_id bigint, date date, start_ts timestamp_ntz, name string, type string, duration_s double, distance_m double, elevation_gain_m double, avg_hr int, max_hr int, calories int, avg_pace_s_per_km double, training_load double, aerobic_te double, anaerobic_te double, raw_path string, fetched_at timestamp",
}
KEYS = {name: ["user_id", "activity_id" if name == "activities" else "date"] for name in TABLES}
#: Tables in which a day without a row is a gap.
DAILY = ("daily_wellness", "sleep", "hrv")

RAW = "user_id bigint, path string, date date, endpoint string, fetched_at timestamp, content string"
LEDGER = "user_id bigint, endpoint string, date date, seq bigint, status string, error string, at timestamp"
DEVICE = "user_id bigint, bundle string, file string, seq bigint, name string, ts timestamp_ntz, local_ts timestamp_ntz, heart_rate int, activity_type string, steps bigint, distance double, stress_level_value int, event int, event_type string, u map<string,double>"

#: Fixed order of the endpoints, which is also their order of work.
ENDPOINTS = ("usersummary", "sleep", "hrv", "training_status", "activities")


def columns(table: str) -> list[tuple[str, str]]:
    """(name, type) of a table's columns."""
    return [tuple(part.strip().split(" ", 1)) for part in TABLES[table].split(", ")]


def value_columns(table: str) -> list[str]:
    return [name for name, _ in columns(table) if name not in KEYS[table]]
