"""A warehouse drawn from a seeded generator, with its own copy in plain Python to compute expectations from.

User 11 is drawn day by day and carries what tests look for: a peak, a calm stretch, two nights without sleep
data, and sleep that follows stress by two days. User 12 is drawn alike from another seed, user 13 never
changes, user 14 has four days only.
"""

import random
from datetime import date, datetime, timedelta

from pulsefleet.queries import typed
from pulsefleet.sources.schemas import TABLES

N = 35
FIRST = date(2024, 3, 4)
LAST = FIRST + timedelta(days=N - 1)
PEAK, CALM, MISSING = 9, range(20, 27), (17, 30)


def day(i):
    return FIRST + timedelta(days=i)


def drawn(seed, n=N):
    """Per day: resting rate, steps, stress, night (score, minutes) or None, hrv."""
    rng, out, stress = random.Random(seed), [], []
    for i in range(n):
        stress.append(rng.randrange(15, 70))
        rest = 95 if i == PEAK else 48 if i in CALM else rng.randrange(57, 64)
        night = None if i in MISSING else (rng.randrange(60, 90), 300.0 + 3 * stress[max(i - 2, 0)])
        out.append((rest, rng.randrange(3000, 9000) if i < n - 1 else 30_000, stress[-1], night, rng.randrange(40, 60)))
    return out


DAYS = {11: drawn(5), 12: drawn(6), 13: [(60, 5000, 30, (75, 400.0 + i % 7), 50) for i in range(N)], 14: drawn(7, 4)}
#: user, id, day, hour, name, type, seconds, metres, climb, rate
ACTS = [
    (11, 501, 1, 18, "Evening swim", "swimming", 2400.0, 1500.0, 0.0, 128),
    (11, 502, 6, 6, "Harbour loop", "hiking", 9000.0, 14000.0, 310.0, 112),
    (11, 503, 6, 17, "Short swim", "swimming", 900.0, 600.0, 0.0, 121),
    (11, 504, 12, 7, "Dunes", "hiking", 7200.0, 11000.0, 95.0, 109),
    (11, 505, 33, 7, "Laps", "swimming", 1800.0, 1000.0, 0.0, 133),
    (12, 501, 3, 9, "Unmeasured", "swimming", 300.0, None, None, None),
]


def warehouse(spark):
    wellness = [(u, day(i), r, s, x) for u, days in DAYS.items() for i, (r, s, x, _, _) in enumerate(days)]
    sleep = [(u, day(i), n[0], n[1], ["sparse_sleep_stage_logging"] if (u, i) == (11, 4) else None) for u, days in DAYS.items() for i, (_, _, _, n, _) in enumerate(days) if n]
    hrv = [(11, day(i), h, "unbalanced" if h < 45 else "balanced") for i, (_, _, _, _, h) in enumerate(DAYS[11])]
    acts = [(u, k, day(d), datetime.combine(day(d), datetime.min.time()).replace(hour=h), *more) for u, k, d, h, *more in ACTS]
    frames = {
        "daily_wellness": spark.createDataFrame(wellness, "user_id long, date date, resting_hr int, steps int, stress_avg int"),
        "sleep": spark.createDataFrame(sleep, "user_id long, date date, score int, duration_min double, quality_flags array<string>"),
        "hrv": spark.createDataFrame(hrv, "user_id long, date date, last_night_avg int, status string"),
        "training_status": spark.createDataFrame([], "user_id long, date date"),
        "activities": spark.createDataFrame(acts, "user_id long, activity_id long, date date, start_ts timestamp_ntz, name string, type string, duration_s double, distance_m double, elevation_gain_m double, avg_hr int"),
    }
    return {name: typed(frames[name], name).cache() for name in TABLES}
