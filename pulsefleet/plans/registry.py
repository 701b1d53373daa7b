"""Named metrics: a table, a Column expression, and how days add up.

One registration makes a metric known to every operator.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(NamedTuple):
    """kind: "level" is averaged over a week or month, "amount" is added up, "category" has no numbers."""

    name: str
    table: str
    expr: Callable[[], Column]
    kind: str

    @property
    def numeric(self) -> bool:
        return self.kind != "category"

    @property
    def additive(self) -> bool:
        return self.kind == "amount"


METRICS: dict[str, Metric] = {}
#: What baselines and anomalies look at unless told otherwise.
DEFAULT_METRICS = ("resting_hr", "hrv", "sleep_score", "skin_temp_dev_c", "stress_avg", "steps")


def register_metric(name: str, table: str, expr: str | Callable[[], Column], kind: str = "level") -> Metric:
    """``expr``: a column name, or a function giving a Column (an aggregate, for ``activities``)."""
    METRICS[name] = Metric(name, table, (lambda: F.col(expr)) if isinstance(expr, str) else expr, kind)
    return METRICS[name]


def resolve(names: Sequence[str], what: str = "", numeric: bool = False) -> list[Metric]:
    """Metrics by name; refuses none, unknown, repeated and (on request) categorical ones."""
    asked = Counter(names)
    wrong = {
        "no metric is asked for": not asked,
        "asked for twice": sorted(n for n, times in asked.items() if times > 1),
        f"not among {', '.join(sorted(METRICS))}": sorted(asked.keys() - METRICS.keys()),
        f"categories, but {what} takes numbers": sorted(n for n in asked.keys() & METRICS.keys() if numeric and not METRICS[n].numeric),
    }
    for why, which in wrong.items():
        if which:
            raise ValueError(why if which is True else f"{', '.join(which)}: {why}")
    return [METRICS[n] for n in names]


# The vocabulary of metric names and the columns behind them.
for _name in "resting_hr min_hr max_hr steps distance_m floors_up stress_avg stress_max body_battery_high body_battery_low calories_total calories_active spo2_avg respiration_avg skin_temp_dev_c intensity_min_moderate intensity_min_vigorous".split():
    register_metric(_name, "daily_wellness", _name)
register_metric("sleep_score", "sleep", "score")
register_metric("sleep_duration_min", "sleep", "duration_min")
for _name in "deep_min light_min rem_min awake_min restless_moments nap_min".split():
    register_metric(_name, "sleep", _name)
register_metric("hrv", "hrv", "last_night_avg")
register_metric("hrv_weekly", "hrv", "weekly_avg")
register_metric("hrv_status", "hrv", "status", "category")
for _name in ("vo2max", "acute_load", "load_ratio"):
    register_metric(_name, "training_status", _name)
register_metric("activity_count", "activities", lambda: F.count(F.lit(1)), "amount")
register_metric("activity_duration_s", "activities", lambda: F.sum("duration_s"), "amount")
register_metric("activity_distance_m", "activities", lambda: F.sum("distance_m"), "amount")
register_metric("elevation_gain_m", "activities", lambda: F.sum("elevation_gain_m"), "amount")
register_metric("training_load", "activities", lambda: F.sum("training_load"), "amount")
