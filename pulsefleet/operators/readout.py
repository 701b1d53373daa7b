"""Results in the order they are shown in, and the ranges of jobs that name none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.functions.calendar import trailing, yesterday

#: What a user's rows of a result are ordered by.
ORDERS: dict[str, tuple[Column | str, ...]] = {
    "series": ("date",),
    "anomalies": ("date", "metric"),
    "streaks": ("start", "metric"),
    "gaps": ("table", "date"),
    "errors": ("date", "endpoint"),
    "days": ("date",),
    "activities": ("rank",),
}


def read_out(rows: DataFrame, kind: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """rows with ``position`` (from 1) in each user's order; the first or the last so many of them.

    A limit by rank prunes before the shuffle; for one result in order, sort by (user_id, position).
    """
    if first is not None and last is not None:
        raise ValueError("first or last, not both")
    if min(x for x in (first, last, 1) if x is not None) < 1:
        raise ValueError("a limit must be 1 or more")
    order = [F.col(c) for c in ORDERS[kind]]
    if last is not None:
        back = Window.partitionBy("user_id").orderBy(*[c.desc() for c in order])
        rows = rows.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= last).drop("back")
    own = Window.partitionBy("user_id").orderBy(*[c.asc() for c in order])
    out = rows.withColumn("position", F.row_number().over(own))
    return out if first is None else out.filter(F.col("position") <= first)


def write_in_order(rows: DataFrame, kind: str, folder: str) -> None:
    """Write a result so that its files, by name, and the rows in them stand in order: users are dealt to files by ranges."""
    order = ["user_id", *(c for c in ORDERS[kind] if c in rows.columns)]
    rows.repartitionByRange("user_id").sortWithinPartitions(*order).write.parquet(folder)


def default_range(instant: Column, zone: str, days: int) -> Column:
    """(start, end) of the ``days`` days that end yesterday in a zone."""
    end = yesterday(instant, zone)
    return F.struct(trailing(end, days).alias("start"), end.alias("end"))


__all__ = ["ORDERS", "default_range", "read_out", "write_in_order"]
