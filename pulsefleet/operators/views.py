"""Day views, activity lists and gap reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.functions.calendar import check_range, parse_day
from pulsefleet.sources.schemas import DAILY

from .series import Warehouse, in_range

# The columns that lists and day views show.
LISTED = ("activity_id", "date", "name", "type", "duration_s", "distance_m", "elevation_gain_m", "avg_hr")
IN_DAY = ("activity_id", "name", "type", "duration_s", "distance_m", "avg_hr")


def day_views(warehouse: Warehouse, start: str | Date, end: str | Date) -> DataFrame:
    """user_id, date, wellness, sleep, hrv, training, activities, flags for every day with any row.

    The sections are JSON texts of what is not null ("{}" for no row); activities are ordered by
    start and id.
    """
    first, last = check_range(start, end)
    sections = {"wellness": "daily_wellness", "sleep": "sleep", "hrv": "hrv", "training": "training_status"}
    parts = []
    for name, table in sections.items():
        rows = in_range(warehouse[table], first, last)
        shown = [c for c in rows.columns if c not in ("user_id", "date", "month", "fetched_at", "quality_flags")]
        flags = F.coalesce("quality_flags", F.array().cast("array<string>")) if "quality_flags" in rows.columns else F.lit(None).cast("array<string>")
        parts.append(rows.select("user_id", "date", F.lit(name).alias("section"), F.to_json(F.struct(*shown)).alias("json"), flags.alias("flags"), F.lit(None).alias("activity")))
    kinds = ", ".join(f"{c}:{dict(warehouse['activities'].dtypes)[c]}" for c in ("start_ts", *IN_DAY))
    parts = [p.withColumn("activity", F.col("activity").cast(f"struct<{kinds}>")) for p in parts]
    acts = in_range(warehouse["activities"], first, last)
    parts.append(acts.select("user_id", "date", F.lit("activity").alias("section"), F.lit(None).cast("string").alias("json"), F.lit(None).cast("array<string>").alias("flags"), F.struct("start_ts", *IN_DAY).alias("activity")))
    rows = reduce(DataFrame.unionByName, parts).filter("date is not null")
    # collect_list skips the nulls of the other sections.
    ordered = F.array_sort(F.collect_list("activity"))
    out = rows.groupBy("user_id", "date").agg(
        *[F.coalesce(F.max(F.when(F.col("section") == name, F.col("json"))), F.lit("{}")).alias(name) for name in sections],
        F.transform(ordered, lambda a: F.struct(*[a[c].alias(c) for c in IN_DAY])).alias("activities"),
        F.coalesce(F.max("flags"), F.array().cast("array<string>")).alias("flags"),
    )
    return out


def list_activities(warehouse: Warehouse, type: str | None = None, start: str | Date | None = None, end: str | Date | None = None, min_distance_m: float | None = None, limit: int = 20) -> DataFrame:
    """Each user's newest activities that pass the filters, with n and truncated.

    The rank limit comes before anything else looks at the group, so tasks prune before the shuffle.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    first = None if start is None else parse_day(start, "start")
    last = None if end is None else parse_day(end, "end")
    rows = in_range(warehouse["activities"], first, last)
    if type is not None:
        rows = rows.filter(F.col("type") == type)
    if min_distance_m is not None:
        rows = rows.filter(F.col("distance_m") >= min_distance_m)
    newest = Window.partitionBy("user_id").orderBy(F.col("date").desc(), F.col("start_ts").desc(), F.col("activity_id").desc())
    own = Window.partitionBy("user_id")
    top = rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit + 1)
    top = top.withColumn("seen", F.max("rank").over(own))
    return top.filter(F.col("rank") <= limit).select("user_id", *LISTED, "rank", F.least("seen", F.lit(limit)).alias("n"), (F.col("seen") > limit).alias("truncated"))


def get_activities(warehouse: Warehouse, keys: DataFrame) -> DataFrame:
    """Full rows of the (user_id, activity_id) in ``keys``; a key without a row has none here."""
    return warehouse["activities"].join(keys.select("user_id", "activity_id").distinct(), ["user_id", "activity_id"], "left_semi")


def get_activity(warehouse: Warehouse, user_id: int, activity_id: int) -> DataFrame:
    """The row of one activity; LookupError if there is none."""
    row = warehouse["activities"].filter((F.col("user_id") == user_id) & (F.col("activity_id") == activity_id))
    if row.isEmpty():
        raise LookupError(f"user {user_id} has no activity {activity_id}")
    return row


#: Days whose presence one number holds.
BITS = 64


def block_of(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BITS)


def present_days(warehouse: Warehouse, tables: Sequence[str], first: Date | None, last: Date) -> DataFrame:
    """(user_id, held): of every user with any row a map from (table, block of days) to the bits of the days that have rows.

    Tasks shrink their rows to one number per user, table and block before they move; days out of range leave the user alone.
    """
    have = reduce(DataFrame.unionByName, [warehouse[t].select("user_id", F.lit(t).alias("table"), "date") for t in tables])
    inside = F.col("date") <= F.lit(last)
    inside = inside & (F.col("date") >= F.lit(first)) if first is not None else inside
    own = lambda value, name: F.when(inside, value).alias(name)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.unix_date("date"), F.lit(BITS)))
    blocks = have.groupBy("user_id", own(F.col("table"), "table"), own(block_of(F.col("date")), "block")).agg(F.bit_or(own(bit, "bits")).alias("bits"))
    entry = F.when(F.col("block").isNotNull(), F.struct(F.struct("table", "block").alias("key"), F.col("bits").alias("value")))
    return blocks.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("held"))


def missing_days(ranges: DataFrame, tables: Sequence[str]) -> DataFrame:
    """(user_id, table, date) of the days from first to last that ``held`` (see present_days) lacks: no day is a row before this."""
    number = lambda c: F.unix_date(c)
    wanted = ranges.withColumn("table", F.explode(F.array(*map(F.lit, tables))))
    bits = lambda b: F.coalesce(F.try_element_at("held", F.struct(F.col("table"), b.alias("block"))), F.lit(0).cast("long"))
    blocks = F.transform(F.sequence(block_of(F.col("first")), block_of(F.col("last"))), lambda b: F.struct(b.alias("block"), bits(b).alias("bits")))

    def lacking(b: Column) -> Column:
        low, high = F.greatest(number("first"), b["block"] * BITS), F.least(number("last"), b["block"] * BITS + BITS - 1)
        days = F.filter(F.sequence(low, high), lambda d: F.getbit(b["bits"], F.pmod(d, F.lit(BITS))) == 0)
        return F.transform(days, lambda d: F.date_from_unix_date(d.cast("int")))

    return wanted.select("user_id", "table", F.explode(F.flatten(F.transform(blocks, lacking))).alias("date"))


def gaps(warehouse: Warehouse, start: str | Date, end: str | Date, tables: Sequence[str] = DAILY) -> DataFrame:
    """(user_id, table, date) of days without a row; a row counts whatever its values. Users are those with a row in any of the tables."""
    first, last = check_range(start, end)
    held = present_days(warehouse, tables, first, last)
    return missing_days(held.withColumns({"first": F.lit(first), "last": F.lit(last)}), tables)


def gaps_by_user_range(warehouse: Warehouse, ledger: DataFrame, end: str | Date, tables: Sequence[str] = DAILY) -> DataFrame:
    """As gaps, but each user's range begins on the first day of their ledger."""
    last = parse_day(end, "end")
    ranges = ledger.groupBy("user_id").agg(F.min("date").alias("first")).filter(F.col("first") <= F.lit(last)).withColumn("last", F.lit(last))
    none = F.map_from_entries(F.array().cast("array<struct<key:struct<table:string,block:bigint>,value:bigint>>"))
    held = ranges.join(present_days(warehouse, tables, None, last), "user_id", "left")
    return missing_days(held.withColumn("held", F.coalesce("held", none)), tables)


__all__ = ["day_views", "gaps", "gaps_by_user_range", "get_activities", "get_activity", "list_activities"]
