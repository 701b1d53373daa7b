"""Ingest bookkeeping: a log of attempts, its fold, work plans and reports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date as Date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.functions.calendar import check_range
from pulsefleet.sources.schemas import ENDPOINTS

STATUSES = ("ok", "empty", "error")
DONE = ("ok", "empty")


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """(user_id, endpoint, date, status, attempts, last_error, updated_at) from the log, newest attempt by seq.

    A status outside STATUSES raises; an attempt that is not an error clears the error.
    """
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no status: "), F.coalesce("status", F.lit("null")))))
    last = F.max_by(F.struct(known.alias("status"), F.when(F.col("status") == "error", F.col("error")).alias("error")), F.struct("seq", "at", "status", "error"))
    return attempts.groupBy("user_id", "endpoint", "date").agg(last.alias("last"), F.count(F.lit(1)).alias("attempts"), F.max("at").alias("updated_at")).select("user_id", "endpoint", "date", "last.status", "attempts", F.col("last.error").alias("last_error"), "updated_at")


def sync_plan(ledger: DataFrame, users: DataFrame, start: str | Date, end: str | Date, force: bool = False, endpoints: tuple[str, ...] = ENDPOINTS) -> DataFrame:
    """(user_id, date, endpoint, turn) still to fetch; turn orders the endpoints within a day."""
    order = F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.lit(i).alias("turn")) for i, e in enumerate(endpoints)]))
    first, last = check_range(start, end)
    wanted = users.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("date")).select("user_id", "date", order.alias("e")).select("user_id", "date", "e.endpoint", "e.turn")
    if force:
        return wanted
    done = ledger.filter(F.col("status").isin(*DONE)).select("user_id", "date", "endpoint")
    return wanted.join(done, ["user_id", "date", "endpoint"], "left_anti")


def sync_report(ledger: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Per endpoint: days ok, empty, in error, and (given the day and endpoint pairs wanted) skipped as done before."""
    report = ledger.groupBy("endpoint").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.sum("attempts").alias("attempts"))
    if planned is None:
        return report
    done = ledger.filter(F.col("status").isin(*DONE))
    skipped = planned.join(done, ["user_id", "date", "endpoint"], "left_semi").groupBy("endpoint").agg(F.count(F.lit(1)).alias("skipped"))
    return report.join(skipped, "endpoint", "left").fillna(0, ["skipped"])


def coverage(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(user_id, table, rows, first_date, last_date) of every table."""
    parts = [df.groupBy("user_id").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def sync_state_summary(ledger: DataFrame) -> DataFrame:
    """Per user: time of the last attempt and number of open errors."""
    return ledger.groupBy("user_id").agg(F.max("updated_at").alias("last_sync"), F.count_if(F.col("status") == "error").alias("errors"))


def recent_errors(ledger: DataFrame, limit: int = 10) -> DataFrame:
    """Each user's newest open errors, by date downwards, then endpoint."""
    newest = Window.partitionBy("user_id").orderBy(F.col("date").desc(), "endpoint")
    errors = ledger.filter("status = 'error'").withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)
    return errors.select("user_id", "date", "endpoint", "last_error", "rank")


def errors_in_range(ledger: DataFrame, start: str | Date | None = None, end: str | Date | None = None) -> DataFrame:
    """Open errors of a range (or all), to be shown by date and endpoint."""
    rows = ledger.filter("status = 'error'")
    if start is not None and end is not None:
        first, last = check_range(start, end)
        rows = rows.filter(F.col("date").between(F.lit(first), F.lit(last)))
    return rows.select("user_id", "date", "endpoint", "last_error")


__all__ = ["coverage", "errors_in_range", "fold_attempts", "recent_errors", "sync_plan", "sync_report", "sync_state_summary"]
