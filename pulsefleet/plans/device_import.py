"""Import of device bundles: messages to decoded bundles, admitted rows, tables and a report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefleet.operators.device import decode_bundles, device_rows, undated
from pulsefleet.operators.merge import admit, contribution, import_report, upsert
from pulsefleet.sources.schemas import DAILY, KEYS, TABLES, value_columns
from pulsefleet.sources.store import Store, place_name
from pulsefleet.sources.tables import write_table
from pulsefleet.sources.warehouse import month_of, replace_tables

#: The tables that devices write to.
WRITTEN = DAILY


class Imported(NamedTuple):
    tables: dict[str, DataFrame]
    report: DataFrame
    rejected: DataFrame


def import_bundles(messages: DataFrame, existing: Mapping[str, DataFrame], force: bool = False) -> Imported:
    """Tables with the bundles on top, a report per bundle, and the bundles that no date can be found for.

    ``existing``: tables to write to; one that is missing counts as empty. A row that the vendor gave keeps its values
    unless forced. Bundles of one day write in the order of their names.
    """
    return import_decoded(decode_bundles(messages), existing, force)


def import_decoded(decoded: DataFrame, existing: Mapping[str, DataFrame], force: bool = False) -> Imported:
    """As import_bundles, of bundles that are decoded."""
    tables, admitted = {}, []
    for table, rows in device_rows(decoded).items():
        old = existing.get(table)
        keep = [*KEYS[table], "source"]
        if old is not None:
            held = old.filter("source is not null").select(*keep, F.lit(None).cast("string").alias("bundle"), F.lit("").alias("write_seq"))
            judged = admit(rows.withColumn("write_seq", F.concat(F.lit("b"), "bundle")).unionByName(held, allowMissingColumns=True), table, force)
            judged = judged.filter("bundle is not null")
        else:
            judged = rows.withColumns({"write_seq": F.concat(F.lit("b"), "bundle"), "admitted": F.lit(True)})
        flags = F.col("quality_flags") if "quality_flags" in judged.columns else F.lit(None).cast("array<string>")
        admitted.append(judged.select("user_id", "bundle", "date", "admitted", F.lit(table).alias("table"), flags.alias("flags")))
        owned = [c for c in value_columns(table) if c in rows.columns]
        parts = contribution(judged.filter("admitted"), table, owned, "write_seq")
        base = decoded.sparkSession.createDataFrame([], parts.drop("owned", "write_seq").schema) if old is None else old
        tables[table] = upsert(base, parts, table)
    return Imported(tables, import_report(reduce(DataFrame.unionByName, admitted)), undated(decoded))


def write_import(done: Imported, folder: str) -> None:
    """Write the tables, whole, by month."""
    for table, rows in done.tables.items():
        write_table(rows, table, folder)


def import_into(messages: DataFrame, root: str, force: bool = False) -> Imported:
    """Import bundles into the store under ``root``: only the months that admitted rows lie in are read and written, all at once.

    The report and the rejected bundles are returned; ``tables`` holds the months' new rows.
    """
    spark = messages.sparkSession
    batch = Store(spark, root).begin()
    decoded = decode_bundles(messages).persist()
    months = [r[0] for r in decoded.filter("date is not null").select(month_of("date").alias("month")).distinct().collect()]
    places = [place_name({"month": m}) for m in months]
    held = {t: batch.read(t, TABLES[t] + ", month string", places).drop("month") for t in WRITTEN}
    done = import_decoded(decoded, held, force)
    report = done.report.persist()
    report.count()  # judged against the rows before the import
    if months:
        replace_tables(batch, done.tables, months)
        batch.publish()
    decoded.unpersist()
    return done._replace(report=report, tables={t: Store(spark, root).read(t, TABLES[t] + ", month string", places) for t in WRITTEN})


__all__ = ["Imported", "import_bundles", "import_into", "write_import"]
