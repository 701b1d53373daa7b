"""What the training-data operators share: reading, shared storage, hash splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes; bytes.split() splits on exactly these.
ASCII_SPACE = r"[\x20\x09-\x0D]+"

#: Rows of a batch that a task looks at at once.
PART = 500
#: Files whose numbers may be broadcast, some 200 bytes each.
FILES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under spark.checkpoint.dir, the folder that all machines share.

    Only a purely local session may go without that setting; it gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="pulsefleet-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, rows_per_file: int = 0, rows_per_group: int = 0) -> DataFrame:
    """Write to shared storage and read again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    out = df.write.option("maxRecordsPerFile", rows_per_file)
    if rows_per_group:
        out = out.option("parquet.block.row.count.limit", rows_per_group)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a location as Spark names it (file:/... included)."""
    return pafs.FileSystem.from_uri("/" + uri[len("file:") :].lstrip("/") if uri.startswith("file:") else uri)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more; what the file system can't delete stays."""
    for path in {p.rpartition("/")[0] for t in tables for p in t.inputFiles()}:
        try:
            fs, root = file_system(path)
            fs.delete_dir(root)
        except (pa.ArrowInvalid, OSError, NotImplementedError):
            pass


def row_numbers(rows: DataFrame, name: str) -> DataFrame:
    """rows with a number of its own for every row, the same in every job, however the scan is cut.

    A row of a file is numbered by its file's place among the sorted paths (which the planner of a scan holds on the
    driver anyway) and its own place in the file: 2**27 files of 2**36 rows. Up to FILES paths are broadcast. Rows that come from no
    files are written with their numbers.
    """
    try:
        placed = rows.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_place"))
    except AnalysisException:
        return materialize(rows.withColumn(name, F.monotonically_increasing_id()), "numbered")
    paths = sorted(r[0] for r in placed.select(f"{name}_file").distinct().collect())
    files = rows.sparkSession.createDataFrame(list(enumerate(paths)), f"{name} long, {name}_file string")
    if len(paths) <= FILES:
        files = F.broadcast(files)
    number = F.shiftleft(name, 36) + F.col(f"{name}_place")
    return placed.join(files, f"{name}_file").withColumn(name, number).drop(f"{name}_file", f"{name}_place")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, PART at a time: what Python makes of a batch's texts need not stand beside all of them."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PART):
            yield batch.slice(lo, PART)


def crc_mod(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
