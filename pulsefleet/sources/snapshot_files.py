"""Snapshot trees of a fleet, listed, read and written by tasks.

``root/user=<number>/daily/YYYY/YYYY-MM-DD/<endpoint>.json`` and ``root/user=<number>/activities/<id>.json``. The driver knows
the root only: one job lists the users' folders, the next their years, and the tasks that read a year's folder list its
files. So millions of files cost no memory of the driver, and a lost task lists and reads its own folders again. Reading
small files one by one is slow at any size: take a tree in once (``ingest_batch`` appends it to the store as Parquet).

The file system must be one that pyarrow opens (local or shared disk, S3, GCS, HDFS with its library);
``snapshots.read_snapshot_files`` reads any that Spark reads, with a listing by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RAW
from .snapshots import ACTIVITY_PATH, DAILY_PATH, USER_FOLDER

FOUND = "file string, fetched_at timestamp, content string"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a location as Spark names it."""
    return pafs.FileSystem.from_uri("/" + uri[len("file:") :].lstrip("/") if uri.startswith("file:") else uri) if ":" in uri else (pafs.LocalFileSystem(), uri)


def inner_folders(folders: DataFrame, root: str, tasks: int) -> DataFrame:
    """The folders in the folders (paths below root), dealt to tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                inside = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
                names = [f"{folder}/{x.base_name}".lstrip("/") for x in inside if x.type == pafs.FileType.Directory]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["folder"])

    return folders.mapInArrow(run, "folder string").repartition(tasks, "folder")


def read_snapshot_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Snapshots (see schemas.RAW) of all users' trees under root; files of other names are left out."""
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    users = inner_folders(spark.createDataFrame([("",)], "folder string"), root, n).filter(F.col("folder").startswith("user="))
    kinds = inner_folders(users, root, n)
    years = inner_folders(kinds.filter(F.col("folder").endswith("/daily")), root, n)
    leaves = years.unionByName(kinds.filter(F.col("folder").endswith("/activities")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        kind = pa.schema([("file", pa.string()), ("fetched_at", pa.timestamp("us", "UTC")), ("content", pa.string())])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files = [x for x in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}", recursive=True)) if x.type == pafs.FileType.File and x.extension == "json"]
                for lo in range(0, len(files), 100):
                    rows = []
                    for x in files[lo : lo + 100]:
                        with fs.open_input_stream(x.path) as stream:
                            rows.append({"file": x.path[len(base) :], "fetched_at": x.mtime, "content": stream.read().decode(errors="replace")})
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    found = leaves.mapInArrow(run, FOUND)
    day, endpoint, single = F.regexp_extract("file", DAILY_PATH, 1), F.regexp_extract("file", DAILY_PATH, 2), F.regexp_extract("file", ACTIVITY_PATH, 1)
    rows = found.select(
        F.regexp_extract("file", USER_FOLDER, 1).try_cast("long").alias("user_id"),
        F.regexp_replace("file", r"^.*?/user=\d+/", "").alias("path"),
        F.to_date(F.when(day != "", day)).alias("date"),
        F.when(day != "", endpoint).when(single != "", "activity").alias("endpoint"),
        "fetched_at",
        "content",
    )
    return rows.filter("user_id is not null and endpoint is not null").select(*[c.strip().split(" ")[0] for c in RAW.split(", ")])


def write_snapshot_tree(raw: DataFrame, root: str) -> DataFrame:
    """Write each snapshot to its file unless that exists; (user_id, path, written) once the result is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            done = []
            for user, path, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                name = f"{base}/user={user}/{path}"
                fresh = content is not None and fs.get_file_info(name).type == pafs.FileType.NotFound
                if fresh:
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    # A task that dies leaves no half file under the name.
                    with fs.open_output_stream(f"{name}.part") as stream:
                        stream.write(content.encode())
                    fs.move(f"{name}.part", name)
                done.append(fresh)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.bool_())], names=["user_id", "path", "written"])

    return raw.select("user_id", "path", "content").mapInArrow(run, "user_id long, path string, written boolean")


__all__ = ["read_snapshot_tree", "write_snapshot_tree"]
