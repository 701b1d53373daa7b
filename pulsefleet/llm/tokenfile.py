"""Operator 9: token ids in binary files of independent zstandard frames with a trailing seek table.

File layout (the public "seekable" layout of zstandard, with checksums):

* one zstandard frame per document: its ids, each a little-endian unsigned 32-bit integer;
* a skippable frame (magic 0x184D2A50) with the documents' keys, 64-bit little-endian, in frame order,
  then a byte for each: 1, or 0 for a document without a key;
* a skippable frame (magic 0x184D2A5E) with the seek table: for every frame the compressed size, the
  raw size and the low 32 bits of the raw bytes' XXH64, then the number of frames, a descriptor byte
  and the magic 0x8F92EAB1.

A reader fetches the tail, finds the wanted documents in the key list, and decompresses these frames
only, each against its checksum. Files are written under a name of their own per task attempt, so a
lost executor leaves at most an unreferenced file; the manifest names the files that count.

Edge cases: null text counts as empty (a document of one end id); documents without a key come first and
can be read, but not asked for by key; repeated keys are kept, in the order of their texts; extra columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import worker_bpe
from .common import materialize, partitions, shared_path

#: Fixed values of the public seekable layout.
KEYS_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "shard int, path string, n_docs long, n_ids long"


class FrameWriter:
    """Frames in order, then keys and seek table."""

    def __init__(self, sink, level: int):
        import zstandard

        self.sink, self.pack = sink, zstandard.ZstdCompressor(level=level).compress
        self.table: list[bytes] = []
        self.keys: list[int | None] = []

    def add(self, key: int | None, raw: bytes) -> None:
        import xxhash

        frame = self.pack(raw)
        self.sink.write(frame)
        self.keys.append(key)
        self.table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes() + bytes(k is not None for k in self.keys)
        seek = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", KEYS_MAGIC, len(keys)) + keys + struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
        self.sink.close()


class FrameReader:
    """Random access to a file of FrameWriter; reads the tail once and frames on request."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        n, flag, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != FOOTER_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        table = np.frombuffer(self.at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.raw, self.sums = table[:, 0].astype("i8"), table[:, 1], table[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        keys = self.at(int(self.offsets[-1]) + 8, 9 * n)
        self.keys, self.keyed = np.frombuffer(keys[: 8 * n], "<i8"), np.frombuffer(keys[8 * n :], bool)

    def at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def frame(self, i: int) -> bytes:
        import xxhash

        raw = self.unpack(self.at(int(self.offsets[i]), int(self.sizes[i])), max_output_size=int(self.raw[i]))
        if len(raw) != self.raw[i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i}: wrong checksum")
        return raw


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text", level: int = 1, n_files: int | None = None) -> DataFrame:
    """Write every document's ids, ascending by key over ascending shards; returns the manifest.

    One range shuffle of key and text; every task streams its sorted rows into one file.
    """
    folder = folder or shared_path(docs.sparkSession, "token-files")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, out, n_docs, n_ids = worker_bpe(tokenizer, False), struct.pack("<I", end_id), None, 0, 0
        fs, root = pafs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                out = FrameWriter(fs.open_output_stream(path, compression=None), level)
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = bpe.ids(t) + end
                out.add(k, raw)
                n_docs += 1
                n_ids += len(raw) // 4
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    n = n_files or partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_frames(manifest: DataFrame, folder_uri: str, keys: list[int] | None, columns: Callable[[list[bytes]], dict[str, pa.Array]], schema: str) -> DataFrame:
    """(shard, position, doc_id and ``columns`` of the raw ids), made where the frames are read."""
    wanted = None if keys is None else np.array(sorted(keys), "i8")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder_uri)
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    at = np.arange(len(reader.keys)) if wanted is None else np.flatnonzero(np.isin(reader.keys, wanted) & reader.keyed)
                    for lo in range(0, len(at), 512):
                        part = at[lo : lo + 512]
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(part), pa.int32()), "position": pa.array(part, pa.int32()), "doc_id": pa.array(reader.keys[part], pa.int64(), mask=~reader.keyed[part]), **columns([reader.frame(i) for i in part])})

    files = manifest.select("shard", "path")
    return files.repartition(partitions(manifest.sparkSession), "shard").mapInArrow(read, f"shard int, position int, doc_id long, {schema}")


def read_token_files(manifest: DataFrame, folder_uri: str, keys: list[int] | None = None) -> DataFrame:
    """(shard, position, doc_id, ids): the documents, or those with the given keys only."""
    return read_frames(manifest, folder_uri, keys, lambda raw: {"ids": pa.array(raw, pa.binary())}, "ids binary")


def token_file_digest(manifest: DataFrame, folder_uri: str) -> DataFrame:
    """Per document, read back from its file: doc_id, start, n_tokens, ids_crc32."""

    def digest(raw: list[bytes]) -> dict[str, pa.Array]:
        return {"n_tokens": pa.array([len(x) // 4 for x in raw], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64())}

    docs = read_frames(manifest, folder_uri, None, digest, "n_tokens long, ids_crc32 long")
    # One row per file: a window over all of them is as long as the list of files.
    bases = manifest.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("position")) - F.col("n_tokens")
    return docs.withColumn("within", within).join(bases, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
