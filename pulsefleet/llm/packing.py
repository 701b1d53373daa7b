"""Operator 8: best-fit packing of token documents into sequences of a fixed capacity.

Only lengths decide a packing, and a length is at most the capacity. So Spark counts pieces per
length; the driver plans over this histogram of at most ``capacity`` counters, whatever the input;
and every task looks up its pieces' places in the plan by length and rank.

The plan (exact-complement hashing): open a sequence with the longest length left; if one, two or
three lengths left sum exactly to its gap (indexes from sums to single lengths, pairs and triples, checked
against the counts still available), take them and repeat the whole pattern while the counts last.
Else add the longest length that fits (best fit) and look for the complement of the smaller gap.

Edge cases: null text counts as empty, so the document is the end id alone; a null doc_id is kept as
a document of its own; repeated doc_ids are separate documents; ties in length are broken by doc_id
and piece where these differ, and any order packs equally well; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CACHE_ROWS, worker_bpe
from .common import materialize, parts

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", cache_rows: int = CACHE_ROWS) -> DataFrame:
    """One row per piece of every document: ids plus end id, cut every ``capacity`` ids; part and nth number them. cache_rows: words a worker process remembers."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, width = worker_bpe(tokenizer, True, rows=cache_rows), struct.pack("<I", end_id), 4 * capacity
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in parts(batches):
            out: list[tuple] = []
            for key_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = bpe.ids(text_) + end
                for n, lo in enumerate(range(0, len(raw), width)):
                    ids = raw[lo : lo + width]
                    length = len(ids) // 4
                    out.append((key_, n, lo // 4, length, zlib.crc32(ids), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return rows.mapInArrow(cut, PIECES)


class Sums:
    """Lengths still available, with indexes from a sum to a pair or triple of them that makes it.

    An index entry names one member; it is checked against the counts left when it is used, and looked for anew if
    it ran out. Counts only fall, so a sum without an entry never gets one again.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n
        #: Per sum: the larger member of a pair; the longest member of a triple, -1 before the first look.
        self.pair, self.triple = np.zeros(capacity + 1, np.int64), np.full(capacity + 1, -1, np.int64)
        lengths = np.flatnonzero(self.left)
        for n, length in enumerate(lengths):
            small = lengths[: n + (self.left[length] > 1)]
            self.pair[length + small[small <= capacity - length]] = length

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n

    def has(self, a: int, b: int) -> bool:
        return bool(self.left[a] > 0 and self.left[b] > (a == b))

    def pair_of(self, total: int) -> tuple[int, int] | None:
        """Two lengths with this sum, the larger as long as possible when it was looked for."""
        a = int(self.pair[total])
        if a and not self.has(a, total - a):
            small = np.arange(1, total // 2 + 1)
            ok = (self.left[small] > 0) & (self.left[total - small] > (small == total - small))
            a = int(total - small[ok.argmax()]) if ok.any() else 0
            self.pair[total] = a
        return (a, total - a) if a else None

    def triple_of(self, total: int) -> tuple[int, int, int] | None:
        if self.triple[total] > 0 and (found := self.with_third(total, int(self.triple[total]))):
            return found
        if self.triple[total]:
            # Thirds whose rest has a pair in the index, longest first.
            thirds = np.flatnonzero((self.left[:total] > 0) & (self.pair[total:0:-1] > 0))
            for c in thirds[::-1].tolist():
                if found := self.with_third(total, c):
                    self.triple[total] = c
                    return found
            self.triple[total] = 0
        return None

    def with_third(self, total: int, c: int) -> tuple[int, int, int] | None:
        if self.left[c] <= 0:
            return None
        self.left[c] -= 1
        a = int(self.pair[total - c])
        pair = (a, total - c - a) if a and self.has(a, total - c - a) else None
        if pair is None and a:
            # The pair in the index may just lack the third taken here: look on without forgetting it.
            small = np.arange(1, (total - c) // 2 + 1)
            ok = (self.left[small] > 0) & (self.left[total - c - small] > (small == total - c - small))
            pair = (int(total - c - small[ok.argmax()]), int(small[ok.argmax()])) if ok.any() else None
        self.left[c] += 1
        return (c, *pair) if pair else None

    def complement(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths that sum exactly to the gap; () if there are none."""
        if self.left[gap] > 0:
            return (gap,)
        return self.pair_of(gap) or self.triple_of(gap) or ()


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) with their numbers of sequences, from counts per length.

    Every pattern is repeated until one of its lengths runs out (or has fewer left than the pattern
    needs), so the number of patterns follows the number of different lengths, not of pieces.
    """
    sums = Sums(counts, capacity)
    patterns: list[tuple[tuple[int, ...], int]] = []
    longest = capacity
    while longest:
        if sums.left[longest] <= 0:
            longest -= 1
            continue
        pattern, gap = [longest], capacity - longest
        sums.take(longest)
        while gap:
            if exact := sums.complement(gap):
                for x in exact:
                    sums.take(x)
                pattern += exact
                break
            fits = np.flatnonzero(sums.left[: gap + 1] > 0)
            if not len(fits):
                break
            pattern.append(int(fits[-1]))
            sums.take(pattern[-1])
            gap -= pattern[-1]
        use = {x: pattern.count(x) for x in dict.fromkeys(pattern)}
        more = min(int(sums.left[x]) // n for x, n in use.items())
        for x, n in use.items():
            sums.take(x, n * more)
        patterns.append((tuple(pattern), 1 + more))
    return patterns


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Per pattern and length: the ranks it takes (first, end), pieces per sequence, first sequence, offset of the first."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            n, first = pattern.count(length), used.get(length, 0)
            rows.append((length, first, first + n * times, n, base, offset))
            used[length] = first + n * times
            offset += n * length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "end", "per", "base", "offset"])


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with part, nth and ``length`` (1 to ``capacity``).

    (part, nth) numbers the pieces of a length: nth within its part. Ranks within a length then come
    from counts per (part, length), a small table; no length, however frequent, gathers in one task.
    """
    spark = pieces.sparkSession
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(plan_packing(counts, capacity))
    by_length = spark.sparkContext.broadcast({int(k): v[["first", "end", "per", "base", "offset"]].to_numpy() for k, v in slots.groupby("length")})
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = per_part.select("part", "length", before.alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    columns = [c for c in pieces.columns if c not in ("part", "nth")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(own):
                    length = int(lengths[own[0]])
                    slot = by_length.value[length]
                    at = slot[np.searchsorted(slot[:, 1], ranks[own], side="right")]
                    within = ranks[own] - at[:, 0]
                    sequence[own] = at[:, 3] + within // at[:, 2]
                    offset[own] = at[:, 4] + within % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text", cache_rows: int = CACHE_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity, key, text, cache_rows), "pieces")
    out = pack(pieces, capacity)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
