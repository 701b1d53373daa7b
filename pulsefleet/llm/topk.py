"""Operator 4: exact top-k inner products over norm-sorted blocks.

Candidates are sorted by descending length (norm) and cut into blocks, numbered in that order; all
vectors are rotated by the eigenvectors of the candidates' Gram matrix (their right singular vectors),
so that the first coordinates carry most of an inner product.

Rounds visit the blocks in descending order, twice as many in each round. A query's floor is the k-th
best of its scores so far; it rises from round to round. A query takes part in a round only as far as
its length times a block's longest vector reaches its floor (Cauchy-Schwarz): queries of like cutoffs
(floor over length) are packed together, the blocks of a round form steps of equal size (``STEPS`` at most, until
a step would hold more than ``WIDTH`` blocks), and packed queries are dealt to the steps only that they can still gain
from. So pairs of blocks that cannot matter are never formed. When no query reaches the next round's longest vector, the
search ends.

A task gets one step, or a share of the queries (a lane) where there are fewer steps than tasks. It holds the step's blocks
and reads the packed queries one after the other, so its memory is bounded by ``WIDTH`` blocks, and nothing but the queries moves
more than once for each lane. No side is broadcast. Both travel in the fewest bytes that hold their whole numbers.
Within a pair, partial sums over the first coordinates plus the product of the residual
lengths bound each score, coordinate group after coordinate group up to the whole vector, until few candidates are left;
only candidates that still reach the floor, which rises from block to block, get their integer score.

Scores are exact: where lengths allow sums beyond 2^53 they are added as Python integers, and one beyond the range of a
long raises. Only the Gram matrix (dimension squared), a count per partition and the steps' longest
vectors come to the driver.

Edge cases: vectors that are null or hold null or non-finite components take no part, as query or
candidate; shorter vectors count as padded with zeros; rows without an id take no part; a query never
gets rows with its own id; repeated ids are candidates each, repeated query ids one query; equal scores
go to the smaller id; fewer than k candidates give them all; extra columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

BLOCK = "part int, at int, top double, ids binary, vectors binary"
ASKED = "cutoff double, ids binary, vectors binary, floors binary"
#: Steps of a round, and blocks of a step at most: a task holds them as doubles, some 2 MB each at 2048 rows of 64.
STEPS, WIDTH = 64, 32
#: Integers up to here are exact as doubles.
EXACT = float(1 << 53)
#: Up to here bounds are taken in single precision.
SINGLE = 1e30
#: Share of a pair's candidates that is scored without a look at further coordinates.
FEW = 0.01


def floored(x: Column) -> Column:
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def integer_vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): v holds floor(scale * x) of every component, as doubles; usable vectors only."""
    v = F.transform(vector, lambda x: floored(F.lit(float(scale)) * x.cast("double")))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).filter(usable).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` doubles, padded with zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def narrow(m: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them."""
    most = np.abs(m).max(initial=0.0)
    return m.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64)).tobytes()


def widened(raw: bytes, n: int, dim: int) -> np.ndarray:
    """n rows of ``dim`` doubles from what ``narrow`` left."""
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}[len(raw) // (n * dim)]
    return np.frombuffer(raw, kind).reshape(n, dim).astype(np.float64)


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first, from their Gram matrix summed by Spark."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = matrix(batch.column(0), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(dim * dim), pa.int32()), "x": total.ravel()})

    cells = rows.select("v").mapInArrow(gram, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    g = np.zeros(dim * dim)
    for r in cells:
        g[r["cell"]] = r["x"]
    _, vectors = np.linalg.eigh(g.reshape(dim, dim))
    return vectors[:, ::-1].copy()


def packed(size: int, pack: Callable[[int, list[np.ndarray]], pa.RecordBatch], read: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Callable:
    """For mapInArrow: rows gathered to blocks of ``size``, numbered within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, []
        for batch in batches:
            held.append(read(batch))
            while sum(len(x[0]) for x in held) >= size:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield pack(at, [x[:size] for x in whole])
                at, held = at + 1, [[x[size:] for x in whole]]
        if sum(len(x[0]) for x in held):
            yield pack(at, [np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def candidate_blocks(rows: DataFrame, dim: int, size: int, n: int) -> DataFrame:
    """Blocks of up to ``size`` rows of (id, v, norm); all norms fall from block to block, by (part, at)."""

    def pack(at: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        from pyspark import TaskContext

        ids, m = columns
        top = float(np.sqrt((m * m).sum(1)).max())
        return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "at": pa.array([at], pa.int32()), "top": [top], "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([narrow(m)], pa.binary())})

    ordered = rows.repartitionByRange(n, F.col("norm").desc(), "id").sortWithinPartitions(F.col("norm").desc(), "id")
    return ordered.select("id", "v").mapInArrow(packed(size, pack, lambda b: [b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), dim)]), BLOCK)


def query_blocks(rows: DataFrame, dim: int, size: int, n: int) -> DataFrame:
    """Blocks of (id, v, floor, cutoff), of like cutoffs; cutoff: the least of the block."""

    def pack(_: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        ids, m, floors, cutoffs = columns
        return pa.RecordBatch.from_pydict({"cutoff": [float(cutoffs.min())], "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([narrow(m)], pa.binary()), "floors": pa.array([floors.tobytes()], pa.binary())})

    ordered = rows.repartitionByRange(n, "cutoff", "id").sortWithinPartitions("cutoff", "id")
    plain = lambda c: c.to_numpy(zero_copy_only=False)
    return ordered.select("id", "v", "floor", "cutoff").mapInArrow(packed(size, pack, lambda b: [plain(b.column(0)), matrix(b.column(1), dim), plain(b.column(2)), plain(b.column(3))]), ASKED)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best scores, best first, equal scores by smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def exact_scores(m: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Inner products as integers; ``bound``: the product of the lengths."""
    if bound < EXACT:
        return (m @ q).astype(np.int64)
    own = [int(x) for x in q]
    sums = [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in m]
    if any(not -(1 << 63) <= s < 1 << 63 for s in sums):
        raise ValueError("an inner product lies beyond the range of a long")
    return np.array(sums, np.int64)


def heads(turned: np.ndarray, cuts: Sequence[int], kind: type) -> list[np.ndarray]:
    """For every cut the coordinates before it and the length of those behind: two heads' product bounds the whole product."""
    return [np.column_stack([turned[:, :c], np.sqrt((turned[:, c:] ** 2).sum(1))]).astype(kind) for c in cuts]


class Held:
    """A candidate block as a task holds it."""

    def __init__(self, row: dict, dim: int, turn: np.ndarray, cuts: Sequence[int], kind: type):
        self.ids, self.top = np.frombuffer(row["ids"], np.int64), row["top"]
        self.rows = widened(row["vectors"], len(self.ids), dim)
        self.heads = heads(self.rows @ turn, cuts, kind)


def met(asked: dict, held: Sequence[Held], dim: int, turn: np.ndarray, k: int, cuts: Sequence[int], kind: type, count: Callable[[], None]) -> Iterator[tuple[np.ndarray, ...]]:
    """(query ids, candidate ids, scores) of a block of queries in candidate blocks of falling norms, up to k for each query.

    Bounds are taken as ``kind``, with what it may round off; the last cut is the whole vector.
    """
    ids, floors = np.frombuffer(asked["ids"], np.int64), np.frombuffer(asked["floors"]).copy()
    rows = widened(asked["vectors"], len(ids), dim)
    own, length = heads(rows @ turn, cuts, kind), np.sqrt((rows * rows).sum(1))
    rounded = (dim + 16) * float(np.finfo(kind).eps) + 1e-9
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for block in held:
        bound = length * block.top
        floor = floors - rounded * bound - 1e-9
        alive = np.flatnonzero(bound >= floor)
        if not len(alive):
            continue
        count()
        least = floor[alive, None].astype(kind)
        for mine, theirs in zip(own, block.heads, strict=True):
            open_ = mine[alive] @ theirs.T >= least
            if np.count_nonzero(open_) <= FEW * open_.size:
                break
        for row in np.flatnonzero(open_.any(1)):
            a = alive[row]
            at = np.flatnonzero(open_[row] & (block.ids != ids[a]))
            scores = exact_scores(block.rows[at], rows[a], bound[a])
            keep = np.flatnonzero(scores >= floor[a])
            if not len(keep):
                continue
            c, s = block.ids[at[keep]], scores[keep]
            if a in found:
                c, s = np.concatenate([found[a][0], c]), np.concatenate([found[a][1], s])
            top = best(s, c, k)
            found[a] = c[top], s[top]
            if len(top) >= k:
                floors[a] = max(floors[a], float(s[top[-1]]))
    for a, (c, s) in found.items():
        yield np.full(len(c), ids[a]), c, s


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding", block: int = 2048, query_block: int = 256, steps: tuple[int, ...] = (8, 24), pairs_read: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k best candidates but those of its own id. pairs_read counts pairs of blocks."""
    spark = candidates.sparkSession
    n = partitions(spark)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows, asked = (integer_vectors(df, key, vector, scale).withColumn("norm", norm) for df in (candidates, queries))
    dim = max((df.agg(F.max(F.size("v"))).first()[0] or 1) for df in (rows, asked))
    turn = rotation(rows, dim)
    ask = materialize(asked, "queries")
    cand = materialize(candidate_blocks(rows, dim, block, n), "candidate-blocks")
    # Blocks are numbered over all partitions from a count for each of them.
    counts = {r["part"]: r["count"] for r in cand.groupBy("part").count().collect()}
    before = np.cumsum([0, *(counts.get(p, 0) for p in range(n))])
    base = F.element_at(F.lit([int(x) for x in before[:-1]] or [0]), F.col("part") + 1)
    cand = cand.withColumn("nth", base + F.col("at"))
    total, kind = int(before[-1]), "query_id long, vec_id long, score long"
    cuts = [*(x for x in steps if x < dim), dim]
    # Scores that single precision can bound are bounded in it.
    longest = [df.agg(F.max("norm")).first()[0] or 0.0 for df in (ask, cand.select(F.col("top").alias("norm")))]
    kind_of = np.float32 if max(*longest, longest[0] * longest[1]) < SINGLE else np.float64

    def count() -> None:
        if pairs_read is not None:
            pairs_read.add(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["cell"] != cell:
                    cell, held = row["cell"], []
                if row["floors"] is None:
                    held.append(Held(row, dim, turn, cuts, kind_of))
                    continue
                out = list(met(row, held, dim, turn, k, cuts, kind_of, count))
                if out:
                    q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_pydict({"query_id": q, "vec_id": c, "score": s})

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    held = spark.createDataFrame([], kind)
    lo, hi = 0, min(2, total)
    while lo < hi:
        width = min(-(-(hi - lo) // STEPS), WIDTH)  # blocks in a step
        now = cand.filter((F.col("nth") >= lo) & (F.col("nth") < hi)).withColumn("step", F.floor((F.col("nth") - lo) / width))
        tops = [r["top"] for r in now.groupBy("step").agg(F.max("top").alias("top")).orderBy("step").collect()]
        floors = held.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("found")).filter(F.col("found") >= k)
        open_ = ask.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        cutoff = F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).when(F.col("floor") <= 0, float("-inf")).otherwise(float("inf"))
        open_ = open_.withColumn("cutoff", cutoff - F.lit(1e-9) * F.abs(cutoff) - 1e-9).filter(F.col("cutoff") <= tops[0])
        blocks = materialize(query_blocks(open_, dim, query_block, n), "query-blocks")
        if lo and blocks.isEmpty():
            break  # all later vectors are shorter
        reach = F.size(F.filter(F.lit(tops), lambda t: t >= F.col("cutoff")))
        lanes = max(1, n // len(tops))
        lane = F.pmod(F.xxhash64("ids"), F.lit(lanes))
        q_side = blocks.filter(reach > 0).withColumn("step", F.explode(F.sequence(F.lit(0), reach - 1))).select((F.col("step") * lanes + lane).cast("int").alias("cell"), F.lit(None).cast("double").alias("top"), "ids", "vectors", "floors")
        c_side = now.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select((F.col("step") * lanes + F.col("lane")).cast("int").alias("cell"), "top", "ids", "vectors", F.lit(None).cast("binary").alias("floors"))
        # A cell's candidates come first, by falling norms, then its queries.
        dealt = c_side.unionByName(q_side).repartitionById(len(tops) * lanes, "cell").sortWithinPartitions("cell", F.col("top").desc_nulls_last())
        found = dealt.mapInArrow(scan, kind)
        best_now = held.unionByName(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        last, held = held, materialize(best_now.select("query_id", "vec_id", "score"), "top-so-far")
        discard(last, blocks)
        lo, hi = hi, min(2 * hi, total)
    discard(ask, cand)
    return held.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
