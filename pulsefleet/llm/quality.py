"""Operator 7: a quality classifier on pooled random-indexing vectors.

Tokens are runs of letters, runs of digits and runs of other marks; a word in capitals adds a marker
token, as does a token that repeats the one before it. Every token hashes to one of ``buckets``
rows. A row has a fixed sparse random index vector, and its context vector is the sum of the index
vectors of its neighbours over the whole corpus, summed by Spark. A text's features are the mean of its
tokens' vectors (context, scaled to length one, plus own index vector).

A two-layer network (numpy, on the driver) learns from at most ``max_rows`` labelled training rows,
chosen by a hash of the key, a documented bound; a fifth of them is kept aside to fit the temperature
that calibrates its probabilities. Scoring runs in the tasks that hold the features. Labels,
language, source and key never enter a score.

Edge cases: null and empty texts have the mean features and are scored like all others; keys without a
label only get scores; several labels of a key count by their mean; null labels are ignored; without
labels of both kinds the score is the smoothed share of label 1; null keys are kept and unlabelled;
repeated keys give one row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import release
from .common import crc_mod, materialize, parts

TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
NONZEROS = 4
CAPS = 1 << 30
CACHE_ROWS = 500_000


class Tokens:
    """Bucket numbers of a text's tokens; markers use the first two buckets."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.cache: dict[str, int] = {}

    def number(self, token: str) -> int:
        caps = CAPS if len(token) > 1 and token.isupper() else 0
        got = (2 + zlib.crc32((token.lower() if caps else token).encode()) % (self.buckets - 2)) | caps
        if len(self.cache) >= CACHE_ROWS:
            self.cache.clear()
        self.cache[token] = got
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        get, number = self.cache.get, self.number
        return np.array([get(t) or number(t) for t in TOKEN.findall(text or "")], np.int64)


def index_vectors(buckets: int, dim: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors, half of the non-zero entries negative."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, dim), np.float32)
    at = rng.permuted(np.tile(np.arange(dim), (buckets, 1)), axis=1)[:, :NONZEROS]
    out[np.arange(buckets)[:, None], at] = np.where(np.arange(NONZEROS) % 2, -1, 1)
    return out


def word_vectors(docs: DataFrame, buckets: int, dim: int, seed: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all buckets and their mean over the corpus; the corpus sums come back as ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        index, tokens = index_vectors(buckets, dim, seed), Tokens(buckets)
        near = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZEROS]
        sign = np.take_along_axis(index, near, 1)
        total, seen = np.zeros(buckets * dim), np.zeros(buckets)

        def add(parts: list[np.ndarray]) -> None:
            # A negative number between texts keeps them apart.
            ids = np.concatenate([x for p in parts for x in (p & (CAPS - 1), [-1])])
            seen[:] += np.bincount(ids[ids >= 0], minlength=buckets)
            left, right = ids[:-1], ids[1:]
            both = (left >= 0) & (right >= 0)
            for a, b in ((left[both], right[both]), (right[both], left[both])):
                for k in range(NONZEROS):
                    total[:] += np.bincount(a * dim + near[b, k], weights=sign[b, k], minlength=buckets * dim)

        held, size = [], 0
        for batch in parts(batches):
            for t in batch.column(0).to_pylist():
                held.append(tokens(t))
                size += len(held[-1])
                if size > 500_000:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        sums = np.c_[total.reshape(buckets, dim), seen]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "x": pa.array(list(sums[at]), pa.list_(pa.float64()))})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, x array<double>")
    sums = [F.sum(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(dim + 1)]
    context = np.zeros((buckets, dim + 1))
    for r in rows.groupBy("bucket").agg(*sums).collect():
        context[r["bucket"]] = r[1:]
    context, seen = context[:, :dim], context[:, dim]
    length = np.sqrt((context**2).sum(1, keepdims=True))
    vectors = (context / np.maximum(length, 1e-9) + index_vectors(buckets, dim, seed) / np.sqrt(NONZEROS)).astype(np.float32)
    return vectors, (seen @ vectors / max(seen.sum(), 1)).astype(np.float32)


def pooled(docs: DataFrame, vectors, buckets: int, prior: float, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, x, carry...): the mean vector of every text's tokens and markers."""

    def features(tokens: Tokens, text_: str | None) -> np.ndarray:
        (w, mean), ids = vectors.value, tokens(text_)
        if not len(ids):
            return mean
        caps = int((ids >= CAPS).sum())
        ids = ids & (CAPS - 1)
        again = int((ids[1:] == ids[:-1]).sum())
        counts = np.bincount(ids, minlength=2)
        counts[0], counts[1] = caps, again
        at = np.flatnonzero(counts)
        return (counts[at].astype(np.float32) @ w[at] + prior * mean) / np.float32(counts.sum() + prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(buckets)
        for batch in parts(batches):
            x = [features(tokens, t) for t in batch.column(1).to_pylist()]
            more = [batch.column(2 + i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32())), *more], names=["doc_id", "x", *carry])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {kinds[key]}", "x array<float>", *(f"{c} {kinds[c]}" for c in carry)])
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *carry).mapInArrow(run, schema)


class Network:
    """Two layers, tanh between them; inputs scaled by the training rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int):
        rng = np.random.default_rng(seed)
        self.share = float((y.sum() + 1) / (len(y) + 2))
        self.constant = len(np.unique(y)) < 2
        self.temperature = 1.0
        if self.constant:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        order = rng.permutation(len(x))
        aside, own = order[: len(x) // 5], order[len(x) // 5 :]
        z = (x - self.mean) / self.scale
        self.p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
        self.train(z[own], y[own], epochs, rng)
        if len(np.unique(y[aside])) == 2:
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            logit = self.logit(z[aside])
            loss = [np.logaddexp(0, np.where(y[aside] == 1, -logit, logit) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def train(self, z: np.ndarray, y: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), 256):
                at = order[lo : lo + 256]
                a, b = z[at], y[at, None]
                h = np.tanh(a @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - b) / len(at)
                back = d @ self.p[2].T * (1 - h * h)
                step += 1
                rate = 0.01 * (1 - epoch / epochs)
                for i, g in enumerate((a.T @ back, back.sum(0), h.T @ d, d.sum(0))):
                    g = g + 1e-4 * self.p[i] * (i in (0, 2))
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def logit(self, z: np.ndarray) -> np.ndarray:
        return (np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-self.logit((x - self.mean) / self.scale) / self.temperature))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 5, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = 8192, dim: int = 32, hidden: int = 24, epochs: int = 40, max_rows: int = 30_000, prior: float = 4.0, seed: int = 17, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted (1 if score >= threshold), carry: further columns as they are."""
    sc = docs.sparkSession.sparkContext
    vectors = sc.broadcast(word_vectors(docs, buckets, dim, seed, text))
    features = materialize(pooled(docs, vectors, buckets, prior, key, text, carry), "quality-features")
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    sample = features.filter(crc_mod("doc_id", mod) != 0).join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("x", "y").toArrow()
    x = rows_of(sample["x"].combine_chunks(), dim) if sample.num_rows else np.zeros((0, dim))
    network = sc.broadcast(Network(x, sample["y"].to_numpy().astype(float), hidden, epochs, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = network.value.score(rows_of(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *(batch.column(2 + i) for i in range(len(carry)))], names=["doc_id", "score", *carry])

    kinds = dict(features.dtypes)
    scored = features.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "score double", *(f"{c} {kinds[c]}" for c in carry)]))
    return scored.select("doc_id", (crc_mod("doc_id", mod) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
