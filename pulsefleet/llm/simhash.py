"""Operator 3: SimHash near-duplicates by a binary trie self-join.

A fingerprint's bit is set if it is set in more than half of the XXH64 hashes (seed 42) of a text's
word shingles. Two fingerprints link if they differ in at most ``budget`` bits.

Self-join: equal fingerprints become one row first. Any linked pair agrees on at least one of
``budget + 1`` bands of bits, so every band in turn is moved to the top of the trie, and below each
of its values node pairs of the trie are walked together, bit by bit, adding up differing bits; a
pair of nodes goes when it exceeds the budget, and also when all its leaves are known to hang
together already, as then it can link nothing new. So a large group of near copies costs about its
size, and at most one link per fingerprint and band comes out. Bands with very many fingerprints are
split again by a second band of the remaining bits. No link is lost.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts with fewer
words than a shingle are hashed whole; documents without a key have rows and link others, but never
name a component (it is null if no member has a key); texts of a repeated key hang together through it and give one row
each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, parts
from .components import connected_components

#: Bits a band takes from the 64.
BITS = 64
#: A band value with more fingerprints than this is split by a second band.
HOT = 20_000
#: Rows that a task joins at once, whole band values; and rows of node pairs that it walks at once.
BATCH, CHUNK = 60_000, 200_000


def fingerprint(text: str | None, shingle: int) -> int:
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [hash64(joined, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [hash64(joined[lo : hi - 1], 42) for lo, hi in zip(starts, ends[shingle - 1 :], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[lo : lo + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def hang_together(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: each the smallest index of its component."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int) -> np.ndarray:
    """Component labels (indexes) of fingerprints linked within their group; rows sorted by group, fp."""
    n = len(fp)
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    ends = np.r_[heads[1:], n].astype(int)
    zero = np.zeros(len(heads), int)
    stack = [(BITS - 1, heads, ends, heads, ends, zero)]
    while stack:
        bit, alo, ahi, blo, bhi, d = stack.pop()
        if len(alo) > CHUNK:
            half = len(alo) // 2
            stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, d))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, d)))]
            continue
        run = np.cumsum(np.r_[0, label[1:] != label[:-1]])
        known = (run[alo] == run[ahi - 1]) & (run[blo] == run[bhi - 1]) & (label[alo] == label[blo])
        alo, ahi, blo, bhi, d = (x[~known] for x in (alo, ahi, blo, bhi, d))
        few = (ahi - alo) * (bhi - blo) <= 256
        if few.any():
            label = leaf_links(label, fp, alo[few], ahi[few], blo[few], bhi[few], budget)
        alo, ahi, blo, bhi, d = (x[~few] for x in (alo, ahi, blo, bhi, d))
        if not len(alo):
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum(fp >> np.uint64(bit) & np.uint64(1)).astype(np.int64)]
        amid, bmid = ahi - (ones[bit][ahi] - ones[bit][alo]), bhi - (ones[bit][bhi] - ones[bit][blo])
        own = (alo == blo) & (ahi == bhi)
        children = [
            (alo, amid, bmid, bhi, d + 1),
            *([tuple(x[~own] for x in (amid, ahi, blo, bmid, d + 1))] if not own.all() else []),
            (amid, ahi, bmid, bhi, d),
            (alo, amid, blo, bmid, d),
        ]
        for child in children:
            live = (child[0] < child[1]) & (child[2] < child[3]) & (child[4] <= budget)
            if live.any():
                stack.append((bit - 1, *(x[live] for x in child)))
    return label


def leaf_links(label: np.ndarray, fp: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, budget: int) -> np.ndarray:
    """Compare all leaves of small node pairs, up to CHUNK pairs of leaves at a time."""
    width = bhi - blo
    total = (ahi - alo) * width
    cuts = np.searchsorted(np.cumsum(total), np.arange(0, total.sum(), CHUNK * 8))
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(total)], strict=True):
        hi = max(hi, lo + 1) if lo < len(total) else lo
        size = total[lo:hi]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        w = np.repeat(width[lo:hi], size)
        i, j = np.repeat(alo[lo:hi], size) + at // w, np.repeat(blo[lo:hi], size) + at % w
        near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        label = hang_together(label, i[near], j[near])
    return label


def bands(width: int, n: int) -> list[tuple[int, int]]:
    """n bands (lowest bit, bits) that cover ``width`` bits."""
    cuts = [round(width * i / n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def near_links(nodes: DataFrame, budget: int) -> DataFrame:
    """(u, v): links that connect all fingerprints ``fp`` within ``budget`` bits; fp is unique."""
    top = bands(BITS, budget + 1)

    def value(lo: int, bits: int):
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << bits) - 1))

    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), value(*b).alias("top")) for i, b in enumerate(top)])).alias("k")).select("fp", "k.band", "k.top")
    hot = keyed.groupBy("band", "top").count().filter(F.col("count") > HOT).select("band", "top", F.lit(True).alias("hot"))
    split = keyed.join(hot, ["band", "top"], "left")
    # A second band of the bits outside the first: of the band's own list of remaining bands.
    second = F.array(*[F.struct(F.lit(i).alias("sub"), value(lo, bits).alias("under")) for i, (lo, bits) in enumerate(bands(BITS, 2 * budget + 2))])
    inside = (F.floor(F.col("x.sub") / 2) == F.col("band")).cast("boolean")
    rows = split.withColumn("x", F.explode(F.when(F.col("hot"), second).otherwise(F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("under")))))).filter(~inside)
    rows = rows.select(F.xxhash64("band", "top", "x.sub", "x.under").alias("k"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            bits = fp.view(np.uint64)
            order = np.lexsort((bits, k))
            label = trie_links(k[order], bits[order], budget)
            ids = fp[order]
            far = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
            if sum(len(x[0]) for x in held) >= BATCH:
                k, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = np.searchsorted(k, k[-1])  # the last key may go on in the next batch
                held = [(k[whole:], fp[whole:])]
                if whole:
                    yield links(k[:whole], fp[:whole])
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    n = partitions(nodes.sparkSession)
    return rows.repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, "u long, v long")


def simhash_links(docs: DataFrame, shingle: int = 4, budget: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(u, v): links between keys that connect all documents with a key as far as their fingerprints do."""
    prints = materialize(fingerprints(docs, shingle, key, text).filter("doc_id is not null"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    same = prints.join(nodes, "fp").filter("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    found = near_links(nodes, budget).withColumnRenamed("v", "w")
    found = found.join(nodes.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(nodes.select(F.col("fp").alias("w"), F.col("least").alias("b")), "w")
    links = materialize(same.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "fingerprint-links")
    discard(prints, nodes)
    return links


def simhash_components(docs: DataFrame, shingle: int = 4, budget: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    prints = materialize(fingerprints(docs, shingle, key, text), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    # A key with several fingerprints ties them together.
    tied = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    tied = prints.join(tied, "doc_id").filter("fp <> lo").select(F.col("fp").alias("u"), F.col("lo").alias("v"))
    components = connected_components(near_links(nodes, budget).unionByName(tied))
    own = nodes.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    names = own.groupBy("group").agg(F.min("least").alias("component_id"))
    own = own.join(names, "group").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(own, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
