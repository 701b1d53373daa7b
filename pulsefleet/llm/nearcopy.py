"""Near copies for the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal texts (lower case, white space aside) become one node first. Candidates are operator 3's links
and, as 64 bits lose most of these pairs, 30 bands of six MinHash values each: a pair with a
similarity of 0.8 shares no band once in 9,000 times, a more similar one less often. Every candidate
is verified on the two whole sets, so nothing is linked that is less similar.

Nodes of a band value are not compared all with all at once. In each of two rounds (operator 3's links join the first) every node is
compared with its neighbour in a random order of the band value's nodes, as far as the two do not hang
together already. So a large group of near copies costs about its size. What still hangs apart is then compared
in blocks: a band value's nodes, ordered by component, are cut into blocks of up to BLOCK shingles, blocks
that do not lie in one component together meet, and a task counts the common shingles of two blocks by matrix products.
So no pair of different components goes unseen, and pairs are rows only where they are similar. A band value that more
than HOT different components still share (texts with a common passage, say) is split first: its nodes meet only
where they share one of their rarest shingles. Of a set of n these are n - ceil(0.8 n) + 1: two sets that are similar
enough have too much in common to differ in all of them, so the split loses no pair.

Edge cases: null and empty texts are copies of each other; a text of fewer words than a shingle is one
shingle; documents without a key are left out; repeated keys with different texts share a node; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import release
from .common import discard, materialize, parts
from .components import connected_components
from .simhash import simhash_links

BANDS, ROWS = 30, 6
ROUNDS = 2
#: Components of a band value from which it is split by other band values, and nodes that are put in one random order.
HOT, ORDERED = 2000, 10_000
#: Shingles that are hashed at once.
STEP = 4096
#: Shingles in a block of texts, and different ones that are looked at at once.
BLOCK, COLUMNS = 20_000, 8192
_random = np.random.default_rng(42)
FACTORS, TERMS = (_random.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) << np.uint64(1)) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([hash64(joined, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.array([hash64(joined[lo : hi - 1], 42) for lo, hi in zip([0, *ends], ends[shingle - 1 :], strict=False)], np.uint64))


def band_values(own: np.ndarray) -> np.ndarray:
    """One hash for each band of MinHash values."""
    least = np.min([(own[lo : lo + STEP] * FACTORS + TERMS).min(axis=1) for lo in range(0, len(own), STEP)], axis=0).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = (out ^ least[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, whole, size, bands): a hash of the whole text, its number of distinct shingles, its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        for batch in parts(batches):
            wholes, sizes, bands = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                own = shingles(words, shingle)
                wholes.append(xxhash.xxh128_digest(b" ".join(words)))
                sizes.append(len(own))
                bands.append(band_values(own))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wholes, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "whole", "size", "bands"])

    return rows.mapInArrow(run, "doc_id long, whole binary, size long, bands array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, own): a text's shingle hashes, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            own = [shingles(words_of(t), shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "own"])

    return rows.mapInArrow(run, "node long, own binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u")
    joined = joined.join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    return joined.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def common_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` has in common with each of ``b``."""
    values, codes = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(values), COLUMNS):
        at = slice(*np.searchsorted(codes, [lo, lo + COLUMNS]))
        has = np.zeros((len(a) + len(b), min(COLUMNS, len(values) - lo)), np.float32)
        has[owner[at], codes[at] - lo] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out


def apart(at: DataFrame) -> DataFrame:
    """Rows (k, node, size, c) whose k joins nodes of several c, with k's n nodes in some ``groups`` c. Sums and a join that Spark can split, for k may be frequent."""
    ends = at.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("c").alias("groups")).filter("lo <> hi")
    return at.join(ends.select("k", "n", "groups"), "k")


def rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, k): each set's rarest shingles k, so many that sets which are similar enough share one; without those of one set only.

    Similar sets have ceil(similarity * n) shingles in common, n being the size of either. If all sets put their
    shingles in one order, the first n - ceil(similarity * n) + 1 of both can't all be different.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                own = part.column(1).to_pylist()
                n = np.array([len(x) // 8 for x in own])
                columns = (np.repeat(part.column(0).to_numpy(), n), np.repeat(n, n), np.frombuffer(b"".join(own), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["node", "n", "k"])

    each = sets.select("node", "own").mapInArrow(run, "node long, n long, k long")
    often = each.groupBy("k").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # A set's only shingles of its own come first in the order and meet no one.
    held = each.join(often, "k").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "k"))).alias("xs"))
    left = F.size("xs") - F.ceil(similarity * F.col("n") - 1e-6) + 1
    return held.select("node", F.explode(F.slice("xs", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))).alias("x")).select("node", "x.k")


def split_hot(at: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (k, node, size, c) with each k of more than HOT components replaced by the other values that ``shared`` (node, k) gives its nodes.

    A value whose nodes hang together but for a few costs its size as it is: blocks of one component do not meet.
    Of values with the same nodes one is kept.
    """
    rows = apart(at)
    hot = rows.filter(F.col("groups") > HOT)
    finer = hot.select("node", "size", "c").distinct().join(shared.join(hot.select("k").distinct(), "k", "left_anti"), "node").select("k", "node", "size", "c")
    ends = finer.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    one = ends.filter("lo <> hi").groupBy("n", "x", "y").agg(F.min("k").alias("k")).select("k")
    return rows.filter(F.col("groups") <= HOT).select("k", "node", "size", "c").unionByName(finer.join(one, "k", "left_semi"))


def block_links(at: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Similar pairs (u, v) among rows (k, node, size, c) of one k and different c."""
    order = Window.partitionBy("k").orderBy("c", "node")
    placed = at.withColumn("block", F.floor((F.sum("size").over(order) - F.col("size")) / BLOCK))
    held = placed.select("k", "node", "c", "block").join(sets, "node")
    blocks = held.groupBy("k", "block").agg(F.collect_list(F.struct("node", "c", "own")).alias("xs"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    blocks = materialize(blocks, "copy-blocks")
    other = blocks.select("k", *(F.col(c).alias(f"{c}2") for c in ("block", "xs", "lo", "hi")))
    one = (F.col("lo") == F.col("hi2")) & (F.col("lo2") == F.col("hi"))
    pairs = blocks.join(other, "k").filter((F.col("block") <= F.col("block2")) & ~one).select("xs", "xs2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                a, b = ([np.frombuffer(x["own"], np.uint64) for x in xs] for xs in (left, right))
                both, n, m = common_shingles(a, b), np.array(list(map(len, a))), np.array(list(map(len, b)))
                near = both >= similarity * (n[:, None] + m[None, :] - both) - 1e-6
                near &= np.array([x["c"] for x in left])[:, None] != np.array([x["c"] for x in right])[None, :]
                u, v = near.nonzero()
                yield pa.RecordBatch.from_pydict({"u": pa.array([left[j]["node"] for j in u], pa.int64()), "v": pa.array([right[j]["node"] for j in v], pa.int64())})

    return pairs.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over copies and similar pairs)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    found = materialize(sketches(rows, shingle), "sketches")
    nodes = found.groupBy("whole").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "sketch-nodes")
    node_of = materialize(found.select("doc_id", "whole").join(nodes.select("whole", "node"), "whole").select("doc_id", "node"), "text-nodes")
    discard(found)

    # Operator 3's links between different texts.
    links = simhash_links(docs, key=key, text=text)
    ends = (node_of.select(F.col("doc_id").alias(c), F.col("node").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    linked = links.join(next(ends), "u").join(next(ends), "v").filter("a <> b")
    linked = materialize(linked.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "simhash-links")
    discard(links)

    keyed = nodes.select("node", "size", F.explode("bands").alias("k"))
    # Band values of two nodes or more.
    shared = keyed.join(keyed.groupBy("k").count().filter("count > 1").select("k"), "k").select("node", "size", "k")
    shared = materialize(shared, "shared-bands")
    discard(nodes)
    asked = shared.select("node").unionByName(linked.select(F.col("u").alias("node"))).unionByName(linked.select(F.col("v").alias("node"))).distinct()
    sets = materialize(shingle_sets(rows.select(F.col("doc_id").alias("node"), "text").join(asked, "node", "left_semi"), shingle), "shingle-sets")

    components = None
    for n in range(ROUNDS + 1):
        if components is None:
            at = shared.withColumn("c", F.col("node"))
        else:
            at = shared.join(components, "node", "left").select("k", "node", "size", F.coalesce("component", "node").alias("c"))
        if n == ROUNDS:
            known = components.select(F.col("node").alias("u"), F.col("component").alias("v"))
            at = materialize(apart(at).select("k", "node", "size", "c", "groups"), "apart")
            hot = at.filter(F.col("groups") > HOT).select("node").distinct()
            rare = materialize(rare_shingles(sets.join(hot, "node", "left_semi"), similarity), "rare-shingles")
            components = connected_components(block_links(materialize(split_hot(at.drop("groups"), rare), "split"), sets, similarity).unionByName(known))
            discard(at, rare)
            break
        # A frequent value's nodes are put in several random orders, as many as they need.
        part = F.pmod(F.xxhash64("node", F.lit(n + ROUNDS)), F.ceil(F.col("n") / ORDERED))
        shuffled = Window.partitionBy("k", "part").orderBy(F.xxhash64("node", F.lit(n)))
        pairs = apart(at).withColumn("part", part).withColumns({f"{c}2": F.lag(c).over(shuffled) for c in ("node", "size", "c")}).filter("node2 is not null")
        pairs = pairs.filter((F.col("c") != F.col("c2")) & (F.least("size", "size2") >= similarity * F.greatest("size", "size2") - 1e-9))
        pairs = pairs.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct()
        if components is None:
            components = connected_components(similar(pairs.unionByName(linked).distinct(), sets, similarity))
        else:
            known = components.select(F.col("node").alias("u"), F.col("component").alias("v"))
            components = connected_components(similar(pairs, sets, similarity).unionByName(known))
    discard(shared, sets, linked)
    return node_of.join(components, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
