"""Operator 1: language-model scores by online logistic context mixing.

A text's tokens are its lower-cased words and one end. Each token is coded after the ones before it, by
up to four flag bits and what they announce: it comes (1) from what followed the word before, in the
training texts and earlier in this text, (2) from this text's own words so far, (3) from the words of the
text's class, (4) from all words, or else (5) it is spelled, bit by bit. Within the first four the token costs its share of
the counts. All ways to code a token add up, so a token's probability is the mix of five shares with the flags'
probabilities as weights; a text's score is the log10 of a true probability of the whole text.

Bit predictors: every flag and every bit of a spelled word is predicted from several hashed contexts, whose
counts give log-odds; these are mixed by weights that a gate picks, and flags pass a last adaptive
stage that averages the mix with what happened at similar predictions. Flags look at how often the word before
was seen, at which of the last tokens the word before foretold (the text's run of hits), at the word before, at the
class and the place in the text; spelled bits at the two to four bytes before and the word so far. The text's own
counts and hits are updated token by token, so order counts, repeated phrases get cheap, and no text looks ahead.
A text's class is its most frequent letter beyond ASCII, coded first.

Training texts are scored without their own occurrences (counts of the text are taken from the totals, its own
earlier tokens count as in any text), so a text that occurs once is not known by heart, one with a copy is.

Plan: tokens are numbered in chunks of some million (never cutting a text). Distinct words and pairs of words of a
chunk travel once, packed, to the bucket of their 64-bit hash, are counted there over all chunks, and the totals go
back to the chunk. Buckets follow the hash of the whole word or pair and chunks add up before they send,
so a frequent word, a common beginning or a third of all texts being copies makes no bucket large. Flag and spelling weights
are fitted over all training tokens and words by sums that Spark adds up (soft counts and a Newton step), so they do not depend on how rows are dealt. Counts grow with the input; only tables of fixed size come to the driver or are broadcast.

Edge cases: null text counts as empty (the end alone); a null doc_id counts as the empty text in the
split and is kept; every row, also of a repeated doc_id, has its own score; a very long word is spelled in linear time; a text
stays in one task (some 100 bytes a token); extra columns are ignored; an empty table gives no rows; without training texts all is spelled.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from copy import copy
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, file_system, materialize, partitions

CLASSES = 16
CHUNK_TOKENS, CHUNK_BYTES = 1_000_000, 1 << 26
#: Bytes of text that are split into words at once, whole texts.
STEP_BYTES = 1 << 18
#: Tokens that are scored at once, whole texts.
GROUP_TOKENS = 100_000
U = np.uint64
#: Odd multipliers of the hashes.
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Primes of XXH64.
X1, X2, X3, X4, X5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: The "word" before a text's first.
START = U(0x5851F42D4C957F2D)
END = b"\n"
#: Stands behind a text while its words are looked for; no UTF-8 text holds its middle byte.
MARK = b" \xff "
#: A bucket takes no more than these chunks' worth of words and pairs, however many chunks there are.
BUCKET_CHUNKS = 16
#: Bits of a key that are sent, after those of its bucket.
KEY_BITS = 40
#: What this text has said counts so much against the training texts.
RECENT = 4.0
FLAGS = 4
HISTORY, RUN = 3, 16
#: Slots of each flag's contexts: (word before seen, last hits), word before, (hits in a run, class), (place, word before seen).
FLAG_SLOTS = (16 * 8, 4096, (RUN + 1) * CLASSES, 16 * 16)
FLAG_FIRST = (0.3, 0.1, 0.6, 0.6)
REFINE = 33
#: Contexts of a spelled bit: the last two, three and four bytes, and all of the word so far.
ORDERS, SPELL_BITS = 4, 18
SPELL_SLOTS = 1 << SPELL_BITS
SPELL_GATES = 4 * (ORDERS + 1)
SPELL_BATCH = 1 << 17
SLICE = 1 << 16
LN10 = np.float32(math.log(10))


def text_class(text: str) -> int:
    if text.isascii():
        return 0
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + int(np.bincount(codes[codes > 127]).argmax()) % (CLASSES - 1)


def held_out(key: object, mod: int) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % mod == 0


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, stirred."""
    x = (x ^ (x >> U(31))) * M1
    x = (x ^ (x >> U(29))) * M2
    return x ^ (x >> U(32))


# --- packed arrays ----------------------------------------------------------------------------


def pack(*arrays: np.ndarray | bytes) -> bytes:
    import zstandard

    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([struct.pack(f"<{len(raw)}Q", *map(len, raw)), *raw]))


def unpack(blob: bytes, *kinds: object) -> list:
    """The arrays of pack; a kind is a dtype, or bytes."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, struct.unpack_from(f"<{len(kinds)}Q", raw), strict=True):
        part = raw[at : at + size]
        out.append(part if kind is bytes else np.frombuffer(part, kind))
        at += size
    return out


def planes(x: np.ndarray, kind: str = "<i4") -> bytes:
    """Whole numbers, byte planes apart: the high ones are mostly zero."""
    size = np.dtype(kind).itemsize
    own = x.astype(kind, copy=False).view(np.uint8).reshape(-1, size)
    used = size if x.min(initial=0) < 0 else (int(x.max(initial=0)).bit_length() + 7) // 8
    out = np.zeros((size, len(own)), np.uint8)
    for k in range(used):
        out[k] = own[:, k]
    return out.tobytes()


def from_planes(raw: np.ndarray, kind: str = "<i4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((len(raw) // size, size), np.uint8)
    for k, plane in enumerate(raw.reshape(size, -1)):
        if plane.any():
            out[:, k] = plane
    return out.view(kind).ravel()


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << U(bits) | x >> U(64 - bits)


def word_hashes(joined: bytes | np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 of every word; words of one length below 32 are taken together."""
    import xxhash

    raw = np.frombuffer(bytes(joined) + bytes(8), np.uint8)
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from every place on
    ends = np.cumsum(lengths, dtype=np.int64)
    starts, out = ends - lengths, np.empty(len(lengths), np.uint64)
    kinds = np.minimum(lengths, 32).astype(np.uint8)
    order = np.argsort(kinds, kind="stable")
    cuts = np.cumsum(np.bincount(kinds, minlength=33))
    for n in np.flatnonzero(np.diff(cuts[:32], prepend=0)).tolist():
        at = order[cuts[n - 1] if n else 0 : cuts[n]]
        place = starts[at]
        h = np.full(len(at), X5 + U(n))
        for k in range(0, n - 7, 8):
            h = turned(h ^ turned(eight[place + k] * X2, 31) * X1, 27) * X1 + X4
        if n & 4:
            h = turned(h ^ (eight[place + (n & ~7)] & U(0xFFFFFFFF)) * X1, 23) * X2 + X3
        for k in range(n & ~3, n):
            h = turned(h ^ raw[place + k] * X5, 11) * X1
        h = (h ^ h >> U(33)) * X2
        h = (h ^ h >> U(29)) * X3
        out[at] = h ^ h >> U(32)
    for i in order[cuts[31] :].tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return out


def pack_keys(keys: np.ndarray, bits: int) -> bytes:
    """The KEY_BITS after the first ``bits`` of sorted keys, byte planes apart: the leading ones hardly change."""
    own = keys << U(bits) >> U(64 - KEY_BITS)
    return np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(KEY_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : KEY_BITS // 8] = planes.T
    return out.view(np.uint64).ravel()


def vector_sum(df: DataFrame, make: Callable[[Iterator[dict]], np.ndarray], length: int) -> np.ndarray:
    """The sum over tasks of a vector of fixed length, added up by Spark in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(row for batch in batches for row in batch.to_pylist())
        for part, lo in enumerate(range(0, length, SLICE)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([pack(total[lo : lo + SLICE])], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["part"], r["data"]) for batch in batches for r in batch.to_pylist())
        for part, own in groupby(rows, itemgetter(0)):
            total = sum(unpack(data, np.float64)[0] for _, data in own)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([pack(total)], pa.binary())})

    n = min(partitions(df.sparkSession), -(-length // SLICE))
    rows = df.mapInArrow(run, "part int, data binary").repartition(n, "part").sortWithinPartitions("part").mapInArrow(add, "part int, data binary").toArrow().to_pylist()
    out = np.zeros(length)
    for r in rows:
        out[r["part"] * SLICE : (r["part"] + 1) * SLICE] = unpack(r["data"], np.float64)[0]
    return out


# --- chunks of texts ----------------------------------------------------------------------------


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all lower-cased words and each text's end, their lengths, tokens per text)."""
    raw = np.frombuffer(b"".join([t + MARK for t in texts]).lower(), np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    edge = np.flatnonzero(np.diff(space, prepend=True))  # a word's first byte, then the white space behind it
    starts, ends = edge[::2], edge[1::2]
    stops = np.flatnonzero(raw[starts] == MARK[1])
    joined = raw[~space]
    joined[joined == MARK[1]] = END[0]
    return joined, ends - starts, np.diff(stops, prepend=-1)


def array_of(joined: np.ndarray, lengths: np.ndarray) -> pa.LargeBinaryArray:
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(joined)])


def bytes_of(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, their lengths): what array_of takes."""
    _, ends, joined = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(joined or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends).astype(np.int32)


def numbered(joined: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """Each word's number and the distinct words, by number."""
    words = array_of(joined, lengths).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary


def chunks(docs: DataFrame, mod: int) -> DataFrame:
    """(chunk, doc_ids, texts, tok, vocab): texts as numbers of (word, class) pairs, which are sorted by the word's hash."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, tokens, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, held, tokens, size
            keys, joined, lengths, sizes, n_bytes, cls, out = zip(*held, strict=True)
            sizes, n_bytes, cls, out = (np.concatenate(x) for x in (sizes, n_bytes, cls, out))
            word, words = numbered(np.concatenate(joined), np.concatenate(lengths))
            present, own = np.unique(cls, return_inverse=True)
            pair = word.astype(np.int64) * len(present) + np.repeat(own, sizes)
            rank = np.zeros(len(words) * len(present), np.int32)
            rank[pair] = 1
            found = np.flatnonzero(rank)
            found = found[in_order(word_hashes(*bytes_of(words))[found // len(present)])]  # a word's classes stay in order
            rank[found] = np.arange(len(found), dtype=np.int32)
            ordered = bytes_of(words.take(pa.array(found // len(present))))
            row = {
                "chunk": pa.array([part << 32 | nth], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(keys)),
                "texts": pa.array([pack(sizes, n_bytes, cls, out)], pa.binary()),
                "tok": pa.array([pack(planes(rank[pair]))], pa.binary()),
                "vocab": pa.array([pack(*ordered, present[found % len(present)])], pa.binary()),
            }
            nth, held, tokens, size = nth + 1, [], 0, 0
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for batch in batches:
            ids, texts, first, step, some = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, [], 0
            for i, text in enumerate(texts):
                step.append(text.encode())
                some += len(step[-1])
                if some >= STEP_BYTES or i == len(texts) - 1:
                    now = slice(first, i + 1)
                    joined, lengths, sizes = words_of(step)
                    cls = np.array(list(map(text_class, texts[now])), np.uint8)
                    out = np.array([held_out(key, mod) for key in ids[now]], np.uint8)
                    held.append((batch.column(0)[now], joined, lengths, sizes, np.array(list(map(len, step)), np.int64), cls, out))
                    tokens, size = tokens + len(lengths), size + some
                    first, step, some = i + 1, [], 0
                    if tokens >= CHUNK_TOKENS or size >= CHUNK_BYTES:
                        yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"chunk long, doc_ids array<{kind}>, texts binary, tok binary, vocab binary")


class Texts:
    """The texts of a chunk: for every token its number, text, word before (its place in ``hashes`` or START)."""

    def __init__(self, row: dict):
        self.sizes, self.n_bytes, self.cls, self.held = unpack(row["texts"], np.int64, np.int64, np.uint8, np.uint8)
        self.tok = from_planes(unpack(row["tok"], np.uint8)[0])
        self.lay_out()

    def lay_out(self) -> None:
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.place = np.arange(len(self.tok)) - self.per_token(self.starts)
        self.train = self.per_token(self.held == 0)

    def per_token(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.sizes)

    def groups(self) -> Iterator[tuple[Texts, slice]]:
        """Successive texts, some GROUP_TOKENS tokens at a time, with their tokens' places."""
        ends, lo = np.cumsum(self.sizes), 0
        while lo < len(ends):
            first = int(ends[lo] - self.sizes[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, first + GROUP_TOKENS, side="right")))
            own, part = copy(self), slice(lo, hi)
            own.sizes, own.n_bytes, own.cls, own.held = self.sizes[part], self.n_bytes[part], self.cls[part], self.held[part]
            at = slice(first, int(ends[hi - 1]))
            own.tok = self.tok[at]
            own.lay_out()
            yield own, at
            lo = hi

    def before(self, values: np.ndarray, first: object) -> np.ndarray:
        """Per token, the value of the token before it in its text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def pair_keys(self, hashes: np.ndarray) -> np.ndarray:
        own = hashes[self.tok]
        return mixed(self.before(own, START) * M3 + own)


def in_order(keys: np.ndarray) -> np.ndarray:
    """np.argsort(keys, kind="stable"), mostly by a plain sort of each key's first bits with its place behind them."""
    bits = max(1, (len(keys) - 1).bit_length())
    wide = keys.dtype.itemsize == 8
    front = keys >> U(bits) << U(bits) if wide else keys.astype(np.uint64) << U(bits)
    order = (np.sort(front | np.arange(len(keys), dtype=np.uint64)) & U((1 << bits) - 1)).astype(np.int64)
    if wide and (keys[order[1:]] < keys[order[:-1]]).any():  # different keys with the same first bits
        return np.argsort(keys, kind="stable")
    return order


def occurrences(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, heads, own, earlier): keys in order and where each key begins there; per token, how often its
    text has its key, and how often before it."""
    order = in_order(keys)
    k, t = keys[order], text[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    run = new.copy()
    run[1:] |= t[1:] != t[:-1]
    begins = np.flatnonzero(run)
    lengths = np.diff(np.r_[begins, len(k)])
    own, earlier = np.empty(len(k), np.int32), np.empty(len(k), np.int32)
    own[order] = np.repeat(lengths, lengths)
    earlier[order] = np.arange(len(k)) - np.repeat(begins, lengths)
    return order, np.flatnonzero(new), own, earlier


# --- counting in buckets ----------------------------------------------------------------------------


REQUEST = "bucket int, chunk long, data binary"
ANSWER = "chunk long, kind int, bucket int, data binary"


def in_buckets(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit hashes by their first bits."""
    cuts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << U(64 - bits))
    ends = np.r_[cuts[1:], len(hashes)]
    for b in np.flatnonzero(ends > cuts):
        yield int(b), int(cuts[b]), int(ends[b])


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], names=list(names))


def asked_words(chunk_rows: DataFrame, bits: int) -> DataFrame:
    """Per chunk and bucket: its (word, class) pairs and their training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            texts = Texts(row)
            joined, lengths, classes = unpack(row["vocab"], bytes, np.int32, np.uint8)
            hashes = word_hashes(joined, lengths)
            n = np.bincount(texts.tok, weights=texts.train, minlength=len(lengths)).astype(np.int64)
            ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
            yield batch_of([(b, row["chunk"], pack(joined[ends[lo] : ends[hi]], lengths[lo:hi], classes[lo:hi], n[lo:hi])) for b, lo, hi in in_buckets(hashes, bits)], REQUEST)

    return chunk_rows.mapInArrow(run, REQUEST)


def asked_pairs(chunk_rows: DataFrame, bits: int) -> DataFrame:
    """Per chunk and bucket: its pairs of successive words and their training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            texts = Texts(row)
            keys = texts.pair_keys(word_hashes(*unpack(row["vocab"], bytes, np.int32, np.uint8)[:2]))
            order, heads, _, _ = occurrences(keys, texts.text)
            found = keys[order[heads]]
            n = np.add.reduceat(texts.train[order].astype(np.int32), heads, dtype=np.int32)
            yield batch_of([(b, row["chunk"], pack(pack_keys(found[lo:hi], bits), n[lo:hi])) for b, lo, hi in in_buckets(found, bits)], REQUEST)

    return chunk_rows.mapInArrow(run, REQUEST)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    rows = ((r["bucket"], r["chunk"], r["data"]) for batch in batches for r in batch.to_pylist())
    for bucket, own in groupby(rows, itemgetter(0)):
        yield bucket, [(chunk, data) for _, chunk, data in own]


def dealt(requests: DataFrame) -> DataFrame:
    """Requests by bucket; Spark merges small partitions, as each is written to a file."""
    return requests.repartition("bucket").sortWithinPartitions("bucket", "chunk")


TYPES = "bucket int, words binary, asked binary, n long, v long, of_class array<long>, ends array<long>"


def word_types(requests: DataFrame) -> DataFrame:
    """Per bucket: its distinct words with training counts, who asked for which, and totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in by_bucket(batches):
            joined, lengths, classes, counts = zip(*(unpack(data, bytes, np.int32, np.uint8, np.int64) for _, data in own), strict=True)
            sizes = list(map(len, lengths))
            at, words = numbered(np.frombuffer(b"".join(joined), np.uint8), np.concatenate(lengths))
            classes, counts = np.concatenate(classes).astype(np.int64), np.concatenate(counts)
            total = np.bincount(at, weights=counts, minlength=len(words)).astype(np.int64)
            per_class = np.zeros(len(words) * CLASSES, np.int64)
            np.add.at(per_class, at.astype(np.int64) * CLASSES + classes, counts)
            end = words.index(END).as_py()
            ends = per_class.reshape(-1, CLASSES)[end].tolist() if end >= 0 else [0] * CLASSES
            asked = pack(np.array([c for c, _ in own], np.int64), np.array(sizes, np.int64), at, per_class[at.astype(np.int64) * CLASSES + classes])
            yield batch_of([(bucket, pack(*bytes_of(words), total), asked, int(total.sum()), int((total > 0).sum()), np.bincount(classes, weights=counts, minlength=CLASSES).astype(np.int64).tolist(), ends)], TYPES)

    return dealt(requests).mapInArrow(run, TYPES)


def pair_answers(requests: DataFrame) -> DataFrame:
    """Per chunk and bucket: the training tokens of its pairs over all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in by_bucket(batches):
            parts = [unpack(data, bytes, np.int32) for _, data in own]
            keys, n = np.concatenate([unpack_keys(k) for k, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(keys, kind="stable")
            heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            sums = np.add.reduceat(n[order], heads, dtype=np.int64)
            total = np.empty(len(keys), np.int64)
            total[order] = np.repeat(sums, np.diff(np.r_[heads, len(keys)]))
            ends = np.cumsum([len(x) for _, x in parts])
            yield batch_of([(chunk, 2, bucket, pack(planes(total[e - len(x) : e], "<i8"))) for (chunk, _), (_, x), e in zip(own, parts, ends, strict=True)], ANSWER)

    return dealt(requests).mapInArrow(run, ANSWER)


# --- spelling -------------------------------------------------------------------------------------


def spelled_batches(words: bytes, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, bytes with word ends) of words, some SPELL_BATCH bytes at a time."""
    ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SPELL_BATCH)) - 1)
        own = [words[ends[i] : ends[i + 1]] for i in range(lo, hi)]
        yield lo, hi, [w if w == END else w + b" " for w in own]
        lo = hi


class Spelled:
    """Bits of closed words: for each of eight bits of all bytes the outcome and the slots of its contexts."""

    def __init__(self, closed: list[bytes]):
        self.lengths = np.array(list(map(len, closed)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = np.frombuffer(b"".join(closed), np.uint8)
        self.pos = np.arange(len(flat)) - np.repeat(self.starts, self.lengths)
        self.byte = flat.astype(np.uint64)
        back, contexts = np.zeros(len(flat), np.uint64), []
        for k in range(1, ORDERS + 1):
            older = np.zeros(len(flat), np.uint64)
            older[k:] = self.byte[:-k] + U(1)
            older[self.pos < k] = 0
            back = back << U(9) | older
            if k > 1:
                contexts.append(mixed(back * M3 + U(k)))
        power = np.multiply.accumulate(np.full(int(self.lengths.max(initial=1)), M1)) * M2
        term = (self.byte + U(1)) * power[self.pos]
        so_far = np.cumsum(term) - term
        contexts.append(mixed(so_far - np.repeat(so_far[self.starts], self.lengths)))
        self.contexts = contexts

    def bits(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(outcome, slots of every order) for each bit."""
        for j in range(8):
            node = U(1 << j) | self.byte >> U(8 - j)
            step = node * M2
            at = [((c + step) * M1 >> U(64 - SPELL_BITS)).astype(np.int32) + np.int32(k * SPELL_SLOTS) for k, c in enumerate(self.contexts)]
            yield (self.byte >> U(7 - j) & U(1)).astype(bool), np.array(at)


def odds_tables(tables: np.ndarray) -> np.ndarray:
    """Log-odds of every slot as it is, without a one, and without a zero; 0 where nothing is known."""
    out = []
    for less1, less0 in ((0, 0), (1, 0), (0, 1)):
        zeros, ones = np.maximum(tables[0] - less0, 0), np.maximum(tables[1] - less1, 0)
        odds = np.log((ones + 0.4) / (zeros + 0.4))
        out.append(np.where(zeros + ones == 0, 0, np.where(odds == 0, 1e-6, odds)))
    return np.concatenate(out).astype(np.float32)


def spell_inputs(y: np.ndarray, at: np.ndarray, pos: np.ndarray, odds: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds (orders and a constant, bits) and gates; leave: for bits of words that are in the tables, without their
    own occurrence."""
    x = np.full((ORDERS + 1, len(y)), 0.3, np.float32)
    gate = np.minimum(pos, 3).astype(np.int16) * np.int16(ORDERS + 1)
    variant = np.where(leave, np.where(y, np.int32(1), np.int32(2)), np.int32(0)) * np.int32(ORDERS * SPELL_SLOTS)
    for k in range(ORDERS):
        np.take(odds, at[k] + variant, out=x[k], mode="clip")
        gate += x[k] != 0
    return x, gate


def mix_of(w: np.ndarray, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weighted sum of the inputs, weights picked by the gate."""
    columns, gate = np.ascontiguousarray(w.T), gate.astype(np.intp, copy=False)
    out = np.take(columns[0], gate, mode="clip") * x[0]
    for k in range(1, len(x)):
        out += np.take(columns[k], gate, mode="clip") * x[k]
    return out


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -14, 14)))


def newton_sums(x: np.ndarray, gate: np.ndarray, miss: np.ndarray, curve: np.ndarray, gates: int) -> np.ndarray:
    """Gradient and curvature of every gate's weights, flat."""
    order = np.argsort(gate.astype(np.uint8), kind="stable")
    return sorted_sums(x[:, order], gate[order], miss[order], curve[order], gates)


def sorted_sums(x: np.ndarray, gate: np.ndarray, miss: np.ndarray, curve: np.ndarray, gates: int) -> np.ndarray:
    """newton_sums of rows in order of their gates."""
    k, cuts = len(x), np.searchsorted(gate, np.arange(gates + 1))
    out = np.zeros((gates, k + k * k))
    for g in np.flatnonzero(np.diff(cuts)):
        at = slice(cuts[g], cuts[g + 1])
        own = x[:, at]
        out[g, :k] = own @ miss[at].astype(np.float32)
        out[g, k:] = ((own * curve[at].astype(np.float32)) @ own.T).ravel()
    return out.ravel()


def newton_step(w: np.ndarray, sums: np.ndarray, ridge: float = 2.0) -> np.ndarray:
    gates, k = w.shape
    sums = sums.reshape(gates, k + k * k)
    return np.stack([w[g] + np.clip(np.linalg.solve(s[k:].reshape(k, k) + ridge * np.eye(k), s[:k]), -2, 2) for g, s in enumerate(sums)])


def learned_spelling(types: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones in every slot over the distinct training words; the gates' weights, fitted
    to all words that occur once, as the words that will have to be spelled are most like these."""

    def trained(rows: Iterator[dict], most: int = 1 << 62) -> Iterator[Spelled]:
        for row in rows:
            joined, lengths, n = unpack(row["words"], bytes, np.int32, np.int64)
            ends = np.cumsum(lengths, dtype=np.int64)
            keep = np.flatnonzero((n > 0) & (n <= most))
            own = [joined[ends[i] - lengths[i] : ends[i]] for i in keep.tolist()]
            for _, _, closed in spelled_batches(b"".join(own), lengths[keep]):
                yield Spelled(closed)

    def count(rows: Iterator[dict]) -> np.ndarray:
        out = np.zeros((ORDERS * SPELL_SLOTS, 2))
        for s in trained(rows):
            seen = np.concatenate([at * 2 + y for y, at in s.bits()], axis=1)
            for k, own in enumerate(seen):  # an order's slots lie together
                slots = slice(k * SPELL_SLOTS, (k + 1) * SPELL_SLOTS)
                out[slots] += np.bincount(own - 2 * slots.start, minlength=2 * SPELL_SLOTS).reshape(-1, 2)
        return out.T.ravel()

    spark = types.sparkSession
    words = types.select("words")
    tables = vector_sum(words, count, 2 * ORDERS * SPELL_SLOTS).reshape(2, -1)
    shared = spark.sparkContext.broadcast(odds_tables(tables))
    weights = np.full((SPELL_GATES, ORDERS + 1), 0.3, np.float32)
    weights[:, ORDERS] = 0

    def fit(rows: Iterator[dict]) -> np.ndarray:
        out = np.zeros(weights.size * (ORDERS + 2))
        for s in trained(rows, 1):
            for y, at in s.bits():
                x, gate = spell_inputs(y, at, s.pos, shared.value, np.ones(len(y), bool))
                p = squash(mix_of(weights, gate, x))
                out += newton_sums(x, gate, y - p, p * (1 - p), SPELL_GATES)
        return out

    return tables, newton_step(weights, vector_sum(words, fit, weights.size * (ORDERS + 2))).astype(np.float32)


def spelling_costs(words: bytes, lengths: np.ndarray, trained: np.ndarray, odds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 probability of each word, spelled."""
    out = np.zeros(len(lengths))
    for lo, hi, closed in spelled_batches(words, lengths):
        s = Spelled(closed)
        leave = np.repeat(trained[lo:hi].astype(bool), s.lengths)
        p = np.ones(len(s.byte))
        for y, at in s.bits():
            x, gate = spell_inputs(y, at, s.pos, odds, leave)
            mix = mix_of(w, gate, x)
            p *= squash(np.where(y, mix, -mix))
        out[lo:hi] = np.add.reduceat(np.log10(p), s.starts)
    return out


def word_answers(types: DataFrame, spelling) -> DataFrame:
    """Per chunk and bucket: training tokens, those of the class, and spelled cost of its (word, class) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            joined, lengths, n = unpack(row["words"], bytes, np.int32, np.int64)
            asking, sizes, at, of_class = unpack(row["asked"], np.int64, np.int64, np.int32, np.int64)
            cost = spelling_costs(joined, lengths, n > 0, *spelling.value)
            ends = np.cumsum(sizes)
            out = []
            for chunk, lo, hi in zip(asking.tolist(), ends - sizes, ends, strict=True):
                own = at[lo:hi]
                out.append((chunk, 1, row["bucket"], pack(n[own], of_class[lo:hi], cost[own].astype(np.float32))))
            yield batch_of(out, ANSWER)

    return types.select("bucket", "words", "asked").mapInArrow(run, ANSWER)


# --- texts with their counts -----------------------------------------------------------------------


def stored_row(uri: str, place: int) -> pa.Table:
    """The row at a place of a Parquet file; only its row group is read."""
    import pyarrow.parquet as pq

    fs, path = file_system(uri)
    with pq.ParquetFile(path, filesystem=fs) as file:
        ends = np.cumsum([file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)])
        group = int(np.searchsorted(ends, place, side="right"))
        return file.read_row_group(group).slice(place - (ends[group - 1] if group else 0), 1)


def counted(chunk_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with what the buckets answered: (doc_ids, texts, tok, words, pairs).

    Only the answers are shuffled; a chunk, alone in its row group, is read where its answers arrive.
    """
    doc_ids = dict(chunk_rows.dtypes)["doc_ids"]
    files = chunk_rows.select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("data"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))
    both = files.unionByName(answers, allowMissingColumns=True)
    ordered = both.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, own in groupby(rows, itemgetter("chunk")):
            first = next(own)
            stored = stored_row(first["path"], first["place"])
            head = {c: stored[c][0].as_py() for c in ("texts", "tok", "vocab")}
            texts, parts = Texts(head), {1: [], 2: []}
            for r in own:
                parts[r["kind"]].append(r["data"])
            n, of_class, cost = (np.concatenate(x) for x in zip(*(unpack(d, np.int64, np.int64, np.float32) for d in parts[1]), strict=True))
            hashes = word_hashes(*unpack(head["vocab"], bytes, np.int32, np.uint8)[:2])
            order, heads, own_pair, earlier = occurrences(texts.pair_keys(hashes), texts.text)
            total = np.concatenate([from_planes(unpack(d, np.uint8)[0], "<i8") for d in parts[2]])
            pair = np.empty(len(order), np.int64)
            pair[order] = np.repeat(total, np.diff(np.r_[heads, len(order)]))
            _, _, own_word, earlier_word = occurrences(texts.tok, texts.text)
            columns = [stored["doc_ids"].combine_chunks(), pa.array([head["texts"]], pa.binary()), pa.array([head["tok"]], pa.binary()), pa.array([pack(n, of_class, cost, (hashes >> U(52)).astype(np.uint16))], pa.binary()), pa.array([pack(planes(pair, "<i8"), *map(planes, (own_pair, earlier, own_word, earlier_word)))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_ids", "texts", "tok", "words", "pairs"])

    return ordered.mapInArrow(run, f"doc_ids {doc_ids}, texts binary, tok binary, words binary, pairs binary")


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def level(x: np.ndarray) -> np.ndarray:
    """0 for 0, then one step for each doubling, 15 at most."""
    return np.minimum(np.ceil(np.log2(np.maximum(x, 0) + 1)), 15).astype(np.int64)


class Shares:
    """Per token: its share by each way to code it, and the slots of the flags' contexts."""

    def __init__(self, t: Texts, words: list[np.ndarray], pairs: list[np.ndarray], totals: dict):
        self.texts = t
        n, of_class, cost, prefix = words
        tok = t.tok.astype(np.intp)
        pair, own_pair, earlier_pair, own, earlier = pairs
        self.n = n[tok]
        self.train = leave = t.train
        size = np.where(t.held == 0, t.sizes, 0)
        mine = leave * own
        others = self.n - mine
        before = t.before(others, totals["ends"].sum() - (t.held == 0))
        seen = before + RECENT * t.before(earlier, 0)
        self.p = np.empty((FLAGS, len(tok)), np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.p[0] = (pair - leave * own_pair + RECENT * earlier_pair) / seen
            self.p[1] = earlier / t.place
            self.p[2] = (of_class[tok] - mine) / t.per_token(totals["of_class"][t.cls] - size)
            self.p[3] = others / t.per_token(totals["n"] - size)
        self.p[~np.isfinite(self.p)] = 0
        self.spelled = cost[tok]
        # Which tokens the word before foretold better than their class: known once the token is.
        hit = (self.p[0] > np.maximum(self.p[2], self.p[3])).astype(np.uint8)
        last = hit
        pattern = np.zeros(len(hit), np.uint8)
        for k in range(HISTORY):
            last = t.before(last, 0)
            pattern |= last << k
        done = np.cumsum(hit, dtype=np.int64) - hit
        run = done - done[np.maximum(np.arange(len(hit)) - RUN, np.arange(len(hit)) - t.place)]
        known, place = level(seen), level(t.place)
        self.known = known
        self.slots = [known * 8 + pattern, t.before(prefix[tok], 0).astype(np.int64), run * CLASSES + t.per_token(t.cls), place * 16 + known]

    def by_gate(self) -> Shares:
        """The same tokens in order of their gates, as far as the flags are fitted."""
        order, own = np.argsort(self.known.astype(np.uint8), kind="stable"), copy(self)
        own.p, own.spelled, own.train, own.known = np.take(self.p, order, axis=1), self.spelled[order], self.train[order], self.known[order]
        own.slots = [at[order] for at in self.slots]
        return own

    def weights(self, q: np.ndarray) -> np.ndarray:
        """How much each way counts, from the flags' probabilities."""
        out = np.empty((FLAGS + 1, q.shape[1]), np.float32)
        left = np.ones(q.shape[1], np.float32)
        for flag in range(FLAGS):
            out[flag] = q[flag] * left
            left = left - out[flag]
        out[FLAGS] = left
        return out

    def log_p(self, q: np.ndarray) -> np.ndarray:
        g = self.weights(q)
        told = np.einsum("ij,ij->j", g[:FLAGS], self.p)
        last = np.maximum(g[FLAGS], np.float32(1e-12))
        spelled = self.spelled * LN10 + np.log(last)
        with np.errstate(divide="ignore"):
            return np.where(told > 0, np.log(told + np.exp(np.maximum(spelled, -80))), spelled) / LN10

    def parts(self, q: np.ndarray) -> np.ndarray:
        """Each way's part in the token's probability."""
        g = self.weights(q)
        g[:FLAGS] *= self.p
        g[FLAGS] *= np.exp(np.maximum(self.spelled * LN10, -80))
        total = g.sum(axis=0)
        g[FLAGS] += total == 0
        return g / (total + (total == 0))


def shares_of(rows: Iterator[dict], totals: dict) -> Iterator[Shares]:
    """The shares of chunks' tokens, a group of texts at a time."""
    for row in rows:
        words = unpack(row["words"], np.int64, np.int64, np.float32, np.uint16)
        pairs = unpack(row["pairs"], *[np.uint8] * 5)
        pairs = [from_planes(pairs[0], "<i8"), *map(from_planes, pairs[1:])]
        for texts, at in Texts(row).groups():
            yield Shares(texts, words, [x[at] for x in pairs], totals)


OFFSETS = np.cumsum([0, *FLAG_SLOTS])
N_SLOTS = int(OFFSETS[-1])
N_INPUTS = len(FLAG_SLOTS) + 1


def flag_inputs(shares: Shares, odds: np.ndarray) -> np.ndarray:
    """Every flag's inputs: the log-odds of its contexts and a constant."""
    x = np.full((FLAGS, N_INPUTS, len(shares.spelled)), 0.3, np.float32)
    for k, at in enumerate(shares.slots):
        for flag in range(FLAGS):
            np.take(odds[flag, OFFSETS[k] : OFFSETS[k + 1]], at, out=x[flag, k], mode="clip")
    return x


def refine_at(mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (np.clip(mix, -7.999, 7.999) + 8) * np.float32((REFINE - 1) / 16)
    low = at.astype(np.int32)
    return low.astype(np.intp), at - low


def flag_probabilities(shares: Shares, odds: np.ndarray, w: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mix by the gates' weights, averaged with what happened where the plain mean of the inputs was alike."""
    out = np.empty((FLAGS, len(shares.n)), np.float32)
    for flag, x in enumerate(flag_inputs(shares, odds)):
        low, part = refine_at(x[:-1].mean(axis=0))
        p = 0.5 * squash(mix_of(w[flag], shares.known, x)) + 0.5 * (np.take(table[flag], low, mode="clip") * (1 - part) + np.take(table[flag], low + 1, mode="clip") * part)
        out[flag] = np.clip(p, 1e-5, 1 - 1e-5)
    return out


def learned_flags(ready: DataFrame, totals: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of all slots, weights of all gates and the table of the last stage, over all training tokens."""
    first = np.array(FLAG_FIRST, np.float32)[:, None]

    def tallies(rows: Iterator[dict]) -> np.ndarray:
        out = np.zeros((2, FLAGS, N_SLOTS))
        for s in shares_of(rows, totals):
            r = (s.parts(np.repeat(first, len(s.n), axis=1)) * s.train).astype(np.float64)
            train = s.train.astype(np.float64)
            for k, at in enumerate(s.slots):
                own = slice(OFFSETS[k], OFFSETS[k + 1])
                later = np.bincount(at, weights=train, minlength=FLAG_SLOTS[k])
                for flag in range(FLAGS):
                    ones = np.bincount(at, weights=r[flag], minlength=FLAG_SLOTS[k])
                    later = later - ones
                    out[1, flag, own] += ones
                    out[0, flag, own] += np.maximum(later, 0)
        return out.ravel()

    zeros, ones = vector_sum(ready, tallies, 2 * FLAGS * N_SLOTS).reshape(2, FLAGS, N_SLOTS)
    share = ((ones.sum(axis=1) + 1) / (zeros.sum(axis=1) + ones.sum(axis=1) + 2))[:, None]
    odds = stretch(np.clip((ones + 8 * share) / (zeros + ones + 8), 1e-4, 1 - 1e-4)).astype(np.float32)
    weights = np.full((FLAGS, 16, N_INPUTS), 1 / len(FLAG_SLOTS))
    weights[:, :, -1] = 0
    n_fit = 16 * N_INPUTS * (N_INPUTS + 1)

    def fit(rows: Iterator[dict]) -> np.ndarray:
        out = np.zeros((FLAGS, n_fit + 2 * REFINE))
        for s in (x.by_gate() for x in shares_of(rows, totals)):
            inputs = flag_inputs(s, odds)
            means = inputs[:, :-1].mean(axis=1)
            q = np.clip(squash(means), 1e-5, 1 - 1e-5)
            r = s.parts(q) * s.train
            left = r.sum(axis=0)
            for flag in range(FLAGS):
                near = np.rint((np.clip(means[flag], -8, 8) + 8) * ((REFINE - 1) / 16)).astype(np.int64)
                out[flag, n_fit : n_fit + REFINE] += np.bincount(near, weights=left, minlength=REFINE)
                out[flag, n_fit + REFINE :] += np.bincount(near, weights=r[flag], minlength=REFINE)
                miss = r[flag] - left * q[flag]
                out[flag, :n_fit] += sorted_sums(inputs[flag], s.known, miss, left * q[flag] * (1 - q[flag]), 16)
                left = left - r[flag]
        return out.ravel()

    sums = vector_sum(ready, fit, FLAGS * (n_fit + 2 * REFINE)).reshape(FLAGS, -1)
    weights = np.stack([newton_step(weights[flag], sums[flag, :n_fit]) for flag in range(FLAGS)])
    all_, hits = sums[:, n_fit : n_fit + REFINE], sums[:, n_fit + REFINE :]
    centre = squash(np.arange(REFINE) * (16 / (REFINE - 1)) - 8)
    return odds, weights.astype(np.float32), ((hits + 20 * centre) / (all_ + 20)).astype(np.float32)


def class_shares(totals: dict) -> np.ndarray:
    """log10 probability of every class of texts."""
    return np.log10((totals["ends"] + 0.5) / (totals["ends"].sum() + 0.5 * CLASSES))


def prepared(rows: DataFrame, mod: int) -> tuple[DataFrame, dict, tuple]:
    """Chunks with their counts, totals over the training texts, and the spelling model."""
    spark = rows.sparkSession
    chunk_rows = materialize(chunks(rows, mod), "lm-chunks", rows_per_group=1)
    bits = max(4, (4 * partitions(spark) - 1).bit_length(), (chunk_rows.count() // BUCKET_CHUNKS).bit_length())
    types = materialize(word_types(asked_words(chunk_rows, bits)), "lm-types")
    sums = [F.sum("n"), F.sum("v"), *(F.sum(F.get(c, F.lit(k))) for c in ("of_class", "ends") for k in range(CLASSES))]
    got = [int(x or 0) for x in types.agg(*sums).first()]
    totals = {"n": got[0], "v": got[1], "of_class": np.array(got[2 : 2 + CLASSES]), "ends": np.array(got[2 + CLASSES :])}
    spelling = learned_spelling(types)
    shared = spark.sparkContext.broadcast((odds_tables(spelling[0]), spelling[1]))
    answers = word_answers(types, shared).unionByName(pair_answers(asked_pairs(chunk_rows, bits)))
    ready = materialize(counted(chunk_rows, answers), "lm-counted")
    discard(chunk_rows, types)
    return ready, totals, spelling


def lm_scores(docs: DataFrame, mod: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    ready, totals, _ = prepared(rows, mod)
    model = docs.sparkSession.sparkContext.broadcast(learned_flags(ready, totals))
    shares_of_class = class_shares(totals)
    denominator = math.log10(totals["n"] + 0.1 * (totals["v"] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column("doc_ids").flatten(), 0
            for s in shares_of(iter(batch.drop_columns(["doc_ids"]).to_pylist()), totals):
                t = s.texts
                log_p = s.log_p(flag_probabilities(s, *model.value))
                score = np.add.reduceat(log_p, t.starts) + shares_of_class[t.cls]
                base = np.add.reduceat(np.log10(s.n + 0.1), t.starts) - t.sizes * denominator
                known = np.add.reduceat((s.n > 0).astype(np.int64), t.starts)
                columns = {"doc_id": keys[at : at + len(t.sizes)], "held_out": pa.array(t.held == 1), "n_tokens": t.sizes, "n_known": known, "base_score": base, "score": score, "n_bytes": t.n_bytes}
                at += len(t.sizes)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    out = ready.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
