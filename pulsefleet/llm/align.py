"""Alignment of two tokenizers: interval coalescing of the token bytes, and counts of linked id pairs.

All tokens of both sides are sorted by their first byte; a group ends where the next token starts at or behind the largest
end so far (a running maximum), so groups are the finest cuts that both sides share. In a group every
A token is linked to every B token. A group's links are spread by its distinct ids with their multiplicities,
so a long group costs its distinct pairs, not its occurrences.

How many documents hold an id pair linked is a count over the corpus. Documents are cut into chunks of about CHUNK
tokens, which are written once. A chunk sends each of its distinct pairs with the number of its documents to Spark,
where pairs meet their other chunks by pair; the totals go back to the chunk. The highest count of an A id has one
row per id of the vocabulary, which bounds its broadcast.

Edge cases: a null or empty text has no tokens, and neither has one whose joined token bytes differ from space
and text (zeros, an empty digest); rows with a null or repeated doc_id are documents of their own; an empty
table gives no rows; extra columns are ignored; a very long text is one chunk.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_ROWS as BPE_ROWS
from .bpe import Cache, CachedBpe, byte_alphabet
from .common import materialize

#: Tokens in a chunk and bytes of text looked at at once, but for longer documents.
CHUNK, STEP = 2_000_000, 1 << 19
#: Pairs of ids that are spread at once.
SPREAD = 1 << 20
CACHE_ROWS = 400_000
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
OUT = ", ".join(f"{c} string" if c == "groups_sha256" else f"{c} long" for c in COLUMNS)


def bytes_of(names: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(names.__getitem__, array("I", ids)))


class Words(Cache):
    """A cache that is asked for all words of a text at once."""

    def joined(self, keys: list[str], make: Callable[[list[str]], list[bytes | None]]) -> bytes | None:
        """The joined rows of the keys; None if one of them has none. ``make`` gets the distinct keys that are new."""
        got = list(map(self.young.get, keys))
        lacking = [k for k, ids in zip(keys, got, strict=True) if ids is None]
        if lacking:
            found = {k: self.old.get(k) for k in lacking}
            new = [k for k, ids in found.items() if ids is None]
            found.update(zip(new, make(new), strict=True))
            if len(self.young) + len(found) > self.half:
                self.old, self.young = self.young, {}
            self.young.update(found)
            got = [found[k] if ids is None else ids for k, ids in zip(keys, got, strict=True)]
        try:
            return b"".join(got)
        except TypeError:
            return None


class Bytes(CachedBpe):
    """A's ids of space + text."""

    def __init__(self, path: str):
        super().__init__(path, False, True)
        back = {c: b for b, c in byte_alphabet().items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [bytes(back.get(c, 0) for c in n) for n in names]
        self.rest = Words(BPE_ROWS)

    def encoded(self, text: str) -> bytes:
        return self.whole(" " + text)

    def made(self, keys: list[str]) -> list[bytes | None]:
        out = []
        for key in keys:
            ids = self.chunk(key, " ")
            same = ids is not None and bytes_of(self.bytes, ids) == (key if key[:1] == "\n" else " " + key).encode()
            out.append(ids if same else None)
        return out

    def sure(self, text: str) -> bytes | None:
        """The ids if every word stands alone and is given back by its own, so that the text is, too."""
        return self.rest.joined(text.replace("\n", " \n").split(" "), self.made)


class Pieces:
    """B's ids of space + text. No piece holds a space behind another character or a line end, so words stand alone."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        whole = [i for i, n in enumerate(names) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.apart = not any("\n" in names[i] or "▁" in names[i].lstrip("▁") for i in whole)
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.rest = Words(CACHE_ROWS)

    def encoded(self, text: str) -> bytes:
        return array("I", self.model.encode(text)).tobytes()

    def made(self, keys: list[str]) -> list[bytes | None]:
        out = []
        # The model puts the space before a word.
        for key, ids in zip(keys, self.model.encode(keys, num_threads=1), strict=True):
            same = key and b"".join(map(self.bytes.__getitem__, ids)) == b" " + key.encode()
            out.append(array("I", ids).tobytes() if same else None)
        return out

    def sure(self, text: str) -> bytes | None:
        """The ids if every word stands alone and is given back by its own, so that the text is, too."""
        return self.rest.joined(text.split(" "), self.made) if self.apart else None


class Sides:
    """Both tokenizers of a worker process with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Bytes(path_a), Pieces(path_b)
        self.bytes = self.a.bytes, self.b.bytes
        self.lengths = [np.array(list(map(len, x)), np.int64) for x in self.bytes]
        # An id's text in the digest behind its separator: a group's first A, its first B, any other.
        first = [[f"{mark}{i}" for i in range(len(x))] for mark, x in ((";", self.bytes[0]), ("|", self.bytes[1]))]
        more = [[f",{i}" for i in range(len(x))] for x in self.bytes]
        self.texts = np.array([*first[0], *more[0], *first[1], *more[1]], object)

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if a side does not give space + text back."""
        none = np.zeros(0, "<u4"), np.zeros(0, "<u4")
        if not text:
            return none
        out = []
        for side in (self.a, self.b):
            ids = side.sure(text)
            if ids is None:
                ids = side.encoded(text)
                if bytes_of(side.bytes, ids) != b" " + text.encode():
                    return none
            out.append(np.frombuffer(ids, "<u4"))
        return out[0], out[1]


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def coalesced(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the tokens by start, A before B, and the group of each in that order."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(opens) - 1


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def links(group: np.ndarray, ids: np.ndarray, side: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of all links: a group's distinct A ids by its distinct B ids. owner: the group's document."""
    per_side = []
    for s in (0, 1):
        own = side == s
        per_side.append(counted(group[own] << 32 | ids[own]))
    (a, na), (b, nb) = per_side
    size_b = np.bincount(b >> 32, minlength=len(owner))
    first_b = np.cumsum(size_b) - size_b
    spread = size_b[a >> 32]
    done = np.cumsum(spread)
    parts, lo, taken = [], 0, 0
    while lo < len(a):  # in slices of A ids; one id's partners are at most a vocabulary
        hi = max(lo + 1, int(np.searchsorted(done, taken + SPREAD, "right")))
        taken = int(done[hi - 1])
        one = np.repeat(np.arange(lo, hi), spread[lo:hi])
        within = np.arange(len(one)) - np.repeat(np.cumsum(spread[lo:hi]) - spread[lo:hi], spread[lo:hi])
        other = first_b[a[one] >> 32] + within
        pair = (a[one] & 0xFFFFFFFF) * width + (b[other] & 0xFFFFFFFF)
        parts.append(merged(owner[a[one] >> 32] << 40 | pair, na[one] * nb[other]))
        lo = hi
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, times = parts[0] if len(parts) == 1 else merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return keys >> 40, keys & ((1 << 40) - 1), times


def aligned(both: Sides, texts: list[str | None]) -> tuple[dict[str, np.ndarray | list], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per document n_a, n_b, n_groups, n_links, digest; and the links (document, pair, times)."""
    found = [both.ids(t) for t in texts]
    n = np.array([[len(a), len(b)] for a, b in found], np.int64).reshape(-1, 2)
    ids = [np.concatenate([x[s] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for s in (0, 1)]
    ends = [np.cumsum(both.lengths[s][ids[s]]) for s in (0, 1)]
    starts = [e - both.lengths[s][ids[s]] for s, e in enumerate(ends)]
    doc = np.concatenate([np.repeat(np.arange(len(texts)), n[:, s]) for s in (0, 1)])
    side = np.repeat([0, 1], list(map(len, ids)))
    # Both sides hold the same bytes, so places run on from document to document.
    order, group = coalesced(np.concatenate(starts), np.concatenate(ends), side)
    doc, side, ids = doc[order], side[order], np.concatenate(ids)[order]
    opens = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    owner = doc[opens]
    d, pair, times = links(group, ids, side, owner, len(both.bytes[1]))
    shown = np.lexsort((side, group))
    doc, side, ids, group = doc[shown], side[shown], ids[shown], group[shown]
    kind = group * 2 + side
    first = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, bool)
    width = len(both.bytes[0])
    words = both.texts[ids + np.where(side == 0, np.where(first, 0, width), 2 * width + np.where(first, 0, len(both.bytes[1])))].tolist()
    cuts = np.concatenate([[0], np.cumsum(n.sum(axis=1))]).tolist()
    digests = [hashlib.sha256("".join(words[lo:hi])[1:].encode()).hexdigest() if hi > lo else "" for lo, hi in zip(cuts, cuts[1:], strict=False)]
    stats = {"n_a": n[:, 0], "n_b": n[:, 1], "n_groups": np.bincount(owner, minlength=len(texts)), "n_links": np.bincount(d, weights=times, minlength=len(texts)).astype(np.int64), "digest": digests}
    return stats, (d, pair, times)


def steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of about STEP characters, one document at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > STEP:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


CHUNKS = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, lengths array<int>, pairs array<long>, documents array<int>, at binary, times binary"


def chunked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per chunk: its documents, its distinct pairs in order with the number of documents, and each document's pairs by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both, part, count = sides(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        held: dict[str, list] = {}
        tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal held, tokens, count
            pair = np.concatenate(held["pair"])
            distinct, at = np.unique(pair, return_inverse=True)
            row = {
                "chunk": [part + count],
                "doc_ids": [held["doc_ids"]],
                **{c: [np.concatenate(held[c])] for c in ("n_a", "n_b", "n_groups", "n_links")},
                "digests": [held["digest"]],
                "lengths": [np.concatenate(held["lengths"]).astype(np.int32)],
                "pairs": [distinct],
                "documents": [np.bincount(at, minlength=len(distinct)).astype(np.int32)],
                "at": [at.astype("<u4").tobytes()],
                "times": [np.concatenate(held["times"]).astype("<u4").tobytes()],
            }
            count, tokens, held = count + 1, 0, {}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([(c, {"long": pa.int64(), "int": pa.int32()}.get(t, pa.binary())) if "<" not in t else (c, pa.list_({"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t[6:-1]])) for c, t in (f.split() for f in CHUNKS.split(", "))]))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in steps(texts.to_pylist()):
                stats, (d, pair, times) = aligned(both, texts.slice(lo, hi - lo).to_pylist())
                new = {"doc_ids": ids[lo:hi], **stats, "pair": [pair], "times": [times], "lengths": [np.bincount(d, minlength=hi - lo)]}
                for name, value in new.items():
                    held.setdefault(name, []).extend(value if name in ("doc_ids", "digest", "pair", "times", "lengths") else [value])
                tokens += int(stats["n_a"].sum() + stats["n_b"].sum())
                if tokens >= CHUNK:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(run, CHUNKS), "aligned-chunks", 1)


def answers(chunks: DataFrame, width: int) -> DataFrame:
    """(chunk, found): for each pair of a chunk its documents over the corpus, and whether no other pair of its A id has more."""
    asked = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "documents")).alias("x")).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("documents"))
    totals = asked.groupBy("pair").agg(F.sum("documents").alias("total"))
    totals = materialize(totals, "pair-counts")
    best = totals.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("total").alias("most"))
    held = asked.select("chunk", "pair").join(totals, "pair").join(F.broadcast(best), F.expr(f"pair div {width}") == F.col("a"))
    return held.groupBy("chunk").agg(F.collect_list(F.struct("pair", "total", (F.col("total") == F.col("most")).alias("best"))).alias("found"))


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    import sentencepiece

    chunks = chunked(docs, path_a, path_b)
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
    joined = chunks.drop("pairs", "documents").join(answers(chunks, width), "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                lengths = np.array(row["lengths"].values, np.int64)
                if row["found"].is_valid:
                    found = row["found"].values
                    pair, total, best = (found.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "total", "best"))
                    order = np.argsort(pair, kind="stable")
                    total, best = total[order], best[order]
                else:
                    total, best = np.zeros(0, np.int64), np.zeros(0, bool)
                at, times = (np.frombuffer(row[c].as_py(), "<u4").astype(np.int64) for c in ("at", "times"))
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * total[at])]
                ends = np.cumsum(lengths)
                n_best, count_sum = (s[ends] - s[ends - lengths] for s in sums)
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, *[row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(n_best), pa.array(count_sum), row["digests"].values], names=COLUMNS)

    return joined.mapInArrow(run, OUT)


__all__ = ["alignments", "coalesced", "links"]
