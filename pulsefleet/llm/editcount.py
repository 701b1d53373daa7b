"""Operator 2: token counts that follow edits, kept in a segment tree per document.

A byte-level vocabulary merges inside pre-tokens only, so a text's count is the sum over its
pre-tokens. A document's tree has leaves of up to ``SEGMENT`` successive pre-tokens, each with its
characters and tokens, under a binary tree of sums. An edit finds its leaves by character sums,
splits the text anew from a little before the edit (a pre-token looks at most two characters past its
end), and stops as soon as a pre-token ends where an old leaf ended behind the edit: from there on
nothing can change. Only pre-tokens of that region are encoded again; the sums above the touched
leaves are updated on their way to the root.

Trees are rows: the leaves' characters and tokens and the inner sums travel as arrays next to the
text, so a later job can take them up. Documents are independent: no shuffle, any number of tasks.

Edge cases: null text counts as empty (no leaves, no tokens); null or empty lists of edits change
nothing; a null edit is skipped, its null fields count as 0 and as empty text; positions beyond the text mean its end, negative ones its
start; control strings of special tokens are ordinary text; repeated keys are documents of their
own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BEYOND, BYTE_PIECES, CachedBpe

SEGMENT = 64
#: Characters that a pre-token's end may depend on beyond it.
LOOK = 2
TREE = "doc_id {key}, text string, leaf_chars array<int>, leaf_tokens array<int>, sums array<long>"


@lru_cache(maxsize=1)
def worker_counter(path: str) -> Counter:
    """The worker process's own Counter, warm for later tasks."""
    return Counter(path)


class Counter:
    """Token counts of pre-tokens, cached; pre-tokens of a text from any of their starts on."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.bpe = CachedBpe(path, False)
        self.any = regex.compile(public_tokenizers.PATTERN)
        self.counts: dict[str, int] = {}

    def pattern(self, text: str):
        return self.any if BEYOND.search(text) else BYTE_PIECES

    def count(self, piece: str) -> int:
        got = self.counts.get(piece)
        if got is None:
            if len(self.counts) >= 400_000:
                self.counts.clear()
            mapped = piece.replace(" ", "Ġ") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bpe.table)
            got = self.counts[piece] = len(self.bpe.model.tokenize(mapped))
        return got

    def leaves(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Characters and tokens of groups of SEGMENT pre-tokens."""
        counts, lengths = list(map(self.count, pieces)), list(map(len, pieces))
        at = range(0, len(pieces), SEGMENT)
        return [sum(lengths[i : i + SEGMENT]) for i in at], [sum(counts[i : i + SEGMENT]) for i in at]


class Tree:
    """Leaves under heap-ordered sums of (characters, tokens); node 1 is the root."""

    def __init__(self, chars: list[int], tokens: list[int], sums: list[int] | None = None):
        self.n = len(chars)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        self.node = np.zeros((2, 2 * self.size), np.int64)
        self.node[0, self.size : self.size + self.n], self.node[1, self.size : self.size + self.n] = chars, tokens
        if sums is not None and len(sums) == 2 * self.size:
            self.node[:, : self.size] = np.array(sums, np.int64).reshape(2, self.size)
            return
        at = self.size
        while at > 1:
            self.node[:, at // 2 : at] = self.node[:, at : 2 * at].reshape(2, -1, 2).sum(2)
            at //= 2

    @property
    def total(self) -> int:
        return int(self.node[1, 1])

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position (the last leaf at the end) and its start."""
        i, start = 1, 0
        while i < self.size:
            left = int(self.node[0, 2 * i])
            if position < start + left or not self.node[0, 2 * i + 1]:
                i = 2 * i
            else:
                start, i = start + left, 2 * i + 1
        return i - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        change = np.array([chars, tokens]) - self.node[:, i]
        while i:
            self.node[:, i] += change
            i //= 2

    def lists(self) -> tuple[list[int], list[int], list[int]]:
        own = slice(self.size, self.size + self.n)
        return self.node[0, own].tolist(), self.node[1, own].tolist(), self.node[:, : self.size].ravel().tolist()


def edited(text: str, tree: Tree, counter: Counter, start: int, length: int, new: str) -> tuple[str, Tree, int]:
    """Text and tree after one edit, and how many characters were split and encoded again."""
    start = min(max(start, 0), len(text))
    stop = min(start + max(length, 0), len(text))
    after = text[:start] + new + text[stop:]
    if not tree.n:
        return after, Tree(*counter.leaves(counter.pattern(after).findall(after))), len(after)
    # One leaf further back if the edit lies within a leaf's first characters.
    first, begin = tree.leaf_at(max(0, start - LOOK - 1))
    chars = tree.node[0, tree.size : tree.size + tree.n]
    shift = len(after) - len(text)
    last, end = first, begin + int(chars[first])
    pieces, at = [], begin
    for m in counter.pattern(after).finditer(after, begin):
        pieces.append(m[0])
        at = m.end()
        while last + 1 < tree.n and (end < stop or end + shift < at):
            last += 1
            end += int(chars[last])
        if end >= stop and at == end + shift and at >= start + len(new):
            break
    else:
        last = tree.n - 1
    new_chars, new_tokens = counter.leaves(pieces)
    old = last - first + 1
    if len(new_chars) <= old:
        for i in range(old):
            tree.put(first + i, new_chars[i] if i < len(new_chars) else 0, new_tokens[i] if i < len(new_tokens) else 0)
    else:
        c, t, _ = tree.lists()
        tree = Tree(c[:first] + new_chars + c[last + 1 :], t[:first] + new_tokens + t[last + 1 :])
    return after, tree, at - begin


def token_trees(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, sums): every document with its tree."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            trees = [Tree(*counter.leaves(counter.pattern(t).findall(t))).lists() for t in texts]
            yield tree_batch(batch.column(0), texts, trees)

    return docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, TREE.format(key=kind))


def tree_batch(keys: pa.Array, texts: list[str], trees: list[tuple], *more: list[int]) -> pa.RecordBatch:
    leaf_chars, leaf_tokens, sums = zip(*trees, strict=True) if trees else ((), (), ())
    arrays = [keys, pa.array(texts, pa.string()), pa.array(leaf_chars, pa.list_(pa.int32())), pa.array(leaf_tokens, pa.list_(pa.int32())), pa.array(sums, pa.list_(pa.int64())), *(pa.array(m, pa.int64()) for m in more)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "leaf_chars", "leaf_tokens", "sums", "n_tokens_before", "n_tokens", "reencoded_chars"][: len(arrays)])


def apply_edits(trees: DataFrame, tokenizer: str, edits: str = "edits") -> DataFrame:
    """Rows of token_trees with ``edits`` (array of start, length, text; each over the text the last one left):
    the new rows, with n_tokens_before, n_tokens and reencoded_chars."""
    kind = dict(trees.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer)
        for batch in batches:
            texts, out, before, now, work = [], [], [], [], []
            for text, chars, tokens, sums, changes in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                tree = Tree(chars, tokens, sums)
                before.append(tree.total)
                done = 0
                for e in changes or []:
                    if e is not None:
                        text, tree, n = edited(text, tree, counter, e["start"] or 0, e["length"] or 0, e["text"] or "")
                        done += n
                texts.append(text)
                out.append(tree.lists())
                now.append(tree.total)
                work.append(done)
            yield tree_batch(batch.column(0), texts, out, before, now, work)

    rows = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "sums", F.col(edits).alias("edits"))
    return rows.mapInArrow(run, TREE.format(key=kind) + ", n_tokens_before long, n_tokens long, reencoded_chars long")
