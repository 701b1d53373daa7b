"""License scan by diagonal voting.

Every document's rolling k-word hashes meet the templates' hashes in a Spark join. A hit lies on a diagonal (place in
the text minus place in the template); hits are counted per document, template and diagonal, and neighbouring
diagonals (words put in or left out) are merged. Spans with enough votes are verified on the words themselves: the longest
common run of words in order against the template's length. Base phrases are templates that must stand word for word,
so their spans are single diagonals with all votes, compared word by word.

The templates are given, so their table's size is known and it is broadcast; no text moves for the votes. Spans are
few; up to BROADCAST of them (counted) are broadcast to the texts they came from, more are joined by row.

Edge cases: null and empty texts have no words, labels are empty, the score is zero; rows with null or repeated
doc_ids are judged by their own text; repeated phrases count each time; a text of fewer words than k has no hits; an
empty table gives no rows; extra columns are ignored. Of overlapping spans with
different labels the one with the larger share counts, both if they are equal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_numbers

#: Words in a hash; the shortest template has as many.
K = 3
#: Share of a template's k-word hashes that a span needs to be looked at, and of its words to count.
VOTES, LEAST = 0.3, 0.8
#: Spans that may be broadcast, some 50 bytes each.
BROADCAST = 1_000_000
#: K-word hashes in an Arrow batch.
STEP = 1 << 18
ROW = "_license_row"

#: Phrases that must stand word for word (fixed values).
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Customary notices of common licenses (fixed values): label, text.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl-2", "this work is licensed under the GNU General Public License, version 2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

#: Lower-cases A-Z and turns every other ASCII character but letters and digits into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


class Template(NamedTuple):
    label: str
    words: list[bytes]
    exact: bool

    @property
    def slack(self) -> int:
        """How far a neighbouring diagonal may lie."""
        return 0 if self.exact else len(self.words) // 8

    @property
    def votes(self) -> int:
        grams = len(self.words) - K + 1
        return grams if self.exact else max(1, round(VOTES * grams))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def templates(phrases: dict[str, str], notices: Sequence[tuple[str, str]]) -> list[Template]:
    out = [Template(label, words_of(text), True) for label, text in phrases.items()]
    out += [Template(label, words_of(text), False) for label, text in notices]
    if short := [t.label for t in out if len(t.words) < K]:
        raise ValueError(f"templates of fewer than {K} words: {', '.join(short)}")
    return out


class Hasher:
    """Rolling hashes of K words; the hashes of words are kept, as they repeat."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        import xxhash

        if len(self.known) > 500_000:
            self.known.clear()
        return self.known.setdefault(word, xxhash.xxh64_intdigest(word) or 1)

    def grams(self, words: list[bytes]) -> np.ndarray:
        n = len(words) - K + 1
        if n < 1:
            return np.zeros(0, np.int64)
        get = self.known.get
        own = np.array([get(w) or self.word(w) for w in words], np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(K):
            out = (out ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def hashes(rows: DataFrame) -> DataFrame:
    """(row, place, hash) of every K-word run of rows (ROW, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            held, size = [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = hasher.grams(words_of(text.as_py()))
                for lo in range(0, len(own), STEP):
                    held.append((row, lo, own[lo : lo + STEP]))
                    size += len(held[-1][2])
                    if size >= STEP:
                        yield packed(held)
                        held, size = [], 0
            if held:
                yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        sizes = [len(x) for _, _, x in held]
        rows_ = np.repeat(np.array([r for r, _, _ in held], np.int64), sizes)
        places = np.concatenate([np.arange(lo, lo + len(x), dtype=np.int32) for _, lo, x in held])
        return pa.RecordBatch.from_arrays([pa.array(rows_), pa.array(places), pa.array(np.concatenate([x for _, _, x in held]))], names=["row", "place", "hash"])

    return rows.select(ROW, "text").mapInArrow(run, "row long, place int, hash long")


def spans(rows: DataFrame, found: list[Template]) -> DataFrame:
    """(row, template, low, high): merged diagonals with enough votes; the template's words lie from low to high + its length."""
    hasher = Hasher()
    grams = [(t, p, int(h), x.slack, x.votes) for t, x in enumerate(found) for p, h in enumerate(hasher.grams(x.words))]
    table = rows.sparkSession.createDataFrame(grams, "template int, at int, hash long, slack int, votes int")
    hits = hashes(rows).join(F.broadcast(table), "hash")
    lines = hits.groupBy("row", "template", "slack", "votes", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack"), F.lit(True))
    numbered = lines.withColumn("opens", apart.cast("int")).withColumn("island", F.sum("opens").over(order))
    merged = numbered.groupBy("row", "template", "slack", "votes", "island").agg(F.sum("n").alias("n"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    return merged.filter(F.col("n") >= F.col("votes")).select("row", "template", "low", "high")


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence of words."""
    line = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, line[j] = line[j], last + 1 if x == y else max(line[j], line[j - 1])
    return line[-1]


def verified(words: list[bytes], found: list[Template], asked: list[dict]) -> tuple[list[int], set[str], set[str], float]:
    """Places of base phrases, base labels, all labels, best share of a template's words."""
    places, base, seen = [], set(), []
    for span in asked:
        t = found[span["template"]]
        n = len(t.words)
        if t.exact:
            if words[span["low"] : span["low"] + n] == t.words:
                places.append(span["low"])
                base.add(t.label)
                seen.append((1.0, t.label, span["low"], span["low"] + n))
            continue
        # A wide span (a text that repeats its notice) is looked at in windows.
        windows = range(span["low"], span["high"] + 1, max(1, t.slack))
        share = max(common_words(t.words, words[max(0, at) : at + n + t.slack]) for at in windows) / n
        if share >= LEAST:
            seen.append((share, t.label, span["low"], span["high"] + n))
    seen.sort(key=lambda x: -x[0])
    kept = []
    for share, label, low, high in seen:
        if not any(s > share and lab != label and low < h and lo < high for s, lab, lo, h in kept):
            kept.append((share, label, low, high))
    return places, base, base | {label for _, label, _, _ in kept}, max((s for s, *_ in kept), default=0.0)


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest; labels are distinct,
    sorted and joined by commas; score is the largest share of a template's words that a verified span has, in order.
    """
    found = templates(phrases, notices)
    rows = row_numbers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ROW)
    near = materialize(spans(rows, found), "license-spans")
    per_row = near.groupBy("row").agg(F.collect_list(F.struct("template", "low", "high")).alias("asked")).withColumnRenamed("row", ROW)
    if near.count() <= BROADCAST:
        per_row = F.broadcast(per_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, asked in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                places, base, labels, score = verified(words, found, asked.as_py() or [])
                out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    joined = rows.join(per_row, ROW, "left").select("doc_id", "text", "asked")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


__all__ = ["NOTICES", "PHRASES", "license_scan"]
