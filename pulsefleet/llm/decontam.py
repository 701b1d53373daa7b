"""Operator 10: benchmark decontamination by spaced seeds, in DataFrame functions only.

A text is its runs of letters and digits, lower case. A document overlaps a test item if some
alignment of the two has a window of 13 words (the whole item, if it has fewer) with at most two
substituted words (one in items of 8 to 12 words, none in shorter ones). Candidates come from spaced seeds: fixed masks hash six of
eight successive words and ignore the others; every window of 13 words with two substitutions keeps
all six words of one of the two masks somewhere, so the masks lose no overlap. Items of 8 to 12 words also
have seeds of their first and last four words, of which one substitution leaves one; items of under eight
words have one seed of all their words. Documents are hashed for the lengths that the items call for. Each hit gives an
alignment, whose words are then compared around the hit.

Plan: document positions are exploded and hashed inside one generated stage and probe the hashes of
the test items there. These are broadcast only if counted to be at most ``broadcast_rows``; a larger
test set is joined by a shuffle on the hash, and the words are fetched afterwards.

Edge cases: null and empty texts and items overlap nothing; an item of few words is found wherever just these
words stand; documents and items without an id have a null id in the result; repeated rows and several
alignments count as their best one; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word offsets that the masks hash; found by trying all placements of two substitutions in 13 words.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
SPAN = 8
#: Words of the seeds at both ends of items that are too short for a whole window.
END = 4


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def run_hash(at: Column, length: int) -> Column:
    """Hash of ``length`` successive words; another for each length."""
    return F.xxhash64(*[F.get("words", at + i) for i in range(length)], F.lit(len(MASKS) + length))


def mask_hashes(at: Column) -> list[Column]:
    return [F.xxhash64(*[F.get("words", at + i) for i in mask], F.lit(n)) for n, mask in enumerate(MASKS)]


def seeds(rows: DataFrame, lengths: Sequence[int], *keep: str) -> DataFrame:
    """(keep..., words, at, h): one row for each mask and each run of ``lengths`` words at each position of ``words``."""
    # No filter on the words' number: pushed below, it would split every text twice.
    least = min([SPAN, *lengths])
    starts = F.when(F.size("words") >= least, F.sequence(F.lit(0), F.size("words") - least))
    at = rows.select(*keep, "words", F.explode(starts).alias("at"))
    place, left = F.col("at"), F.size("words") - F.col("at")
    if not lengths:
        return at.select(*keep, "words", "at", F.explode(F.array(*mask_hashes(place))).alias("h"))
    hashes = [F.when(left >= SPAN, h) for h in mask_hashes(place)] + [F.when(left >= n, run_hash(place, n)) for n in lengths]
    return at.select(*keep, "words", "at", F.explode(F.array(*hashes)).alias("h")).filter("h is not null")


def item_seeds(tests: DataFrame, window: int) -> DataFrame:
    """(item_id, words, at, h) of the items, by their length."""
    long = seeds(tests.filter(F.size("words") >= SPAN), (), "item_id")
    middle = tests.filter((F.size("words") >= SPAN) & (F.size("words") < window)).withColumn("at", F.explode(F.array(F.lit(0), F.size("words") - END)))
    middle = middle.select("item_id", "words", "at", run_hash(F.col("at"), END).alias("h"))
    short = tests.filter((F.size("words") > 0) & (F.size("words") < SPAN)).withColumn("at", F.lit(0))
    of_length = F.coalesce(*[F.when(F.size("words") == n, run_hash(F.col("at"), n)) for n in range(1, SPAN)])
    return long.unionByName(middle).unionByName(short.select("item_id", "words", "at", of_length.alias("h")))


def contaminated(docs: DataFrame, items: DataFrame, window: int = 13, substitutions: int = 2, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, item_id, matched_words, window_words, first_word) of every overlap.

    matched_words: equal words of the best alignment; window_words: of its best window; first_word:
    the first document word (from 0) of the earliest window that counts, over all alignments.
    """
    tests = items.select(F.col(item_key).cast("long").alias("item_id"), words_of(item_text).alias("words"))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), words_of(text).alias("words"))
    # The lengths, seven at most, that items too short for a mask or for a window call for.
    size = F.size("words")
    wanted = tests.select(F.when(size < SPAN, size).when(size < window, END).alias("n")).filter("n > 0").distinct().collect()
    lengths = sorted(r["n"] for r in wanted)
    asked = item_seeds(tests, window).select("h", "item_id", F.col("at").alias("item_at"), F.size("words").alias("item_words")).distinct()
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(shift, F.lit(0))
    piece = F.slice("words", first + 1, F.least(F.size("words"), shift + F.col("item_words")) - first)
    found = seeds(texts, lengths, "doc_id")
    if asked.count() <= broadcast_rows:
        near = found.join(F.broadcast(asked), "h").select("doc_id", "item_id", shift.alias("shift"), piece.alias("piece")).distinct()
    else:
        hits = found.drop("words").join(asked, "h").select("doc_id", "item_id", shift.alias("shift"), "item_words").distinct()
        shift = F.col("shift")
        first = F.greatest(shift, F.lit(0))
        piece = F.slice("words", first + 1, F.least(F.size("words"), shift + F.col("item_words")) - first)
        near = hits.join(texts.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own"))).filter(F.size("words") > first).select("doc_id", "item_id", "shift", piece.alias("piece")).distinct()
    # Words of the item from where the alignment begins; equal or not, word by word.
    lined = near.join(tests.select(F.col("item_id").alias("own"), F.col("words").alias("item")), F.col("item_id").eqNullSafe(F.col("own")))
    begin = F.greatest(-F.col("shift"), F.lit(0))
    same = F.zip_with("piece", F.slice("item", begin + 1, F.size("piece")), lambda a, b: F.when(a == b, 1).otherwise(0))
    width = F.least(F.size("item"), F.lit(window))
    least = F.when(F.size("item") < SPAN, F.size("item")).when(F.size("item") < window, F.size("item") - min(substitutions, 1)).otherwise(window - substitutions)
    add = lambda s, x: s + x
    sums = F.when(F.size("same") >= F.col("width"), F.transform(F.sequence(F.lit(1), F.size("same") - F.col("width") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("width")), F.lit(0), add)))
    scored = lined.select("doc_id", "item_id", F.greatest("shift", F.lit(0)).alias("start"), same.alias("same"), width.alias("width"), least.alias("least")).withColumn("sums", sums)
    good = scored.filter(F.array_max("sums") >= F.col("least"))
    first_word = F.col("start") + F.array_position(F.transform("sums", lambda s: s >= F.col("least")), True) - 1
    return good.groupBy("doc_id", "item_id").agg(
        F.max(F.aggregate("same", F.lit(0), add)).cast("long").alias("matched_words"),
        F.max(F.array_max("sums")).cast("long").alias("window_words"),
        F.min(first_word).cast("long").alias("first_word"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents that overlap no test item, with their own columns."""
    bad = contaminated(docs, items, key=key, text=text, **options).select(F.col("doc_id").alias(key)).distinct()
    return docs.alias("d").join(bad.alias("b"), F.col(f"d.{key}").eqNullSafe(F.col(f"b.{key}")), "left_anti")
