"""A training corpus from ``documents`` in four stages.

1. quality: a classifier learns from ``labels``; documents it scores under 0.3 go.
2. near_duplicates: of each group of copies and near copies (five-word Jaccard similarity from 0.8) the smallest doc_id stays.
3. decontamination: documents that overlap a ``benchmark`` item go.
4. packing: what is left is packed into sequences of 4096 tokens; one row per piece.

Every stage works on all rows the one before kept, and all but the last return the columns they got.
Decisions are made for rows, not for doc_ids: the first three stages number their rows.

Edge cases: rows without a doc_id and rows that repeat one are judged by their own text; null and empty texts are
copies of each other, so one of them stays, if the classifier keeps it; of equal rows the first stays, of
a group the smallest doc_id (rows with one before rows without); extra columns stay as they are; empty tables give no
rows; without labels of both kinds nothing is rejected or everything, as the share of label 1 says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefleet.llm.common import discard, materialize, row_numbers, table
from pulsefleet.llm.decontam import decontaminate
from pulsefleet.llm.nearcopy import near_copies
from pulsefleet.llm.packing import pack_documents
from pulsefleet.llm.quality import quality_scores

#: A classifier is fitted: SQL can't express the pipeline's rows; tests compare its stages with brute force.
ORACLE_SQL = None
#: Name of the rows' numbers while a stage runs.
ROW = "_pipeline_row"
#: Words that a worker process remembers while it packs: half of operator 8's, for here executors hold other stages' memory too.
CACHE_ROWS = 400_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = row_numbers(docs, ROW)
    bad = quality_scores(rows, table(spark, sf_dir, "labels"), carry=[ROW]).filter("predicted = 0").select(ROW)
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = row_numbers(docs, ROW)
    groups = near_copies(rows, shingle=5, similarity=0.8, key=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    # Members of groups of two or more; the others are their own component and no one else's.
    members = materialize(groups.join(groups.filter(F.col(ROW) != F.col("component_id")).select("component_id").distinct(), "component_id", "left_semi"), "copies")
    named = rows.select(ROW, "doc_id").join(members, ROW)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col(ROW))
    kept = named.groupBy("component_id").agg(F.min_by(ROW, first).alias(ROW)).select(ROW)
    copies = members.select(ROW).join(kept, ROW, "left_anti")
    return rows.join(copies, ROW, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(row_numbers(docs, ROW), table(spark, sf_dir, "benchmark"), key=ROW).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, cache_rows=CACHE_ROWS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if n:
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
