"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import alignments
from .chat import chat_digest, chat_windows
from .common import shared_path, table
from .contextmix import lm_scores
from .decontam import contaminated
from .editcount import apply_edits, token_trees
from .htmltext import extract
from .licenses import license_scan
from .packing import pack_documents
from .quality import quality_scores
from .simhash import simhash_components
from .tokenfile import token_file_digest, write_token_files
from .topk import top_inner_products
from .whitening import whitened


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), mod=10)


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under three edits derived from it: an insertion, a deletion and a replacement."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    trees = token_trees(table(spark, sf_dir, "documents"), path)
    at = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(n)), F.length("text") + 1).cast("int").alias("start")
    edits = F.array(
        F.struct(at(1), F.lit(0).alias("length"), F.concat(F.lit(" revised, see 2024-"), F.col("doc_id").cast("string")).alias("text")),
        F.struct(at(2), F.lit(12).alias("length"), F.lit("").alias("text")),
        F.struct(at(3), F.lit(30).alias("length"), F.substring("text", 1, 30).alias("text")),
    )
    done = apply_edits(trees.withColumn("edits", edits), path)
    return done.select("doc_id", "n_tokens_before", "n_tokens", F.length("text").cast("long").alias("n_chars"), F.size("leaf_chars").cast("long").alias("n_leaves"), "reencoded_chars")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=4, budget=4)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_inner_products(rows.filter("vec_id % 20 = 0"), rows, k=20, scale=64.0)


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat_digest(chat_windows(rows.unionByName(more), budget=2048, history=512))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, folder)
    return token_file_digest(manifest, folder)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), scale=64.0, shift=1_000_000, top=32)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_edit_counts": op2_edit_counts,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_chat_windows": op5_chat_windows,
    "op6_main_text": op6_main_text,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_files": op9_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_license_scan": op11_license_scan,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_alignment": op13_token_alignment,
}

ORACLES: dict[str, str] = {
    "op4_exact_topk": """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from usable q, usable c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
) where rank <= 20""",
    "op10_decontamination": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
dp as (select doc_id, w, unnest(range(1, len(w) - 6)) as p from d where len(w) >= 8),
ip as (select item_id, unnest(range(1, len(w) - 6)) as p, w from i where len(w) >= 8),
ds as (
  select doc_id, p, 0 as m, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] || ' ' || w[p+6] || ' ' || w[p+7] as k from dp
  union all select doc_id, p, 1, w[p] || ' ' || w[p+1] || ' ' || w[p+3] || ' ' || w[p+5] || ' ' || w[p+6] || ' ' || w[p+7] from dp),
iss as (
  select item_id, p, 0 as m, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] || ' ' || w[p+6] || ' ' || w[p+7] as k from ip
  union all select item_id, p, 1, w[p] || ' ' || w[p+1] || ' ' || w[p+3] || ' ' || w[p+5] || ' ' || w[p+6] || ' ' || w[p+7] from ip),
need as (select distinct case when len(w) < 8 then len(w) else 4 end as n from i where len(w) between 1 and 12),
dr as (select doc_id, p, 10 + n as m, array_to_string(w[p : p + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, need where len(w) >= n)),
ir as (
  select item_id, 1 as p, 10 + len(w) as m, array_to_string(w, ' ') as k from i where len(w) between 1 and 7
  union all select item_id, p, 14, array_to_string(w[p : p + 3], ' ') from (select item_id, w, unnest([1, len(w) - 3]) as p from i where len(w) between 8 and 12)),
near as (
  select distinct doc_id, item_id, ds.p - iss.p as shift from ds join iss using (m, k)
  union select doc_id, item_id, dr.p - ir.p from dr join ir using (m, k)),
same as (
  select doc_id, item_id, greatest(shift, 0) as start, least(len(i.w), 13) as width,
    case when len(i.w) < 8 then len(i.w) when len(i.w) < 13 then len(i.w) - 1 else 11 end as least_,
    [case when d.w[j + shift] = i.w[j] then 1 else 0 end for j in range(greatest(1, 1 - shift), least(len(i.w), len(d.w) - shift) + 1)] as eq
  from near join d using (doc_id) join i using (item_id)),
sums as (
  select *, [list_sum(eq[j : j + width - 1]) for j in range(1, greatest(len(eq) - width + 2, 1))] as s from same)
select doc_id, item_id, max(list_sum(eq))::bigint as matched_words, max(list_max(s))::bigint as window_words,
  min(start + list_position([x >= least_ for x in s], true) - 1)::bigint as first_word
from sums where list_max(s) >= least_ group by doc_id, item_id""",
    "op5_chat_windows": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p as (
  select *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ':', '\:')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')) + 9 as size from t),
e as (
  select *, (size + 3) // 4 as tokens, sum((size + 3) // 4) over o as stop, row_number() over o as nth, first(role) over o as role1, first(size) over o as size1,
    greatest(1536 - case when first(role) over o = 'system' then (first(size) over o + 3) // 4 else 0 end, 1) as stride
  from p window o as (partition by conv_id order by turn, role, text)),
c as (select *, stop - tokens as start, (stop - tokens) // stride as a, (stop - 1) // stride as b from e),
w as (select *, coalesce(lag(a) over o <> a or lag(b) over o <> b, true) as opens from c window o as (partition by conv_id order by nth)),
r as (
  select *, case when role1 = 'system' and nth = 1 then 0 else
    coalesce(sum(opens::int) over (partition by conv_id order by start range between 1 following and 512 following), 0) end as repeats,
    case when role1 = 'system' and opens and nth > 1 then size1 else 0 end as system
  from w window o as (partition by conv_id order by nth))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by nth)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by nth) filter (role = 'assistant'), '')) as loss_sha256,
  sum(size * (1 + repeats) + system)::bigint as formatted_chars
from r group by conv_id""",
}
