"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, lexical, license_scan, line_dedup, lm_scoring, mixing, nearest, packing, prefix_trie, sharding, simhash, topk, toxicity
from tessera.llm.common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(read_table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))[0]


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(read_table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_nearest, op3_packing, op4_topk, op5_simhash, op6_lm_scoring, op7_chat_format, op8_mixing, op9_toxicity, op10_sharding, op11_license_scan, op12_lexical, op13_prefix_trie)}

_USABLE = """vec_id is not null and embedding is not null and list_count(embedding) = len(embedding) and
  coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_nearest": f"""
with v as (select vec_id, embedding::double[] as e from embeddings where {_USABLE} and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs as (
  select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) as score
  from v q, v c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs) where rank <= 10
""",
    "op7_chat_format": chat.ORACLE,
    "op12_lexical": lexical.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
    "op4_topk": f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings where {_USABLE}),
pairs as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 20
""",
}
