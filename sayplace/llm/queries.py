"""The queries opN_<name>: each gets its rows through its operator and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sayplace.llm.chat_format import digests, format_turns
from sayplace.llm.decontaminate import scan
from sayplace.llm.exact_dedup import exact_dedup
from sayplace.llm.html_extract import extract_text
from sayplace.llm.near_dedup import near_dedup
from sayplace.llm.packing import pack
from sayplace.llm.sharding import shard
from sayplace.llm.token_count import token_counts
from sayplace.llm.toxicity import Model, fit, scores
from sayplace.llm.url_filter import judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(_table(spark, sf_dir, "documents"), "doc_id", "text", 40)
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), "doc_id", "text", size=4, threshold=0.8).withColumnRenamed("id", "doc_id")


#: The rules the query is asked to apply.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Sites of these pages register names below them.
SUFFIXES = ["com", "net", "org", "example.com", "example.net", "example.org"]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("bad"))
    return judge(_table(spark, sf_dir, "pages"), "page_id", "url", outcomes, RULES, SUFFIXES).withColumnRenamed("id", "page_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, t, r, "\\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))]
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    return digests(format_turns(turns, "conv_id", "turn", "role", "text", in_order=True)).withColumnRenamed("conversation", "conv_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_text(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def toxicity_model(spark: SparkSession, sf_dir: str) -> Model:
    labels = _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fit(docs.join(labels, "doc_id"), "doc_id", "text", "toxic")


def op7_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(_table(spark, sf_dir, "documents"), "doc_id", "text", toxicity_model(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return rows.withColumnRenamed("id", "doc_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_rendezvous_sharding": op1_rendezvous_sharding,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_chat_format": op4_chat_format,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_counts": op6_token_counts,
    "op7_nb_toxicity": op7_nb_toxicity,
    "op8_window_packing": op8_window_packing,
    "op9_decontamination": op9_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
}
