"""The corpus pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept; all but the last
return the columns of documents. Rows are judged one by one, also where they share a doc_id, but for near
duplicates: there the texts of one doc_id stay or go together.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace
from sayplace.llm.decontaminate import clean
from sayplace.llm.exact_dedup import exact_dedup
from sayplace.llm.near_dedup import near_dedup
from sayplace.llm.packing import pack
from sayplace.llm.queries import toxicity_model
from sayplace.llm.toxicity import below

#: Scores from here on are rejected as toxic.
TOXIC = 0.3

#: SQL can't express the classifier, the sketches and the tokenizer; each stage is tested against a brute-force version.
ORACLE_SQL = None


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among the ids; a null doc_id can be."""
    same = docs["doc_id"].eqNullSafe(ids["id"]) if ids.schema["id"].nullable else docs["doc_id"] == ids["id"]
    return docs.join(ids, same, "left_semi")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is TOXIC or more. One scan."""
    return below(docs, "text", toxicity_model(spark, sf_dir), TOXIC)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for the case of A-Z, keeps the one with the largest doc_id.

    Rows meet their verdict by doc_id and the digest of their text, so that of two texts under one doc_id
    one can stay and the other go.
    """
    kept = exact_dedup(docs, "doc_id", "text").filter("kept").select("id", F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase), 256)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]) & (sha == kept["_sha"]), "left_semi")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five words, keeps the one with the smallest doc_id."""
    return _only(docs, near_dedup(docs, "doc_id", "text", size=5, threshold=0.8).filter("kept").select("id"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs. One scan."""
    return clean(docs, "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    rows = pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return rows.withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("benchmark", benchmark), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written in the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
