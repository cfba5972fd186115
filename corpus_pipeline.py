"""A training-corpus pipeline over ``documents``: quality rules, near-dedup, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellspark.llm import decontaminate, hashstore, line_quality, order_minhash, pieces, queries
from shellspark.llm import textcore as tc


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits go from those that stay."""
    queries.prepare(spark)
    own = tc.free(docs.columns, "quality")[0]
    judged = line_quality.judge(docs, into=own)
    kept = judged.where(f"`{own}`.kept")
    cleaned, changed = F.col(f"{own}.cleaned"), F.col(f"{own}.n_removed_lines") > 0
    text = F.when(changed, cleaned).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length(cleaned).cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least doc_id."""
    queries.prepare(spark)
    return order_minhash.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item within its edit budget go."""
    queries.prepare(spark)
    own = tc.free(docs.columns, "hits")[0]
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=own)
    return found.where(F.size(own) == 0).select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with the end id, and whether decoding them gives the text back."""
    queries.prepare(spark)
    out = pieces.encode_decode(docs, queries.model_path(), id_cols=("doc_id", "lang", "source"))
    n_tokens, digest = F.size("ids").cast("long"), F.sha2("decoded", 256)
    return out.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "ids", digest.alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL cannot express the near-duplicate and encoding stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = hashstore.shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
