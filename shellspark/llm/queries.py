"""Queries of the pipeline operators over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_MODEL = "piece_bpe_32k.model"
SHARDS, SHARD_SEED = 24, 20240607
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def prepare(spark: SparkSession) -> None:
    """Arrow batches stay small also where texts are long; in local mode workers find this package where the driver did."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kneser_ney as kn

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = kn.fit(docs.where(~F.col("held_out")))
    out = kn.score(docs, model, id_cols=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import order_minhash

    return order_minhash.classes(_table(spark, sf_dir, "documents"))


def op3_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    out = sharding.shuffle(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, SHARD_SEED)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", sharding.row_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    docs = _table(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return pieces.count(docs, model_path(), id_cols=("doc_id", "n_bytes")).withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_quality as lq

    out = lq.judge(_table(spark, sf_dir, "documents"), into="q", keep=["doc_id"])
    return out.select("doc_id", *(F.col(f"q.{m}").alias(m) for m in lq.MEASURES), "q.base_failed", "q.kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, item) pairs within the edit budget."""
    from . import decontaminate

    out = decontaminate.find(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return out.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    out = pieces.encode_decode(_table(spark, sf_dir, "documents"), model_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    out = warc.read(warc.write(_table(spark, sf_dir, "pages")), payload=False)
    return out.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("refers_to"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.rank(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    out = secrets.scan(_table(spark, sf_dir, "documents"), into="spans", keep=["doc_id"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.listed(F.filter("spans", lambda s: s.kind != "learned"))
    return out.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def queries() -> dict:
    own = (
        op1_kneser_ney, op2_order_minhash, op3_two_pass_shuffle, op4_token_counts, op5_line_quality,
        op6_license_scan, op7_decontaminate, op8_warc, op9_sentencepiece, op10_url_filter,
        op11_lexical_search, op12_collocations, op13_secret_scan,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {"op5_line_quality": sql.LINE_QUALITY, "op8_warc": sql.WARC, "op11_lexical_search": sql.LEXICAL_SEARCH, "op12_collocations": sql.COLLOCATIONS}
