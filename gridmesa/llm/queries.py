"""The corpus queries opN_<name>, each over its whole table, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmesa.llm import ann, byte_bpe, exact_dedup, language_id, packing, quality, simhash, substring_dedup, token_counts, toxicity
from gridmesa.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that have labels and are not held out."""
    return docs.select("doc_id", "text").join(labels, "doc_id").where(fold(5) != 0)


def _scored(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(_labelled(docs, _table(spark, sf_dir, "labels")))
    return _scored(toxicity.score(docs, model), 0.5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(_labelled(docs, _table(spark, sf_dir, "labels")))
    return _scored(quality.score(docs, model), 0.3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = packing.sized(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return packing.pack(lengths).withColumnRenamed("key", "doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold(4) != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_bytes(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), ["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op3_quality": op3_quality,
    "op2_packing": op2_packing,
    "op4_language_id": op4_language_id,
    "op5_ann": op5_ann,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLES = {
    "op9_exact_dedup": r"""
        WITH hashed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        joined AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256 FROM hashed)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM joined""",
}
