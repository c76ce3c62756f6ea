"""A corpus pipeline: language identification, exact and near deduplication, removal of repeated passages, packing.

Each stage is written as Parquet and read again before the next, so that a lost executor never costs more than a stage.
Documents are known by an integer doc_id and a text; all other columns pass through, whatever their names. A null text
counts as empty: language identification rejects it. An empty table gives empty stages. Repeated rows count as copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmesa.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from gridmesa.llm.common import written_alone


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no learned language with a probability of a half, go."""
    return language_id.reject_unidentified(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, the document with the smallest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by sharing 0.8 of their five-word shingles, the one with the smallest id stays."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that occur elsewhere go; of a character cut in half, the rest goes too. A null text becomes an empty one; n_chars, where there is such a column, follows the text."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    cut = substring_dedup.remove_repeats(row, ["row"])
    whole = F.call_function("try_validate_utf8", F.col("kept").cast("string"))
    cut = cut.withColumn("kept_text", F.coalesce(whole, F.regexp_replace(F.call_function("make_valid_utf8", F.col("kept").cast("string")), "\ufffd", "")))
    changed = F.col("row").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return cut.select(changed.alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the texts in pieces of at most 4096, with their length bucket, batch and slot. Texts without tokens have no piece."""
    return packing.pack_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language identification", identify_language),
    ("exact deduplication", drop_exact_copies),
    ("SimHash near-deduplication", drop_near_copies),
    ("repeated substring removal", cut_repeated_passages),
    ("packing", pack),
]

#: Naive Bayes, SimHash and the dynamic program have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # Tables that a stage needed on its way are deleted once its result is written.
        docs = written_alone(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023
    return docs
