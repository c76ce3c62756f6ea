"""Token counts through a digest cache.

The cache is a Parquet table keyed by the digest of the tokenizer's file and the digest of the content. Texts whose digest
is cached are counted by the join alone; of the others one text per digest is encoded and the counts are appended.

Texts do not shuffle wholesale: digests with several missing rows become a bit map of fixed size (as in exact
deduplication), rows outside it are encoded where they lie, and only possible repeats are brought together, after each
task has cut a digest's copies to one.

Defined results: null counts as the empty text, which has 0 tokens. The count is the library's for the whole text,
without begin, end or special tokens, truncation or padding; special strings are ordinary text where that is the
library's default. Repeated rows get equal counts and are encoded once. An empty table gives an empty result. Other
columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridmesa.llm.common import arrow_texts, shared_root, text_or_empty, with_columns, written
from gridmesa.llm.exact_dedup import _bits_for, _possibly_repeated, repeated_slots

CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"


@lru_cache(4)
def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(2)
def tokenizer_encoder(path: str):
    """A function from texts to lists of ids: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: library.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def tokenizer_counter(path: str):
    """A function from texts to token counts."""
    encode = tokenizer_encoder(path)
    return lambda texts: [len(ids) for ids in encode(texts)]


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of texts (content, text)."""

    def run(batches):
        count = tokenizer_counter(path)
        for part, values in arrow_texts(batches):
            yield with_columns(part, ["content"], n_tokens=pa.array(count(values), pa.int64()))

    return texts.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """The columns `keep` with n_bytes, n_tokens and over_limit. `cache` is a path in shared storage; the default is a new, empty one."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache = cache or f"{shared_root(spark)}/token-counts-{uuid.uuid4().hex}"
    columns = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*columns, text_or_empty(text).alias("_text"))
    content = F.sha2("_text", 256)
    digests = written(rows.select(*columns, content.alias("_content"), F.octet_length("_text").cast("long").alias("n_bytes")), "content-digests")
    own = read_cache(spark, cache).where(F.col("tokenizer") == version)
    missing = digests.select("_content").join(own.select(F.col("content").alias("_content")), "_content", "left_anti") if not own.isEmpty() else digests.select("_content")
    bits = _bits_for(digests.count())
    repeats = repeated_slots(missing, "_content", bits)
    todo = rows.select(F.col("_text").alias("text"), content.alias("content"))
    if not own.isEmpty():
        todo = todo.join(own.select("content"), "content", "left_anti")
    maybe = _possibly_repeated(repeats, F.col("content"), bits)
    flagged = todo.withColumn("_maybe", maybe)
    place = F.row_number().over(Window.partitionBy("content").orderBy("content"))
    once = flagged.where("_maybe").withColumn("_place", place).where("_place = 1")
    for misses in (flagged.where("not _maybe"), once):
        encode_counts(misses, tokenizer).select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    # Written, so that the join deals both sides itself and can split a hot text's partition.
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy(F.col("content").alias("_content")).agg(F.max("n_tokens").alias("n_tokens"))
    return digests.join(written(counts, "counts"), "_content").select(*columns, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
