"""Packing by optimal length buckets.

Lengths are numbers of a tokenizer's tokens. Their histogram is global and has at most max_len bins. Dynamic programming over it picks the
bucket boundaries that minimise the padding when every piece is padded to its bucket's boundary; then each bucket is cut
into batches of as many rows as the token budget holds.

Pieces are numbered within a bucket without sorting it in one task: rows get a chunk by a hash, each chunk numbers its
own rows, and a running sum over the chunks' counts gives each chunk its first number. Rows without a key are told apart by a
hash of their texts, so they spread too.

Defined results: null and empty texts, and others without tokens, have no piece, so no row. A text longer than
max_len is cut into pieces of max_len tokens and a rest; nothing is dropped. Repeated rows are packed each. An empty table
gives an empty result. Only the named columns are returned, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from gridmesa.llm.common import arrow_texts, small_batches, with_columns, written
from gridmesa.llm.token_counts import tokenizer_counter, tokenizer_encoder

MAX_LEN, BUCKETS, BUDGET = 4096, 16, 65_536
ROWS_PER_CHUNK = 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` of the distinct, rising lengths, the last among them, such that padding each piece up to the next boundary costs least; ties go to the earlier cut."""
    n = len(lengths)
    if n == 0:
        return []
    below = np.concatenate([[0], np.cumsum(counts)])
    # The total after padding lengths[i:j+1] to lengths[j] is lengths[j] * (below[j+1] - below[i]); the unpadded total is a constant.
    best = lengths * below[1:]
    cuts = []
    for _ in range(1, min(buckets, n)):
        now, cut = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (below[j + 1] - below[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], cut[j] = cost[i], i + 1
        cuts.append(cut)
        best = now
    at, chosen = n - 1, []
    for cut in reversed(cuts):
        chosen.append(int(lengths[at]))
        at = cut[at] - 1
        if at < 0:
            break
    else:
        chosen.append(int(lengths[at]))
    return sorted(chosen)


def sized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, salt, n): the number of the tokenizer's tokens in each text. The salt, a hash of the text, tells rows without a key apart."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("salt", LongType()), StructField("n", LongType())])

    def run(batches):
        count = tokenizer_counter(tokenizer)
        for part, texts in arrow_texts(batches):
            yield with_columns(part, ["key", "salt"], n=pa.array(count(texts), pa.int64()))

    return rows.withColumn("salt", F.xxhash64("text")).mapInArrow(run, schema)


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """(key, salt, piece, start, n, ids): the tokens of each text as ids, in consecutive pieces of at most max_len."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("salt", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("n", LongType()), StructField("ids", ArrayType(IntegerType()))])

    def run(batches):
        encode = tokenizer_encoder(tokenizer)
        for part, texts in arrow_texts(batches):
            found = encode(texts)
            owner = [i for i, ids in enumerate(found) for _ in range(0, len(ids), max_len)]
            starts = [at for ids in found for at in range(0, len(ids), max_len)]
            parts = [found[i][at : at + max_len] for i, at in zip(owner, starts, strict=True)]
            taken = part.take(pa.array(owner, pa.int64()))
            yield with_columns(taken, ["key", "salt"], piece=pa.array([at // max_len for at in starts], pa.int32()), start=pa.array(starts, pa.int64()), n=pa.array([len(x) for x in parts], pa.int64()), ids=pa.array(parts, pa.list_(pa.int32())))

    return rows.withColumn("salt", F.xxhash64("text")).mapInArrow(run, schema)


def pieces(lengths: DataFrame, max_len: int) -> DataFrame:
    """(key, salt, piece, start, n) of lengths (key, salt, n): consecutive pieces of at most max_len tokens."""
    last = F.floor((F.col("n") - 1) / max_len)
    cut = lengths.where("n > 0").select("key", "salt", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut.select("key", "salt", F.col("piece").cast("int").alias("piece"), (F.col("piece") * max_len).alias("start"), F.least(F.lit(max_len).cast("long"), F.col("total") - F.col("piece") * max_len).alias("n"))


def place(cut: DataFrame, buckets: int, budget: int, rows_per_chunk: int, max_len: int) -> DataFrame:
    """Pieces (key, salt, piece, start, n, and more) with bucket (the boundary a piece is padded to), batch (numbered from 0 in each bucket), slot (row of the batch) and padding, without the salt."""
    if budget < max_len:
        raise ValueError("a batch must hold at least one piece of max_len tokens")
    histogram = cut.groupBy("n").agg(F.count("*").alias("rows")).orderBy("n").toPandas()
    boundaries = optimal_boundaries(histogram.n.to_numpy(np.int64), histogram.rows.to_numpy(np.int64), buckets)
    bucket = F.element_at(F.filter(F.array(*[F.lit(b).cast("long") for b in boundaries or [max_len]]), lambda b: b >= F.col("n")), 1)
    chunks = max(1, -(-int(histogram.rows.sum()) // rows_per_chunk))
    placed = cut.withColumns({"bucket": bucket, "_chunk": F.pmod(F.xxhash64("key", "salt", "piece"), F.lit(chunks)).cast("int")})
    numbered = placed.withColumn("_place", F.row_number().over(Window.partitionBy("bucket", "_chunk").orderBy("key", "piece", "salt")) - 1)
    before = Window.partitionBy("bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("bucket", "_chunk").agg(F.count("*").alias("_rows")).withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    per_batch = F.floor(F.lit(budget) / F.col("bucket"))
    row = F.col("_first") + F.col("_place")
    kept = [c for c in cut.columns if c != "salt"]
    # The firsts are few: one row for each chunk and bucket.
    return numbered.join(firsts, ["bucket", "_chunk"]).select(*kept, "bucket", F.floor(row / per_batch).alias("batch"), (row % per_batch).alias("slot"), (F.col("bucket") - F.col("n")).alias("padding"))


def pack(lengths: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The placement of lengths (key, salt, n): key, piece, start, n, bucket, batch, slot, padding."""
    return place(written(pieces(lengths, max_len), "pieces"), buckets, budget, rows_per_chunk, max_len)


def pack_texts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The placement of the texts' tokens, with the token ids of each piece."""
    placed = place(written(token_pieces(docs, tokenizer, key, text, max_len), "token-pieces"), buckets, budget, rows_per_chunk, max_len)
    return placed.withColumnRenamed("key", key)
