"""Exact deduplication in two Bloom passes, on DataFrame functions alone.

Pass one hashes every text and counts, with partial aggregation, how often each slot of a hash table is hit; slots hit
twice or more become a bit map of fixed size. Pass two tests each row against that map: a row that misses any of its
slots is certainly unique and passes straight through; only the others shuffle, and are then compared by SHA-256.
False positives cost a shuffled row, never a wrong result. Once a corpus has more texts than the map has bits for, more
rows shuffle and the result is the same.

Defined results: null text counts as empty. Equal texts are those identical after each run of white space
(space, tab to carriage return) is replaced by one space. Of equal texts the row with the smallest order key stays; a
null key is larger than any other. Repeated rows with the same key count each in group_size, and all rows holding the
smallest key are `kept` unless keep_one() is used, which keeps one of them. Empty tables give empty results.
membership() returns the key and its results only; keep_one() returns all columns unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmesa.llm.common import text_or_empty, written

#: The bit map never has more than 2**MAX_BITS bits (16 MB), nor fewer than 2**MIN_BITS.
MIN_BITS, MAX_BITS = 16, 27
BITS_PER_ROW = 32
PROBES = 2


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text's UTF-8 bytes, lowercase hex."""
    return F.sha2(normalised(text), 256)


def _slots(hashed: Column, bits: int) -> list[Column]:
    """PROBES independent slots of a hex digest: disjoint stretches of it."""
    return [F.conv(F.substring(hashed, 1 + 12 * i, 12), 16, 10).cast("long") % (1 << bits) for i in range(PROBES)]


def _bits_for(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, (max(rows, 1) * BITS_PER_ROW).bit_length()))


def repeated_slots(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """One row: an array of 2**bits / 64 words, in which the slots hit at least twice are 1. At most 16 MB, written to the shared folder."""
    hit = hashes.select(F.explode(F.array(*_slots(F.col(column), bits))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    words = hit.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    blocks = words.groupBy(F.floor(F.col("word") / 512).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("own"))
    zero = F.lit(0).cast("long")
    dense = F.transform(F.sequence(F.col("block") * 512, F.col("block") * 512 + 511), lambda w: F.coalesce(F.element_at("own", w), zero))
    gathered = blocks.select("block", dense.alias("dense")).agg(F.map_from_entries(F.collect_list(F.struct("block", "dense"))).alias("blocks"))
    every = F.sequence(zero, F.lit((1 << bits) // 64 // 512 - 1).cast("long"))
    return written(gathered.select(F.flatten(F.transform(every, lambda b: F.coalesce(F.element_at("blocks", b), F.array_repeat(zero, 512)))).alias("words")), "repeated-slots")


def _possibly_repeated(words: DataFrame, hashed: Column, bits: int) -> Column:
    """Whether all slots of the digest are set; the bit map enters the plan as a scalar subquery's literal."""
    table = words.scalar()
    hit = lambda slot: F.call_function("shiftrightunsigned", F.get(table, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    first, *rest = [hit(slot) for slot in _slots(hashed, bits)]
    for one in rest:
        first = first & one
    return first


def membership(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the key, keep_id, group_size, kept and text_sha256. The texts are read once; only digests move."""
    hashes = written(docs.select(F.col(key), digest(text).alias("text_sha256")), "digests")
    bits = _bits_for(hashes.count())
    maybe = _possibly_repeated(repeated_slots(hashes, "text_sha256", bits), F.col("text_sha256"), bits)
    flagged = hashes.withColumn("_maybe", maybe)
    alone = flagged.where(~F.col("_maybe")).withColumns({"keep_id": F.col(key), "group_size": F.lit(1).cast("long")})
    shared = flagged.where("_maybe")
    # Written, so that the join deals both sides itself and can split a hot group's partition.
    groups = written(shared.groupBy("text_sha256").agg(F.min(key).alias("keep_id"), F.count("*").alias("group_size")), "groups")
    out = alone.unionByName(shared.join(groups, "text_sha256"))
    return out.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one per group of equal texts, with docs' columns, whatever their names. A group's copies are cut to one per task before the shuffle."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("key"), digest(text).alias("sha256"))
    hashes = written(rows.select("sha256"), "digests")
    bits = _bits_for(hashes.count())
    maybe = _possibly_repeated(repeated_slots(hashes, "sha256", bits), F.col("sha256"), bits)
    first = Window.partitionBy("sha256").orderBy(F.col("key").asc_nulls_last())
    shared = rows.where(maybe).withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.where(~maybe).select("row.*").unionByName(shared.select("row.*"))
