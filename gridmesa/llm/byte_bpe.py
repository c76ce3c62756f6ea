"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

The pattern splits a text into words in the JVM. A word's bytes are an array of ids, and a fold merges, step by step, the
first of the pairs whose joint bytes rank lowest, until no pair has a rank. Ranks come from one literal: all pairs of the
vocabulary as an array of small maps, chosen by a hash of the pair (a single map literal would be searched entry by entry).

All words of the corpus are counted. Every distinct word among the most frequent is folded once, and enters the plan with its
ids' bytes and the bytes they decode to as a second literal of the same form, of a fixed size; so the main pass works by word, not by
id. The others, each rarer than all of these, are folded where they stand. Which words are in the literal changes the time,
never the result.

Long words are folded in windows, in time linear in their length. A stretch of an encoding is the encoding of its own bytes, and
two encodings that share a token may be joined at it, as every two neighbours then stand in one of them: whether bytes of
two neighbouring tokens would merge depends on these two alone. So each window starts at a token of the last one, and if it does not
begin with the same token, it is tried again twice as wide, until it reaches the word's end.

Defined results: null counts as the empty text: no ids, no bytes. Special strings are ordinary text. Texts are encoded
whole; repeated rows get equal results; an empty table gives an empty result. Columns not named are not returned, and names
of results replace columns of the input.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmesa.llm.common import text_or_empty, written

#: The literal of folded words holds at most so many, of at most MAX_WORD bytes each.
WORDS, MAX_WORD = 400_000, 32
#: Words of more bytes are folded in windows of twice as many, so many windows in a round.
LONG, STEPS = 64, 32
RANK_BUCKETS, PAIR_BUCKETS, WORD_BUCKETS = 1 << 16, 1 << 18, 1 << 18
#: Bits of an id or rank, and of a place in a word; all ones in the place of a rank stand for "no rank".
_ID_BITS, _PLACE_BITS = 20, 23
_NONE = (1 << _ID_BITS) - 1


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def java_pattern(pattern: str) -> str:
    """The pattern with Unicode's white space and categories."""
    return f"(?U){pattern}"


def _bucket(key: Column, buckets: int) -> Column:
    """buckets is a power of two."""
    return F.hash(key).bitwiseAND(F.lit(buckets - 1))


def _bucketed(rows: DataFrame, key: str, value: str, buckets: int) -> DataFrame:
    """One row with an array of `buckets` maps from key to value; a key is in the map that its hash chooses."""
    own = rows.groupBy(_bucket(F.col(key), buckets).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(own, "b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m")), lambda x, y: x["b"] - y["b"]), lambda x: x["m"]).alias("maps"))


def _lookup(maps: Column, key: Column, buckets: int) -> Column:
    """The value of key, or null. Arrays of the literal count from 0."""
    return F.try_element_at(F.get(maps, _bucket(key, buckets)), key)


def _literal(row: DataFrame) -> Column:
    """The one value of a one-row table as a literal in Catalyst's own binary form. (Subqueries may not stand in higher-order functions, and a literal spelled out would be an expression of 100,000 nodes.)"""
    jvm = row.sparkSession._jvm
    value = row._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, row._jdf.schema().apply(0).dataType())))


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once: lambdas have no common subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merges(ranks: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """(pair, rank) for every two pieces whose joint bytes are a piece; a pair is the left id times 2**20 plus the right id."""
    known = dict(ranks)
    return [((known[piece[:i]] << 20) | known[piece[i:]], rank) for piece, rank in ranks for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]


class Codec:
    """Literals for one vocabulary, each of a size that the vocabulary or WORDS and MAX_WORD bound. Bytes are kept as strings that need not be UTF-8, since only strings can be joined natively."""

    def __init__(self, spark: SparkSession, path: str):
        ranks = read_ranks(path)
        known = dict(ranks)
        if max(known.values(), default=0) >= _NONE:
            raise ValueError(f"ranks of {_NONE} and more are not supported")
        rows = lambda names, values: spark.createDataFrame(pa.table(dict(zip(names, map(pa.array, zip(*values, strict=True)), strict=True))))
        self.ranks = _literal(_bucketed(rows(("piece", "rank"), [(p.hex().upper(), r) for p, r in ranks]).withColumn("rank", F.col("rank").cast("int")), "piece", "rank", RANK_BUCKETS))
        pairs = merges(ranks) or [(-1, 0)]
        self.pairs = _literal(_bucketed(rows(("pair", "rank"), pairs), "pair", "rank", PAIR_BUCKETS))
        pieces: list[bytes | None] = [None] * (1 + max(known.values(), default=-1))
        for piece, rank in ranks:
            pieces[rank] = piece
        one = lambda value, kind, to: _literal(spark.createDataFrame([(value,)], f"v array<{kind}>").select(F.col("v").cast(f"array<{to}>").alias("v")))
        self.pieces = one([bytearray(p) if p is not None else None for p in pieces], "binary", "string")
        self.little = one([bytearray(r.to_bytes(4, "little")) for r in range(len(pieces))], "binary", "string")
        self.sizes = one([len(p or b"") for p in pieces], "int", "int")
        self.bytes = one([known.get(bytes([i])) for i in range(256)], "long", "long")
        self.byte_pairs = one([known.get(bytes([i, j]), _NONE) for i in range(256) for j in range(256)], "long", "long")
        self.words: Column | None = None

    def pair(self, left: Column, right: Column) -> Column:
        """The rank, which is also the id, of two pieces joined; _NONE if they do not join."""
        return F.coalesce(_lookup(self.pairs, F.shiftleft(left, 20).bitwiseOR(right), PAIR_BUCKETS), F.lit(_NONE).cast("long"))

    def merged(self, values: Column) -> Column:
        """Ids of some bytes (an array of their values), merged pair by pair in the order of rank.

        A part is one number: the rank of it and the next part joined, where it starts, and its id. So the least part is the next to merge.
        """
        n = F.size(values)
        id_ = lambda x: x.bitwiseAND(F.lit(_NONE).cast("long"))
        placed = lambda rank, rest: F.shiftleft(rank, _ID_BITS + _PLACE_BITS).bitwiseOR(rest)
        rank_of = lambda x: F.shiftright(x, _ID_BITS + _PLACE_BITS)
        low = F.lit((1 << (_ID_BITS + _PLACE_BITS)) - 1).cast("long")

        def merge(parts: Column, at: Column) -> Column:
            """The part at `at` takes in the next, which is marked -1 and removed; of the others only the one before changes."""
            best = rank_of(F.get(parts, at))
            following = F.get(parts, at + 2)
            own = placed(F.when(following.isNull(), F.lit(_NONE).cast("long")).otherwise(self.pair(best, id_(following))), F.get(parts, at).bitwiseAND(low).bitwiseXOR(id_(F.get(parts, at))).bitwiseOR(best))
            before = lambda x: placed(self.pair(id_(x), best), x.bitwiseAND(low))
            return F.array_remove(F.transform(parts, lambda x, i: F.when(F.abs(i - at) > 1, x).when(i < at, before(x)).when(i == at, own).otherwise(F.lit(-1).cast("long"))), F.lit(-1).cast("long"))

        def step(parts: Column, _: Column) -> Column:
            merging = lambda at: merge(parts, at)
            return F.when(rank_of(F.array_min(parts)) < _NONE, _bind(F.array_position(parts, F.array_min(parts)).cast("int") - 1, merging)).otherwise(parts)

        def first(v: Column, i: Column) -> Column:
            rank = F.when(i == n - 1, F.lit(_NONE).cast("long")).otherwise(F.get(self.byte_pairs, v * 256 + F.get(values, i + 1)))
            return placed(rank, F.shiftleft(i.cast("long"), _ID_BITS).bitwiseOR(F.get(self.bytes, v)))

        merged = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.transform(values, first), step)
        return F.transform(merged, lambda x: id_(x).cast("int"))

    def part(self, data: Column, first: Column, n: Column) -> Column:
        """The values of n bytes from the byte `first`."""
        byte = lambda digits: lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        some = lambda digits: F.transform(F.sequence(F.lit(0), n - 1), byte(digits))
        return F.when(n > 0, _bind(F.hex(F.substring(data, first + 1, n)), some)).otherwise(F.array().cast("array<int>"))

    def in_windows(self, data: Column) -> Column:
        """Ids of a long word's bytes, by windows that start at a token of the one before. Windows go in rounds of STEPS, as each step copies its round's ids."""
        n = F.octet_length(data)
        state = lambda at, width, first, parts: F.struct(at.alias("at"), width.alias("width"), first.alias("first"), parts.alias("parts"))
        wider = lambda s: state(s["at"], s["width"] * 2, s["first"], s["parts"])
        narrow = F.lit(2 * LONG)

        def accepted(s: Column, ids: Column) -> Column:
            """The state after a window that begins with the token expected: all its ids if it reaches the end, else those before the last that starts in its first half."""
            half = (s["width"] / 2).cast("int")
            sizes = lambda total, i: total + F.get(self.sizes, i)
            on = lambda k: state(s["at"] + F.aggregate(F.slice(ids, F.lit(1), k), F.lit(0), sizes), narrow, F.get(ids, k), F.array_append(s["parts"], F.slice(ids, F.lit(1), k)))
            # Tokens that end in the first half, so that the next one starts there; the last of the window always stays outside.
            count = F.aggregate(ids, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("k")), lambda t, i: F.struct((t["bytes"] + F.get(self.sizes, i)).alias("bytes"), (t["k"] + (t["bytes"] + F.get(self.sizes, i) <= half).cast("int")).alias("k")))["k"]
            end = state(n, narrow, F.lit(-1), F.array_append(s["parts"], ids))
            return F.when(s["at"] + s["width"] >= n, end).otherwise(_bind(count, lambda k: F.when(k > 0, on(k)).otherwise(wider(s))))

        def step(s: Column, _: Column) -> Column:
            fits = lambda ids: F.when((s["first"] < 0) | (F.get(ids, F.lit(0)) == s["first"]), accepted(s, ids)).otherwise(wider(s))
            own = _bind(self.part(data, s["at"], F.least(s["width"], n - s["at"])), self.merged)
            return F.when(s["at"] >= n, s).otherwise(_bind(own, fits))

        def round_(s: Column, _: Column) -> Column:
            own = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state(s["at"], s["width"], s["first"], F.array().cast("array<array<int>>")), step)
            return F.when(s["at"] >= n, s).otherwise(_bind(own, lambda o: state(o["at"], o["width"], o["first"], F.array_append(s["parts"], F.flatten(o["parts"])))))

        rounds = F.aggregate(F.sequence(F.lit(1), (n / (STEPS * LONG / 4)).cast("int") + 16), state(F.lit(0), narrow, F.lit(-1), F.array().cast("array<array<int>>")), round_)
        # Only a word that keeps on asking for wider windows is left unfinished.
        return _bind(rounds, lambda s: F.when(s["at"] >= n, F.flatten(s["parts"])).otherwise(_bind(self.part(data, F.lit(0), n), self.merged)))

    def fold(self, word: Column) -> Column:
        """Ids of a word: a piece of the vocabulary as it is, else its bytes' ids, merged."""
        n = F.octet_length(word)
        short = lambda data: _bind(self.part(data, F.lit(0), n), self.merged)
        folded = lambda data: F.when(n <= LONG, short(data)).otherwise(self.in_windows(data))
        whole = lambda data: _bind(_lookup(self.ranks, F.hex(data), RANK_BUCKETS), lambda rank: F.when(rank.isNull(), folded(data)).otherwise(F.array(rank)))
        return _bind(F.encode(word, "utf-8"), whole)

    def bytes_of(self, ids: Column) -> Column:
        """(le, decoded): the ids as unsigned 32-bit integers, little end first, and the bytes of their pieces, concatenated."""
        joined = lambda table: F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
        return F.struct(joined(self.little).alias("le"), joined(self.pieces).alias("decoded"))

    def learn_words(self, words: DataFrame) -> None:
        """Folds the distinct words (column w) once and keeps them as a literal."""
        folded = words.select("w", _bind(self.fold(F.col("w")), self.bytes_of).alias("own"))
        self.words = _literal(_bucketed(written(folded, "folded-words"), "w", "own", WORD_BUCKETS))

    def word(self, word: Column) -> Column:
        """bytes_of the word's ids."""
        folded = _bind(self.fold(word), self.bytes_of)
        return folded if self.words is None else F.coalesce(_lookup(self.words, word, WORD_BUCKETS), folded)


def split(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def frequent_words(texts: DataFrame, pattern: str, words: int) -> DataFrame:
    """At most `words` of the distinct words (column w) of the texts, those that occur at least so often; a count's size class stays or goes as a whole, so no sort is needed."""
    counted = written(texts.select(F.explode(split(F.col("_text"), pattern)).alias("w")).where(F.octet_length("w") <= MAX_WORD).groupBy("w").agg(F.count("*").alias("n")), "words")
    size = F.floor(F.log2("n") * 16)
    room, least = words, None
    for r in counted.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 16 classes for each doubling of a count
        if r["count"] > room:
            break
        room, least = room - r["count"], r["size"]
    return counted.where(F.lit(False) if least is None else size >= least).select("w")


def encode_bytes(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """The columns `keep` with n_tokens, ids (binary: unsigned 32-bit integers, little end first) and decoded (binary: what the ids decode to)."""
    codec = Codec(docs.sparkSession, path)
    keep = [c for c in keep if c not in ("n_tokens", "ids", "decoded")]
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], text_or_empty(text).alias("_text"))
    if words:
        codec.learn_words(frequent_words(source.select("_text"), pattern, words).repartition(docs.sparkSession.sparkContext.defaultParallelism * 4))
    found = source.withColumn("_found", F.transform(split(F.col("_text"), pattern), codec.word))
    joined = lambda name: F.array_join(F.col(f"_found.{name}"), "").cast("binary")
    out = found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], joined("le").alias("ids"), joined("decoded").alias("decoded"))
    return out.select(*keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """The columns `keep` with ids, array<int>."""
    keep = [c for c in keep if c != "ids"]
    digit = lambda digits, at: F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("int")
    whole = lambda digits: lambda i: sum((F.shiftleft(digit(digits, i * 8 + 1 + 2 * k), 8 * k) for k in range(1, 4)), digit(digits, i * 8 + 1))
    ids = lambda digits, n: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("int"), n - 1), whole(digits))).otherwise(F.array().cast("array<int>"))
    encoded = encode_bytes(docs, path, pattern, keep, text, words)
    return encoded.withColumn("_hex", F.hex("ids")).select(*keep, ids(F.col("_hex"), F.col("n_tokens").cast("int")).alias("ids"))


def decode(ids: Column, codec: Codec) -> Column:
    """The bytes of the ids' pieces, concatenated."""
    return codec.bytes_of(ids)["decoded"].cast("binary")
