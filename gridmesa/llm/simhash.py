"""Near-duplicates by SimHash, with covering locality-sensitive hashing as the candidate search.

Every bit of the fingerprint gets a fixed nonzero vector of radius + 1 bits; for every nonzero vector v there is a table
that keeps just the bits whose vector has odd inner product with v. Two fingerprints at most `radius` bits apart differ
in bits whose vectors span at most `radius` dimensions, so some v is orthogonal to all of them, and in v's table both have
the same key: no pair within the radius is lost. The tables are 2**(radius + 1) - 1.

Equal fingerprints form one class first, so tables hold each fingerprint once. Within a bucket no list of all pairs is
made: a small bucket compares its members with each other, a large one sends every member to the centres half the radius
away (the member itself, or with one of the bits flipped that vary in the bucket and that the table leaves out), and members that meet at
a centre are linked to the smallest of them; a centre has no more than 65 members. Both ways are exact for a radius of 2.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are linked like any others.
Texts of fewer words than a shingle have one shingle, the whole sequence. Repeated rows get equal results. Empty tables
give empty results; only the columns named are returned, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridmesa.llm.common import appended_schema, arrow_texts, with_columns, written
from gridmesa.llm.components import connected_components
from gridmesa.llm.substring_dedup import _bit_map, _in_map

WIDTH = 64
SEED = 42
#: Buckets of up to so many fingerprints are compared pair by pair.
SMALL_BUCKET = 24
#: Independent SimHashes of a document's words in the search for near copies, and the radius within which each is covered.
HASHES, NEAR = 8, 3
#: Classes of the smallest and of the largest sketch of a set's shingles, see parities().
CLASSES = (1 << 8, 1 << 14)
#: Pairs for which one copy of a set is sent.
PAIRS = 256
#: Rows of a bucket that are resident in one cell; larger buckets are dealt out.
CELL = 2_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingle hashes whose bits are counted at once.
_BLOCK = 1 << 14


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of the text's word shingles, repeats included; a bit is set if over half of the hashes have it."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, last, _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(at + _BLOCK, last)].tolist(), stops[at : at + _BLOCK].tolist(), strict=False)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3, text: str = "text", name: str = "fp") -> DataFrame:
    """The columns `keep` of docs and the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for part, texts in arrow_texts(batches, text):
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64)
            yield with_columns(part, keep, **{name: pa.array(prints)})

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, appended_schema(docs, keep, f"{name} long"))


def covering_masks(radius: int) -> list[int]:
    """The bits kept by each of the 2**(radius + 1) - 1 tables. Bit i's vector is i modulo their number, plus one: all nonzero, evenly spread."""
    tables = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(WIDTH) if (v & (i % tables + 1)).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): each at most `radius` bits apart, and enough to connect every two within the radius."""
    if radius != 2:
        raise ValueError("large buckets are split exactly for a radius of 2 only")
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks(radius)])
    tables = prints.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    buckets = tables.groupBy("t", "key").agg(F.count("*").alias("n"), F.bit_or("fp").alias("ors"), F.bit_and("fp").alias("ands")).where("n > 1")
    # Of two members both differ in just the bits that vary, so buckets of two farther apart than the radius end here.
    varying = F.col("ors").bitwiseXOR(F.col("ands"))
    buckets = buckets.withColumn("varying", varying).where((F.col("n") > 2) | (F.bit_count("varying") <= radius)).drop("ors", "ands")
    # Written, so that the join deals both sides itself and can split a hot bucket's partition.
    members = tables.join(written(buckets, "buckets"), ["t", "key"])
    small = members.where(F.col("n") <= SMALL_BUCKET).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    close = lambda x: F.filter("all", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= radius))
    pairs = small.select(F.explode(F.flatten(F.transform("all", lambda x: F.transform(close(x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(WIDTH)])
    large = members.where(F.col("n") > SMALL_BUCKET).groupBy("fp").agg(F.bit_or("varying").alias("varying"))
    centres = large.select("fp", F.explode(F.filter(flips, lambda f: f.bitwiseAND(F.col("varying")) == f)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    met = centres.groupBy("centre").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    starred = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b")
    return pairs.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits) and component_id, the smallest key reachable through links."""
    prints = written(with_fingerprints(docs, [key], shingle, text), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = connected_components(links(distinct, radius))
    classes = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = written(classes.join(smallest, "component").select("fp", "component_id"), "components")
    return prints.join(of_print, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_fingerprints(text: str) -> np.ndarray:
    """HASHES independent SimHashes of the set of the text's lower-cased words: few changed words change few bits, and unrelated texts differ in about half."""
    words = set(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    ones = np.zeros((HASHES, WIDTH), np.int64)
    for at in range(0, len(hashes), _BLOCK):
        mixed = _mixed(hashes[None, at : at + _BLOCK] ^ _SEEDS[:, None])
        ones += np.unpackbits(mixed.view(np.uint8).reshape(HASHES, -1, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def table_keys(prints: np.ndarray) -> np.ndarray:
    """documents x (HASHES times tables): the bucket of each in every table of every hash, as one 64-bit name. prints: documents x HASHES."""
    masks = np.array(covering_masks(NEAR), np.uint64)
    table = np.arange(1, HASHES * len(masks) + 1, dtype=np.uint64).reshape(HASHES, -1) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed((prints[:, :, None] & masks) + table).reshape(len(prints), -1)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles; a text of fewer words has one, the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))), np.uint64)).view(np.int64)


def parities(shingles: np.ndarray) -> bytes:
    """Parity of the count of shingles in each of as many hash classes as there are shingles, rounded up to a power of two, within CLASSES. Two sets differ in at least as many shingles as parities.

    Unrelated sets, or those that share half, so differ in more parities than similar ones may, however long they are.
    """
    classes = min(max(CLASSES[0], 1 << (len(shingles) - 1).bit_length()), CLASSES[1])
    return np.packbits((np.bincount(shingles & (classes - 1), minlength=classes) & 1).astype(np.uint8)).tobytes()


def _folded(parity: pa.BinaryArray, rows: np.ndarray, width: int) -> np.ndarray:
    """The rows' sketches in `width` bytes, as words: classes are equal modulo their number, so a longer sketch folds onto a shorter one."""
    ends = np.frombuffer(parity.buffers()[1], np.int32)[parity.offset : parity.offset + len(parity) + 1]
    data, start, size = np.frombuffer(parity.buffers()[2], np.uint8), ends[:-1][rows].astype(np.int64), np.diff(ends)[rows]
    out = np.empty((len(rows), width), np.uint8)
    for own in np.unique(size):
        at = np.flatnonzero(size == own)
        out[at] = np.bitwise_xor.reduce(data[start[at, None] + np.arange(own)].reshape(len(at), own // width, width), axis=1)
    return out.view(np.uint64)


def _parities_apart(parity: pa.BinaryArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of rows the parities in which they differ, by the shorter sketch of the two."""
    size = pa.compute.binary_length(parity).to_numpy()
    least, out = np.minimum(size[i], size[j]), np.zeros(len(i), np.int64)
    for width in np.unique(least).tolist():
        at = np.flatnonzero(least == width)
        for part in np.array_split(at, -(-len(at) * width >> 22)):
            out[part] = np.bitwise_count(_folded(parity, i[part], width) ^ _folded(parity, j[part], width)).sum(1, dtype=np.int64)
    return out


def _cell_pairs(component, n, parity, prints, resident, similarity: float, every: bool):
    """Index pairs of a cell's rows, at least one of them resident, in pieces, each with whether some were put off: rows in different components that are within NEAR bits in one of the hashes and may have the similarity. Unless `every`, of each row and component only the pair that differs in the fewest parities; the others are put off."""
    share, size = (1 - similarity) / (1 + similarity), len(n)
    _, index, counts = np.unique(component, return_inverse=True, return_counts=True)
    resident = resident.astype(bool)
    few = _folded(parity, np.arange(size), CLASSES[0] // 8)
    # Members of the largest component are compared with the others only.
    inside = index == counts.argmax()
    order = np.lexsort([n, inside])
    for a in range(0, size - int(inside.sum()), 512):
        for b in range(a, size, 1024):
            i, j = (x.ravel() for x in np.meshgrid(order[a : a + 512], order[b : b + 1024], indexing="ij"))
            # Sets of the similarity differ in at most this many shingles.
            use = (i != j) & (index[i] != index[j]) & (abs(n[i] - n[j]) <= (n[i] + n[j]) * share + 1e-9) & (resident[i] | resident[j])
            i, j = i[use], j[use]
            use = np.bitwise_count(few[i] ^ few[j]).sum(1, dtype=np.int64) <= (n[i] + n[j]) * share + 1e-9
            i, j = i[use], j[use]
            use = (np.bitwise_count(prints[i] ^ prints[j]) <= NEAR).any(1)
            i, j = i[use], j[use]
            apart = _parities_apart(parity, i, j)
            use = apart <= (n[i] + n[j]) * share + 1e-9
            i, j, apart = i[use], j[use], apart[use]
            all_pairs = len(i)
            if len(i) and not every:
                best = np.lexsort((apart, index[j], i))
                first = np.concatenate([[True], (np.diff(i[best]) != 0) | (np.diff(index[j][best]) != 0)])
                i, j = i[best[first]], j[best[first]]
            yield i, j, len(i) < all_pairs


_ATTRIBUTES = [f"f{k}" for k in range(HASHES)]


def candidate_pairs(rows: DataFrame, similarity: float, every: bool) -> DataFrame:
    """(a, b, later): ids of rows (a written table: rank, id, component, n, parity, f0..) that share a rank and may be similar, see _cell_pairs; later, alone in its row, is a rank of which pairs were put off.

    A rank with over CELL rows is dealt out into cells: each row is resident in one of them. Rows of the rank's largest component are
    in no other, since they need no comparison with each other; the rest visit every cell.
    """
    own = rows.groupBy("rank", "component").agg(F.count("*").alias("n")).groupBy("rank")
    sizes = own.agg(F.ceil(F.sum("n") / CELL).cast("int").alias("cells"), F.max(F.struct("n", "component"))["component"].alias("largest")).where("cells > 1")
    sizes = written(sizes, "hot-buckets")
    if sizes.isEmpty():
        dealt = rows.withColumns({"cell": F.lit(0), "resident": F.lit(1)})
    else:
        sized = rows.join(sizes, "rank", "left")
        home = F.coalesce(F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"), F.lit(0))
        stays = F.col("cells").isNull() | (F.col("component") == F.col("largest"))
        dealt = sized.withColumn("home", home).withColumn("cell", F.explode(F.when(stays, F.array("home")).otherwise(F.sequence(F.lit(0), F.col("cells") - 1))))
        dealt = dealt.withColumn("resident", (F.col("home") == F.col("cell")).cast("int")).drop("home", "cells", "largest")

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            cell = np.stack([rest.column(c).to_numpy() for c in ("rank", "cell")])
            change = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1
            if len(change):
                yield from emit(rest.slice(0, change[-1]), np.concatenate([[0], change]))
                rest = rest.slice(change[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from emit(rest, np.array([0, rest.num_rows]))

    def emit(table, bounds):
        ranks, ids, component, n, resident = (table.column(c).to_numpy() for c in ("rank", "id", "component", "n", "resident"))
        prints = np.stack([table.column(c).to_numpy() for c in _ATTRIBUTES], axis=1).view(np.uint64)
        parity = table.column("parity").combine_chunks()
        for k in np.flatnonzero(np.diff(bounds) > 1):
            cell = slice(bounds[k], bounds[k + 1])
            put_off = False
            for i, j, more in _cell_pairs(component[cell], n[cell], parity[cell], prints[cell], resident[cell], similarity, every):
                put_off |= more
                if len(i):
                    a, b = ids[cell][i], ids[cell][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], names=["a", "b", "later"])
            if put_off:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(ranks[cell][:1])], names=["a", "b", "later"])

    return dealt.repartition("rank", "cell").sortWithinPartitions("rank", "cell", "id").mapInArrow(run, "a long, b long, later long").where("later IS NOT NULL OR a != b").distinct()


def similar_pairs(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a written table) whose sets of word shingles have a Jaccard similarity of at least `similarity`. docs: id, text.

    The set of b goes to where a's is. An a with many pairs is dealt out, with a copy of its set for every PAIRS of them.
    """
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def run(batches):
        for part, texts in arrow_texts(batches):
            yield with_columns(part, ["id"], shingles=pa.array([shingle_set(t, shingle) for t in texts], pa.list_(pa.int64())))

    sets = written(docs.join(involved, "id", "left_semi").mapInArrow(run, "id long, shingles array<long>"), "shingles")
    deals = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("deals")), "deals")
    dealt = pairs.join(deals, "a").withColumn("deal", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int")).select("a", "b", "deal")
    many = dealt.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    one = deals.select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal")).join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    both = many.join(one.hint("merge"), ["a", "deal"])
    return both.where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b").distinct()


def _entries(rows: DataFrame, bits=None) -> DataFrame:
    """rank, the row's bucket in each table, before the columns of rows (prints, and others): a row for every bucket, or for those whose rank is in a bit map."""
    names = [c for c in rows.columns if c != "prints"]
    schema = StructType([StructField("rank", LongType()), *[rows.schema[c] for c in names]])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                rank = table_keys(part.column("prints").flatten().to_numpy().reshape(-1, HASHES).view(np.uint64)).view(np.int64)
                owner = np.repeat(np.arange(part.num_rows), rank.shape[1])
                rank = rank.ravel()
                if bits is not None:
                    use = np.flatnonzero(_in_map(bits.value, rank))
                    rank, owner = rank[use], owner[use]
                taken = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(rank), *[part.column(c).take(taken) for c in names]], names=["rank", *names])

    return rows.mapInArrow(run, schema)


def _bucket_map(classes: DataFrame):
    """A broadcast bit map of the buckets with several members; of buckets with just the same members, of one. Others that the map lets through cost work only."""
    context = classes.sparkSession.sparkContext
    ids = classes.select("id", "prints")
    repeated = written(_entries(ids.select("prints")).groupBy("rank").count().where("count > 1").select("rank"), "repeated-keys")
    bits = context.broadcast(_bit_map(repeated))
    found = _entries(ids, bits)
    members = found.groupBy("rank").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    chosen = written(members.where("n > 1").groupBy("n", "x", "y").agg(F.min("rank").alias("rank")).select("rank"), "distinct-buckets")
    bits.destroy()
    return context.broadcast(_bit_map(chosen))


def _first_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): for each id b the smallest id a that it finds at the head of one of its buckets. rows: rank, id. Rows are sorted over all tasks by both columns, so a hot bucket spreads; each task's part of a bucket has a head of its own."""

    def run(batches):
        rank, head = None, 0
        for batch in batches:
            ranks, ids = batch.column("rank").to_numpy(), batch.column("id").to_numpy()
            starts = np.concatenate([[rank is None or ranks[0] != rank], ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, bool)
            at = np.maximum.accumulate(np.where(starts, np.arange(len(ranks)), -1))
            heads = np.where(at >= 0, ids[np.maximum(at, 0)], head)
            if len(ranks):
                rank, head = ranks[-1], heads[-1]
            use = heads != ids
            yield pa.RecordBatch.from_arrays([pa.array(heads[use]), pa.array(ids[use])], names=["a", "b"])

    return rows.repartitionByRange("rank", "id").sortWithinPartitions("rank", "id").mapInArrow(run, "a long, b long").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, one per group of near-duplicates (that of the smallest integer key), with docs' columns.

    Two documents are candidates if one of HASHES independent SimHashes of their words is within NEAR bits; covering tables
    lose none of these. Candidates link if they share at least `similarity` of their word shingles, and groups are the
    components of all links. Equal sets form one class first. So as to compare few pairs, three rounds each verify some
    candidates: of each document the one with its buckets' smallest id; then of each document and each other component of a
    bucket the closest; at last, in the buckets where that put candidates off, all that are still in different components.

    Defined results: null and empty texts, and texts without words, have one shingle, the empty one, and so form one group.
    Rows with a null key always stay. Rows that repeat a key count as one document, which stays if one of its texts does. An empty table
    gives an empty result; other columns pass through, whatever their names.
    """
    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def summaries(batches):
        for part, texts in arrow_texts(batches):
            sets = [shingle_set(t, shingle) for t in texts]
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            parity = pa.array([parities(s) for s in sets], pa.binary())
            prints = np.array([word_fingerprints(t) for t in texts], np.uint64)
            yield with_columns(part, ["id"], digest=digest, n=pa.array([len(s) for s in sets], pa.int64()), parity=parity, prints=pa.array(list(prints.view(np.int64)), pa.list_(pa.int64())))

    sets = written(keyed.mapInArrow(summaries, "id long, digest binary, n long, parity binary, prints array<long>"), "summaries")
    classes = written(sets.groupBy("digest").agg(F.min(F.struct("id", "n", "parity", "prints")).alias("least")).select("digest", "least.*"), "classes")
    judged = sets.select("id", "digest").join(classes.select("digest", F.col("id").alias("least")), "digest").groupBy("id").agg(F.min(F.col("id") > F.col("least")).alias("copy"))
    copies = judged.where("copy").select("id")
    # Each row becomes many: small tables spread over all cores, large ones by their rows.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism * 4, classes.count() // 20_000)
    classes = classes.repartition(tasks)
    context = docs.sparkSession.sparkContext
    bits = _bucket_map(classes)
    pairs = written(_first_pairs(_entries(classes.select("id", "prints"), bits)), "pairs")
    edges = written(similar_pairs(pairs, keyed, shingle, similarity), "similar")
    labels = written(connected_components(edges).withColumnRenamed("node", "id"), "labels")
    verified = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    attributes = ["parity", *[F.col("prints")[k].alias(f"f{k}") for k in range(HASHES)]]
    for every in (False, True):
        now = classes.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        ranked = _entries(now.select("component", "n", "prints"), bits).groupBy("rank").agg(F.count("*").alias("rows"), F.min("component").alias("least"), F.max("component").alias("most"), F.min("n").alias("short"), F.max("n").alias("long"))
        # Two sets alone in a bucket must be of similar sizes.
        mixed = written(ranked.where((F.col("least") < F.col("most")) & ((F.col("rows") > 2) | (F.col("short") >= F.lit(similarity) * F.col("long") - 1e-9))).select("rank"), "mixed")
        mixed_bits = context.broadcast(_bit_map(mixed))
        open_ = written(_entries(now.select("id", "component", "n", *attributes, "prints"), mixed_bits), "open-buckets")
        mixed_bits.destroy()
        found = written(candidate_pairs(open_, similarity, every), "candidates")
        # Pairs that have been verified already need it no more.
        pairs = written(found.where("later IS NULL").select("a", "b").join(verified, ["a", "b"], "left_anti"), "pairs")
        verified = verified.unionByName(pairs)
        similar = written(similar_pairs(pairs, keyed, shingle, similarity), "similar")
        if not similar.isEmpty():
            edges = edges.unionByName(similar)
            labels = written(connected_components(edges).withColumnRenamed("node", "id"), "labels")
        later = written(found.where("later IS NOT NULL").select(F.col("later").alias("rank")).distinct(), "later")
        bits.destroy()
        if every or later.isEmpty():
            break
        bits = context.broadcast(_bit_map(later))
    dropped = written(labels.where("id != component").select("id").unionByName(copies).distinct(), "dropped")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("id"))
    return marked.join(dropped, "id", "left_anti").select("row.*")
