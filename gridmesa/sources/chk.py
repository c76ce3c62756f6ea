"""Map scenario files: sections of (name, size, payload), decoded with binary expressions; only the scan itself is Python.

A section's payload is little-endian. Lookups of unit types, tile groups and mini-tiles are joins with tables of a size the
format bounds (at most 65,536 groups).
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmesa.operators.grid import by_map

# Fixed values of the scenario format.
UNIT_SIZE, DOODAD_SIZE = 36, 10
MINERALS, GEYSER, START = (176, 177, 178), 188, 214
TILESETS = ("badlands", "platform", "install", "ashworld", "jungle", "desert", "ice", "twilight")
WALKABLE = 1
UNBUILDABLE = 0x80

#: Pixels from a unit's centre to its left and upper edge.
EDGES = {"mineral": (32, 16), "geyser": (64, 32), "start": (64, 48)}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, name, length, content): one row per file; map_id is the SHA-1 of the content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha1("content").alias("map_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def content_hash(content: Column) -> Column:
    """SHA-1 of the whole file, lowercase hex."""
    return F.sha1(content)


def sections(files: DataFrame) -> DataFrame:
    """(map_id, seq, name, size, payload): every section in file order; a truncated last one is cut at the end of the file."""

    def run(batches):
        for pdf in batches:
            rows = []
            for map_id, content in zip(pdf.map_id, pdf.content, strict=True):
                at, seq = 0, 0
                while content is not None and at + 8 <= len(content):
                    name, size = struct.unpack_from("<4si", content, at)
                    stop = at + 8 + max(0, size)
                    rows.append((map_id, seq, name.decode("latin-1"), size, content[at + 8 : stop]))
                    at, seq = stop, seq + 1
            yield pd.DataFrame(rows, columns=["map_id", "seq", "name", "size", "payload"])

    return files.select("map_id", "content").mapInPandas(run, "map_id string, seq int, name string, size int, payload binary")


def section_list(scanned: DataFrame) -> DataFrame:
    return scanned.select("map_id", "seq", "name", "size")


def unsigned(payload: Column, offset: Column | int, width: int) -> Column:
    """A little-endian unsigned integer of `width` bytes at an offset counted from 0."""
    digits = [F.hex(F.substring(payload, F.lit(offset + k + 1) if isinstance(offset, int) else offset + k + 1, F.lit(1))) for k in range(width)]
    return F.conv(F.concat(*digits[::-1]), 16, 10).cast("long")


def _records(scanned: DataFrame, name: str, size: int) -> DataFrame:
    own = scanned.where((F.col("name") == name) & (F.octet_length("payload") >= size))
    return own.select("map_id", "seq", "payload", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("payload") / size).cast("int") - 1)).alias("k"))


def dimensions(scanned: DataFrame) -> DataFrame:
    """(map_id, width, height) in tiles, from the first DIM section."""
    first = scanned.where(F.col("name") == "DIM ").groupBy("map_id").agg(F.min_by("payload", "seq").alias("p"))
    return first.select("map_id", unsigned(F.col("p"), 0, 2).cast("int").alias("width"), unsigned(F.col("p"), 2, 2).cast("int").alias("height"))


def units(scanned: DataFrame) -> DataFrame:
    """(map_id, seq, k, kind, tx, ty, amount): minerals, geysers and start locations of all UNIT sections; other units are ignored."""
    at = lambda offset, width: unsigned(F.col("payload"), F.col("k") * UNIT_SIZE + offset, width)
    raw = _records(scanned, "UNIT", UNIT_SIZE).select("map_id", "seq", "k", at(4, 2).alias("x"), at(6, 2).alias("y"), at(8, 2).alias("unit"), at(20, 4).alias("amount"))
    kind = F.when(F.col("unit").isin(*MINERALS), "mineral").when(F.col("unit") == GEYSER, "geyser").when(F.col("unit") == START, "start")
    edge = lambda i: F.when(F.col("kind") == "mineral", EDGES["mineral"][i]).when(F.col("kind") == "geyser", EDGES["geyser"][i]).otherwise(EDGES["start"][i])
    tile = lambda c, i: F.floor((F.col(c) - edge(i)) / 32).cast("int")
    return raw.withColumn("kind", kind).where("kind IS NOT NULL").select("map_id", "seq", "k", "kind", tile("x", 0).alias("tx"), tile("y", 1).alias("ty"), "amount")


def doodads(scanned: DataFrame) -> DataFrame:
    """(map_id, k, id, x, y): THG2 records with bit 12 of their flags clear."""
    at = lambda offset: unsigned(F.col("payload"), F.col("k") * DOODAD_SIZE + offset, 2)
    raw = _records(scanned, "THG2", DOODAD_SIZE).select("map_id", "k", at(0).cast("int").alias("id"), at(2).cast("int").alias("x"), at(4).cast("int").alias("y"), at(8).alias("flags"))
    return raw.where(F.shiftright("flags", 12).bitwiseAND(1) == 0).drop("flags")


def tileset(scanned: DataFrame) -> DataFrame:
    """(map_id, tileset, tileset_name): the first ERA byte's low three bits; a map without the section has no row."""
    first = scanned.where(F.col("name") == "ERA ").groupBy("map_id").agg(F.min_by("payload", "seq").alias("p"))
    number = unsigned(F.col("p"), 0, 1).bitwiseAND(7).cast("int")
    return first.select("map_id", number.alias("tileset"), F.get(F.array(*[F.lit(n) for n in TILESETS]), number).alias("tileset_name"))


def terrain(scanned: DataFrame) -> DataFrame:
    """(map_id, x, y, tile): of repeated MTXM sections, one as large as the map replaces all before it; a smaller one overwrites the first tiles if a full one came before, else it is ignored.

    A map's sections are laid over one another as bytes, so that its tiles come out once and need no grouping."""
    is_dim, is_tiles = F.col("name") == "DIM ", F.col("name") == "MTXM"
    first = F.min_by(F.when(is_dim, F.col("payload")), F.when(is_dim, F.col("seq")))
    own = by_map(scanned.where(is_dim | is_tiles)).groupBy("map_id").agg(first.alias("_d"), F.array_sort(F.collect_list(F.when(is_tiles, F.struct("seq", "payload")))).alias("_s"))
    sized = own.select("map_id", "_s", unsigned(F.col("_d"), 0, 2).cast("int").alias("width"), unsigned(F.col("_d"), 2, 2).cast("int").alias("height")).withColumn("n", F.col("width") * F.col("height"))

    def laid(under: Column, section: Column) -> Column:
        payload = section["payload"]
        top = F.substring(payload, F.lit(1), F.least(F.floor(F.octet_length(payload) / 2).cast("int"), F.col("n")) * 2)
        over = F.concat(top, F.substring(under, F.octet_length(top) + 1, F.col("n") * 2))
        return F.when(F.octet_length(payload) >= F.col("n") * 2, top).when(under.isNotNull(), over)

    whole = sized.where("n > 0").select("map_id", "width", "n", F.aggregate("_s", F.lit(None).cast("binary"), laid).alias("tiles")).where("tiles IS NOT NULL")
    cells = whole.select("map_id", "width", "tiles", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return cells.select("map_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), unsigned(F.col("tiles"), F.col("i") * 2, 2).cast("int").alias("tile"))


def tile_group(tile: Column) -> Column:
    return F.shiftright(tile, 4).bitwiseAND(0x7FF)


def tile_variation(tile: Column) -> Column:
    return tile.bitwiseAND(0xF)


def buildable(flags: Column) -> Column:
    return flags.bitwiseAND(UNBUILDABLE) == 0


def build_grid(tiles: DataFrame, groups: DataFrame) -> DataFrame:
    """(map_id, x, y, buildable) from tiles and tile groups (group, buildability, mini: array of 16)."""
    joined = tiles.withColumn("group", tile_group(F.col("tile"))).join(groups, "group")
    return joined.select("map_id", "x", "y", buildable(F.col("buildability")).alias("buildable"))


def mini_tiles(tiles: DataFrame, groups: DataFrame, flags: DataFrame) -> DataFrame:
    """(map_id, x, y, flag) by walk cell: the tile's variation names a mini-tile, whose 16 flags cover its 4 x 4 cells. flags: mini, flags (array of 16)."""
    named = tiles.withColumn("group", tile_group(F.col("tile"))).join(groups, "group").withColumn("mini", F.get("mini", tile_variation(F.col("tile"))))
    cells = named.join(flags, "mini").select("map_id", "x", "y", F.posexplode("flags").alias("i", "flag"))
    return cells.select("map_id", (F.col("x") * 4 + F.col("i") % 4).alias("x"), (F.col("y") * 4 + F.floor(F.col("i") / 4).cast("int")).alias("y"), "flag")


def raw_walkable(flag: Column) -> Column:
    return flag.bitwiseAND(WALKABLE) != 0
