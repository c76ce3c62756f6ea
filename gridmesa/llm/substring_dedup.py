"""Removal of long repeated byte strings: prefix doubling over sampled positions.

A repeated string of `length` bytes (200) holds, at the same place in every occurrence, the position where a hash of the next
`half` bytes (100) is smallest among its own positions; these anchors are about one position in 51. Ranks are 64-bit names of byte
strings, made inside a text by doubling (1, 2, 4 ... bytes): that part of the doubling needs no other text.

Round 1, offset `half`: Spark groups the ranks of the anchors' `half` bytes; those that are unique drop out, with every
position they stand for. Round 2: of the others each stands for the run of positions whose window chose it, at most
`half` + 1. Rows are dealt and sorted by rank; the strings of `length` bytes at all their positions are named afresh from the
bytes, the names are sorted, and positions that share one are repeated, once their bytes have been compared. That passes the threshold, so it ends.

This is not the doubling of every position in Spark, which has a row of rank pairs for each byte in every round; the README
says what that took.

A rank with more than HOT rows is dealt out instead, position by position, under two independent names (128 bits), so no task holds an
unbounded group. Which ranks repeat, and which are hot, reaches the second scan as bit maps of fixed size; a false positive
there costs work, never a wrong result.

Defined results: null counts as the empty text; texts shorter than `length` keep every byte. Equal texts repeat each
other, so they lose all their bytes if long enough. Results are by text, so that repeated rows and null ids get equal
ones. An empty table gives an empty result; only the named columns are returned, and the four results replace columns named like them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmesa.llm.common import appended_schema, arrow_texts, text_or_empty, with_columns, written

LENGTH = 200
#: Rows of a rank that one task may hold.
HOT = 50_000
#: Bits in each of the two maps (16 MB).
MAP_BITS = 27
#: Bytes of text whose names are made at once, and rows' bytes compared at once.
PIECE = 1 << 17
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    out = left * _B + np.uint64(seed)
    out ^= (left >> np.uint64(31)) + right * _A
    out *= _C
    out ^= out >> np.uint64(29)
    return out


def names(data: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """For each position with `length` bytes from it, a name of them; another salt gives an independent one."""
    now, width = (data.astype(np.uint64) + np.uint64(1 + 257 * salt)) * _A, 1
    while width * 2 <= length:
        now, width = _mixed(now[: len(now) - width], now[width:], width), 2 * width
    rest = length - width
    return _mixed(now[: len(now) - rest], now[rest:], length) if rest else now


def chosen_places(ranks: np.ndarray, window: int) -> np.ndarray:
    """For each window of so many consecutive ranks, the place of the smallest, the first of equals."""
    value, place, width = ranks, np.arange(len(ranks)), 1

    def merged(step: int):
        a, b = value[: len(value) - step], value[step:]
        right = b < a
        return np.where(right, b, a), np.where(right, place[step:], place[: len(place) - step])

    while width * 2 <= window:
        value, place = merged(width)
        width *= 2
    return merged(window - width)[1] if window > width else place


def _pieces(texts: list[bytes], length: int):
    """Concatenated bytes of about PIECE, the start and end in them of each part of a text, the text's index and the part's offset. Parts of one text overlap by length - 1 bytes."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            group.append((part, i, at))
            size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def sampled(texts: list[bytes], length: int):
    """For each group of pieces: its bytes, and for each anchor its rank, its first and last window's place in the bytes, the text's index and the offset of the bytes' place 0 in that text."""
    half = length // 2
    for group in _pieces(texts, length):
        data = np.frombuffer(b"".join(g[0] for g in group), np.uint8)
        sizes = np.array([len(g[0]) for g in group])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        ranks = names(data, half)
        chosen = chosen_places(ranks, length - half + 1)
        valid = np.ones(len(chosen), bool)
        for end in ends[:-1]:
            valid[max(0, end - length + 1) : end] = False
        at = np.flatnonzero(valid)
        place = chosen[at]
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.append(first[1:], len(at)) - 1
        low, high = at[first], at[last]
        own = np.searchsorted(ends, low, side="right")
        index, offset = np.array([g[1] for g in group])[own], np.array([g[2] for g in group])[own] - starts[own]
        yield data, ranks[place[first]].view(np.int64), low, high, index, offset


def text_key(text: str = "text") -> Column:
    """What stands for a text in the results: half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text_or_empty(text), 256), 1, 32))


def _encoded(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> bool:
    """Whether the `length` bytes at each left place equal those at the right one. After a pair of places just before, only the last byte is new."""
    if not (data[left + length - 1] == data[right + length - 1]).all():
        return False
    partner = np.full(len(data) + 1, -2)
    partner[left] = right
    heads = np.flatnonzero(partner[left - 1] != right - 1) if len(left) else left
    windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else data[:0, None]
    return all((windows[left[part]] == windows[right[part]]).all() for part in np.array_split(heads, -(-len(heads) // 1024)) if len(part)) if len(heads) else True


def _bit_map(ranks: DataFrame) -> np.ndarray:
    """The map's words, put together on the executors in blocks of 32 KB, of which the driver gets 512 at most."""
    slot = F.pmod("rank", F.lit(1 << MAP_BITS))
    words = ranks.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(rank, {1 << MAP_BITS}) & 63 AS int))")).alias("bits"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(4096, np.int64)
        block[pdf.word.to_numpy(np.int64) & 4095] = pdf.bits
        return pd.DataFrame({"block": [pdf.word.iloc[0] >> 12], "words": [block.tobytes()]})

    out = np.zeros((1 << MAP_BITS) // 64, np.uint64)
    for r in words.groupBy(F.shiftright("word", 12).alias("b")).applyInPandas(pack, "block long, words binary").toLocalIterator():
        out[r.block * 4096 : (r.block + 1) * 4096] = np.frombuffer(r.words, np.uint64)
    return out


def _in_map(bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    slot = ranks & np.int64((1 << MAP_BITS) - 1)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(text_key, spans), a written table: for each distinct text with bytes covered by a repeated string, the covered stretches (start, stop), which may overlap."""
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") >= length)

    def count(batches):
        for _, texts in arrow_texts(batches):
            for _, ranks, *_ in sampled(_encoded(texts), length):
                rank, n = np.unique(ranks, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(n)], names=["rank", "n"])

    counted = source.mapInArrow(count, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = written(counted, "repeated-ranks")
    context = docs.sparkSession.sparkContext
    candidate = context.broadcast(_bit_map(repeated))
    burning = repeated.where(F.col("n") > hot)
    crowded = context.broadcast(None if burning.isEmpty() else _bit_map(burning))

    def rows(batches):
        for _, texts in arrow_texts(batches):
            encoded = _encoded(texts)
            keys = [hashlib.sha256(t).digest()[:16] for t in encoded]
            for data, ranks, low, high, index, offset in sampled(encoded, length):
                use = _in_map(candidate.value, ranks)
                if crowded.value is not None:
                    use &= ~_in_map(crowded.value, ranks)
                at = np.flatnonzero(use)
                whole = data.tobytes()
                blobs = [whole[a : b + length] for a, b in zip(low[at].tolist(), high[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ranks[at]), pa.array([keys[i] for i in index[at]], pa.binary()), pa.array(low[at] + offset[at]), pa.array(blobs, pa.binary())], names=["rank", "text_key", "start", "bytes"])

    def compare(batches):
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                room = np.searchsorted(np.cumsum(pa.compute.binary_length(batch.column("bytes")).to_numpy()), max(1, PIECE - size))
                part = batch.slice(0, min(batch.num_rows, int(room) + 1))
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.column("bytes").nbytes
                if size >= PIECE:
                    table = pa.Table.from_batches(held).combine_chunks()
                    ranks = table.column("rank").to_numpy()
                    cut = int(np.flatnonzero(ranks != ranks[-1])[-1]) + 1 if ranks[0] != ranks[-1] else 0
                    if cut:
                        yield from shared(table.slice(0, cut))
                        held = table.slice(cut).combine_chunks().to_batches()
                        size = sum(b.column("bytes").nbytes for b in held)
                    else:
                        size = 0  # one rank so far, of at most `hot` rows: looked at again after as many bytes
        if held:
            yield from shared(pa.Table.from_batches(held).combine_chunks())

    def shared(table):
        blobs = table.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(blobs), np.uint8)
        sizes = np.array([len(b) for b in blobs])
        ends = np.cumsum(sizes)
        named = names(data, length)
        valid = np.ones(len(named), bool)
        for end in ends[:-1]:
            valid[max(0, end - length + 1) : end] = False
        at = np.flatnonzero(valid)
        order = np.argsort(named[at], kind="stable")
        ranked = named[at][order]
        same = ranked[1:] == ranked[:-1]
        if not _same_bytes(data, at[order[:-1]][same], at[order[1:]][same], length):  # two strings share a name: the bytes themselves are sorted
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"V{length}")[:, 0]
            exact = np.unique(windows, return_inverse=True)[1]
            order = np.argsort(exact, kind="stable")
            same = exact[order][1:] == exact[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        flags = np.zeros(len(data) + 1, bool)
        flags[at[order[twice]]] = True
        first, last = _runs(flags)
        own = np.searchsorted(ends, first, side="right")
        start = table.column("start").to_numpy()[own] + first - (ends - sizes)[own]
        yield pa.RecordBatch.from_arrays([table.column("text_key").combine_chunks().take(pa.array(own)) if len(blobs) else pa.array([], pa.binary()), pa.array(start), pa.array(start + last - first + length)], names=["text_key", "start", "stop"])

    cold = source.mapInArrow(rows, "rank long, text_key binary, start long, bytes binary").repartition("rank").sortWithinPartitions("rank")
    spans = cold.mapInArrow(compare, "text_key binary, start long, stop long")
    if crowded.value is not None:
        spans = spans.unionByName(_dealt_by_position(source, crowded, length))
    out = written(spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "repeated-spans")
    for bits in (candidate, crowded):
        bits.destroy()
    return out


def _dealt_by_position(source: DataFrame, crowded, length: int) -> DataFrame:
    """Spans from the hot ranks: one row per position, grouped by two independent names of its `length` bytes, 128 bits in all, with partial aggregation."""

    def positions(batches):
        for _, texts in arrow_texts(batches):
            encoded = _encoded(texts)
            keys = [hashlib.sha256(t).digest()[:16] for t in encoded]
            for data, ranks, low, high, index, offset in sampled(encoded, length):
                named, again = (names(data, length, salt).view(np.int64) for salt in (0, 1))
                use = np.flatnonzero(_in_map(crowded.value, ranks))
                for at in range(0, len(use), 256):
                    part = use[at : at + 256]
                    sizes = high[part] - low[part] + 1
                    place = np.repeat(low[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(named[place]), pa.array(again[place]), pa.array([k for i, n in zip(index[part], sizes, strict=True) for k in [keys[i]] * n], pa.binary()), pa.array(place + np.repeat(offset[part], sizes))], names=["name", "again", "text_key", "start"])

    rows = source.mapInArrow(positions, "name long, again long, text_key binary, start long")
    twice = written(rows.groupBy("name", "again").agg(F.count("*").alias("n")).where("n > 1").select("name", "again"), "repeated-names")
    return rows.join(twice, ["name", "again"]).select("text_key", "start", (F.col("start") + length).alias("stop"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The columns `keep` with kept (the remaining bytes), n_bytes, n_removed and n_spans (maximal removed runs), which replace columns so named."""
    columns = [c for c in keep if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    spans = repeated_spans(docs.select(F.col(f"`{text}`").alias("text")), "text", length, hot)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row") if columns else F.lit(0).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    joined = own.withColumn("text_key", text_key()).join(spans, "text_key", "left")

    def cut(batches):
        for part, texts in arrow_texts(batches):
            kept, removed, runs, sizes = [], [], [], []
            for data, own in zip(_encoded(texts), part.column("spans").to_pylist(), strict=True):
                merged = _merged(own or [])
                at, left = 0, []
                for a, b in merged:
                    left.append(data[at:a])
                    at = b
                kept.append(b"".join([*left, data[at:]]))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                runs.append(len(merged))
            yield with_columns(part, ["row"], kept=pa.array(kept, pa.binary()), n_bytes=pa.array(sizes, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(runs, pa.int64()))

    out = joined.select("row", "text", "spans").mapInArrow(cut, appended_schema(joined, ["row"], "kept binary, n_bytes long, n_removed long, n_spans long"))
    return out.select(*(["row.*"] if columns else []), "kept", "n_bytes", "n_removed", "n_spans")
