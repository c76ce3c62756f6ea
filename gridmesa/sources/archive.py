"""Read-only access to the members of a map archive, given its bytes.

The archive has a header at a multiple of 512 bytes, an encrypted hash table that finds a member by three hashes of its
name, an encrypted block table, and members stored in sectors that may each be encrypted and compressed. Codecs: zlib,
bzip2, LZMA, sparse runs, and the PKWARE format with plain literals; the audio codecs are not for scenario files and raise an error.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

SCENARIO = "staredit\\scenario.chk"
_M = 0xFFFFFFFF

# Fixed values of the archive format.
EXISTS, COMPRESSED, IMPLODED, ENCRYPTED, KEY_ADJUSTED, SINGLE = 0x80000000, 0x200, 0x100, 0x10000, 0x20000, 0x1000000
OFFSET, NAME_A, NAME_B, KEY = 0, 1, 2, 3
HUFFMAN, ZLIB, PKWARE, BZIP2, SPARSE, MONO, STEREO, LZMA = 0x01, 0x02, 0x08, 0x10, 0x20, 0x40, 0x80, 0x12


@lru_cache(1)
def _table() -> list[int]:
    """1280 words from a linear congruential generator, five to each byte value."""
    seed, out = 0x00100001, [0] * 1280

    def half() -> int:
        nonlocal seed
        seed = (seed * 125 + 3) % 0x2AAAAB
        return seed & 0xFFFF

    for i in range(256):
        for j in range(5):
            high = half()
            out[i + 256 * j] = (high << 16) | half()
    return out


def name_hash(name: str, kind: int) -> int:
    """Hash of a name, in which case and the kind of slash do not count."""
    a, b = 0x7FED7FED, 0xEEEEEEEE
    for c in name.upper().replace("/", "\\").encode("latin-1"):
        a = _table()[256 * kind + c] ^ ((a + b) & _M)
        b = (c + a + 33 * b + 3) & _M
    return a


def crypt(data: bytes, key: int, encrypt: bool = False) -> bytes:
    """Whole 32-bit words are decrypted (or encrypted); bytes left over stay."""
    words = list(struct.unpack_from(f"<{len(data) // 4}I", data))
    seed = 0xEEEEEEEE
    for i, word in enumerate(words):
        seed = (seed + _table()[0x400 + (key & 0xFF)]) & _M
        words[i] = word ^ ((key + seed) & _M)
        plain = word if encrypt else words[i]
        key = ((((~key) << 21) + 0x11111111) & _M) | (key >> 11)
        seed = (plain + 33 * seed + 3) & _M
    return struct.pack(f"<{len(words)}I", *words) + data[len(words) * 4 :]


# Fixed values of the PKWARE format: the lengths of the codes of match lengths and of distances, symbol by symbol; then the least
# match length of each symbol and its number of extra bits.
LENGTH_CODES = [
    2, 3, 3, 3, 4, 4, 4, 5, 5, 5, 5, 6, 6, 6, 7, 7,
]
DISTANCE_CODES = [
    2, 4, 4, 5, 5, 5, 5, 6, 6, 6, 6, 6, 6, 6, 6, 6,
    6, 6, 6, 6, 6, 6, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7,
    7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7,
    8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
]
LEAST_LENGTHS = [3, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 72, 136, 264]
EXTRA_BITS = [0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8]


def _codes(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol: canonical codes, shorter ones first and equal ones in the order of symbols."""
    code, out = 0, {}
    for size in range(1, max(lengths) + 1):
        for symbol, own in enumerate(lengths):
            if own == size:
                out[size, code] = symbol
                code += 1
        code <<= 1
    return out


LENGTH_SYMBOLS, DISTANCE_SYMBOLS = _codes(LENGTH_CODES), _codes(DISTANCE_CODES)


class _Bits:
    """Reads numbers low bit first, and codes bit by bit, inverted."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def number(self, width: int) -> int:
        value = 0
        for k in range(width):
            value |= (self.data[self.at >> 3] >> (self.at & 7) & 1) << k
            self.at += 1
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = size = 0
        while size < 16:
            code, size = code << 1 | (1 - self.number(1)), size + 1
            if (size, code) in codes:
                return codes[size, code]
        raise ValueError("a code that the format does not have")


def explode(data: bytes) -> bytes:
    """PKWARE data with plain literals: bytes and copies of earlier output, as Ben Rudiak-Gould described the format publicly in 2001. Literals under codes, which archives of this kind do not use, are not supported."""
    if data[0] != 0:
        raise ValueError("coded literals are not supported")
    window, bits, out = data[1], _Bits(data, 16), bytearray()
    while True:
        if not bits.number(1):
            out.append(bits.number(8))
            continue
        k = bits.symbol(LENGTH_SYMBOLS)
        length = LEAST_LENGTHS[k] + bits.number(EXTRA_BITS[k])
        if length == 519:
            return bytes(out)
        low = 2 if length == 2 else window
        back = (bits.symbol(DISTANCE_SYMBOLS) << low) + bits.number(low) + 1
        if back > len(out):
            raise ValueError("a copy from before the beginning")
        for _ in range(length):
            out.append(out[-back])


def unsparse(data: bytes) -> bytes:
    """Runs: a byte with its high bit set is followed by that many (plus one) bytes as they are, another stands for that many (plus three) zeros."""
    size, at, out = struct.unpack(">I", data[:4])[0], 4, bytearray()
    while at < len(data) and len(out) < size:
        head = data[at]
        at += 1
        if head & 0x80:
            n = (head & 0x7F) + 1
            out += data[at : at + n]
            at += n
        else:
            out += bytes((head & 0x7F) + 3)
    return bytes(out[:size])


def _unlzma(data: bytes) -> bytes:
    return lzma.LZMADecompressor(lzma.FORMAT_ALONE).decompress(data[1:])


def decompress(sector: bytes, size: int) -> bytes:
    """A sector shorter than `size` starts with a byte that names its codecs, undone in a fixed order."""
    if len(sector) >= size:
        return sector[:size]
    if not sector:
        raise ValueError("an empty sector")
    mask, data = sector[0], sector[1:]
    if mask == LZMA:
        return _unlzma(data)
    for bit, undo in ((BZIP2, bz2.decompress), (PKWARE, explode), (ZLIB, zlib.decompress), (SPARSE, unsparse)):
        if mask & bit:
            data, mask = undo(data), mask & ~bit
    if mask:
        raise ValueError(f"codec {mask:#x} is not supported")
    return data


@dataclass
class Archive:
    content: bytes

    def __post_init__(self):
        self.base = next((i for i in range(0, len(self.content), 512) if self.content[i : i + 4] == b"MPQ\x1a"), None)
        if self.base is None:
            raise ValueError("no archive header")
        _, _, _, _, shift, hashes, blocks, n_hashes, n_blocks = struct.unpack_from("<4sIIHHIIII", self.content, self.base)
        self.sector = 512 << shift
        read = lambda at, n, name: list(struct.iter_unpack("<IIII", crypt(self.content[self.base + at : self.base + at + 16 * n], name_hash(name, KEY))))
        self.hashes, self.blocks = read(hashes, n_hashes, "(hash table)"), read(blocks, n_blocks, "(block table)")

    def find(self, name: str) -> tuple[int, int, int, int] | None:
        """The member's block: offset, stored size, size, flags."""
        n, wanted = len(self.hashes), (name_hash(name, NAME_A), name_hash(name, NAME_B))
        start = name_hash(name, OFFSET) % n if n else 0
        for i in range(n):
            a, b, _, block = self.hashes[(start + i) % n]
            if block == _M:
                return None
            if (a, b) == wanted and block < len(self.blocks) and self.blocks[block][3] & EXISTS:
                return self.blocks[block]
        return None

    def read(self, name: str) -> bytes | None:
        block = self.find(name)
        if block is None:
            return None
        offset, stored, size, flags = block
        data = self.content[self.base + offset : self.base + offset + stored]
        key = name_hash(name.replace("/", "\\").rpartition("\\")[2], KEY) if flags & ENCRYPTED else None
        if key is not None and flags & KEY_ADJUSTED:
            key = ((key + offset) & _M) ^ size
        undo = explode if flags & IMPLODED else None
        step = size if flags & SINGLE else self.sector
        count = -(-size // step) if size else 0
        if flags & (COMPRESSED | IMPLODED) and not flags & SINGLE:
            head = data[: 4 * (count + 1)]
            bounds = struct.unpack(f"<{count + 1}I", crypt(head, (key - 1) & _M) if key is not None else head)
        else:
            bounds = [min(len(data), k * step) for k in range(count)] + [len(data)]
        out = []
        for k in range(count):
            part = data[bounds[k] : bounds[k + 1]]
            own = min(step, size - k * step)
            part = crypt(part, (key + k) & _M) if key is not None else part
            out.append((undo(part) if len(part) < own else part) if undo else decompress(part, own) if flags & COMPRESSED else part)
        return b"".join(out)


#: What reading a damaged archive may raise: lists and structures that end early, codecs that meet what they cannot read.
DAMAGE = (ValueError, IndexError, struct.error, zlib.error, lzma.LZMAError, OSError, EOFError, MemoryError, OverflowError)


def extract(files: DataFrame, member: str = SCENARIO) -> DataFrame:
    """(map_id, content, problem): the member of every archive (map_id, content). Without content there is a problem: 'no file' (null content), 'no member', or what made the archive unreadable; a file that cannot be read never ends the job."""

    def one(content: bytes | None) -> tuple[bytes | None, str | None]:
        if content is None:
            return None, "no file"
        try:
            found = Archive(content).read(member)
        except DAMAGE as error:
            return None, f"{type(error).__name__}: {error}"
        return found, None if found is not None else "no member"

    def run(batches):
        for pdf in batches:
            got = [one(c) for c in pdf.content]
            yield pd.DataFrame({"map_id": pdf.map_id, "content": [c for c, _ in got], "problem": [p for _, p in got]})

    return files.select("map_id", "content").mapInPandas(run, "map_id string, content binary, problem string")


def pack(content: bytes, member: str = SCENARIO, shift: int = 3) -> bytes:
    """The smallest archive that holds one member, encrypted and compressed with zlib by sector."""
    sector, name = 512 << shift, member.rpartition("\\")[2]
    parts = [content[i : i + sector] for i in range(0, len(content), sector)]
    parts = [min(p, bytes([ZLIB]) + zlib.compress(p), key=len) for p in parts]
    bounds = [4 * (len(parts) + 1)]
    for part in parts:
        bounds.append(bounds[-1] + len(part))
    key = name_hash(name, KEY)
    body = crypt(struct.pack(f"<{len(bounds)}I", *bounds), (key - 1) & _M, True) + b"".join(crypt(p, (key + i) & _M, True) for i, p in enumerate(parts))
    hashes = [(name_hash(member, NAME_A), name_hash(member, NAME_B), 0, 0)]
    blocks = [(32, len(body), len(content), EXISTS | COMPRESSED | ENCRYPTED)]
    table = lambda rows, kind: crypt(b"".join(struct.pack("<IIII", *r) for r in rows), name_hash(kind, KEY), True)
    end = 32 + len(body)
    return struct.pack("<4sIIHHIIII", b"MPQ\x1a", 32, end + 32, 0, shift, end, end + 16, 1, 1) + body + table(hashes, "(hash table)") + table(blocks, "(block table)")


def wrapped(files: DataFrame, member: str = SCENARIO) -> DataFrame:
    """(map_id, content): every file (map_id, content) as the member of an archive of its own."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"map_id": pdf.map_id, "content": [None if c is None else pack(bytes(c), member) for c in pdf.content]})

    return files.select("map_id", "content").mapInPandas(run, "map_id string, content binary")
