import bz2
import lzma
import random
import struct
import zlib

import pytest

from gridmesa.sources import archive as a


def build(members: dict[str, tuple[bytes, int, int]], shift: int = 1, lead: int = 512) -> bytes:
    """An archive of members (data, flags, codec)."""
    sector, body, blocks = 512 << shift, bytearray(), []
    for name, (data, flags, codec) in members.items():
        offset = 32 + len(body)
        key = a.name_hash(name.rpartition("\\")[2], a.KEY)
        if flags & a.KEY_ADJUSTED:
            key = ((key + offset) & 0xFFFFFFFF) ^ len(data)
        encrypted = lambda part, k: a.crypt(part, k & 0xFFFFFFFF, True) if flags & a.ENCRYPTED else part  # noqa: B023, E731
        parts = [data[i : i + sector] for i in range(0, len(data), sector)]
        if flags & a.COMPRESSED:
            squeeze = {a.ZLIB: zlib.compress, a.BZIP2: bz2.compress, a.LZMA: lambda d: b"\0" + lzma.compress(d, lzma.FORMAT_ALONE)}[codec]
            parts = [min(p, bytes([codec]) + squeeze(p), key=len) for p in parts]
            bounds = [4 * (len(parts) + 1)]
            for p in parts:
                bounds.append(bounds[-1] + len(p))
            stored = encrypted(struct.pack(f"<{len(bounds)}I", *bounds), key - 1) + b"".join(encrypted(p, key + i) for i, p in enumerate(parts))
        else:
            stored = b"".join(encrypted(p, key + i) for i, p in enumerate(parts))
        blocks.append((offset, len(stored), len(data), flags | a.EXISTS))
        body += stored
    size = 16
    hashes = [(0xFFFFFFFF,) * 4] * size
    for i, name in enumerate(members):
        at = a.name_hash(name, a.OFFSET) % size
        while hashes[at][3] != 0xFFFFFFFF:
            at = (at + 1) % size
        hashes[at] = (a.name_hash(name, a.NAME_A), a.name_hash(name, a.NAME_B), 0, i)
    table = lambda rows, name: a.crypt(b"".join(struct.pack("<IIII", *r) for r in rows), a.name_hash(name, a.KEY), True)
    h, b = table(hashes, "(hash table)"), table(blocks, "(block table)")
    head = struct.pack("<4sIIHHIIII", b"MPQ\x1a", 32, 32 + len(body) + len(h) + len(b), 0, shift, 32 + len(body), 32 + len(body) + len(h), size, len(blocks))
    return bytes(lead) + head + bytes(body) + h + b


TEXT = b"terrain " * 900 + bytes(range(256))


@pytest.mark.parametrize("codec", [a.ZLIB, a.BZIP2, a.LZMA])
@pytest.mark.parametrize("extra", [0, a.ENCRYPTED, a.ENCRYPTED | a.KEY_ADJUSTED])
def test_members_round_trip(codec, extra):
    noise = random.Random(1).randbytes(3001)
    content = build({a.SCENARIO: (TEXT, a.COMPRESSED | extra, codec), "plain.txt": (noise, extra, 0), "empty": (b"", 0, 0)})
    own = a.Archive(content)
    assert own.read(a.SCENARIO.upper().replace("\\", "/")) == TEXT
    assert own.read("plain.txt") == noise and own.read("empty") == b"" and own.read("absent") is None


def test_known_name_hashes():
    assert (a.name_hash("(hash table)", a.KEY), a.name_hash("(block table)", a.KEY)) == (0xC3AF3770, 0xEC83B3A3)


def test_explode_known_stream():
    assert a.explode(bytes.fromhex("00048224258f807f")) == b"AIAIAIAIAIAIA"


def test_sparse_runs():
    assert a.unsparse(struct.pack(">I", 9) + b"\x82abc\x01\x81xy") == b"abc\0\0\0\0xy"


def test_extract(spark):
    good = build({a.SCENARIO: (TEXT, a.COMPRESSED, a.ZLIB)})
    rows = [("m", good), ("n", b"no archive"), ("o", None), ("p", build({"other": (TEXT, 0, 0)}))]
    got = {r.map_id: r for r in a.extract(spark.createDataFrame(rows, "map_id string, content binary")).collect()}
    assert bytes(got["m"].content) == TEXT and got["m"].problem is None
    assert {k: (got[k].content, got[k].problem) for k in "nop"} == {"n": (None, "ValueError: no archive header"), "o": (None, "no file"), "p": (None, "no member")}


@pytest.mark.parametrize("codec", [a.ZLIB, a.BZIP2, a.LZMA])
def test_damaged_archives_are_reported(spark, codec):
    good = build({a.SCENARIO: (TEXT, a.COMPRESSED, codec)})
    rng = random.Random(codec)
    rows = [("cut", good[:900])]
    for k in range(40):
        bad = bytearray(good)
        for _ in range(8):
            bad[rng.randrange(544, len(bad))] ^= 1 << rng.randrange(8)
        rows.append((f"flip{k}", bytes(bad)))
    got = a.extract(spark.createDataFrame(rows, "map_id string, content binary")).collect()
    assert len(got) == len(rows) and all((r.content is None) == (r.problem is not None) for r in got) and any(r.problem for r in got)


def test_explode_refuses_coded_literals():
    with pytest.raises(ValueError, match="coded literals"):
        a.explode(bytes([1, 4, 0, 0]))
