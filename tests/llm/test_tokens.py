"""Token counts, byte-level BPE and packing."""

import base64
import itertools
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridmesa.llm import byte_bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "  two  spaces\n\n", "It's 3,000 naïve cafés — 日本語 😀 <|endoftext|>", "x" * 400, "The and. " * 3000, "don't stop now\u0085", "áb ½ Ⅷ ١٢"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS + TEXTS[3:5])], "doc_id long, text string, n_tokens int")


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_equal_the_library(docs, name):
    path = public_tokenizers.path(name)
    count = token_counts.tokenizer_counter(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, limit=100).collect()}
    for i, t in enumerate(TEXTS + TEXTS[3:5]):
        n = count([t or ""])[0]
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_cache_encodes_only_misses(spark, docs, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts.count_tokens(docs, path, cache).collect()))
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})
    more = docs.unionByName(spark.createDataFrame([(99, "quite new", 1)], docs.schema))
    again = sorted(map(tuple, token_counts.count_tokens(more, path, cache).collect()))
    assert again[:-1] == first and spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1
    token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("words", [0, 5000])
def test_bpe_equals_tiktoken_and_round_trips(docs, library, words):
    frame = docs.withColumnsRenamed({"n_tokens": "decoded"})
    for r in byte_bpe.encode_bytes(frame, RANKS, public_tokenizers.PATTERN, ["doc_id", "decoded"], words=words).collect():
        text = (TEXTS + TEXTS[3:5])[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == (len(ids), np.array(ids, "<u4").tobytes(), text.encode())
    assert byte_bpe.encode_bytes(frame.limit(0), RANKS, public_tokenizers.PATTERN, ["doc_id"], words=words).count() == 0


def test_bpe_ids_and_decoding(spark, docs, library):
    codec = byte_bpe.Codec(spark, RANKS)
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, ["doc_id"], words=5000)
    for r in encoded.select("doc_id", "ids", byte_bpe.decode(F.col("ids"), codec).alias("bytes")).collect():
        text = (TEXTS + TEXTS[3:5])[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.bytes) == text.encode()


def test_bpe_of_long_words(spark, library):
    rng = random.Random(2)
    alphabet = ["ab", "e t".replace(" ", ""), "the", "ing", "q", "z", "ß", "日本", "tion"]
    texts = ["=" * 9000, "hahah" * 1500, "abcdefg" * 900, "".join(rng.choice(alphabet) for _ in range(4000)), "".join(rng.choice("etaoinshrdlu") for _ in range(700)), "Ã" * 3000, "-" * 65, "x" * 127, "y" * 129]
    texts += ["".join(rng.choice(alphabet + [chr(rng.randrange(0x4E00, 0x9FFF))]) for _ in range(rng.randrange(30, 300))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in byte_bpe.encode_bytes(frame, RANKS, public_tokenizers.PATTERN, ["doc_id"], words=0).collect():
        assert bytes(r.ids) == np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes(), r.doc_id


def test_bpe_of_a_megabyte_without_a_break(spark, library):
    rng = random.Random(3)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20))
    began = time.monotonic()
    (r,) = byte_bpe.encode_bytes(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN, ["doc_id"]).collect()
    assert time.monotonic() - began < 60
    assert bytes(r.decoded) == text.encode() and r.n_tokens == len(bytes(r.ids)) / 4
    cut = text[: 1 << 14]
    assert np.frombuffer(bytes(r.ids), "<u4")[:2000].tolist() == library.encode_ordinary(cut)[:2000]


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(np.arange(1, 30), n, replace=False)), rng.integers(1, 9, n)
        cost = lambda bs: sum(c * (min(b for b in bs if b >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(cost((*c, lengths[-1])) for m in range(min(k, n)) for c in itertools.combinations(lengths[:-1].tolist(), m))
        found = packing.optimal_boundaries(lengths, counts, k)
        assert len(found) <= k and cost(found) == best


PIECE = public_tokenizers.path("piece_bpe_32k.model")


def test_packing_keeps_every_token(spark):
    rows = [(None, "a b"), (None, "a b"), (None, "c d e f"), (1, None), (2, ""), (3, "w " * 25), (4, "x y z"), (4, "x y z")] + [(i, "t " * (i % 17)) for i in range(10, 200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    got = packing.pack_texts(docs, PIECE, max_len=10, buckets=4, budget=30, rows_per_chunk=20).toPandas()
    encode = token_counts.tokenizer_encoder(PIECE)
    assert sorted(map(tuple, got.ids)) == sorted(tuple(ids[at : at + 10]) for ids in encode([t or "" for _, t in rows]) for at in range(0, len(ids), 10))
    assert (got.n == got.ids.map(len)).all() and (got.start == 10 * got.piece).all() and (got.padding == got.bucket - got.n).all() and (got.padding >= 0).all()
    assert not got.duplicated(["bucket", "batch", "slot"]).any() and ((got.slot + 1) * got.bucket <= 30).all()
    for bucket, own in got.groupby("bucket"):
        assert own.batch.nunique() == own.batch.max() + 1 == -(-len(own) // (30 // bucket))
    numbers = packing.pack(packing.sized(docs, PIECE), max_len=10, buckets=4, budget=30, rows_per_chunk=20).toPandas()
    key = ["n", "bucket", "batch", "slot"]
    assert sorted(map(tuple, numbers[key].to_numpy())) == sorted(map(tuple, got[key].to_numpy()))
    assert packing.pack_texts(docs.limit(0), PIECE).count() == 0 and packing.pack(packing.sized(docs.limit(0), PIECE)).count() == 0


def test_packing_of_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "word and " * 200_000), (2, "x" * 500_000)], "doc_id long, text string")
    got = packing.pack_texts(docs, PIECE).toPandas()
    for i, ids in zip((1, 2), token_counts.tokenizer_encoder(PIECE)([r.text for r in docs.orderBy("doc_id").collect()]), strict=True):
        own = got[got.doc_id == i].sort_values("piece")
        assert [x for part in own.ids for x in part] == ids
