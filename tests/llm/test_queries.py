"""Every registered corpus query against its contract, on a small table."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from gridmesa.llm import queries, token_counts
from tests.llm.test_dedup import _brute, _reachable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _held_out(i, divisor, rest):
    return zlib.crc32(str(i).encode()) % divisor == rest


@pytest.mark.parametrize(("name", "least"), [("op1_toxicity", 0.5), ("op3_quality", 0.3)])
def test_scores(spark, texts, name, least):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least) and r.held_out == _held_out(r.doc_id, 5, 0)


def test_packing(spark, texts):
    rows = queries.QUERIES["op2_packing"](spark, SF).toPandas()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    size = {i: len(library.encode(t)) for i, t in texts.items()}
    assert rows.groupby("doc_id").n.sum().to_dict() == {i: n for i, n in size.items() if n}
    assert not rows.duplicated(["bucket", "batch", "slot"]).any() and ((rows.slot + 1) * rows.bucket <= 65_536).all() and (rows.n <= rows.bucket).all() and rows.bucket.nunique() <= 16


def test_language(spark, texts):
    """Against naive Bayes spelt out with dictionaries of strings instead of hashed buckets."""
    rows = {r.doc_id: r for r in queries.QUERIES["op4_language_id"](spark, SF).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def grams(text):
        points = "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        for i, c in enumerate(points):
            for n in (1, 2, 3):
                gram = ("  " + points)[i + 3 - n : i + 3]
                if c != " " or (n > 1 and i and points[i - 1] != " "):
                    yield gram

    counts: dict = {}
    prior: Counter = Counter()
    for i, t in texts.items():
        if lang[i] is not None and not _held_out(i, 4, 2):
            counts.setdefault(lang[i], Counter()).update(grams(t))
            prior[lang[i]] += 1
    kinds = len(set().union(*counts.values()))
    agree = known = 0
    for i, t in texts.items():
        assert rows[i].held_out == _held_out(i, 4, 2) and 0 <= rows[i].score <= 1
        if not any(c.isalpha() for c in t):
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0)
            continue
        own = Counter(grams(t))
        score = {x: np.log(prior[x]) + sum(n * np.log((c[g] + 0.5) / (c.total() + 0.5 * kinds)) for g, n in own.items()) for x, c in counts.items()}
        known += 1
        agree += rows[i].lang_pred == max(sorted(score), key=score.get)
    assert set(rows) == set(texts) and agree >= 0.99 * known


def test_nearest(spark):
    rows = queries.QUERIES["op5_ann"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    usable = {r.vec_id: np.array(r.embedding, float) for r in table if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    hits = total = 0
    for q in [i for i in usable if i % 100 == 0]:
        own = rows[rows.query_id == q].sort_values("rank")
        true = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        assert own["rank"].tolist() == list(range(1, len(true) + 1)) and list(zip(own.score, own.vec_id, strict=True)) == sorted(zip(own.score, own.vec_id, strict=True))
        assert all(s == pytest.approx(float(np.sqrt(((usable[q] - usable[i]) ** 2).sum())), abs=1e-12) for i, s in zip(own.vec_id, own.score, strict=True))
        hits += len({i for _, i in true} & set(own.vec_id))
        total += len(true)
    assert hits >= 0.9 * total


def test_counts(spark, texts):
    count = token_counts.tokenizer_counter(public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.QUERIES["op6_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(t.encode()), n, n > 4096) for (i, t), n in zip(texts.items(), count(list(texts.values())), strict=True)}


def test_fingerprints(spark, texts):
    import xxhash

    rows = {r.doc_id: r for r in queries.QUERIES["op7_simhash"](spark, SF).collect()}
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert rows[i].fingerprint == f"{prints[i]:016x}"
    assert {i: r.component_id for i, r in rows.items()} == _reachable(prints, 2)


def test_bpe(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = queries.QUERIES["op8_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_exact(spark, texts):
    sha = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest() for i, t in texts.items()}
    groups: dict = {}
    for i, s in sha.items():
        groups.setdefault(s, []).append(i)
    rows = queries.QUERIES["op9_exact_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == {i: (min(groups[s]), len(groups[s]), i == min(groups[s]), s) for i, s in sha.items()}


def test_repeats(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op10_substring_dedup"](spark, SF).collect()}
    for (i, t), (kept, runs) in zip(texts.items(), _brute(list(texts.values()), 200), strict=True):
        size = len(t.encode())
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (size, size - len(kept), runs, hashlib.sha256(kept).hexdigest())
