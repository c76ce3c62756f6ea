"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmesa.llm import components, exact_dedup, simhash, substring_dedup

SF = "/root/testdata/sf0.001"
ODD = [(None, None, "a"), (5, "", "b"), (7, "  ", "c"), (3, " \t", "d"), (9, "one two", "e"), (8, "one\n two", "f"), (8, "one  two", "g"), (1, "solo", "h")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, kept string")


def test_exact_membership(odd):
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.membership(odd).collect()}
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest(), []).append(i)
    for sha, ids in groups.items():
        keep = min(i for i in ids if i is not None)
        for i in ids:
            assert got[i, sha] == (keep, len(ids), i == keep)


def test_exact_keep_one(odd):
    kept = exact_dedup.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 5, 8]
    assert exact_dedup.keep_one(odd.limit(0)).count() == 0 and exact_dedup.membership(odd.limit(0)).count() == 0


def test_bit_map_has_no_false_negatives(spark):
    hashes = spark.range(4000).select(F.sha2((F.col("id") % 3000).cast("string"), 256).alias("h"))
    words = exact_dedup.repeated_slots(hashes, "h", 16)
    flagged = hashes.distinct().withColumn("m", exact_dedup._possibly_repeated(words, F.col("h"), 16))
    repeated = hashes.groupBy("h").count().where("count > 1").join(flagged, "h")
    assert repeated.where("not m").count() == 0 and flagged.where("not m").count() > 1000


def _reachable(prints: dict[int, int], radius: int) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [2, 24])
def test_links_lose_no_pair(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = random.Random(3)
    prints = []
    for _ in range(30):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(8)]
    prints = dict(enumerate(sorted(set(prints))))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints.values()]
    found = components.connected_components(simhash.links(spark.createDataFrame(signed, "fp long")))
    label = {r.node & (2**64 - 1): r.component for r in found.collect()}
    expected = _reachable(prints, 2)
    of = {p: i for i, p in prints.items()}
    mine: dict = {}
    for p, i in of.items():
        mine.setdefault(label.get(p, ("alone", p)), set()).add(i)
    theirs: dict = {}
    for i, r in expected.items():
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_masks_cover_the_radius(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(differ & m == 0 for m in masks)


def test_fingerprint_by_definition():
    import xxhash

    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in ("", " ", "One", "One two", "Éa B\tc d e f", "a b c " * 40_000, "x y z x y z w"):
        assert simhash.fingerprint(text, 3) == slow(text)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d", 1), (4, None, 1), (2, "", 1), (3, "a b c d", 1), (9, "A b C d", 1), (7, "quite other words here", 1)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()}
    assert got == {None: 3, 4: 2, 2: 2, 3: 3, 9: 3, 7: 7}
    assert simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, x int").limit(0)).count() == 0


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(300)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for c in range(60):
        near = list(base[0])
        for _ in range(2):
            near[rng.randrange(300)] = word()
        rows.append((100 + c, " ".join(near)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(12))


def _kept_by_jaccard(rows):
    """Ids that stay when all pairs of 0.8 are linked, by comparing all of them."""
    sets, root = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if j < i and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


def _edited(rng, words, n):
    for at in rng.sample(range(len(words)), n):
        words = [*words[:at], f"new{rng.randrange(10**9)}", *words[at + 1 :]]
    return words


def test_most_near_copies_go_however_close_to_the_limit(spark):
    """Of all pairs of 0.8, without any condition on fingerprints, at least nine in ten are found, and nothing else goes."""
    rng = random.Random(3)
    rows = []
    for g in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(46, 90))]
        rows += [(2 * g + k, " ".join(w)) for k, w in enumerate((words, _edited(rng, words, 1)))]
    kept, expected = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}, _kept_by_jaccard(rows)
    assert kept >= expected and len(kept - expected) <= 0.1 * (len(rows) - len(expected))


@pytest.mark.parametrize("cell", [7, 2_000])
def test_hot_buckets_are_dealt_out(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(words if i == 40 else _edited(rng, words, 5))) for i in range(60)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == _kept_by_jaccard(rows) == {0}


def test_near_copies_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(None, "a b c d e f", 1), (4, None, 1), (2, "", 1), (9, " \t", 1), (3, "a b c d e f", 1), (8, "A b  c d e f", 1), (7, "quite other words here", 1), (6, long, 1), (5, long + " end", 1), (7, "quite other words here", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, x int").withColumnsRenamed({"x": "rank"}).withColumns({"id": F.lit("i"), "component": F.lit(0), "n": F.lit(1)})
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id or -1, r.id, r["rank"]) for r in kept.collect()) == [(-1, "i", 1), (2, "i", 1), (3, "i", 1), (5, "i", 1), (7, "i", 1), (7, "i", 1)]
    assert simhash.keep_one(frame.limit(0)).count() == 0


def test_copies_of_a_text_with_a_middle_id_go(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    rows = [(i, " ".join(words if i == 100 else _edited(rng, words, 9))) for i in range(201)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == _kept_by_jaccard(rows) == {0}


def _brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
    return out


@pytest.mark.parametrize("hot", [2, 50_000])
def test_repeated_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "PIECE", 3000)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = noise(70)
    texts = [None, "", "short", "ab" * 150, "a" * 100, noise(5000), noise(9000)]
    texts += [noise(rng.randint(0, 90)) + passage[rng.randint(0, 20) :] + noise(rng.randint(0, 90)) for _ in range(40)]
    texts += [texts[5], texts[6][2000:4000], noise(30) + texts[6][1000:1060] + noise(9)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame, ["doc_id"], length=40, hot=hot).collect()}
    for i, (kept, runs) in enumerate(_brute(texts, 40)):
        assert (bytes(got[i].kept), got[i].n_spans) == (kept, runs), i
    assert substring_dedup.remove_repeats(frame.limit(0), ["doc_id"]).count() == 0


def test_names_tell_strings_apart():
    data = np.frombuffer(b"abcabcabcabd" * 3, np.uint8)
    names = substring_dedup.names(data, 5)
    whole = data.tobytes()
    for i in range(len(names)):
        for j in range(len(names)):
            assert (names[i] == names[j]) == (whole[i : i + 5] == whole[j : j + 5])
