"""The pipeline's stages against brute force, each on what its predecessor kept."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridmesa.llm import token_counts
from tests.llm.test_dedup import _brute, _kept_by_jaccard

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{root}/{k}")
        frames.append(spark.read.parquet(f"{root}/{k}"))
    return frames


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay_until_the_last(stages):
    assert all(f.columns == stages[0].columns for f in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = _texts(stages[0]), _texts(stages[1])
    assert all(any(c.isalpha() for c in t or "") for t in after.values())
    assert len(after) >= 0.99 * sum(any(c.isalpha() for c in t or "") for t in before.values())


def test_exact_copies_go(stages):
    groups = {}
    for i, t in _texts(stages[1]).items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    assert set(_texts(stages[2])) == {min(ids) for ids in groups.values()}


def test_near_copies_go(stages):
    """All pairs that share 0.8 of their five-word shingles, without a condition on fingerprints."""
    before, after = _texts(stages[2]), set(_texts(stages[3]))
    expected = _kept_by_jaccard(sorted(before.items()))
    assert after >= expected and len(after - expected) <= 0.1 * (len(before) - len(expected))


def test_repeated_passages_go(stages):
    before, after = _texts(stages[3]), _texts(stages[4])
    ids = sorted(before)
    assert ids == sorted(after)
    for i, (kept, _) in zip(ids, _brute([before[i] for i in ids], 200), strict=True):
        assert after[i] == kept.decode("utf-8", "ignore")
    assert stages[4].where(F.col("n_chars") != F.length("text")).count() == 0


def test_packing_holds_every_token(stages):
    encode = token_counts.tokenizer_encoder(public_tokenizers.path("piece_bpe_32k.model"))
    ids = {i: encode([t])[0] for i, t in _texts(stages[4]).items()}
    found = {}
    for r in stages[5].orderBy("doc_id", "piece").collect():
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert found == {i: x for i, x in ids.items() if x}


def test_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table and clashing names in every stage."""
    long = "Words of the old house and the river. " * 20_000
    names = ["spans", "row", "text_key", "_text", "kept", "_sha256", "_place", "lang_pred", "id", "rank", "component", "n", "key", "salt", "piece", "bucket", "score", "language", "sha256", "digest"]
    texts = [(1, None), (2, ""), (3, "The house by the river is old and the garden is green."), (3, "The house by the river is old and the garden is green."), (4, "The house by  the river is old and the garden is green."), (5, long), (None, "The garden of the king and the queen was open to all of them.")]
    texts = [(i - 1000 if i else i, t) for i, t in texts]  # no other document has such ids
    frame = spark.createDataFrame([(i, t, *[k * 10 + (i or 0) for k in range(len(names))]) for i, t in texts], "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    train = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    docs = frame.withColumn("lang", F.lit("en")).unionByName(train, allowMissingColumns=True)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if k < 4:
            assert out.columns == docs.columns, name
            rows = {(r.doc_id, r[names[0]]): r for r in out.where("spans IS NOT NULL").collect()}
            assert all(r[c] == j * 10 + (r.doc_id or 0) for r in rows.values() for j, c in enumerate(names)), name
            ids = sorted(-1 if i is None else i + 1000 for i, _ in rows)
            assert ids == {0: [-1, 3, 4, 5], 1: [-1, 1, 3, 5], 2: [-1, 1, 3, 5], 3: [-1, 1, 2, 3, 4, 5]}[k], name
        else:
            assert out.where("doc_id IN (-999, -998)").count() == 0 and out.where("doc_id = -997").count() == 2


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5].collect()))
