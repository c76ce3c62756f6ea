import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmesa.llm import ann


def _brute(rows, k):
    out = {}
    for q, v in rows:
        if q % 7 == 0:
            best = sorted((np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()), i) for i, w in rows if i != q)
            out[q] = [(i, d) for d, i in best[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=12)).tolist()) for i in range(1, 900)]
    return rows + [(i, rows[5][1]) for i in range(1000, 1060)]


def test_recall_and_exact_scores(spark, rows):
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0, shard_size=300).toPandas()
    expected = _brute(rows, 10)
    hits = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, 11)) and own.score.is_monotonic_increasing and q not in set(own.vec_id)
        true = dict(expected[q])
        for i, s in zip(own.vec_id, own.score, strict=True):
            if i in true:
                hits += 1
                assert s == pytest.approx(true[i], abs=1e-12)
    assert set(got.query_id) == set(expected) and hits >= 0.95 * 10 * len(expected)


def test_copies_rank_by_id(spark, rows):
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 1001).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [6, 1000, *range(1002, 1010)] and all(r.score == 0 for r in got)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, None, "x"), (2, [0.0, 0.0], "x"), (3, [float("nan"), 1.0], "x"), (4, [1.0, None], "x"), (5, [2.0, 0.0], "x"), (7, [float("inf"), 0.0], "x"), (14, [], "x"), (None, [1.0, 1.0], "x"), (5, [2.0, 0.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(frame, F.col("vec_id") % 7 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 5, 1.0)]
    assert ann.search(frame.limit(0), F.col("vec_id") % 7 == 0).count() == 0
