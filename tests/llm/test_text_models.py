"""Language ID, toxicity and quality: held-out accuracy, and the defined results of odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmesa.llm import language_id, quality, toxicity
from gridmesa.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labelled(spark, docs):
    return docs.select("doc_id", "text").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "12 !! 3", 3), (3, "The heer and. " * 60_000, 4), (4, "The heer and", 5), (4, "The heer and", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


def test_language_held_out(docs):
    model = language_id.train(docs.where(fold(4) != 2))
    held = language_id.identify(docs.where(fold(4) == 2), model)
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()


def test_language_odd_rows(docs, odd):
    model = language_id.train(docs)
    rows = language_id.identify(odd, model).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "en", "en"]
    assert [r.score for r in rows[:3]] == [0, 0, 0] and rows[3].score > 0.5 and rows[4] == rows[5]
    assert language_id.identify(odd.limit(0), model).count() == 0
    assert language_id.reject_unidentified(odd, model).count() == 3
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(docs.limit(0))).collect()} == {"und"}


def test_language_pieces_sum_to_whole():
    model = language_id.Model(["a", "b"], np.random.default_rng(0).normal(size=(1 << language_id.BUCKET_BITS, 2)).astype(np.float32), np.zeros(2))
    texts = ["ab cd", "", "é è", "x" * 50]
    one = [model.predict([t]) for t in texts]
    names, scores = model.predict(texts)
    assert names == [o[0][0] for o in one] and np.allclose(scores, [o[1][0] for o in one])


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("operator", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(labelled, operator, label, least):
    model = operator.train(labelled.where(fold(5) != 0), label=label)
    held = operator.score(labelled.where(fold(5) == 0), model).toPandas()
    assert _auc(held.score.to_numpy(), held[label].to_numpy()) >= least


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_rows(labelled, odd, operator, label):
    model = operator.train(labelled, label=label)
    rows = operator.score(odd, model).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score and rows[4] == rows[5]
    assert operator.score(odd.limit(0), model).count() == 0
    assert operator.score(odd, operator.train(labelled.limit(0), label=label)).count() == 6


def test_gapped_insults_keep_their_kernel():
    kernel = toxicity.Kernel(["scoundrel", "numbskull"])
    best = lambda t: kernel.sentences([t])[0].max(0)
    assert best("you scoundrel there")[0] == pytest.approx(1)
    assert best("you s c o u n d r e l there")[0] == pytest.approx(1)
    assert best("you scouxndrel")[0] > 0.5 and best("you s.coundr.el")[0] > 0.4
    assert best("the houses stand")[0] == 0


def test_characters_between_all_letters_change_nothing():
    kernel = toxicity.Kernel(["scoundrel", "numbskull"])
    model = toxicity.Model(kernel, np.ones(2), 0.0, 1.0, 0.0)
    plain = model.margins(["you scoundrel there"])[0]
    assert model.margins(["you s.c.o.u.n.d.r.e.l there", "you s*c*o*u*n*d*r*e*l, there", "no such word here"]).tolist() == [pytest.approx(plain), pytest.approx(plain), 0.0]


def test_landmarks_have_one_kernel_on_both_sides():
    kernel = toxicity.Kernel(["scoundrel", "numbskull", "trash"])
    features = kernel.gram @ kernel.nystrom()
    for i, a in enumerate(kernel.landmarks):
        for j, b in enumerate(kernel.landmarks):
            exact = sum(v * toxicity._triples(b).get(u, 0.0) for u, v in toxicity._triples(a).items())
            assert features[i] @ features[j] == pytest.approx(exact, abs=1e-9)


def test_kernel_equals_enumeration():
    kernel = toxicity.Kernel(["scum", "trash"])
    for word in ("scum", "scxum", "trrash", "mucs", "tr-as-h"):
        own = toxicity._triples(word)
        for i, z in enumerate(kernel.landmarks):
            t = toxicity._triples(z)
            exact = sum(v * t.get(u, 0.0) for u, v in own.items()) / sum(v * v for v in t.values())
            found = kernel.sentences([word])[0][0, i]
            assert found == pytest.approx(exact if exact >= toxicity.FLOOR else 0, rel=1e-4)


def test_factorisation_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, quality.RANK)))
    index, value = np.array([3, 70, 900, quality.BUCKETS]), np.array([0.5, -1.0, 2.0, 0.25])
    z = model.bias + (model.linear[index] * value).sum() + sum(model.factors[index[i]] @ model.factors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert model.scores([(index, value)])[0] == pytest.approx(1 / (1 + np.exp(-z)))
