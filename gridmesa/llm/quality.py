"""Quality: a factorisation machine over hashed words, statistics of structure, and metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): the pairwise interactions of all features,
of low rank, in time linear in the features present. Trained by Adam on the logistic loss.

Defined results: null and empty texts have no words and zero statistics, and get a score like any other. Texts of any
length are read whole; repeated rows score equally; an empty table gives an empty result. Input columns pass through
unless named like a result, which replaces them. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmesa.llm.common import appended_schema, arrow_texts, bounded_sample, with_columns

#: At most about so many labelled documents are learned from.
SAMPLE_ROWS = 8_000
BUCKETS, RANK = 1 << 14, 8
#: Statistics of structure and metadata, after the buckets.
STATISTICS = ("upper", "digits", "punctuation", "symbols", "bars", "spaces", "word_length", "distinct_words", "repeated_lines", "line_length", "log_words", "log_chars")
WIDTH = BUCKETS + len(STATISTICS)
_MARKS = str.maketrans("", "", ".,;:!?'\"()-")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features present."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    counts = Counter(text.lower().split())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256)
    punctuation = kinds[[33, 44, 46, 58, 59, 63]].sum()
    symbols = kinds[[35, 36, 37, 38, 42, 64, 94, 95, 126]].sum()
    lines = [x for x in text.split("\n") if x]
    values = np.array([
        kinds[65:91].sum() / chars, kinds[48:58].sum() / chars, punctuation / chars, symbols / chars, kinds[124] / chars, kinds[[9, 10, 13, 32]].sum() / chars,
        min(4, len(text) / max(1, n) / 10), len(counts) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), min(4, len(text) / max(1, len(lines)) / 200), np.log1p(n) / 10, np.log1p(len(text)) / 10,
    ])
    scale = np.array([4, 10, 10, 20, 20, 2, 1, 1, 2, 1, 1, 1])
    slots = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in counts), np.int64, len(counts))
    weights = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    slots, place = np.unique(slots, return_inverse=True)
    weights = np.bincount(place, weights, len(slots))
    weights = weights / max(1e-9, np.sqrt((weights**2).sum()))  # of no words, bincount gives integers
    return np.concatenate([slots, BUCKETS + np.arange(len(STATISTICS))]), np.concatenate([weights, values * scale])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_forward(self, *_packed(rows))[0], -40, 40)))


def _packed(rows):
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return index, value, np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])


def _forward(m: Model, index, value, heads):
    scaled = m.factors[index] * value[:, None]
    sums = np.add.reduceat(scaled, heads, axis=0)
    squares = np.add.reduceat(scaled**2, heads, axis=0)
    return m.bias + np.add.reduceat(m.linear[index] * value, heads) + 0.5 * (sums**2 - squares).sum(1), sums


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    m = Model(float(np.log(share / (1 - share))), np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK)))
    first = [np.zeros(WIDTH), np.zeros((WIDTH, RANK))]
    second = [np.zeros(WIDTH), np.zeros((WIDTH, RANK))]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            index, value, heads = _packed([rows[i] for i in own])
            z, sums = _forward(m, index, value, heads)
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[own]) / len(own)
            sizes = np.diff(np.append(heads, len(index)))
            per = np.repeat(error, sizes) * value
            used, place = np.unique(index, return_inverse=True)
            grad = [np.bincount(place, per, len(used))]
            full = per[:, None] * (np.repeat(sums, sizes, axis=0) - m.factors[index] * value[:, None])
            grad.append(np.stack([np.bincount(place, full[:, f], len(used)) for f in range(RANK)], 1))
            step += 1
            m.bias -= rate * float(error.sum())
            for k, part in enumerate((m.linear, m.factors)):
                g = grad[k] + decay * part[used]
                first[k][used] = 0.9 * first[k][used] + 0.1 * g
                second[k][used] = 0.999 * second[k][used] + 0.001 * g * g
                part[used] -= rate * (0.97**epoch) * (first[k][used] / (1 - 0.9**step)) / (np.sqrt(second[k][used] / (1 - 0.999**step)) + 1e-8)
    return m


def train(labelled: DataFrame, text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, by: tuple[str, ...] = ("doc_id",)) -> Model:
    """Features are made on the executors; those of a bounded sample come to the driver."""
    rows = bounded_sample(labelled.where(F.col(label).isNotNull()).select(*dict.fromkeys([text, label, *by])), sample_rows, *by).select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"))

    def run(batches):
        for part, texts in arrow_texts(batches):
            found = [features(t) for t in texts]
            yield with_columns(part, ["y"], i=pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), v=pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary()))

    got = rows.mapInArrow(run, "y int, i binary, v binary").toPandas()
    if not len(got):
        return Model(0.0, np.zeros(WIDTH), np.zeros((WIDTH, RANK)))
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(np.float64)) for i, v in zip(got.i, got.v, strict=True)], got.y.to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score (0 to 1). No shuffle; the model has a fixed size and is broadcast."""
    keep = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in arrow_texts(batches, text):
            yield with_columns(part, keep, **{name: pa.array(shared.value.scores([features(t) for t in texts]), pa.float64())})

    return docs.mapInArrow(run, appended_schema(docs, keep, f"{name} double"))
