"""Language identification: multinomial naive Bayes over hashed character n-grams.

The table of log probabilities has a fixed size (buckets x languages) and is broadcast; texts are scored in batches by
gathering rows of that table and adding them up by text.

Defined results: a text that is null, empty or without any letter is `und` with score 0. Other texts, of any length, get
the likeliest learned language and its posterior probability; ties go to the first language by name. Repeated rows get
equal results. An empty table gives an empty result. Input columns pass through, unless named like a result, in which
case the result replaces them. Training with no labelled row at all leaves every text `und`. A text of over 2**19 characters
is read in pieces of that size; the one or two n-grams across each border between pieces do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmesa.llm.common import appended_schema, arrow_texts, bounded_sample, slices, with_columns

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
#: At most about so many labelled rows are learned from.
SAMPLE_ROWS = 20_000
UNDETERMINED = "und"
#: Characters handled at once; a longer text is handled piece by piece.
PIECE = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), points, np.uint32(32))


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in lower case, anything else a space, with a space after each text; where each begins."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])[:-1]]).astype(np.int64)
    return _letters()[points], starts


def _grams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram ending at each position, and whether it counts (it ends in a letter, or is a letter before a space)."""
    mixed = points.astype(np.uint64)
    rolled = np.zeros_like(mixed)
    letter = points != 32
    for order in range(1, max(ORDERS) + 1):
        shifted = np.concatenate([np.full(order - 1, 32, np.uint64), mixed[: len(mixed) - order + 1]])[: len(mixed)]
        rolled = (rolled ^ (shifted + np.uint64(order << 32))) * np.uint64(0x9E3779B97F4A7C15)
        if order in ORDERS:
            counted = letter if order == 1 else letter | np.concatenate([[False], letter[:-1]])
            yield (rolled >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), counted


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of at most about PIECE characters, the starts in them and the index of the text at each start."""
    for first, last in slices(texts, PIECE):
        group = texts[first:last]
        if len(group) == 1 and len(group[0]) > PIECE:
            for at in range(0, len(group[0]), PIECE):
                points, starts = _code_points([group[0][at : at + PIECE]])
                yield points, starts, np.array([first])
        else:
            points, starts = _code_points(group)
            yield points, starts, np.arange(first, last)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n, width = len(texts), len(self.languages)
        scores, grams, letters = np.zeros((n, width)), np.zeros(n), np.zeros(n, np.int64)
        if width:
            for points, starts, which in _pieces(texts):
                np.add.at(letters, which, np.add.reduceat(points != 32, starts, dtype=np.int64))
                for buckets, counted in _grams(points):
                    rows = self.log_prob[buckets]
                    rows[~counted] = 0
                    np.add.at(scores, which, np.add.reduceat(rows, starts, axis=0, dtype=np.float64))
                    np.add.at(grams, which, np.add.reduceat(counted, starts, dtype=np.int64))
        scores = scores + self.log_prior if width else np.zeros((n, 1))
        best = scores.argmax(1)
        top = np.exp(scores - scores.max(1, keepdims=True))
        known = letters > 0
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        return names, np.where(known, 1 / top.sum(1), 0.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, by: tuple[str, ...] = ("doc_id",), smoothing: float = 0.5) -> Model:
    """Counts the n-grams of a bounded sample of rows whose lang is not null; counting is distributed, its result has buckets x languages cells."""
    rows = labelled.where(F.col(lang).isNotNull()).select(*dict.fromkeys([text, lang, *by]))
    sample = bounded_sample(rows, sample_rows, *by).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for part, texts in arrow_texts(batches):
            langs = part.column("lang").to_pylist()
            for name in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                counts = totals.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                docs[name] = docs.get(name, 0) + len(own)
                for points, _, _ in _pieces(own):
                    for buckets, counted in _grams(points):
                        counts += np.bincount(buckets[counted], minlength=1 << BUCKET_BITS)
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(counts[used], docs[name]))], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted.lang.unique())
    table, prior = np.full((1 << BUCKET_BITS, len(languages)), smoothing), np.zeros(len(languages))
    for j, name in enumerate(languages):
        own = counted[counted.lang == name]
        docs = own.bucket == -1
        prior[j] = own.n[docs].sum()
        table[own.bucket[~docs], j] += own.n[~docs]
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32), np.log(prior / max(prior.sum(), 1)) if languages else prior)


def identify(docs: DataFrame, model: Model, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its probability. No shuffle; the model is broadcast."""
    keep = [c for c in docs.columns if c not in (predicted, score)]
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in arrow_texts(batches, text):
            names, scores = broadcast.value.predict(texts)
            yield with_columns(part, keep, **{predicted: pa.array(names, pa.string()), score: pa.array(scores, pa.float64())})

    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, appended_schema(docs, keep, f"{predicted} string, {score} double"))


def reject_unidentified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with docs' columns, whatever their names, whose language is determined with a probability of at least `least`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = identify(rows, model, "text", "language", "score")
    return found.where((F.col("language") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
