"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel of two words is the sum, over all subsequences of three characters, of the product of their weights in both;
an occurrence weighs DECAY to the power of the stretch it spans, and spans up to MAX_SPAN characters. An insult therefore
keeps most of its kernel with itself when characters are inserted, dropped or put around it. Single letters standing
apart count as one word, so spelling one out changes nothing, and a word with other characters set between its letters counts as
the letters alone, too. Kernels of under FLOOR of a landmark's own count as none.

Landmarks are the words whose share of toxic training documents most exceeds their share of the others. A word's vector
holds its kernel with each landmark, relative to the landmark's own; a sentence takes the largest over its words, and is
mapped by the inverse square root of the landmarks' kernel matrix, on the same scale (the Nystrom features). A linear support vector machine
learns from labelled sentences: those of clean documents, and of each toxic one the sentence that scores highest, chosen
anew in each round. A document scores as its highest sentence, through a logistic fit.

Only the landmarks' subsequences need to be found in a text, by one table lookup for each of ten spacings, so that time is
linear in the text and texts are read whole.

Defined results: null and empty texts score as a sentence without words. Texts over half a million characters are read in
pieces cut at white space. Repeated rows score equally; an empty table gives an empty result; input columns pass through
unless named like a result, which replaces them. Without labelled rows of both classes every score is the positive share
(0 with none).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmesa.llm.common import appended_schema, arrow_texts, bounded_sample, slices, text_or_empty, with_columns

#: At most about so many labelled documents are learned from, and so many landmarks chosen.
SAMPLE_ROWS, LANDMARKS = 8_000, 48
#: Of each document the most promising sentences are candidates in training.
SENTENCES = 6
DECAY, MAX_SPAN = 0.7, 6
#: Kernels of under so much of a landmark's own count as none.
FLOOR = 0.4
#: Landmarks exceed their expected share by at least so many standard errors.
LEAST_LIFT = 4.5
PIECE = 1 << 19
_SPACINGS = [(j, k) for k in range(2, MAX_SPAN) for j in range(1, k)]
_SYMBOLS = 63
#: Stands for a line break among words.
_BREAK = "\0"
#: Words remembered by a worker.
KNOWN_WORDS = 600_000
#: Three words of one character in a row.
_LETTERS = re.compile(r"(?<!\S)\S\s+\S\s+\S(?!\S)")
#: Characters that are no letters or digits, and such a one between two letters.
_NO_LETTERS, _SET_APART = re.compile(r"[\W_]+"), re.compile(r"[^\W_][\W_]+[^\W_]")
#: White space as str.split() has it, by code point.
_SPACES = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def _units(texts: list[str], joined_letters: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, of white space just one before each unit (a word, or a run of single letters); each one's unit, each unit's sentence, each sentence's text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join([f"\n{t}" for t in lowered]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.array([len(t) + 1 for t in lowered])
    owner = np.repeat(np.arange(len(texts)), lengths)
    space = _SPACES[np.minimum(points, len(_SPACES) - 1)]
    ends = ((points == 33) | (points == 46) | (points == 63)) & np.append(space[1:], True)
    breaks = ends | (points == 10)
    sentence = np.concatenate([[0], np.cumsum(breaks)[:-1]])
    starts = ~space & np.concatenate([[True], space[:-1]])
    at = np.flatnonzero(starts)
    if not len(at):
        return points[:0], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.cumsum(starts) - 1
    size = np.bincount(word[~space], minlength=len(at))
    joined = np.zeros(len(at), bool) if not joined_letters else np.concatenate([[False], (size[1:] == 1) & (size[:-1] == 1) & (sentence[at][1:] == sentence[at][:-1])])
    unit_of_word = np.cumsum(~joined) - 1
    first = at[~joined]
    kept, place = np.unique(sentence[first], return_inverse=True)
    head = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    mark = first - 1
    points[mark] = 32
    kept_points = ~space
    kept_points[mark] = True
    word[mark] = word[first]
    return points[kept_points], unit_of_word[word[kept_points]], place, owner[first[head]]


def _triples(word: str) -> dict[tuple[str, str, str], float]:
    """Weights of the subsequences of a word, its beginning marked by a space."""
    word = f" {word}"
    out: dict[tuple[str, str, str], float] = {}
    for j, k in _SPACINGS:
        for i in range(len(word) - k):
            u = (word[i], word[i + j], word[i + k])
            out[u] = out.get(u, 0.0) + DECAY ** (k + 1)
    return out


@dataclass
class Kernel:
    """Kernels with fixed landmarks, by lookup of their subsequences."""

    landmarks: list[str]
    symbols: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    largest: np.ndarray = field(init=False)
    gram: np.ndarray = field(init=False)
    scale: np.ndarray = field(init=False)

    def __post_init__(self):
        own = [_triples(w) for w in self.landmarks]
        scale = [sum(v * v for v in t.values()) for t in own]
        letters = sorted({c for t in own for u in t for c in u})[:_SYMBOLS]
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.symbols = np.zeros(0x110000, np.uint8)
        for c, i in code.items():
            self.symbols[ord(c)] = i
        names = sorted({u for t in own for u in t if all(c in code for c in u)})
        self.table = np.full((_SYMBOLS + 1) ** 3, -1, np.int32)
        self.weights = np.zeros((len(names), len(own)), np.float32)
        for n, u in enumerate(names):
            a, b, c = (code[x] for x in u)
            self.table[(a << 12) | (b << 6) | c] = n
            self.weights[n] = [t.get(u, 0.0) / s for t, s in zip(own, scale, strict=True)]
        self.largest = self.weights.max(1, initial=0.0)
        # Kernels of the landmarks with each other, on the same scale as those of units: relative to the second one's own.
        self.gram = np.array([[sum(v * t.get(u, 0.0) for u, v in s.items()) / q for t, q in zip(own, scale, strict=True)] for s in own])
        self.scale = np.array(scale)

    def nystrom(self) -> np.ndarray:
        """What takes a unit's kernels with the landmarks, as units() gives them, to its Nystrom features: the scale taken back, then the inverse square root of the landmarks' kernel matrix. Features of two landmarks have their kernel as inner product."""
        value, vector = np.linalg.eigh(self.gram * self.scale)
        return self.scale[:, None] * ((vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))) @ vector.T)

    def units(self, points: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
        """units x landmarks; kernels below FLOOR are 0. A first pass sums each subsequence's largest weight, a bound above every kernel of the unit; only units whose bound reaches FLOOR get vectors."""
        out = np.zeros((n, len(self.landmarks)), np.float32)
        ids = self.symbols[points].astype(np.int32)
        hits, bound = [], np.zeros(n)
        for j, k in _SPACINGS:
            if len(ids) <= k:
                break
            found = self.table[(ids[:-k] << 12) | (ids[j : j - k] << 6) | ids[k:]]
            at = np.flatnonzero(found >= 0)
            at = at[unit[at] == unit[at + k]]
            found, owner = found[at], unit[at]
            bound += np.bincount(owner, self.largest[found], n) * DECAY ** (k + 1)
            hits.append((found, owner, np.float32(DECAY ** (k + 1))))
        able = bound >= FLOOR
        for found, owner, weight in hits:
            at = np.flatnonzero(able[owner])
            if len(at):
                owner = owner[at]
                head = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
                out[owner[head]] += np.add.reduceat(self.weights[found[at]], head, axis=0) * weight
        out[out < FLOOR] = 0
        return out

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """sentences x landmarks, the largest over a sentence's units; the index of the text of each."""
        points, unit, sentence, owner = _units(texts)
        if not len(owner):
            return np.zeros((0, len(self.landmarks)), np.float32), owner
        heads = np.concatenate([[0], np.flatnonzero(np.diff(sentence)) + 1])
        return np.maximum.reduceat(self.units(points, unit, len(sentence)), heads, axis=0), owner


def _cut(text: str) -> list[str]:
    out = []
    while len(text) > PIECE:
        at = max(text.rfind(" ", 1, PIECE), text.rfind("\n", 1, PIECE))
        at = at if at > 0 else PIECE
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray  # of the landmarks' kernels, the Nystrom map multiplied in
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self.known: set[str] = set()
        self.telling: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": set(), "telling": {}}

    def _learn(self, words: set[str]) -> None:
        """Notes for words not met before whether any kernel of theirs reaches FLOOR, and the vectors of those. At most KNOWN_WORDS are remembered."""
        new = sorted(words - self.known)
        if not new:
            return
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            self.telling.clear()
        for first, last in slices(new, PIECE // 2):
            points, unit, _, _ = _units(["\n".join(new[first:last])], joined_letters=False)
            vectors = self.kernel.units(points, unit, last - first)
            # A word with other characters set between its letters also counts as the letters alone.
            bare = {i: _NO_LETTERS.sub("", w) for i, w in enumerate(new[first:last]) if _SET_APART.search(w)}
            if bare:
                points, unit, _, _ = _units(["\n".join(bare.values())], joined_letters=False)
                rows = list(bare)
                vectors[rows] = np.maximum(vectors[rows], self.kernel.units(points, unit, len(rows)))
            self.telling.update((new[first + i], vectors[i].copy()) for i in np.flatnonzero(vectors.any(1)))
        self.known.update(new)

    def _margin(self, words: list[str]) -> float:
        """The highest sentence of a text in words, line breaks being words of their own."""
        sentences: list[np.ndarray] = []
        last = None
        for i in [i for i, w in enumerate(words) if w in self.telling]:
            own = self.telling[words[i]]
            if last is not None and not any(w == _BREAK or w[-1] in ".!?" for w in words[last:i]):
                sentences[-1] = np.maximum(sentences[-1], own)
            else:
                sentences.append(own)
            last = i
        return float((np.array(sentences) @ self.weights).max()) + self.bias if sentences else self.bias

    def margins(self, texts: list[str]) -> np.ndarray:
        """Only words with a kernel of at least FLOOR tell; a text scores at least as a sentence without any, the bias."""
        out = np.full(len(texts), self.bias)
        for first, last in slices(texts, PIECE):
            lowered = [t.lower() for t in texts[first:last]]
            words = [t.replace("\n", f" {_BREAK} ").split() for t in lowered]
            self._learn(set().union(*words))
            for i, (text, own) in enumerate(zip(lowered, words, strict=True), first):
                if _LETTERS.search(text):  # single letters stand apart, which only the kernel's own units join
                    parts = [self.kernel.sentences([p])[0] for p in _cut(text)]
                    out[i] = max([float((v @ self.weights).max()) + self.bias for v in parts if len(v)], default=self.bias)
                else:
                    out[i] = self._margin(own)
        return np.maximum(out, self.bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -40, 40)))


def choose_landmarks(labelled: DataFrame, text: str, label: str, count: int, candidates: int = 3000, alike: float = 0.6) -> list[str]:
    """Words and beginnings of words whose document share among toxic rows most exceeds that among the others, in standard errors; of those alike by the kernel, the best."""
    word = F.explode(F.array_distinct(F.split(F.lower(text_or_empty(text)), r"[\s\p{Punct}]+"))).alias("w")
    words = labelled.select(F.monotonically_increasing_id().alias("d"), F.col(label).alias("y"), word).where(F.length("w").between(4, 24))
    stems = F.array_union(F.array("w"), F.transform(F.sequence(F.lit(4), F.least(F.length("w"), F.lit(9))), lambda n: F.col("w").substr(F.lit(1), n)))
    counted = words.select("d", "y", F.explode(stems).alias("w")).distinct().groupBy("w").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    toxic, total = labelled.agg(F.sum(label), F.count("*")).head()
    share = F.lit(float(toxic) / total)
    lift = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    best = [r.w for r in counted.where(lift >= LEAST_LIFT).orderBy(lift.desc(), F.length("w").desc(), "w").limit(candidates).collect()]
    chosen: list[tuple[str, dict, float]] = []
    for w in best:
        own = _triples(w)
        size = sum(v * v for v in own.values())
        if all(sum(v * t.get(u, 0.0) for u, v in own.items()) < alike * (size * z) ** 0.5 for _, t, z in chosen):
            chosen.append((w, own, size))
            if len(chosen) == count:
                break
    return [w for w, _, _ in chosen]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared hinge loss by accelerated gradient descent."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (2 * (np.linalg.norm(rows * np.sqrt(weight)[:, None], 2) ** 2 / weight.sum()) + penalty)
    w = before = np.zeros(rows.shape[1])
    for i in range(rounds):
        z = w + (i / (i + 3)) * (w - before)
        slack = np.maximum(0, 1 - y * (rows @ z))
        before, w = w, z - step * (-2 * rows.T @ (weight * slack * y) / weight.sum() + penalty * np.append(z[:-1], 0))
    return w[:-1], float(w[-1])


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, by: tuple[str, ...] = ("doc_id",), rounds: int = 4) -> Model:
    rows = bounded_sample(labelled.where(F.col(label).isNotNull()).select(*dict.fromkeys([text, label, *by])), sample_rows, *by).select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    toxic, total = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).head()
    words = choose_landmarks(rows, "text", "y", landmarks) if 0 < toxic < total else []
    if not words:
        share = toxic / total if total else 0.0
        return Model(Kernel(["none"]), np.zeros(1), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    kernel = Kernel(words)
    shared = labelled.sparkSession.sparkContext.broadcast(kernel)

    def vectors(batches):
        for part, texts in arrow_texts(batches):
            out = []
            for t in texts:
                x = np.vstack([shared.value.sentences([p])[0] for p in _cut(t)])
                x = x[np.argsort(-x.max(1), kind="stable")[:SENTENCES]] if len(x) else np.zeros((1, len(words)), np.float32)
                out.append(x.astype(np.float32).tobytes())
            yield with_columns(part, ["y"], x=pa.array(out, pa.binary()))

    got = rows.mapInArrow(vectors, "y int, x binary").toPandas()
    blocks = [np.frombuffer(b, np.float32).reshape(-1, len(words)) for b in got.x]
    owner = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    x, y = np.vstack(blocks).astype(np.float64), got.y.to_numpy()
    nystrom = kernel.nystrom()
    features = x @ nystrom
    margin = x.max(1)
    heads = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    w, b = np.zeros(len(words)), 0.0
    for _ in range(rounds):
        order = np.lexsort((-margin, owner))
        best = np.zeros(len(owner), bool)
        best[order[heads]] = True
        used = (y[owner] == 0) | best
        sign = np.where(y[owner] == 1, 1.0, -1.0)[used]
        weight = np.where(sign > 0, 1 / max(1, (sign > 0).sum()), 1 / max(1, (sign < 0).sum()))
        w, b = _svm(features[used], sign, weight)
        margin = features @ w + b
    top = np.maximum(np.maximum.reduceat(margin, heads), b)
    slope, offset = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * top + offset, -40, 40)))
        g = np.array([((p - y) * top).sum() + 1e-2 * (slope - 1), (p - y).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * top * top).sum() + 1e-2, (v * top).sum()], [(v * top).sum(), v.sum() + 1e-6]])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(h, g)
    return Model(kernel, nystrom @ w, b, float(slope), float(offset))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score (0 to 1). No shuffle; the model, of a size that its parameters bound, is broadcast."""
    keep = [c for c in docs.columns if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, texts in arrow_texts(batches, text):
            yield with_columns(part, keep, **{name: pa.array(shared.value.scores(texts), pa.float64())})

    return docs.mapInArrow(run, appended_schema(docs, keep, f"{name} double"))
