"""Toxicity by a subsequence string kernel machine with Nyström landmarks.

Two words are as similar as the subsequences of three characters they share, gaps
allowed and charged by length, so inserted or changed characters and other endings leave
an insult close to itself. Landmark words span the feature space; a document's value for
a landmark is that of its most similar word. A linear support vector machine over the
whitened values, calibrated to probabilities, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

#: Labelled documents of each class, by order of a hash, that training reads at most.
TRAIN = 2_000
#: Characters that it reads of one document at most.
TRAIN_CHARS = 100_000
#: Landmarks: words that tell the classes apart, and their largest similarity.
TELLING, ALIKE = 56, 0.85
#: Largest step between characters of a subsequence, and what each character spanned costs.
STEP, DECAY = 3, 0.6
#: Similarities below it are no sign of anything and count as 0.
LEAST = 0.5
#: Pieces a worker remembers before it starts afresh.
REMEMBERED = 700_000
GAPS = [(a, b) for a in range(1, STEP + 1) for b in range(1, STEP + 1)]


def reduced(piece: str) -> str:
    """A word's letters and digits."""
    return piece if piece.isalnum() else "".join(c for c in piece if c.isalnum())


def pieces_of(text: str) -> set[str]:
    """Distinct lower-case pieces between blanks; letters that stand alone one after
    another are a piece too (``s p a c e d``)."""
    pieces = text.lower().split()
    single = bytes([len(p) == 1 for p in pieces])
    found, at = set(pieces), single.find(b"\1\1\1")
    while at >= 0:
        end = single.find(b"\0", at)
        end = len(single) if end < 0 else end
        found.add("".join(pieces[at:end]))
        at = single.find(b"\1\1\1", end)
    return found


def words_of(text: str) -> set[str]:
    return {reduced(p) for p in pieces_of(text)} - {""}


def _codes(word: str) -> np.ndarray:
    data = np.frombuffer(f"^{word}$".encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((data * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int64)


def subsequences(word: str) -> dict[int, float]:
    """Weights of a word's gapped subsequences of three characters."""
    c, found = _codes(word), {}
    for a, b in GAPS:
        weight = DECAY ** (a + b + 1)
        n = len(c) - a - b
        if n > 0:
            for code in (c[:n] << 12 | c[a : a + n] << 6 | c[a + b :]).tolist():
                found[code] = found.get(code, 0.0) + weight
    return found


def _norm(weights: dict[int, float]) -> float:
    return math.sqrt(sum(w * w for w in weights.values())) or 1.0


@dataclass
class Landmarks:
    """Normalised landmark words: rows of weights by subsequence."""

    words: list[str]

    def __post_init__(self):
        spelled = [subsequences(w) for w in self.words]
        used = sorted({code for s in spelled for code in s})
        self.row = np.zeros(1 << 18, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.weights = np.zeros((len(used) + 1, len(self.words)))
        for n, s in enumerate(spelled):
            norm = _norm(s)
            for code, weight in s.items():
                self.weights[self.row[code], n] = weight / norm
        # unit weight of the best landmark, to bound a word's similarity to all
        self.most = self.weights.max(1)[self.row] if self.words else np.zeros(1 << 18)

    def kernel(self, word: str) -> np.ndarray:
        own = subsequences(word)
        rows = self.row[np.fromiter(own, np.int64, len(own))]
        return np.fromiter(own.values(), float, len(own)) @ self.weights[rows] / _norm(own)

    def gram(self) -> np.ndarray:
        return np.stack([self.kernel(w) for w in self.words])

    def close(self, words: list[str]) -> dict[str, np.ndarray]:
        """Words similar to some landmark, with their similarities. A bound over all
        landmarks at once, computed for all words together, leaves few to be computed."""
        words = [w for w in words if w]
        if not words or not self.words:
            return {}
        text = "".join(f"^{w}$" for w in words)
        c = ((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(2654435761)) >> np.uint32(26)).astype(np.int64)
        size = np.array([len(w) + 2 for w in words])
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(c))  # characters to the word's end
        total = np.zeros(len(c))
        norm = np.zeros(len(words))
        for a, b in GAPS:
            n = len(c) - a - b
            if n <= 0:
                continue
            weight = DECAY ** (a + b + 1)
            total[:n] += weight * self.most[c[:n] << 12 | c[a : a + n] << 6 | c[a + b :]] * (left[:n] > a + b)
            norm += weight * weight * np.maximum(size - a - b, 0)
        bound = np.add.reduceat(total, np.r_[0, ends[:-1]]) / np.sqrt(np.maximum(norm, 1e-12))
        found = {}
        for n in np.flatnonzero(bound >= LEAST).tolist():
            k = self.kernel(words[n])
            if k.max() >= LEAST:
                found[words[n]] = np.where(k >= LEAST, k, 0.0)
        return found


class Reader:
    """A worker's memory of pieces: those close to landmarks, and those that are not."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.near, self.known = landmarks, {}, set()

    def values(self, texts: list[str]) -> np.ndarray:
        """For each text and landmark, the largest similarity of a word."""
        out = np.zeros((len(texts), len(self.landmarks.words)))
        for at in range(0, len(texts), 200):
            sets = [pieces_of(t) for t in texts[at : at + 200]]
            new = set().union(*sets) - self.known
            if len(self.known) + len(new) > REMEMBERED:
                self.near, self.known = {}, set()
                new = set().union(*sets)
            words = {piece: reduced(piece) for piece in new}
            close = self.landmarks.close(list(set(words.values())))
            self.near.update((p, close[w]) for p, w in words.items() if w in close)
            self.known |= new
            for n, pieces in enumerate(sets):
                hits = [self.near[p] for p in pieces & self.near.keys()]
                if hits:
                    out[at + n] = np.max(hits, axis=0)
        return out


# --- training -----------------------------------------------------------------------


def choose_landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Words far more frequent in toxic texts, none too similar to another."""
    counts = [Counter(), Counter()]
    for text, label in zip(texts, toxic, strict=True):
        counts[int(label)].update(words_of(text))
    n = [max(int((toxic == y).sum()), 1) for y in (0, 1)]

    def telling(word):
        p, q = (counts[1][word] + 0.5) / (n[1] + 1), (counts[0][word] + 0.5) / (n[0] + 1)
        return (p - q) / math.sqrt(p * (1 - p) / n[1] + q * (1 - q) / n[0])

    common = [w for w, c in counts[1].items() if c >= 2 and c * n[0] > 3 * (counts[0][w] + 0.5) * n[1]]
    chosen: dict[str, tuple[dict[int, float], float]] = {}
    for word in sorted(common, key=lambda w: (-telling(w), w))[: 20 * TELLING]:
        own = subsequences(word)
        norm = _norm(own)
        alike = (sum(w * other.get(c, 0.0) for c, w in own.items()) / norm / n for other, n in chosen.values())
        if len(chosen) < TELLING and all(k < ALIKE for k in alike):
            chosen[word] = own, norm
    return list(chosen)


@dataclass
class Model:
    landmarks: Landmarks
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, values: np.ndarray) -> np.ndarray:
        margin = values @ self.whiten @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """Train on labelled texts; ``share`` is the toxic share of all labelled rows.

    Without texts of both classes every score is that share.
    """
    if len(set(toxic.tolist())) < 2:
        return Model(Landmarks([]), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, math.log((share + 1e-9) / (1 - share + 1e-9)))
    landmarks = Landmarks(choose_landmarks(texts, toxic))
    if not landmarks.words:
        return fit(texts, np.zeros_like(toxic), share)
    values = Reader(landmarks).values(texts)
    size, turn = np.linalg.eigh(landmarks.gram() / 2 + landmarks.gram().T / 2)
    whiten = turn / np.sqrt(np.maximum(size, 1e-2))
    x = np.c_[values @ whiten, np.ones(len(values))]
    y = np.where(toxic == 1, 1.0, -1.0)
    even = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
    w, ridge = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(50):  # Newton steps on the squared hinge loss
        act = y * (x @ w) < 1
        xa = x[act] * even[act, None]
        new = np.linalg.solve(xa.T @ x[act] + ridge, xa.T @ y[act])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    m = np.c_[x @ w, np.ones(len(x))]
    real = np.where(toxic == 1, share / (toxic == 1).sum(), (1 - share) / (toxic == 0).sum())
    ab = np.zeros(2)
    for _ in range(50):  # Newton steps on the logistic loss of the margins
        p = 1 / (1 + np.exp(-np.clip(m @ ab, -30, 30)))
        grad = m.T @ (real * (p - (toxic == 1))) + 1e-4 * ab
        hess = (m * (real * p * (1 - p))[:, None]).T @ m + 1e-4 * np.eye(2)
        ab = ab - np.linalg.solve(hess, grad)
    return Model(landmarks, whiten, w[:-1], float(w[-1]), float(ab[0]), float(ab[1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most TRAIN documents of each class among the rows of ``labels``."""
    rows = labels.filter("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = sampled(rows.filter("toxic in (0, 1)"), "toxic", TRAIN, docs, TRAIN_CHARS).toPandas()
    sample = sample.sort_values(["doc_id", "toxic"])
    share = counts.get(1, 0) / max(counts.get(0, 0) + counts.get(1, 0), 1)
    return fit(sample["text"].fillna("").tolist(), sample["toxic"].to_numpy(int), share)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs``.

    The text alone decides. Null and empty texts are texts without words and get the
    score of such; repeated rows are scored one by one, very long texts whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value.landmarks)
        for texts in batches:
            yield pd.Series(shared.value.scores(reader.values(texts.tolist())))

    rows = docs.select("doc_id", scored(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
