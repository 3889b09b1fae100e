"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams (n = 2, 3, 4), each an indicator. Every indicator is scaled by the log
ratio of its smoothed frequencies in the two classes, the vector is brought to unit length, and a linear hinge-loss model
is fitted to it by dual coordinate descent. A logistic curve fitted on documents kept out of training turns the margin
into a probability.

Defined results: a null text counts as empty; an empty text has no indicator and gets the model's score at its bias. With
labels of one class only the score is that class. Repeated rows get equal scores; other columns are ignored. The same
labelled text seen twice counts twice. A document labelled more than once takes each of its labels as an example."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, fold_of, pieces, small_batches

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def mark(text: str, bits: int, seen: np.ndarray) -> np.ndarray:
    """The buckets of the n-grams of the whole text, ascending; `seen` is a cleared scratch array of 2**bits flags."""
    for _, parts, _ in pieces([text], size=1 << 18, overlap=3):
        for part in parts:
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            gram = points * _MIX[0]
            for n in (2, 3, 4):
                if len(points) < n:
                    break
                gram = gram[:-1] * np.uint32(31) + points[n - 1 :] * _MIX[n - 1]
                h = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                seen[h >> np.uint32(32 - bits)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class QualityModel:
    """`scale` are the log-count ratios, `weight` the linear model's weights times `scale`."""

    scale: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, texts: list[str | None]) -> np.ndarray:
        seen = np.zeros(1 << self.bits, bool)
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            if text and len(found := mark(text, self.bits, seen)):
                norm = np.sqrt(np.square(self.scale[found]).sum())
                out[i] += self.weight[found].sum() / norm if norm > 0 else 0.0
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def train(rows: list[tuple[str, int, bool]], *, bits: int = 17, smooth: float = 1.0, cost: float = 1.0, epochs: int = 15, seed: int = 1) -> QualityModel:
    """rows: (text, label, calibrate)."""
    size = 1 << bits
    seen = np.zeros(size, bool)
    grams = [(mark(t or "", bits, seen), 1 if label else -1) for t, label, calibrate in rows if not calibrate]
    counts = {1: np.full(size, smooth), -1: np.full(size, smooth)}
    for found, y in grams:
        counts[y][found] += 1
    scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    if len({y for _, y in grams}) < 2:
        only = grams[0][1] if grams else 1
        return QualityModel(np.zeros(size), np.zeros(size), float(only), bits, 5.0, 0.0)
    vectors = []
    for found, y in grams:
        x = scale[found]
        norm = np.sqrt(np.square(x).sum())
        vectors.append((found, x / norm if norm > 0 else x, y))
    rng = np.random.default_rng(seed)
    weight, bias, alpha = np.zeros(size), 0.0, np.zeros(len(vectors))
    for _ in range(epochs):  # dual coordinate descent for the hinge loss; a constant feature 1 is the bias
        for i in rng.permutation(len(vectors)):
            found, x, y = vectors[i]
            gradient = y * (x @ weight[found] + bias) - 1
            after = min(max(alpha[i] - gradient / (x @ x + 1.0), 0.0), cost)
            if after != alpha[i]:
                step = (after - alpha[i]) * y
                weight[found] += step * x
                bias += step
                alpha[i] = after
    model = QualityModel(scale, weight * scale, bias, bits)
    held = [(t, label) for t, label, calibrate in rows if calibrate]
    if len({bool(label) for _, label in held}) == 2:
        margin, truth = model.margins([t for t, _ in held]), np.array([1.0 if label else 0.0 for _, label in held])
        slope, offset = 1.0, 0.0
        for _ in range(50):  # Newton steps for the logistic curve, lightly damped
            p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
            v = p * (1 - p) + 1e-6
            g = np.array([((p - truth) * margin).sum() + 0.1 * (slope - 1), (p - truth).sum()])
            h = np.array([[(v * margin * margin).sum() + 0.1, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
            d = np.linalg.solve(h, g)
            slope, offset = slope - 0.7 * d[0], offset - 0.7 * d[1]
        model.slope, model.offset = float(max(slope, 1e-3)), float(offset)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, folds: int = 5) -> QualityModel:
    """Train on about `sample` labelled documents (a documented bound) outside fold 0; fold 1 of them calibrates."""
    marks = labels.select(F.col("doc_id").alias("labelled_id"), "quality").where(F.col("quality").isNotNull() & (fold_of(F.col("doc_id"), folds) != 0))
    chosen = bounded_sample(marks, sample, "labelled_id")
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").where(fold_of(F.col("doc_id"), folds) != 0)
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))  # of bounded size
    rows = joined.select("text", "quality", (fold_of(F.col("doc_id"), folds) == 1).alias("calibrate")).collect()
    return train(sorted((r.text or "", int(r.quality), r.calibrate) for r in rows))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(batch):
        s = shared.value.score(batch.column("text").to_pylist())
        yield {"doc_id": batch.column("doc_id"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32), pa.int32())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), over, "doc_id long, score double, predicted int")
