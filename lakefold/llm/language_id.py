"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's letters are lower-cased, everything else ends a word. Every n-gram of 1 to 3 characters of a word, its ends
included, is hashed to a row of the embedding table; the mean of those rows goes through a linear softmax. A temperature
fitted on documents kept out of training calibrates the probability, and predictions below a threshold are rejected. It is
fitted on the same documents: on the probabilities of right predictions, of which at most `reject` may fall below it, and on
those of wrong ones and of the same texts with their alphabet permuted, which stand for languages that were not learned;
it is no higher than what rejects 99% of these.

Defined results: a null text, an empty text or one without a letter is `und` with score 0 and is rejected. A null
doc_id counts as fold 0 (never learned from). With no labelled document every text is `und`. Ties of probability go to
the language that sorts first. Repeated rows get equal results; other columns are ignored."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, fold_of, pieces, small_batches

UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """Code point -> lower-cased code point of a letter, or 0 for anything that is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def subwords(points: np.ndarray, bits: int) -> list[np.ndarray]:
    """For n = 1, 2, 3 the bucket of the n-gram at each position; 0 where there is none."""
    n = len(points)
    padded = np.zeros(n + 2, np.uint32)
    padded[:n] = letter_table()[points]
    out = []
    a, b, c = padded[:n], padded[1 : n + 1], padded[2 : n + 2]
    for salt, mixed, valid in (
        (1, a * np.uint32(0x9E3779B1), a > 0),
        (2, a * np.uint32(0x85EBCA77) + b * np.uint32(0xC2B2AE3D), (a > 0) | (b > 0)),
        (3, a * np.uint32(0x27D4EB2F) + b * np.uint32(0x165667B1) + c * np.uint32(0x9E3779B1), b > 0),
    ):
        h = (mixed ^ (mixed >> np.uint32(15)) ^ np.uint32(salt * 0x2545F491 & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)
        h = h >> np.uint32(32 - bits)
        out.append(np.where(valid, np.maximum(h, 1), 0))
    return out


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class LanguageModel:
    """`table` holds each bucket's embedding already multiplied by the softmax weights (row 0 is zero)."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    threshold: float = 0.0
    #: Shares that the threshold rejects: of right predictions, and of wrong ones and permuted texts.
    rejected: tuple[float, float] = (0.0, 0.0)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean logits, and the number of n-grams, over the whole of each text."""
        k = len(self.languages)
        sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for docs, parts, own in pieces(texts, overlap=2):
            joined = points_of("\n".join(parts) + "\n")
            lengths = np.array([len(p) + 1 for p in parts])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            foreign = np.flatnonzero(lengths - 1 > np.array(own))
            where = np.array(docs)
            for bucket in subwords(joined, self.bits):
                for i in foreign:  # positions that only complete n-grams of the piece before
                    bucket[starts[i] + own[i] : starts[i] + lengths[i]] = 0
                np.add.at(counts, where, np.add.reduceat((bucket > 0).astype(np.int64), starts))
                for j in range(k):
                    np.add.at(sums[:, j], where, np.add.reduceat(self.table[j][bucket], starts, dtype=np.float64))
        return sums / np.maximum(counts, 1)[:, None] + self.bias, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and rejection of every text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        scores, _ = self.logits(whole := [t or "" for t in texts])
        p = softmax(scores / self.temperature)
        best = p.argmax(1)
        known = np.array([any(map(str.isalpha, t)) for t in whole], bool) if len(whole) else np.zeros(0, bool)
        score = np.where(known, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], score, ~known | (score < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str, bool]], *, bits: int = 16, width: int = 16, epochs: int = 4, rate: float = 0.5, seed: int = 1, reject: float = 0.001) -> LanguageModel:
    """rows: (text, language, calibrate). Those marked `calibrate` fit the temperature and the threshold only.

    Besides each whole text the model sees three random stretches of it, so that short texts are learned too."""
    languages = sorted({lang for _, lang, _ in rows})
    if not languages:
        return LanguageModel([], np.zeros((0, 1 << bits), np.float32), np.zeros(0), bits)
    rng = np.random.default_rng(seed)
    examples = []
    for text, lang, calibrate in rows:
        if calibrate or not any(map(str.isalpha, text)):
            continue
        spans = [text] + [text[(a := int(rng.integers(0, len(text)))) : a + int(rng.integers(8, 200))] for _ in range(3)]
        for span in spans:
            bucket = np.concatenate([b[b > 0] for b in subwords(points_of(span), bits)])
            if len(bucket):
                unique, count = np.unique(bucket, return_counts=True)
                examples.append((unique, (count / count.sum()).astype(np.float32), languages.index(lang)))
    embed = rng.normal(0, 0.1, (1 << bits, width)).astype(np.float32)
    weights, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            unique, share, label = examples[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            hidden = share @ embed[unique]
            error = softmax(hidden @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= lr * np.outer(hidden, error)
            bias -= lr * np.float32(0.1) * error
            embed[unique] -= (lr * 20 * share)[:, None] * back
    table = np.ascontiguousarray((embed @ weights).T)
    table[:, 0] = 0
    model = LanguageModel(languages, table, bias.astype(np.float64), bits)
    held = [(t, lang) for t, lang, calibrate in rows if calibrate and any(map(str.isalpha, t))]
    if held:
        scores, _ = model.logits([t for t, _ in held])
        truth = np.array([languages.index(lang) if lang in languages else 0 for _, lang in held])
        grid = np.geomspace(0.05, 20, 61)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()))
        p = softmax(scores / model.temperature)
        right = p.argmax(1) == truth
        strange = softmax(model.logits([permuted(t, rng) for t, _ in held])[0] / model.temperature).max(1)
        other = np.concatenate([p.max(1)[~right], strange])
        if right.any():
            model.threshold = float(min(np.quantile(p.max(1)[right], reject), np.nextafter(np.quantile(other, 0.99), 2)))
            model.rejected = float((p.max(1)[right] < model.threshold).mean()), float((other < model.threshold).mean())
    return model


def permuted(text: str, rng: np.random.Generator) -> str:
    """The text with its letters exchanged for each other: words of the same lengths in no language."""
    letters = sorted({c for c in text.lower() if c.isalpha()})
    return text.lower().translate(dict(zip(map(ord, letters), rng.permutation(letters).tolist())))


def fit(docs: DataFrame, *, sample: int = 3000, folds: int = 5) -> LanguageModel:
    """Train on about `sample` labelled rows (a documented bound) outside fold 0; fold 1 of them calibrates."""
    small_batches(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != 0))
    chosen = bounded_sample(labelled.select("doc_id", "text", "lang"), sample, "doc_id").select("text", "lang", (fold_of(F.col("doc_id"), folds) == 1).alias("calibrate"), "doc_id")
    rows = sorted(((r.text, r.lang, r.calibrate) for r in chosen.collect()), key=lambda r: (r[1], r[0]))
    return train(rows)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(batch):
        lang, score, rejected = shared.value.predict(batch.column("text").to_pylist())
        yield {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), over, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs, with all their columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            _, _, rejected = shared.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array(~rejected, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
