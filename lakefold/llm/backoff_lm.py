"""Stupid-backoff scores, computed relationally.

With c the counts over all documents, a word scores c(u v w) / c(u v) if the n-gram (u v w) has been counted, and otherwise
`alpha` times its score with a shorter history, down to c(w) divided by all words. Logs are summed; `mean_log` divides by
the number of words. The model holds all words and all n-grams, those counted once too; they are named by 64-bit hashes.

The log of a quotient is a difference, so a document's score is a sum of logs of counts of its n-grams, less those of their
histories. As the scored documents are the counted ones, every n-gram of theirs has been counted: only a first word, which
has one start sign before it, uses a shorter history.

All n-grams of a history stand in one hash partition, (history, word, document) a row, so the same shuffle gives the
count tables of n-grams and of histories, and joins them to the n-grams of the documents: both counts are sums over the
sorted partition. A history's last place in a text counts too, as a row without a word. The shuffle is done in `rounds`,
each for its part of the histories; what one leaves on disk is gone before the next, so disk holds one part at a time.

Heavy n-grams and histories, those with more than a fixed share of all words, are no keys of that shuffle. Which ones they are
comes from a sample of bounded size, in which one with that share is found some 40 times and 20 are enough; which are missed, or
taken without need, decides only where they are counted. Tasks of the first round count the listed ones in all texts, and the
sums, exact, are broadcast to the last round, which adds their logs to the documents; a single round is followed by a pass for
that. N-grams that are rarer than their heavy history are partitioned by their own name, and only the history's count is taken
from there. What adds nothing, such as the words of a history that only one word follows, ends at the window.

Defined results: a null text is empty; a text without words has n_words 0, log_score 0 and a null mean. Rows of one
doc_id are one document, null ids too. Words are runs of anything but white space. Very long texts are read whole.
Repeated rows add to the counts. An empty table gives an empty result. Other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import passing, small_batches, stored
from .shingles import mixed, word_hashes

ALPHA = 0.4
#: Heavy names are counted with more than this share of all words, so there are about 131,072 of a kind at most.
HEAVY_SHARE = 1 / (1 << 16)
ROUNDS = 2
#: Bytes of text, about, in which heavy names are looked for; of texts beyond LONG characters, parts of that length are drawn.
SAMPLE = 1 << 24
LONG = 1 << 16
#: The start sign, and odd factors of the places in an n-gram.
_START = np.array([0x5851F42D4C957F2D], np.uint64)
_PLACE = np.random.default_rng(31).integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)
#: In place of a word: the end of a text, an n-gram that is its own key, a task's count of a heavy name, and what a
#: document's score has besides.
END, ALONE, HEAVY, FIXED, WORDS = -1, -2, -3, -4, -5


def names(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """A 64-bit name of each tuple of word hashes; tuples of another length, or with another salt, have other names."""
    out = np.full(len(parts[0]), salt * 8 + len(parts), np.uint64)
    for k, part in enumerate(parts):
        out += part * _PLACE[k]
    return mixed(out).view(np.int64)


#: The history of a first word.
_FIRST = mixed(_START).view(np.int64)[0]


@dataclass
class Grams:
    """Texts one after the other, each as its start sign and its words.

    history[i] ends with place i and is the history of the next word; gram[i] is the n-gram that word i makes of its own, and
    means nothing at a start. A first word has the start sign as its history, whatever the order."""

    document: np.ndarray
    word: np.ndarray
    history: np.ndarray
    gram: np.ndarray
    starts: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], len(self.word)) - 1

    @property
    def words(self) -> np.ndarray:
        """Places of words."""
        out = np.ones(len(self.word), bool)
        out[self.starts] = False
        return np.flatnonzero(out)


def grams_of(texts: list[str | None], order: int) -> Grams:
    lines = [" ".join(t.split()) if t else "" for t in texts]
    # A space and a sign of its own before each text: the sign is a word, whose hash is replaced by that of the start.
    hashes = word_hashes(" ".join(f"\x02 {line}" for line in lines))
    lengths = np.array([line.count(" ") + 2 if line else 1 for line in lines])
    starts = np.cumsum(lengths) - lengths
    hashes[starts] = _START[0]
    back = np.roll(hashes, 1)
    history = names([hashes], 0) if order == 2 else names([back, hashes], 0)
    history[starts] = _FIRST
    gram = names([back, hashes], 1)
    if order == 3:
        firsts = np.minimum(starts + 1, len(hashes) - 1)
        short = gram[firsts]
        gram = names([np.roll(hashes, 2), back, hashes], 1)
        gram[firsts] = short
    return Grams(np.repeat(np.arange(len(texts)), lengths), hashes, history, gram, starts)


def batches_of(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about `most` characters, with the number of the first."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > most or k - first >= 128:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


class Heavy:
    """Names, ascending, and the logs of their counts once these are known."""

    def __init__(self, name: np.ndarray, n: np.ndarray | None = None) -> None:
        by = np.argsort(name)
        self.name, self.log_n = name[by], None if n is None else np.log(n[by])
        # 16 to 32 slots a name by leading bits; a name whose slot is empty is certainly not held.
        self.shift = np.uint64(64 - max(8, (16 * len(name)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), bool)
        self.slots[name.view(np.uint64) >> self.shift] = True

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which names are held, and for each of those its place here."""
        held = self.slots[names.view(np.uint64) >> self.shift]
        likely = np.flatnonzero(held)
        few = names[likely]
        at = np.minimum(np.searchsorted(self.name, few), max(0, len(self.name) - 1))
        right = self.name[at] == few
        held[likely] = right
        return held, at[right]


def heavy_names(texts: DataFrame, order: int, share: float) -> Heavy:
    """Histories and n-grams with at least half of `share` of a sample's words, 2 / share of each kind at most."""
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    rate = min(1.0, SAMPLE / max(1, size))
    length = LONG

    def drawn(batches):
        draw = np.random.default_rng([32, TaskContext.get().partitionId()])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if len(text) <= length:
                    yield pa.RecordBatch.from_pydict({"text": pa.array([text])})
                else:
                    for k in np.flatnonzero(draw.random(-(-len(text) // length)) < rate).tolist():
                        yield pa.RecordBatch.from_pydict({"text": pa.array([text[k * length : (k + 1) * length]])})

    def often(batches):
        held, words = [], 0
        for batch in batches:
            for _, part in batches_of(batch.column("text").to_pylist()):
                g = grams_of(part, order)
                held.append((g.history, g.gram[g.words]))
                words += len(held[-1][1])
        least = max(2, math.ceil(share * words / 2))
        for kind in zip(*held):
            name, n = np.unique(np.concatenate(kind), return_counts=True)
            yield pa.RecordBatch.from_pydict({"name": pa.array(name[n >= least])})

    chosen = texts.where((F.rand(32) < rate) | (F.octet_length("text") > length)).where("text is not null").mapInArrow(drawn, "text string")
    return Heavy(np.unique(chosen.repartition(1).mapInArrow(often, "name long").toArrow().column("name").to_numpy()))


def exploded(docs: DataFrame, shared, order: int, alpha: float, part: int, rounds: int, last: bool) -> DataFrame:
    """key, word, doc_id, x: how often a document has an n-gram of one part of the keys.

    With the first part come the counts of heavy names. In the last pass, whose part may be empty, two rows more a document
    carry its number of words, and as x what needs no other document: the logs of heavy names, and `alpha`. Their key is a
    hash of the document, so that it is no hot key."""

    def explode(batches):
        heavy = shared.value
        total = np.zeros(len(heavy.name), np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for first, texts in batches_of(batch.column("text").to_pylist()):
                g = grams_of(texts, order)
                at, ends, gram = g.words, g.ends, g.gram[g.words]
                deep, of_history = heavy.find(g.history)
                known, of_gram = heavy.find(gram)
                alone = deep[at - 1] & ~known
                key = np.concatenate([np.where(alone, gram, g.history[at - 1]), g.history[ends]])
                sent = np.flatnonzero(np.concatenate([~known, ~deep[ends]]) & ((key.view(np.uint64) >> np.uint64(40)) % np.uint64(rounds) == np.uint64(part)))
                word = np.concatenate([np.where(alone, ALONE, (g.word[at] >> np.uint64(33)).astype(np.int64)), np.full(len(ends), END)])[sent]
                key, of = key[sent], np.concatenate([g.document[at], np.arange(len(ends))])[sent]
                same = mixed(key.view(np.uint64) + word.astype(np.uint64)) + of.astype(np.uint64) * _PLACE[0]
                by = np.argsort(same)
                edge = np.flatnonzero(np.diff(same[by], prepend=~same[by[:1]]))
                one, x = by[edge], np.diff(edge, append=len(by))
                columns = [(key[one], word[one], of[one], x)]
                if part == 0:
                    total += np.bincount(of_history, minlength=len(total)) + np.bincount(of_gram, minlength=len(total))
                if last:
                    log_history, log_gram = np.zeros(len(deep)), np.zeros(len(at))
                    log_history[deep], log_gram[known] = heavy.log_n[of_history], heavy.log_n[of_gram]
                    fixed = np.bincount(g.document[at], log_gram - log_history[at - 1], len(ends))
                    n = np.bincount(g.document[at], minlength=len(ends))
                    fixed += (order - 2) * math.log(alpha) * (n > 0)
                    own, every = mixed((ids[first : first + len(ends)] + np.arange(first, first + len(ends)) * null[first : first + len(ends)]).astype(np.int64).view(np.uint64)).view(np.int64), np.arange(len(ends))
                    columns += [(own, np.full(len(ends), FIXED), every, fixed), (own, np.full(len(ends), WORDS), every, n)]
                key, word, of, x = (np.concatenate(c) for c in zip(*columns))
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "word": pa.array(word.astype(np.int32)), "doc_id": pa.array(ids[first + of], mask=null[first + of]), "x": pa.array(x.astype(np.float64))})
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"key": pa.array(heavy.name[seen]), "word": pa.array(np.full(len(seen), HEAVY, np.int32)), "doc_id": pa.nulls(len(seen), pa.int64()), "x": pa.array(total[seen].astype(np.float64))})

    return docs.mapInArrow(explode, "key long, word int, doc_id long, x double")


def scored(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, log_score: the share of each document in one part of the keys; for heavy names: name, and n in log_score."""
    counted = F.when(F.col("word") >= ALONE, F.col("x"))
    by_word = Window.partitionBy("key").orderBy("word")  # one sorted pass for both counts
    every, same = (Window.unboundedPreceding, Window.unboundedFollowing), (Window.currentRow, Window.currentRow)
    rows = rows.repartition("key").withColumns({"m": F.sum(counted).over(by_word.rangeBetween(*every)), "n": F.sum(counted).over(by_word.rangeBetween(*same))})
    rows = rows.where(F.when(F.col("word") >= 0, F.col("n") != F.col("m")).when(F.col("word") == ALONE, F.col("n") != 1).otherwise(F.col("word") != END))
    value = F.when(F.col("word") >= 0, F.col("x") * F.log(F.col("n") / F.col("m"))).when(F.col("word") == ALONE, F.col("x") * F.log("n")).when(F.col("word") >= FIXED, F.col("x"))
    words = F.when(F.col("word") == WORDS, F.col("x").cast("long"))
    name = F.when(F.col("word") == HEAVY, F.col("key")).alias("name")
    return rows.groupBy(name, "doc_id").agg(F.sum(words).alias("n_words"), F.sum(value).alias("log_score"))


def score(docs: DataFrame, *, order: int = 3, alpha: float = ALPHA, heavy_share: float = HEAVY_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_score, mean_log for every document."""
    if not 2 <= order <= 3:
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with passing(spark):
        heavy = heavy_names(narrow.select("text"), order, heavy_share)
        parts, passes = [], max(2, rounds)  # a single round has an empty pass after it
        for k in range(passes):
            rows = exploded(narrow, spark.sparkContext.broadcast(heavy), order, alpha, k, rounds, k == passes - 1)
            parts.append(stored(scored(rows), f"scores{k}", lasting=True))
            if k == 0:
                counts = parts[0].where("name is not null").select("name", "log_score").toArrow()
                heavy = Heavy(counts.column("name").to_numpy(), counts.column("log_score").to_numpy())
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    out = every.where("name is null").groupBy("doc_id").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"), F.coalesce(F.sum("log_score"), F.lit(0.0)).alias("log_score"))
    return out.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log"))
