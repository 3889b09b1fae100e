"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: times occurring times inverse document frequency. Document
frequencies are counted exactly, by a shuffle, over all documents. The weight of a shingle in df of N documents is
1 + log((N + 1) / (max(df, floor) + 1)). The floor is the least one for which at most `most` shingles are above it, so
their frequencies can be broadcast: it is 1 for small tables, and a fixed share of N, about one in 2,000, for large ones of
like texts. The same weights are sampled and verified.

For each of 48 hashes a shingle's weight is quantised on a logarithmic grid and the sample is the (shingle, level) with
the least key, so two documents share it with the probability of their weighted Jaccard similarity. Samples are joined
into 12 bands of 4. Every comparison computes the exact weighted Jaccard similarity from the whole texts; pairs of 0.8 or
more are links, and classes are connected components.

Equal texts are one node from the start. Of each bucket, members are first compared with one leader, of two orders of
leaders for even and odd bands. Then follow all pairs of a bucket that are in different components, unless fewer than
`AGREE` of their 48 samples agree; of pairs with a similarity of 0.8, a share of 1.3e-05 does. They are compared where they
meet, in pairs of blocks of a bucket, so no task gets a whole crowded one and only links that join components leave it.

Defined results: every row is a document, also where doc_ids repeat. Of a class the row with the smallest (doc_id, place)
stays, a null doc_id first; class_id is its doc_id, or for a null one a negative number from the texts. A null text counts
as empty; texts without words are near only to equal texts. A text of fewer than five words has one shingle. Very long
texts are read whole. An empty table gives an empty result. Other columns are ignored, whatever their names."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, located, matched, passing, small_batches, stored, without
from .graph import components
from .shingles import counted, mixed

#: Shingles whose own frequency is broadcast, 16 bytes each; and shingles that a task adds up before it sends them.
MOST, _FLUSH = 1 << 20, 1 << 21
HASHES, ROWS = 48, 4
THRESHOLD = 0.8
#: Samples of 48 in which a pair that the leaders left open agrees at least; members of a block of them, and bytes of text.
AGREE, BLOCK, BYTES = 26, 512, 1 << 23


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of 2**bits cells, by Newton steps on its CDF."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.where(u < 0.3, np.sqrt(2 * u), 1 - np.log1p(-u) + np.log1p(-np.log1p(-u)))
    for _ in range(60):
        f = -np.expm1(-x) - x * np.exp(-x) - u
        x = np.maximum(x - f / np.maximum(x * np.exp(-x), 1e-12), x / 2)
    return x


class Sampler:
    """The random numbers of a (shingle, hash) pair, looked up by the bits of one mixed 64-bit product."""

    def __init__(self, hashes: int = HASHES, rows: int = ROWS, seed: int = 3) -> None:
        self.hashes, self.rows = hashes, rows
        self.odd = np.random.default_rng(seed).integers(1, 1 << 63, hashes, dtype=np.uint64) | np.uint64(1)
        self.r = _gamma_quantiles(12).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(_gamma_quantiles(18)).astype(np.float32)

    def sample(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The 64-bit name of each hash's sample: its shingle and level."""
        log_w = np.log(weights).astype(np.float32)
        best = np.full(self.hashes, np.inf, np.float32)
        name = np.zeros(self.hashes, np.uint64)
        columns = np.arange(self.hashes)
        for at in range(0, len(shingles), 1024):
            f, lw = shingles[at : at + 1024], log_w[at : at + 1024, None]
            z = f[:, None] * self.odd
            z ^= z >> np.uint64(29)
            z *= np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(32)
            k = (z & np.uint64(0xFFF)).astype(np.intp)
            r, inverse = self.r[k], self.inverse[k]
            shift = ((z >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            level = np.floor(lw * inverse + shift)
            key = self.log_c[((z >> np.uint64(28)) & np.uint64(0x3FFFF)).astype(np.intp)]
            key = key - r * (level - shift + np.float32(1))
            row = key.argmin(0)
            low = key[row, columns]
            better = low < best
            best = np.where(better, low, best)
            here = mixed(f[row] + level[row, columns].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            name = np.where(better, here, name)
        return name

    def bands(self, shingles: np.ndarray, weights: np.ndarray) -> list[int]:
        """A 64-bit hash of each band, its number included."""
        return self.banded(self.sample(shingles, weights))

    def banded(self, samples: np.ndarray) -> list[int]:
        grouped = samples.reshape(-1, self.rows)
        out = np.arange(len(grouped), dtype=np.uint64) + np.uint64(1)
        for k in range(self.rows):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
        return out.astype(np.int64).tolist()


@dataclass
class Weights:
    """Inverse document frequencies: of the frequent shingles, ascending, and of all others."""

    shingles: np.ndarray
    idf: np.ndarray
    other: float

    def of(self, shingles: np.ndarray, times: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return times * self.other
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return times * np.where(self.shingles[at] == shingles, self.idf[at], self.other)


def idf(df: np.ndarray | int, documents: int, floor: int) -> np.ndarray:
    return 1 + np.log((documents + 1) / (np.maximum(df, floor) + 1))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending shingles, weights)."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - low
    return low / total if total > 0 else 0.0


def similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of one text and some others, none of them without shingles."""
    starts = np.cumsum([0] + [len(s) for s, _ in others[:-1]])
    shingles, weights = np.concatenate([s for s, _ in others]), np.concatenate([w for _, w in others])
    at = np.minimum(np.searchsorted(one[0], shingles), len(one[0]) - 1)
    low = np.add.reduceat(np.where(one[0][at] == shingles, np.minimum(one[1][at], weights), 0.0), starts)
    return low / (one[1].sum() + np.add.reduceat(weights, starts) - low)


def frequencies(texts: DataFrame, most: int = MOST) -> Weights:
    """Counts the documents of every shingle; each task adds up parts of its own rows first."""
    small_batches(texts.sparkSession)

    def count(batches):
        held, size, total = [], 0, 0

        def out():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found = found.view(np.int64)
            for at in range(0, len(found), 1 << 17):
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(found[at : at + (1 << 17)]), "n": pa.array(n[at : at + (1 << 17)], pa.int64())})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(counted(text)[0])
                size += len(held[-1])
                if size > _FLUSH:
                    yield from out()
                    held, size, total = [], 0, total + size
        if held:
            yield from out()
        yield pa.RecordBatch.from_pydict({"shingle": pa.array([None], pa.int64()), "n": pa.array([total + size], pa.int64())})  # of all

    rows = texts.select("text").mapInArrow(count, "shingle long, n long")
    table = stored(rows.repartition("shingle").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1 or shingle is null"), "frequencies")
    total = table.where("shingle is null").select("n").head()
    documents, floor = texts.count(), max(1, -(-(total.n if total else 0) // most))
    # At most total / floor shingles are in so many documents, so at most `most`.
    frequent = table.where(F.col("shingle").isNotNull() & (F.col("n") >= max(2, floor))).toArrow()
    shingles, n = frequent.column("shingle").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    by = np.argsort(shingles)
    return Weights(shingles[by], idf(n[by], documents, floor), float(idf(1, documents, floor)))


def signatures(rows: DataFrame, shared) -> DataFrame:
    """doc_id, locator, digest, bytes, the band hashes (none for texts without words) and a byte of each sample, of every row."""

    def over(batch):
        weights, sampler = shared.value
        out, marks = [], []
        for text in batch.column("text").to_pylist():
            shingles, times = counted(text)
            samples = sampler.sample(shingles, weights.of(shingles, times)) if len(shingles) else np.zeros(0, np.uint64)
            out.append(sampler.banded(samples) if len(shingles) else [])
            marks.append(samples.astype(np.uint8).tobytes())
        yield {"doc_id": batch.column("doc_id"), "locator": batch.column("locator"), "digest": batch.column("digest"), "size": batch.column("size"), "bands": pa.array(out, pa.list_(pa.int64())), "marks": pa.array(marks, pa.binary())}

    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    size = F.octet_length("text").cast("long").alias("size")
    return arrow_map(rows.select("doc_id", "locator", digest, size, "text"), over, "doc_id long, locator struct<file:string,at:long>, digest string, size long, bands array<long>, marks binary")


def compared(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """a, b, similarity of every pair, from the whole texts."""
    rows = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")

    def over(batch):
        (weights, _), cache, out = shared.value, {}, []

        def weighted(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if node not in cache:
                if len(cache) > 64:
                    cache.clear()
                shingles, times = counted(text)
                cache[node] = shingles, weights.of(shingles, times)
            return cache[node]

        a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
        for i in range(len(a)):
            out.append(similarity(weighted(a[i], x[i]), weighted(b[i], y[i])))
        yield {"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(out, pa.float64())}

    return arrow_map(rows.select("a", "b", "text_a", "text_b"), over, "a long, b long, similarity double")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_rows(held: DataFrame, *, threshold: float, sampler: Sampler, most: int) -> DataFrame:
    """doc_id, locator, class_id, class_size, kept and class_key of every row of `located` rows."""
    spark = held.sparkSession
    rows = held.select(F.col("row.doc_id").cast("long").alias("doc_id"), "locator", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    with passing(spark):
        shared = spark.sparkContext.broadcast((frequencies(rows, most), sampler))
        signed = stored(signatures(rows, shared), "signatures", lasting=True)
        firsts = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
        nodes = stored(firsts.withColumn("node", F.monotonically_increasing_id()), "nodes")
        labels = linked(rows, nodes, shared, threshold)
        parts = nodes.join(labels, "node", "left").select("digest", "first", "copies", F.coalesce("component", "node").alias("component"))
        parts = stored(parts, "parts")
        whole = stored(parts.groupBy("component").agg(F.min("first").alias("keep"), F.sum("copies").alias("class_size"), F.min("digest").alias("class_key")), "classes")
        classes = stored(parts.join(whole, "component").select("digest", "keep", "class_size", "class_key"), "classes", lasting=True)
    nameless = -1 - F.conv(F.substring("class_key", 1, 15), 16, 10).cast("long")
    kept = F.struct("doc_id", "locator").eqNullSafe(F.col("keep")).alias("kept")
    out = signed.select("doc_id", "locator", "digest").join(classes, "digest")
    return out.select("doc_id", "locator", F.coalesce("keep.doc_id", nameless).alias("class_id"), "class_size", kept, "class_key")


def linked(rows: DataFrame, nodes: DataFrame, shared, threshold: float) -> DataFrame:
    """node, component of every node with a link."""
    buckets = stored(nodes.select("node", "size", F.posexplode("bands").alias("band", "key")), "buckets")
    first = F.min_by("node", F.xxhash64(F.col("band") % 2, "node")).alias("leader")
    leaders = stored(buckets.groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader"), "leaders")
    members = stored(buckets.join(leaders, "key").select("key", "leader", "node", "size"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("first.locator").alias("locator")), "node")
    texts = stored(matched(rows.select("locator", "text"), "locator", stored(wanted, "wanted")).select("node", "text"), "candidates")
    pairs = stored(distinct_pairs(members.select(F.col("node").alias("x"), F.col("leader").alias("y"))), "pairs")
    links = stored(compared(pairs, texts, shared).where(F.col("similarity") >= threshold).select("a", "b"), "links")
    labels = components(links)
    more = stored(open_links(members, labels, nodes, texts, shared, threshold), "more")
    return components(links.union(more)) if more.head(1) else labels


def open_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """a, b: links between members of a bucket that are in different components, enough of them to join what they join.

    Of every pair to be compared one is outside the leader's component. These `seekers` are met with all members: blocks
    of both are paired, and a cell of two blocks has about 2 * BLOCK rows and 2 * BYTES of text. A cell compares its
    pairs where they stand and gives only links that join two components, fewer than it has rows."""
    at = members.join(labels, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"), (F.col("node") == F.col("leader")).alias("leads"))
    at = stored(at, "at")
    tops = at.where("leads").select("key", F.col("component").alias("top"))
    at = stored(at.join(tops, "key").select("key", "node", "size", "component", (F.col("component") != F.col("top")).alias("seeks")), "sides")
    few = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BYTES)).cast("long")
    seeking = few(F.count_if("seeks"), F.sum(F.when(F.col("seeks"), F.col("size")).otherwise(0)))
    sizes = at.groupBy("key").agg(few(F.count(F.lit(1)), F.sum("size")).alias("blocks"), seeking.alias("seeking")).where("seeking > 0")
    held = at.drop("size").join(stored(sizes, "open"), "key").join(nodes.select("node", "bands", "marks"), "node").join(texts, "node")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own_i, own_j = (F.pmod(F.xxhash64("node"), F.col(n)) for n in ("blocks", "seeking"))
    cell = lambda i, j, found, asks: F.struct(i.alias("i"), j.alias("j"), found.alias("found"), asks.alias("asks"))
    found = F.transform(upto("seeking"), lambda j: cell(own_i, j, F.lit(True), F.col("seeks") & (j == own_j)))
    asking = F.transform(F.filter(upto("blocks"), lambda i: F.col("seeks") & (i != own_i)), lambda i: cell(i, own_j, F.lit(False), F.lit(True)))
    cells = held.select("key", F.explode(F.concat(found, asking)).alias("cell"), "node", "component", "seeks", "bands", "marks", "text")
    cells = cells.select("key", "cell.*", "node", "component", "seeks", "bands", "marks", "text")
    small_batches(cells.sparkSession)
    least = min(AGREE / HASHES, threshold - 0.25) * shared.value[1].hashes

    def run(batches):
        group, name = [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j"))))
            edges = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
            for start, end in zip(edges, [*edges[1:], len(names)]):
                if names[start] != name and group:
                    yield joining(pa.Table.from_batches(group), shared.value[0], least, threshold)
                    group = []
                name = names[start]
                group.append(batch.slice(start, end - start))
        if group:
            yield joining(pa.Table.from_batches(group), shared.value[0], least, threshold)

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def joining(cell: pa.Table, weights: Weights, least: float, threshold: float) -> pa.RecordBatch:
    """The links of a cell that join components, of pairs that meet in no earlier band and agree in `least` samples."""
    node, component = cell["node"].to_numpy(), cell["component"].to_numpy()
    found, asks, seeks = (cell[c].to_numpy() for c in ("found", "asks", "seeks"))
    marks = np.frombuffer(b"".join(cell["marks"].to_pylist()), np.uint8).reshape(len(node), -1)
    bands = cell["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    band = int(np.flatnonzero(bands[0] == cell["key"][0].as_py())[0])
    root = np.unique(component, return_inverse=True)[1]
    to, read, x, y = np.flatnonzero(found), {}, [], []

    def weighted(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in read:
            shingles, times = counted(cell["text"][k].as_py())
            read[k] = shingles, weights.of(shingles, times)
        return read[k]

    for k in np.flatnonzero(asks).tolist():
        hit = to[(root[to] != root[k]) & (~seeks[to] | (node[to] > node[k]))]  # two seekers meet twice
        hit = hit[(marks[hit] == marks[k]).sum(1) >= least]
        hit = hit[~(bands[hit, :band] == bands[k, :band]).any(1)]
        if not len(hit):
            continue
        near = similarities(weighted(k), [weighted(t) for t in hit.tolist()]) >= threshold
        for t in hit[near].tolist():
            if root[t] != root[k]:
                root[root == root[t]] = root[k]
                x.append(min(node[k], node[t]))
                y.append(max(node[k], node[t]))
    return pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def near_classes(docs: DataFrame, *, threshold: float = THRESHOLD, sampler: Sampler | None = None, most: int = MOST) -> DataFrame:
    """doc_id, class_id, class_size, kept and class_key (which no two classes share) for every row of docs."""
    return near_rows(located(docs), threshold=threshold, sampler=sampler or Sampler(), most=most).drop("locator")


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one row of each class."""
    held = located(docs)
    gone = near_rows(held, threshold=threshold, sampler=Sampler(), most=most).where(~F.col("kept")).select("locator")
    return without(held, stored(gone, "gone", lasting=True))
