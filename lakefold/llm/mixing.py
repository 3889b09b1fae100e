"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

Every source is dealt by a hash into blocks, and its blocks are put into a random order of their own. The target in words
gives each source an exact quota of blocks: whole passes over all its blocks, and then the first blocks in that order
whose words come nearest to what is left. A binary tree over the output shards splits the vector of quotas: at each node
the left half's share of every source is drawn from the multivariate hypergeometric distribution, so each shard gets an
exact quota of each source. Shards then take disjoint runs of the permuted blocks, and rows are shuffled by a hash within
their shard. What a document gives to the mix are its draws, (epoch, shard) each, and nothing else decides on it. Data stay
in the plan; the driver handles one row a source, and quotas of sources by shards. Tables of sources and blocks are
broadcast below a checked number of rows, and joined by a shuffle beyond.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share 150% of all words; a target stops at twice
its source's words and the excess is shared again by weight until none is above.

Defined results: a null or blank text has size 0 and may be taken too. Null is a source of its own. A block is chosen by
doc_id and text, so null doc_ids are spread; rows that repeat both share a block and are taken equally often. An empty table
gives an empty mix. Other columns are ignored or, in `mixed`, kept, and there the three columns added take underscores at
their ends until they clash with none."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import passing, row_of, scratch_path, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCKS = 1024
#: Up to so many rows (blocks of about 50 bytes, sources of about 300) a table is broadcast; beyond, rows are shuffled to it.
BROADCAST_ROWS = 60_000
_LITERAL_ROWS = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed(*columns: Column, seed: int) -> Column:
    """32 bits of the MD5 of the columns' text, as a long."""
    text = F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """What each source is to give: by weight, at most `most` times its size, the excess reshared."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def split_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each source, its exact number of blocks in each shard; every shard gets as many blocks as any other, give or take one."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), np.int64)

    def node(have: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = have
            return
        middle = (first + last) // 2
        left = int(have.sum()) * (middle - first) // (last - first)
        drawn, rest, wanted = np.zeros_like(have), int(have.sum()), left
        for i, n in enumerate(have.tolist()):  # conditional hypergeometric draws, source by source
            drawn[i] = rng.hypergeometric(n, rest - n, wanted) if wanted and n else 0
            rest -= n
            wanted -= int(drawn[i])
        node(drawn, first, middle)
        node(have - drawn, middle, last)

    node(np.array(quotas, np.int64), 0, shards)
    return out.tolist()


def local_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table from the driver: a literal of the plan if it is small, else stored part by part."""
    literal = lambda part: spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(part)), f"array<struct<{schema}>>")).alias("r")).select("r.*")
    if len(rows) <= _LITERAL_ROWS:
        return literal(rows)
    path = scratch_path(spark, "rows")
    for at in range(0, len(rows), _LITERAL_ROWS):
        literal(rows[at : at + _LITERAL_ROWS]).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def beside(rows: DataFrame, table: DataFrame, count: int, *on: str) -> DataFrame:
    """rows joined with a table of `count` rows."""
    return rows.join(F.broadcast(table) if count <= BROADCAST_ROWS else table.hint("merge"), list(on))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def block_of(doc_id: Column, text: Column, blocks: int, seed: int) -> Column:
    return (hashed(F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text), seed=seed) % blocks).cast("int")


def plan_mix(sized: DataFrame, *, shards: int, blocks: int, seed: int, weights: tuple[float, ...]) -> tuple[DataFrame, DataFrame, int, int]:
    """From (source_key, block, size): the block table with its draws, the source table, and the rows of both.

    A block's `draws` is an array of (epoch, shard)."""
    spark = sized.sparkSession
    table = stored(sized.groupBy("source_key", "block").agg(F.sum("size").alias("words")), "blocks")
    found = table.groupBy("source_key").agg(F.sum("words").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    # 's...' by code point, then 'n' for null
    found = sorted(found, key=lambda r: (r.source_key[0] == "n", r.source_key[1:]))
    goal = targets([r.size for r in found], [float(weights[i % len(weights)]) for i in range(len(found))])
    passes = [int(g // r.size) if r.size else 0 for g, r in zip(goal, found)]
    rows = [{"source_key": r.source_key, "source_size": r.size, "target": g, "n": r.n, "passes": p, "rest": g - p * r.size} for r, g, p in zip(found, goal, passes)]
    sources = local_rows(spark, rows, "source_key string, source_size bigint, target double, n bigint, passes int, rest double")
    order = Window.partitionBy("source_key").orderBy(hashed(F.col("source_key"), F.col("block"), seed=seed + 1), "block")
    ranked = table.select("*", (F.row_number().over(order) - 1).alias("rank"), F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    ranked = stored(beside(ranked, sources.select("source_key", "n", "passes", "rest"), len(rows), "source_key"), "ranked")
    # Of the numbers of blocks of the last pass, the one whose words come nearest to the rest; none is one of them.
    miss = F.struct(F.abs(F.col("cum") - F.col("rest")), (F.col("rank") + 1).alias("take"))
    nearest = {r.source_key: (r.best[0], r.best[1], r.rest) for r in ranked.groupBy("source_key").agg(F.min(miss).alias("best"), F.first("rest").alias("rest")).collect()}
    tail = [nearest[r.source_key][1] if nearest[r.source_key][0] < nearest[r.source_key][2] else 0 for r in found]
    quotas = [p * r.n + t for p, r, t in zip(passes, found, tail)]
    split = split_tree(quotas, shards, seed)
    ends = [{"source_key": r.source_key, "quota": q, "ends": np.cumsum(s).tolist()} for r, q, s in zip(found, quotas, split)]
    limits = local_rows(spark, ends, "source_key string, quota bigint, ends array<bigint>")
    drawn = beside(ranked, limits, len(ends), "source_key")
    place = lambda e: F.col("rank") + e * F.col("n")
    epochs = F.filter(F.sequence(F.lit(0), F.lit(int(MOST))), lambda e: place(e) < F.col("quota"))
    shard_at = lambda e: F.size(F.filter("ends", lambda x: x <= place(e)))
    # Only places inside a shard's run of blocks are drawn.
    draws = F.filter(F.transform(epochs, lambda e: F.struct(e.alias("epoch"), shard_at(e).alias("shard"))), lambda d: d["shard"] < shards)
    out = stored(drawn.select("source_key", "block", draws.alias("draws")), "draws", lasting=True)
    return out, sources, sum(r.n for r in found), len(found)


def sized_rows(docs: DataFrame, blocks: int, seed: int, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(source_key(F.col("source")).alias("source_key"), block_of(F.col("doc_id"), text, blocks, seed).alias("block"), words(text).alias("size"), *more)


def mix_counts(docs: DataFrame, *, shards: int = 16, blocks: int = BLOCKS, seed: int = 11, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the draws (epoch, shard) of every document."""
    with passing(docs.sparkSession):
        sized = stored(sized_rows(docs, blocks, seed, F.col("doc_id").cast("long").alias("doc_id")), "sized", lasting=True)
        table, sources, count, some = plan_mix(sized, shards=shards, blocks=blocks, seed=seed, weights=weights)
    out = beside(beside(sized, table, count, "source_key", "block"), sources, some, "source_key")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "draws")


def mixed(docs: DataFrame, *, shards: int = 16, blocks: int = BLOCKS, seed: int = 11, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is drawn, with mix_epoch, mix_shard and mix_order.

    Within a shard, rows are to be read by mix_order; `in_order` puts them so, and `write_mix` stores them so."""
    with passing(docs.sparkSession):
        sized = stored(sized_rows(docs, blocks, seed), "sized")
        table, _, count, _ = plan_mix(sized, shards=shards, blocks=blocks, seed=seed, weights=weights)
    names = mix_names(docs.columns)
    text = F.col("text").cast("string")
    keyed = docs.select(row_of(docs.columns), source_key(F.col("source")).alias("source_key"), block_of(F.col("doc_id"), text, blocks, seed).alias("block"))
    rows = beside(keyed, table, count, "source_key", "block").select("row", F.explode("draws").alias("draw"))
    order = hashed(F.col("row.doc_id"), F.xxhash64(F.col("row.text").cast("string")), F.col("draw.epoch"), seed=seed + 2)
    return rows.select("row.*", F.col("draw.epoch").alias(names[0]), F.col("draw.shard").alias(names[1]), order.alias(names[2]))


def mix_names(taken: list[str]) -> list[str]:
    """The names of the columns that `mixed` adds to those taken."""
    out = []
    for name in ("mix_epoch", "mix_shard", "mix_order"):
        while name.lower() in {t.lower() for t in taken}:
            name += "_"
        out.append(name)
    return out


def in_order(mix: DataFrame) -> DataFrame:
    """A mix shard by shard, each in its own random order: over all partitions, and inside of them."""
    _, shard, order = mix.columns[-3:]
    return mix.repartitionByRange(F.col(f"`{shard}`"), F.col(f"`{order}`")).sortWithinPartitions(F.col(f"`{shard}`"), F.col(f"`{order}`"))


def write_mix(mix: DataFrame, path: str) -> None:
    """One folder a shard, rows in the shard's own random order."""
    in_order(mix).write.partitionBy(mix.columns[-2]).parquet(path)
