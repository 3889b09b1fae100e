"""Sharding along a Hilbert curve: quantise metadata dimensions, sort by curve index, cut runs.

Each dimension is quantised into 2**bits cells of about equal row counts. Borders of numbers and times come from one pass of
mergeable quantile summaries over all rows, those of texts from the counts of their sorted distinct values, which are
compared whole. Cells are turned into the index on the Hilbert curve by a finite-state machine whose
tables come from the Gray code, evaluated inside the plan. Rows are range-partitioned and sorted by (index, tie-breaks);
their exact global positions, from the row counts of the sorted partitions, are cut into runs. Rows near on the curve
share a shard, so each shard covers small ranges of every dimension at once and readers can skip it by min and max.

Defined results: nulls take the first cell of their dimension, and a null text has size 8 and the crc32 of an empty text
is 0. Equal rows are interchangeable and get different slots. An empty table gives an empty result. Other columns are
ignored. Fewer rows than shards leave the last shards empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_of, stored


def gray(i: int) -> int:
    return i ^ (i >> 1)


def state_machine(dims: int) -> tuple[list[int], list[int]]:
    """For state (entry corner, direction) and one bit of every dimension: the curve digit, and the next state.

    State e * dims + d, table index state * 2**dims + bits; after Hamilton's description of compact Hilbert indices."""
    full = (1 << dims) - 1
    left = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & full
    right = lambda x, k: left(x, dims - k % dims)
    rank = {gray(i): i for i in range(full + 1)}
    ones = lambda i: next(k for k in range(dims + 1) if not i >> k & 1)  # noqa: E731  trailing set bits
    digit, after = [], []
    for state in range((full + 1) * dims):
        entry, direction = divmod(state, dims)
        for bits in range(full + 1):
            w = rank[right(bits ^ entry, direction + 1)]
            corner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            turn = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % dims
            digit.append(w)
            after.append((entry ^ left(corner, direction + 1)) * dims + (direction + turn + 1) % dims)
    return digit, after


def curve_index(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer cells in 0 .. 2**bits - 1."""
    digit, after = state_machine(len(cells))
    digits, states = F.array(*map(F.lit, digit)), F.array(*map(F.lit, after))
    words = F.array(*[c.cast("int") for c in cells])

    def plane(bit: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda acc, c: acc * 2 + F.call_function("getbit", c, bit).cast("int"))

    def step(acc: Column, bit: Column) -> Column:
        place = acc["state"] * (1 << len(cells)) + plane(bit)
        return F.struct(F.element_at(states, place + 1).alias("state"), (acc["index"] * (1 << len(cells)) + F.element_at(digits, place + 1)).alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


def number_of(column: Column, kind: T.DataType) -> Column:
    """An order-keeping number of a number or time; for anything else its text."""
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return column.cast("timestamp").cast("double")
    return column.cast("string")


def text_borders(values: DataFrame, cells: int) -> list[str]:
    """Values of the one column of a frame at its i / cells quantiles, i in 1 .. cells - 1; nulls don't count.

    Distinct values are counted, sorted over all partitions and summed up in each; the driver sees one count a partition."""
    (name,) = values.columns
    counts = values.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = stored(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()), "values")
    sums = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total, before = 0, []
    for part, n in sums:
        before.append((part, total))
        total += n
    if not total:
        return []
    starts = values.sparkSession.createDataFrame(before, "part int, start long")  # one row a partition
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(starts), "part").withColumn("upto", F.col("upto") + F.col("start"))
    row = placed.agg(*[F.min(F.when(F.col("upto") * cells >= F.lit(total) * i, F.col("value"))).alias(f"b{i}") for i in range(1, cells)]).head()
    return list(row)


def with_cells(df: DataFrame, dims: dict[str, Column], bits: int) -> DataFrame:
    """Adds an integer cell column of each name; borders are quantiles over all rows."""
    names = list(dims)
    kinds = {f.name: f.dataType for f in df.select(*[c.alias(n) for n, c in dims.items()]).schema}
    numbers = {n: number_of(c, kinds[n]) for n, c in dims.items()}
    keyed = df.select(*[c.alias(n) for n, c in numbers.items()])
    texts = [f.name for f in keyed.schema if isinstance(f.dataType, T.StringType)]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    counted = [n for n in names if n not in texts]
    row = keyed.agg(*[F.percentile_approx(n, shares, 4096).alias(n) for n in counted]).head() if counted else {}
    borders = {n: sorted({float(b) for b in row[n] or []}) for n in counted}
    borders |= {n: sorted(set(text_borders(keyed.select(n), 1 << bits)), key=lambda t: t.encode("utf-8", "surrogatepass")) for n in texts}

    def cell(n: str) -> Column:
        if not borders[n]:
            return F.lit(0)
        value = F.col(f"_number_{n}")
        below = F.size(F.filter(F.array(*map(F.lit, borders[n])), lambda border: border < value))
        return F.when(value.isNull(), 0).otherwise(below).cast("int")

    numbered = df.withColumns({f"_number_{n}": numbers[n] for n in names})
    return numbered.withColumns({n: cell(n) for n in names}).drop(*[f"_number_{n}" for n in names])


def positions(df: DataFrame, key: list[Column], partitions: int | None = None) -> tuple[DataFrame, int]:
    """df with `position`, each row's place from 0 in the order of `key`, and the row count.

    Rows are range-partitioned, sorted and stored, so the numbering survives lost executors. The driver sees one count a
    partition."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_key{i}" for i in range(len(key))]
    keyed = df.select("*", *[c.alias(k) for k, c in zip(names, key)])
    ranged = keyed.repartitionByRange(n, *names).sortWithinPartitions(*names).drop(*names)
    held = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["count"]) for r in held.groupBy(part.alias("p")).count().collect())
    total, offsets = 0, []
    for p, count in counts:
        offsets.append((int(p), total))
        total += count
    table = spark.createDataFrame(offsets, "_part long, _offset long")  # one row a partition
    return held.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn("position", F.col("_offset") + inside).drop("_at", "_part", "_offset"), total


def cut_rows(position: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a position when row counts differ by one at most."""
    low, more = divmod(total, shards)
    border = more * (low + 1)
    late = position - border
    shard = F.when(position < border, F.floor(position / F.lit(low + 1))).otherwise(more + F.floor(late / F.lit(max(low, 1))))
    slot = F.when(position < border, position % F.lit(low + 1)).otherwise(late % F.lit(max(low, 1)))
    return shard.cast("int"), slot.cast("long")


def shard(df: DataFrame, dims: dict[str, Column], ties: list[Column], shards: int, *, bits: int = 5) -> DataFrame:
    """df with `curve`, `shard` and `slot` (gapless from 0 in each shard) under the law `rows`.

    dims: names of dimensions and what they quantise. ties: columns that order rows of one cell. Columns of df with the name
    of one that is added are replaced; all others may have any name."""
    narrow = df.select(row_of(df.columns), *[c.alias(f"dim{i}") for i, c in enumerate(dims.values())], *[c.alias(f"tie{i}") for i, c in enumerate(ties)])
    cells = {f"cell{i}": F.col(f"dim{i}") for i in range(len(dims))}
    indexed = with_cells(narrow, cells, bits).select("row", curve_index([F.col(c) for c in cells], bits).alias("curve"), *[f"tie{i}" for i in range(len(ties))])
    placed, total = positions(indexed, [F.col("curve"), *[F.col(f"tie{i}") for i in range(len(ties))]])
    number, slot = cut_rows(F.col("position"), total, shards)
    names = [c for c in df.columns if c not in ("curve", "shard", "slot")]
    return placed.select(*[F.col(f"row.`{c}`") for c in names], "curve", number.alias("shard"), slot.alias("slot"))


def shard_ranges(df: DataFrame, *columns: str) -> DataFrame:
    """The least and greatest value of each column in each shard: what a reader prunes by."""
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])


def write_shards(df: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index.

    The dimensions are source, language and length."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("source").alias("_source"),
        F.col("lang").alias("_lang"),
    )
    dims = {"_c_source": F.col("_source"), "_c_lang": F.col("_lang"), "_c_size": F.col("size")}
    out = shard(narrow, dims, [F.col("text_crc32"), F.col("doc_id"), F.col("size")], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
