"""What the operators share: the scratch folder, stored tables, Arrow batches and bounded samples."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished write go at once; without it they stay until the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The largest bitmap that `likely` broadcasts has 2**27 bits, 16 MB.
BITMAP_BITS = 27
_passing: list[list[str]] = []
_own_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="lakefold-")
    return _own_root[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/lakefold/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those marked `lasting`, which lazy results still read."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            forget(spark, path)


def stored(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    if _passing and not lasting:
        _passing[-1].append(path)
    with settings(df.sparkSession, {SHUFFLE_CLEANUP: "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_of(names: list[str]) -> Column:
    """All columns of a row in one, so that columns added beside it can't clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")


def located(docs: DataFrame) -> DataFrame:
    """(row, locator): whole rows of docs with the file and the place in it from which each can be read again.

    Frames that don't come straight from files have no such places; they are stored first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("locator")
    try:
        return docs.select(row_of(docs.columns), place)
    except AnalysisException:
        return stored(docs.select(row_of(docs.columns)), "content").select("row", place)


def likely(rows: DataFrame, key: Column, members: DataFrame, member: Column) -> DataFrame:
    """rows with a boolean `likely`: false only where `key` is certainly none of `members`.

    The bitmap has at least 16 bits a member up to its greatest size; beyond that it fills up, and more rows are likely."""
    bits = min(BITMAP_BITS, max(15, math.ceil(math.log2(16 * members.count() + 1))))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    held = members.select(slot(member).alias("s")).select(F.floor(F.col("s") / 32768).alias("bucket"), (F.col("s") % 32768).alias("bit"))
    bitmap = held.groupBy("bucket").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("map"))
    placed = rows.select(row_of(rows.columns), slot(key).alias("slot")).withColumn("bucket", F.floor(F.col("slot") / 32768))
    byte = F.conv(F.hex(F.expr("substring(map, cast((slot % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, (F.col("slot") % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(bitmap), "bucket", "left").select("row.*", hit.alias("likely"))


def matched(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """rows with the columns of members (key, ...) that have the same key; only rows that the bitmap lets through are shuffled."""
    return likely(rows, F.col(key), members, F.col(key)).where("likely").drop("likely").join(members, key)


def without(held: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `located` rows, as they were, whose locator is not in gone (locator).

    Whole rows are shuffled only if a bitmap can't rule out that they go."""
    marked = likely(held, F.col("locator"), gone, F.col("locator"))
    rest = marked.where("likely").join(gone, "locator", "left_anti")
    return marked.where("not likely").select("row.*").unionAll(rest.select("row.*"))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker holds few of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(rows))


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds; a null doc_id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def bounded_sample(df: DataFrame, rows: int, *by: str, salt: int = 7) -> DataFrame:
    """About `rows` rows of df at most, chosen by a hash of `by`; all of them if df has no more.

    The share is computed from a count over all rows, so the sample spreads over the whole table."""
    total = df.count()
    if total <= rows:
        return df
    hashed = F.pmod(F.xxhash64(F.lit(salt), *[F.col(c) for c in by]), F.lit(1 << 30))
    return df.where(hashed < int(rows / total * (1 << 30)))


def arrow_map(df: DataFrame, over: Callable[[list], Iterable[dict]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over small batches: `over` gets a RecordBatch and yields dicts of columns."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in over(batch):
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def pieces(texts: list[str], size: int = 1 << 20, overlap: int = 0) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Cover every text with pieces and yield groups of about `size` characters.

    A group is (document numbers, pieces, starts): of a piece, the first `starts` characters are its own and the rest,
    `overlap` at most, only complete n-grams. A text longer than `size` is spread over groups, so memory stays bounded."""
    docs, parts, own, held = [], [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text)), size):
            end = min(len(text), at + size)
            docs.append(number)
            parts.append(text[at : end + overlap])
            own.append(end - at)
            held += len(parts[-1]) + 1
            if held >= size:
                yield docs, parts, own
                docs, parts, own, held = [], [], [], 0
    if docs:
        yield docs, parts, own
