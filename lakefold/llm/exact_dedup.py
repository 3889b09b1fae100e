"""Exact deduplication as a stateful stream: keyed state on disk, without expiry.

Arrivals (digest, stable id, content locator) flow through a streaming aggregation keyed by digest whose state lives in
RocksDB and never expires: it keeps the least (id, locator) of the digest and the number of rows. On a hit, that is for
every row whose digest has been seen, the full normalised bytes are fetched by digest and compared with those of the
retained row; rows whose bytes differ are grouped again by their bytes, so a collision of digests merges nothing. All
of it is DataFrame code.

With a `folder` the stream's checkpoint, and with it the state, lasts: a later delivery meets everything delivered before,
and its hits are compared with the retained rows in the files of then. A delivery that breaks off is run again under its
name, and counts once. Without one the state ends with the call.

Texts are equal when they are identical after each run of ASCII white space is replaced by one space. The row with the
smallest (doc_id, locator) stays.

Defined results: a null text counts as empty; a null doc_id is smaller than any other. Repeated rows are copies of each
other and one of them stays. An empty table gives an empty result. Other columns are ignored, whatever their names. Of a
later delivery, group sizes count all rows so far; results of earlier deliveries are not corrected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, forget, likely, located, passing, scratch_path, settings, stored, without

SPACES = r"[\x20\x09-\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# An open store sets 4 MB of disk aside for its list of files, so each is closed again as soon as its batch is written.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
ARRIVALS = "doc_id long, locator struct<file:string,at:long>, digest string, text_sha256 string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def rows_of(held: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, locator, text (normalised) and digest of `located` rows."""
    rows = held.select(F.col("row.doc_id").cast("long").alias("doc_id"), "locator", normalised(F.col("row.text").cast("string")).alias("text"))
    return rows.withColumn("digest", digest(F.col("text")))


def stream_state(spark: SparkSession, folder: str, files: int, batches: int = 2) -> DataFrame:
    """Runs the stream over all arrivals that it has not seen and returns digest, keep and group_size of all seen."""
    out = f"{folder}/groups"
    with settings(spark, STATE):
        arrivals = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{folder}/arrivals/*")
        groups = arrivals.groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))

        def emit(changed: DataFrame, number: int) -> None:
            changed.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch run again replaces itself

        query = groups.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(emit).start()
        query.awaitTermination()
    changes = spark.read.schema(groups.schema).parquet(f"{out}/batch=*")
    return changes.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, *, folder: str | None = None, delivery: str = "first") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and locator (file, at) for every row.

    folder: where state lasts, in storage that executors share; delivery: the name of these rows in it. With a folder the
    rows must come straight from Parquet files that stay."""
    return copies_of(located(docs), digest, folder, delivery)


def copies_of(held: DataFrame, digest: Callable[[Column], Column] = sha256, folder: str | None = None, delivery: str = "first") -> DataFrame:
    """The same for `located` rows."""
    spark, lasts = held.sparkSession, folder is not None
    folder = folder or scratch_path(spark, "dedup")
    rows = rows_of(held, digest)
    own = f"{folder}/arrivals/{delivery}"
    if not exists(spark, f"{own}/_SUCCESS"):
        rows.select("doc_id", "locator", "digest", sha256(F.col("text")).alias("text_sha256")).write.mode("overwrite").parquet(own)
    arrivals = spark.read.schema(ARRIVALS).parquet(own)
    with passing(spark):
        state = stream_state(spark, folder, max(1, len(arrivals.inputFiles())))
        groups = state.withColumn("reference", F.col("keep.locator"))
        if lasts:  # rows are compared with a row of an earlier delivery if there is one
            every = spark.read.schema(ARRIVALS).parquet(f"{folder}/arrivals/*")
            earlier = every.join(arrivals.select("locator"), "locator", "left_anti").groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("old"))
            groups = state.join(arrivals.select("digest").distinct(), "digest").join(earlier, "digest", "left")
            groups = groups.select("digest", "keep", "group_size", F.coalesce("old.locator", "keep.locator").alias("reference"))
        groups = stored(groups, "groups", lasting=True)
        texts = rows
        if lasts:  # the driver sees names of files
            names = lambda of: {r[0] for r in of.distinct().collect()}
            here = names(arrivals.select("locator.file"))
            texts = with_files(rows, names(groups.where("group_size > 1").select("reference.file")) - here, digest)
        wrong = stored(stored(unequal(texts, groups), "unequal").distinct(), "collisions", lasting=True)
        if lasts:
            wrong.write.mode("overwrite").parquet(f"{folder}/collisions/{delivery}")
            wrong = spark.read.schema("digest string").parquet(f"{folder}/collisions/*").distinct()
        joined = arrivals.join(groups, "digest")
        if wrong.head(1):  # digests that different texts share: these rows are grouped by their bytes
            if lasts:
                texts = with_files(rows, names(every.join(wrong, "digest").select("locator.file")) - here, digest)
            apart = stored(texts.join(wrong, "digest"), "apart", lasting=True)
            sizes = stored(apart.groupBy("digest", "text").agg(F.min(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "sizes", lasting=True)
            again = apart.join(sizes, ["digest", "text"]).select("digest", "doc_id", "locator", sha256(F.col("text")).alias("text_sha256"), "keep", "group_size")
            if lasts:
                again = again.join(arrivals.select("locator"), "locator", "left_semi")
            joined = joined.join(wrong, "digest", "left_anti").select(again.columns).unionByName(again)
    if not lasts:
        forget(spark, f"{folder}/state")
        forget(spark, f"{folder}/groups")
    return joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", F.struct("doc_id", "locator").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256", "locator")


def with_files(rows: DataFrame, files: set[str], digest: Callable[[Column], Column]) -> DataFrame:
    """rows, and those of further files."""
    return rows.union(rows_of(located(rows.sparkSession.read.parquet(*sorted(files))), digest)) if files else rows


def unequal(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests under which a row's full bytes differ from those of the reference row, the retained one or an earlier one.

    A bitmap of the repeated digests keeps most other rows from being shuffled; the join after it is exact, so a crowded
    bitmap costs time and nothing else. Rows of one digest are joined with one retained row, and Spark splits such a join
    where a digest has very many."""
    repeated = stored(groups.where("group_size > 1").select("digest", "reference"), "repeated")
    held = likely(texts.select("digest", "locator", "text"), F.col("digest"), repeated, F.col("digest")).where("likely")
    members = stored(held.select("digest", "locator", "text").join(repeated, "digest"), "members")
    references = members.where(F.col("locator") == F.col("reference")).select("digest", F.col("text").alias("reference_text"))
    hits = members.where(F.col("locator") != F.col("reference")).select("digest", "text")
    return hits.join(references, "digest").where(F.col("text") != F.col("reference_text")).select("digest")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    held = located(docs)
    return without(held, stored(copies_of(held).where(~F.col("kept")).select("locator"), "gone", lasting=True))
