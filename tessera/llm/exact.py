"""Exact deduplication as a stateful stream.

The documents are a stream of micro-batches. The keyed state is the state store
of a streaming aggregation: disk-backed (RocksDB, checkpointed to the shared
folder), keyed by the text's digest, without watermark and so without expiry.
Per digest it retains a stable identifier (the largest doc_id so far), a content
locator (file and row of that document) and the count. Partial aggregation runs
before the shuffle, so a text that a third of all rows share reaches its key as
one row a task. Each micro-batch appends the keys it changed to a table.

A digest that is met again is only a hit: the bytes of every hit are compared
with those at the locator of the row that would stay. Rows that differ (digests
collide) are regrouped by their whole bytes. So results rest on texts, not on
digests; a weak digest only costs time.

Null text counts as empty. Equal texts form a group whatever their other columns
hold; the largest doc_id stays (a null identifier is below all others), and rows
that repeat identifier and text are all reported, kept where the identifier is
the group's. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, kept, materialize, scope, scratch

#: A key is hot from this share of all rows on; so at most 1/HOT keys are.
HOT = 1 / 500
#: Rows that one copy of a text is compared with.
SHARE = 2000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def stream_state(docs: DataFrame, digest, where: str) -> None:
    """Run ``docs`` (a stream of doc_id, text, locator) through the state to its end."""
    keyed = docs.select("doc_id", "locator", digest(F.col("text")).alias("digest"))
    state = keyed.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("last"),
        F.count(F.lit(1)).alias("group_size"),
    )

    def keep(changed: DataFrame, epoch: int) -> None:
        # The folder is named by the epoch: a batch that is run again replaces its own rows.
        changed.select("digest", F.col("last.doc_id").alias("keep_id"), F.col("last.locator").alias("locator"), "group_size").write.mode("overwrite").parquet(f"{where}/changed/epoch={epoch}")

    query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def final_state(spark: SparkSession, where: str) -> DataFrame:
    """The last state of every key: digest, keep_id, locator, group_size."""
    kinds = "digest string, keep_id long, locator struct<file: string, row: bigint>, group_size long"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/changed")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], kinds)
    changed = spark.read.schema(kinds + ", epoch int").parquet(f"{where}/changed")
    # Counts only grow: the last state of a key is the one with the largest count.
    last = F.max_by(F.struct("keep_id", "locator", "group_size"), F.col("group_size"))
    return materialize(changed.groupBy("digest").agg(last.alias("s")).select("digest", "s.*"), "exact-state")


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream, whose state lies on disk."""
    own = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Many small stores: no disk ahead of need, few old versions.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.minBatchesToRetain": "2",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        own.conf.set(key, value)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        own.conf.set(key, spark.conf.get(key))
    return own


def joined_by_digest(rows: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """rows ⋈ state on digest. Hot digests, at most 1/HOT, are joined by broadcast.

    A hot digest has a share HOT of all rows, so the broadcast side has at most
    1/HOT rows of fixed size, whatever the input.
    """
    hot = F.col("group_size") >= max(2, int(total * HOT))
    few = F.broadcast(state.where(hot))
    keys = F.broadcast(state.where(hot).select("digest"))
    return rows.join(few, "digest").unionByName(rows.join(keys, "digest", "left_anti").join(state.where(~hot), "digest"))


def deduplicate(spark: SparkSession, path: str, batches: int = 3, digest=sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row under ``path``.

    The files present are taken in about ``batches`` micro-batches.
    """
    with scope(spark):
        return kept(deduplicated(spark, path, batches, digest), "exact")


def deduplicated(spark: SparkSession, path: str, batches: int, digest) -> DataFrame:
    where, found = scratch(spark, "exact"), spark.read.parquet(path)
    schema, files = found.schema, len(found.inputFiles())
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def shape(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), locator.alias("locator"))

    # As a pattern, the path may be a folder of files or a single file.
    whole = path.rstrip("/")
    whole = f"{whole[:-1]}[{whole[-1]}]"
    source = state_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(whole)
    stream_state(shape(source), digest, where)
    state = final_state(spark, where)
    docs = shape(found)
    rows = materialize(docs.select("doc_id", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("text_sha256")), "exact-rows")
    total = rows.count()
    placed = joined_by_digest(rows, state.drop("locator"), total)

    # Full bytes of every hit against those at the locator of the row that stays. Texts
    # whose digest is met once are left out where they are read; groups are spread over
    # copies of the text they are compared with, one for every SHARE rows.
    repeated = state.where("group_size > 1").withColumn("salts", F.ceil(F.col("group_size") / SHARE).cast("int")).withColumnRenamed("locator", "at").drop("keep_id")
    texts, _ = apart(docs.select("locator", "text", digest(F.col("text")).alias("digest")), repeated.select("digest"), F.col("digest"))
    hits = materialize(joined_by_digest(texts, repeated, total), "exact-hits")
    stays = hits.where(F.col("locator") == F.col("at")).select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    compared = hits.where(F.col("locator") != F.col("at")).withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int")).join(stays, ["digest", "salt"])
    differ = materialize(compared.where("text <> kept_text").select("digest").distinct(), "exact-collisions")
    result = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if differ.isEmpty():
        return placed.select(*result)
    # Colliding digests: their rows are grouped by the bytes themselves.
    again = docs.withColumn("digest", digest(F.col("text"))).join(differ, "digest", "left_semi")
    groups = again.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    fixed = again.join(groups, "text").withColumn("text_sha256", sha256(F.col("text"))).select(*result)
    return placed.join(differ, "digest", "left_anti").select(*result).unionByName(fixed)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
