"""Exact deduplication by a stream with keyed state that never expires.

The state holds, for each digest of a normalised text, the row that stays, the number of rows and the content's locator (the file of the
table and the row in it); it lives on disk (RocksDB) and in the query's checkpoint, so the stream goes on where it was after any loss. On
hits (digests of more than one row), the rows' locators are followed to their contents, and the full texts are compared byte by byte; two
texts of one digest would stop the run with an error that names the digest. A table that isn't read from files straight away is written
first, so that its rows have locators.

Defined results: null text counts as empty; empty texts are equal to each other; a null identifier sorts after all others; rows that
repeat the same identifier and text are each returned, and each is kept if its identifier is the one that stays; an empty table gives
an empty result; columns beyond identifier and text are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, hinted, shared_dir, table, without_spaces, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream, put back afterwards. One RocksDB cache for all of an executor's stores keeps memory bounded.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no disk is set aside for them in advance
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}

#: Up to so many locators of hits are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

LEDGER = "digest binary, doc_id bigint, n_chars bigint, file string, row bigint"


def located(docs: DataFrame, folder: str) -> DataFrame:
    """docs (doc_id, text) with file and row of each row: of the table's own files, or else of a copy."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        found = docs.select("doc_id", "text", *place)
        found.schema  # noqa: B018  analyses the plan
        return found
    except AnalysisException as e:  # no files below, or of a format without row numbers
        if not (e.getCondition() or "").startswith(("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND")):
            raise
    return written(docs.select("doc_id", "text"), "copy", folder).select("doc_id", "text", *place)


def ledger(docs: DataFrame) -> DataFrame:
    """digest, doc_id, n_chars (code points of the original) and locator (file, row) of every row."""
    return docs.select(
        F.unhex(F.sha2(F.encode(without_spaces(), "UTF-8"), 256)).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "file", "row"
    )


def keyed(rows: DataFrame) -> DataFrame:
    """The keyed state: for each digest the row that stays, with its locator, and the number of rows. rows may be a stream."""
    stays = F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("less"), F.col("file"), F.col("row"))
    return rows.groupBy("digest").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n"))


def stream(rows: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what rows (a streaming DataFrame of LEDGER) has, and returns the latest state of every key."""
    spark = rows.sparkSession
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    out = f"{folder}/state"

    def put(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={batch}")

    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        query = (
            keyed(rows).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/stream").foreachBatch(put).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema("digest binary, stays struct<n_chars: bigint, less: bigint, file: string, row: bigint>, n bigint, batch int")
    # a state only grows in n, and its row that stays only improves: the largest of both is the latest
    return found.parquet(out).groupBy("digest").agg(F.max("stays").alias("stays"), F.max("n").alias("n"))


def false_hits(docs: DataFrame, rows: DataFrame, hits: DataFrame, folder: str) -> DataFrame:
    """Digests whose rows have not all the same bytes: least and greatest text of each hit differ.

    docs: what located() gives; rows: its ledger; hits: digests."""
    places = written(rows.join(hinted(hits.select("digest"), BROADCAST_ROWS), "digest", "left_semi").select("file", "row", "digest"), "places", folder)
    own = docs.select("file", "row", "text").join(hinted(places, BROADCAST_ROWS), ["file", "row"]).select("digest", without_spaces().alias("norm"))
    # texts of a digest that are equal are merged before the shuffle; a hot group sends one text for each task
    return own.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Of equal texts the one with the most code points stays, then the one with the smallest identifier."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    docs = located(columns(docs, doc_id=id_col, text=text_col), folder)
    rows = written(ledger(docs), "ledger", folder)
    feed = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/ledger")
    state = written(stream(feed, folder), "groups", folder)
    wrong = false_hits(docs, rows, state.where("n > 1"), folder)
    if found := wrong.take(5):
        raise ValueError(f"different texts share a SHA-256 digest: {[row.digest.hex() for row in found]}")
    return rows.join(state, "digest", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        (-F.col("stays.less")).cast(kind).alias("keep_id"),
        F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == -F.col("stays.less"), F.col("stays.less").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
