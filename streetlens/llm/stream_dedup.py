"""Exact dedup as a stateful stream with disk-backed state that never expires.

The normalised texts are stored once. A stream over that store, in micro-batches
of bounded bytes, is aggregated per digest in a RocksDB state store: the state of
a digest retains the stable identifier that stays, how many rows it has seen and
a locator (file and row) of the content kept. Spark combines rows map-side before
they reach the state, so a text with a third of all rows costs one row a task.
After the last micro-batch the rows of digests that were hit again are checked on
the full bytes against the content at the locator; should two texts ever share a
digest, their rows are told apart by the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard_path, free_names, lower_ascii, materialize, scratch, slim

#: State lives in RocksDB; commits upload their changes only, and many small stores do not reserve disk ahead.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests hit again are sent to every executor up to this number (48 bytes each); above it they are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


#: Stored bytes that a micro-batch takes, about, and what is stored.
BATCH_BYTES = str(64 << 30)
STORED = "digest binary, doc_id long, text string"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def track(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Run the stateful aggregation of a stream (digest, doc_id, file, row) until its input is used up, in bounded micro-batches.

    Every micro-batch writes the digests it changed below ``table``; a batch
    that is run again after a failure overwrites its own folder. With the same
    ``checkpoint`` a later call goes on where the last one ended.
    """
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def located(store: DataFrame) -> DataFrame:
    """A table of stored files with the place of each row: ``file`` (name) and ``row`` (number in it)."""
    return store.withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")})


def dedup_state(spark: SparkSession, store: str) -> DataFrame:
    """(digest, keep, group_size) of the store's rows (digest, doc_id, text), through the stateful stream.

    ``keep`` is the row that stays: its id, and where its content is stored (file, row).
    """
    table, checkpoint = (scratch(spark, f"dedup-{x}") for x in ("state", "checkpoint"))
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        files = spark.readStream.schema(STORED).option("maxBytesPerTrigger", BATCH_BYTES).parquet(store)
        track(located(files).select("digest", "doc_id", "file", "row"), table, checkpoint)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    schema = "digest binary, keep struct<doc_id:bigint,file:string,row:bigint>, group_size bigint"
    changed = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(table) if _exists(spark, table) else spark.createDataFrame([], schema)
    # a digest that several batches changed has a row from each; the last one has seen most
    latest = changed.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "group_size").alias("s")).select("digest", "s.*")
    latest = materialize(latest, "dedup-digests")
    for path in (table, checkpoint):
        discard_path(spark, path)
    return latest


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, text_key) for each row of ``docs``.

    * Texts are equal when identical after lower-casing A-Z; a null text is empty.
    * Of equal texts the row with the largest doc_id stays; a null id is the
      smallest. Of repeated rows with that id exactly one has ``kept`` true.
    * An empty table gives an empty result; other columns are ignored.
    * ``digest`` may be weak: rows that it confuses are parted by their bytes,
      which is what ``text_key`` (null otherwise) then shows.
    """
    spark = docs.sparkSession
    base = slim(docs, id_col, text_col).select("doc_id", lower_ascii(F.col("text")).alias("text"))
    store = scratch(spark, "dedup-store")
    base.select(digest(F.col("text")).alias("digest"), "doc_id", "text").write.parquet(store)
    state = dedup_state(spark, store)
    stored = located(spark.read.schema(STORED).parquet(store))
    stays = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    out = stored.select("digest", "doc_id", "file", "row").join(state, "digest").select("digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), F.lit(None).cast("string").alias("text_key"))
    confused = _confused(stored, state)
    if not confused.limit(1).count():
        found = materialize(out, "dedup-found")
        discard_path(spark, store)
        return found
    parted = stored.join(confused, "digest").select("digest", "doc_id", "file", "row", F.sha2("text", 512).alias("text_key"), "text")
    best = parted.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = parted.join(best, ["digest", "text"]).select("digest", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_key")
    found = materialize(out.join(confused, "digest", "left_anti").unionByName(again), "dedup-found")
    discard_path(spark, store)
    return found


def _confused(stored: DataFrame, state: DataFrame) -> DataFrame:
    """Digests hit more than once that have a row whose bytes are not those of the content kept, which is read at its locator.

    Equal texts of a task are compared once: they are combined before they are shuffled.
    """
    hits = state.where("group_size > 1").select("digest", "keep")
    if hits.count() <= BROADCAST_DIGESTS:
        hits = F.broadcast(hits)
    again = stored.join(hits, "digest").withColumn("own", (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))
    texts = again.groupBy("digest").agg(F.max(F.when(F.col("own"), F.col("text"))).alias("kept"), F.min("text").alias("a"), F.max("text").alias("b"))
    return materialize(texts.where("kept is null or a <> kept or b <> kept").select("digest"), "dedup-confused")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts are equal as in ``exact_dedup``; a null text is empty, a null id the
    smallest. Of repeated rows with the same id and equal texts one stays. An
    empty table gives an empty result; other columns may have any names.
    """
    own_id, own_digest, digest = free_names(docs, "kept_id", "kept_digest", "dedup_digest")
    found = exact_dedup(docs, id_col, text_col)
    kept = found.where("kept").select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest))
    text = lower_ascii(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    marked = docs.withColumn(digest, sha256(text))
    match = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own_id)) & (F.col(digest) == F.col(own_digest))
    rest = marked.join(kept, match, "left_semi")
    if found.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():
        rest = rest.dropDuplicates([id_col, digest])
    return rest.drop(digest)
