"""Exact deduplication as a stateful stream.

The documents flow through a streaming aggregation whose state, keyed by the text's digest, lies in
RocksDB on disk and never expires. For each digest the state retains the stable identifier of the row
that stays, a content locator (file and row number in it) and the number of rows seen, never a text.
Rows that hit a digest with other rows are then compared byte for byte with the content at the
locator; texts that share a digest and nothing else are parted into groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import fresh_name, materialize, release, shared_folder, table, text_of

#: The state store's settings while the stream starts; the session's own are put back after.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each state partition reserves megabytes for files that stay small
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of files in a micro-batch of the stream.
MAX_BYTES = 64 << 30
#: While hits are fetched: Bloom filters in joins whatever the size of the side that is filtered.
HIT_CONF = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_state(rows: DataFrame) -> DataFrame:
    """Per digest: the largest (identifier, file, row) and the number of rows."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))


def _stream(spark: SparkSession, path: str, keyed: Callable[[DataFrame], DataFrame], max_bytes: int) -> DataFrame:
    """Run the stream over the files at ``path`` to its end; one row for each digest."""
    updates, log = shared_folder(spark, "dedup-updates"), shared_folder(spark, "dedup-state")
    schema = spark.read.parquet(path).schema
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        # as a pattern, since the stream takes a single file by a pattern alone
        source = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
        query = (
            digest_state(keyed(source))
            .writeStream.outputMode("update")
            # a batch that is run again overwrites its own folder
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{updates}/batch={n}"))
            .option("checkpointLocation", log)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    shape = "digest string, top struct<doc_id: bigint, file: string, row: bigint>, group_size bigint"
    # both values only grow, so the last update of a digest holds the largest of each
    seen = spark.read.schema(shape + ", batch int").parquet(updates) if query.lastProgress else spark.createDataFrame([], shape)
    return materialize(seen.groupBy("digest").agg(F.max("top").alias("top"), F.max("group_size").alias("group_size")), "dedup-digests")


def exact_dedup(
    documents: DataFrame,
    path: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    max_bytes_per_trigger: int = MAX_BYTES,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, digest, file, row.

    ``path`` names the Parquet files that hold exactly these rows; without it the two columns needed
    are written to the shared folder first. Equal texts (null counts as empty) form a group; the row
    with the largest identifier stays, of rows that repeat an identifier the one with the largest
    locator. A null identifier is smaller than any other. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    if path is None:
        path = shared_folder(spark, "dedup-landing")
        documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).write.parquet(path)

    def keyed(df: DataFrame) -> DataFrame:
        text = text_of(text_col)
        return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    digests = _stream(spark, path, keyed, max_bytes_per_trigger)
    docs = keyed(spark.read.parquet(path))
    other = _unequal(docs, digests)

    narrow = docs.drop("text").join(digests, "digest")
    n_other = other.groupBy("digest").agg(F.count(F.lit(1)).alias("n_other"))
    same = (
        narrow.join(other.select("file", "row"), ["file", "row"], "left_anti")
        .join(n_other, "digest", "left")
        .withColumn("group_size", F.col("group_size") - F.coalesce("n_other", F.lit(0)))
    )
    apart = other.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    apart = other.join(apart, ["digest", "text"])
    out = ["doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", ((F.col("file") == F.col("top.file")) & (F.col("row") == F.col("top.row"))).alias("kept"), "digest", "file", "row"]
    return same.select(*out).unionByName(apart.select(*out))


def _unequal(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows whose bytes differ from the content at their digest's locator.

    Only rows of digests that were hit are asked for their bytes: Spark's Bloom filter of those digests
    keeps the other texts from being shuffled, in so far as it has room for them.
    """
    spark = docs.sparkSession
    hits = digests.where("group_size > 1").select("digest", F.col("top.file").alias("kept_file"), F.col("top.row").alias("kept_row"))
    with_conf = {k: spark.conf.get(k, None) for k in HIT_CONF}
    for k, v in HIT_CONF.items():
        spark.conf.set(k, v)
    try:
        written = materialize(docs.join(hits, "digest"), "dedup-hits")
    finally:
        for k, v in with_conf.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    is_kept = (F.col("file") == F.col("kept_file")) & (F.col("row") == F.col("kept_row"))
    rows, content = written.where(~is_kept).drop("kept_file", "kept_row"), written.where(is_kept).select("digest", F.col("text").alias("kept_text"))
    found = rows.join(content, "digest").where(F.col("text") != F.col("kept_text")).drop("kept_text")
    out = materialize(found, "dedup-unequal")
    release(written)
    return out


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns, whatever their names.

    Nulls, ties, repeated rows and empty tables are treated as in exact_dedup(), which names rows by
    their place in files, so that rows that repeat in all columns are still told apart.
    """
    spark = documents.sparkSession
    path = shared_folder(spark, "dedup-landing")
    documents.write.parquet(path)
    file, row = fresh_name(documents, "_kept_file"), fresh_name(documents, "_kept_row")
    stay = exact_dedup(documents, path).where("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    landed = spark.read.schema(documents.schema).parquet(path)
    names = [F.col(f"`{c}`") for c in documents.columns]
    located = landed.select(*names, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return located.join(stay, [file, row], "left_semi").select(*names)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    found = exact_dedup(table(spark, sf_dir, "documents"), path)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
