"""Exact deduplication as a stateful stream: keyed state on disk, without expiry, and a check of full bytes on hits.

Each document is reduced to a fingerprint: the SHA-256 of its text without white space, its length in code points, its
doc_id and a locator (its row number in the fingerprint table). A streaming aggregation keyed by the digest keeps,
for ever, the row that stays and the size of its group; the state store is RocksDB, and partial aggregates before the
shuffle make a hot group of copies one row for each task. The full texts of rows that share a digest are then
compared; texts that only share the digest are grouped by their text itself.

Defined cases: null text counts as empty, and empty and all-space texts are equal; of repeated rows one stays; a null
doc_id ranks after all others; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.bloom import BROADCAST_BLOCKS, blocks_for, bloom_filter, probe
from folio.llm.frames import shared_dir

SPACES = " \t\n\x0b\f\r"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # else each of many small stores holds megabytes of empty files
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # one bound for all partitions of an executor, however many it serves, and no store held after its commit
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", digest(F.col("text")).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.monotonically_increasing_id().alias("locator"))


def best_row() -> Column:
    """Least for the row with the most code points, then the least doc_id, then the first."""
    return F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "locator"))


def stream_groups(prints: DataFrame, place: str) -> DataFrame:
    """digest, best, group_size of all fingerprints in a stream, after it has ended; `place` holds state and results.

    Called again with the same place after more fingerprints have come, it goes on from its state.
    """
    spark = prints.sparkSession
    groups = prints.groupBy("digest").agg(best_row().alias("best"), F.count("*").alias("group_size"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/groups/batch={number}")

    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        groups.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fields = f"digest binary, best struct<less: long, nameless: boolean, doc_id: {prints.schema['doc_id'].dataType.simpleString()}, locator: long>, group_size long, batch long"
    latest = spark.read.schema(fields).option("basePath", f"{place}/groups").parquet(f"{place}/groups")
    return latest.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("g")).select("digest", "g.best", "g.group_size")


def unequal_digests(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests that stand for more than one text: the least and the greatest full text of their rows differ.

    Only texts that may have a copy are compared; the two extremes are partial aggregates, so that a large group's
    texts don't meet in one task.
    """
    hits = groups.where("group_size > 1").select(F.col("digest").alias("hit"))
    blocks = blocks_for(hits.count())
    texts = docs.select(normalised(F.col("text")).alias("content"), digest(F.col("text")).alias("digest"))
    if blocks <= BROADCAST_BLOCKS:
        copies = probe(texts, "digest", bloom_filter(hits, "hit", blocks), blocks, "possible").where("possible")
    else:
        copies = texts.join(hits, F.col("digest") == F.col("hit"), "left_semi")
    return copies.groupBy("digest").agg(F.min("content").alias("least"), F.max("content").alias("most")).where("least <> most").select("digest")


def deduplicate(docs: DataFrame, files_per_batch: int = 1_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, a row for each document."""
    spark = docs.sparkSession
    place = f"{shared_dir(spark)}/exact-dedup-{uuid.uuid4().hex}"
    fingerprints(docs).write.parquet(f"{place}/prints")
    prints = spark.read.parquet(f"{place}/prints")
    groups = stream_groups(spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{place}/prints"), place)
    unequal = unequal_digests(docs, groups)
    if not unequal.isEmpty():
        groups = _by_text(docs, prints, groups, unequal)
        return _rows(_with_texts(prints, docs, unequal, "left"), groups, ["digest", "content"])
    return _rows(prints, groups, ["digest"])


def _rows(prints: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    on = [prints[k].eqNullSafe(groups[k]) for k in keys]
    return prints.join(groups, on).select(
        prints["doc_id"], F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("best.locator")).alias("kept"), F.lower(F.hex(prints["digest"])).alias("text_sha256")
    )


def _texts_of(docs: DataFrame, unequal: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("content"))
    return texts.join(unequal, "digest", "left_semi").distinct()


def _with_texts(prints: DataFrame, docs: DataFrame, unequal: DataFrame, how: str) -> DataFrame:
    """prints with the content of rows of unequal texts; rows without a doc_id are matched too."""
    texts = _texts_of(docs, unequal).select(F.col("doc_id").alias("_id"), F.col("n").alias("_n"), F.col("digest").alias("_digest"), "content")
    return prints.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest")), how).drop("_id", "_n", "_digest")


def _by_text(docs: DataFrame, prints: DataFrame, groups: DataFrame, unequal: DataFrame) -> DataFrame:
    """The groups, those of unequal texts parted by the texts themselves."""
    parted = _with_texts(prints, docs, unequal, "inner").groupBy("digest", "content").agg(best_row().alias("best"), F.count("*").alias("group_size"))
    whole = groups.join(unequal, "digest", "left_anti").withColumn("content", F.lit(None).cast("string"))
    return whole.select("digest", "content", "best", "group_size").union(parted.select("digest", "content", "best", "group_size"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: those with the doc_id, length and text of a kept row, once each."""
    kept = deduplicate(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest")).distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id"), digest(F.col("text")).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    first = Window.partitionBy("digest", "doc_id").orderBy(F.desc("n"))
    return found.withColumn("place", F.row_number().over(first)).where("place = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
