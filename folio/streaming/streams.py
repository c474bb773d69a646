"""Structured Streaming: incremental enrichment, duplicate suppression, latest entries, running progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from folio.operators.incremental import Library


def enrich_new_files(spark: SparkSession, source: str, schema, enrich: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 1_000) -> StreamingQuery:
    """New Parquet files go through `enrich` once; a batch that is tried again overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_requests(events: DataFrame, key: list[str], at: str = "ts", lifetime: str = "30 minutes") -> DataFrame:
    """The first event of each key within the lifetime."""
    return events.withWatermark(at, lifetime).dropDuplicatesWithinWatermark(key)


def progress(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are dropped."""
    out = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n")


class _Latest(StatefulProcessor):
    """Of each key the latest entry; it expires a lifetime after its time, and a timer then removes it from the state."""

    def __init__(self, fields: list[str], state: StructType, lifetime: int):
        self.fields, self.schema, self.lifetime = fields, state, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.entry.get() if self.entry.exists() else None
        newest, now = held, timerValues.getCurrentWatermarkInMs()
        for row in rows:
            entry = tuple(row[f] for f in (*self.fields, "_at"))
            # of equal times the greater row, so that the order of rows in a batch doesn't matter
            if newest is None or (entry[-1], repr(entry)) > (newest[-1], repr(newest)):
                newest = entry
        if newest is held or self._ends(newest) <= now:
            return
        if held is not None:
            self.handle.deleteTimer(self._ends(held))
        self.entry.update(newest)
        self.handle.registerTimer(self._ends(newest))
        yield self._made(newest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.entry.exists():
            held = self.entry.get()
            self.entry.clear()
            yield self._made(held, True)

    def _ends(self, entry: tuple) -> int:
        return -(-entry[-1] // 1000) + self.lifetime

    def _made(self, entry: tuple, expired: bool) -> Row:
        return Row(**dict(zip(self.fields, entry, strict=False)), expired=expired)

    def close(self) -> None:
        pass


class _First(StatefulProcessor):
    """The first event of each key, and then each one that comes a lifetime or more after the last one given."""

    def __init__(self, fields: list[str], lifetime: int):
        self.fields, self.lifetime = fields, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.given = handle, handle.getValueState("given", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.given.get()[0] if self.given.exists() else None
        before = last
        for row in sorted(rows, key=lambda r: (r._at, repr(r))):
            if last is None or row._at >= last + self.lifetime * 1000:
                last = row._at
                yield Row(**{f: row[f] for f in self.fields})
        if last != before:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000) + self.lifetime)
            self.given.update((last,))
            self.handle.registerTimer(-(-last // 1000) + self.lifetime)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.given.clear()
        return iter(())

    def close(self) -> None:
        pass


def _keyed(events: DataFrame, key: list[str], at: str, late: str):
    """The events by key, with their time in microseconds."""
    return events.withColumn("_at", F.unix_micros(at)).withWatermark(at, late).groupBy(*key)


def latest_entries(events: DataFrame, key: list[str], at: str = "ts", lifetime_days: float = 30, late: str = "1 hour") -> DataFrame:
    """The latest event of each key as it changes, with `expired`: false for a new latest one, true when its lifetime is over by the watermark.

    The state holds an entry only for its lifetime; a key that comes back later begins anew. Needs RocksDB state stores (`keyed_state`).
    """
    fields = events.columns
    state = StructType([*events.schema.fields, StructField("_at", LongType())])
    made = StructType([*events.schema.fields, StructField("expired", BooleanType())])
    return _keyed(events, key, at, late).transformWithState(_Latest(fields, state, int(lifetime_days * 86_400_000)), made, "Append", "EventTime")


def suppressed(events: DataFrame, key: list[str], at: str = "ts", lifetime_minutes: float = 30, late: str = "1 hour") -> DataFrame:
    """Events without those that come within the lifetime of the last one given of their key; the order of rows in a batch doesn't matter."""
    return _keyed(events, key, at, late).transformWithState(_First(events.columns, int(lifetime_minutes * 60_000)), events.schema, "Append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State stores that timers need, for the streams that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def enrich_into_library(spark: SparkSession, source: str, schema, sign: Callable[[DataFrame], DataFrame], enrich: Callable[[DataFrame], DataFrame], library: Library, checkpoint: str, files: int = 1_000) -> StreamingQuery:
    """New Parquet files are signed (the library's key and `signature`), and only what the library doesn't have with this signature goes through `enrich` and into it.

    A batch that is tried again finds its rows in the library and adds nothing, so each row is enriched once. `enrich` gets the signed
    rows and returns the library's columns. Of rows of one batch with the same key the greatest signature counts.
    """

    def save(batch: DataFrame, number: int) -> None:
        signed = sign(batch)
        newest = Window.partitionBy(library.key).orderBy(F.desc("signature"))
        once = signed.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        library.upsert(enrich(library.pending(once)))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(result: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """A stream's rows after all its input, written as Parquet by batch below `place` and read again."""
    spark = result.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    result.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    fields = StructType([*result.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(fields).option("basePath", f"{place}/rows").parquet(f"{place}/rows")
