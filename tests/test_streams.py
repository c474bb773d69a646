"""Streams over several batches: expiry, suppression, late rows, and enrichment into a library."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from folio.operators import incremental
from folio.streaming import streams

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, k string, v int"


def feed(spark, place, batches):
    """A stream with a file, and so a batch, for each list of (days, key, value)."""
    for n, rows in enumerate(batches):
        made = spark.createDataFrame([(DAY + datetime.timedelta(days=d), k, v) for d, k, v in rows], SCHEMA).coalesce(1)
        made.write.mode("append").parquet(f"{place}/in")
        files = sorted((f for f in os.listdir(f"{place}/in") if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{place}/in/{f}"))
        os.utime(f"{place}/in/{files[-1]}", (1_700_000_000 + 60 * n,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")


def days(rows):
    return [((r.ts - DAY).total_seconds() / 86_400, *[r[c] for c in r.__fields__ if c not in ("ts", "batch")]) for r in rows]


def test_latest_entry_expires_and_comes_back(spark, tmp_path):
    batches = [[(0, "a", 1), (0, "b", 2), (0, "a", 3)], [(10, "a", 4), (9, "a", 5)], [(31.5, "c", 6)], [(42, "c", 7)], [(43, "b", 8), (1, "a", 9)], [(80, "c", 10)]]
    with streams.keyed_state(spark):
        out = streams.run_to_end(streams.latest_entries(feed(spark, tmp_path, batches), ["k"]), str(tmp_path))
    assert sorted(days(out.collect())) == sorted(
        [(0.0, "a", 3, False), (0.0, "b", 2, False), (10.0, "a", 4, False), (31.5, "c", 6, False), (0.0, "b", 2, True), (42.0, "c", 7, False), (10.0, "a", 4, True), (43.0, "b", 8, False), (80.0, "c", 10, False), (43.0, "b", 8, True)]
    )


def test_suppression_lasts_for_the_lifetime(spark, tmp_path):
    minute = 1 / 1440
    batches = [[(20 * minute, "a", 2), (0, "a", 1), (31 * minute, "a", 3)], [(40 * minute, "a", 4), (61 * minute, "a", 5), (0, "b", 6)], [(1, "a", 7)], [(1, "c", 11)], [(0.5, "b", 8), (1 + 29 * minute, "a", 9), (1 + 31 * minute, "a", 10)]]
    with streams.keyed_state(spark):
        out = streams.run_to_end(streams.suppressed(feed(spark, tmp_path, batches), ["k"]), str(tmp_path))
    # the last row of b is later than the watermark allows
    assert sorted(r.v for r in out.collect()) == [1, 3, 5, 6, 7, 10, 11]


def test_late_rows_are_not_counted(spark, tmp_path):
    hour = 1 / 24
    batches = [[(0.2, "a", 1), (0.4, "a", 1)], [(3, "a", 1)], [(3, "b", 1)], [(0.5, "a", 1), (3 - hour / 2, "a", 1)]]
    out = streams.run_to_end(streams.progress(feed(spark, tmp_path, batches), kind="k"), str(tmp_path), "update")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r.batch):
        last[r.k, r.window_start] = r.n
    assert last == {("a", DAY): 2, ("a", DAY + datetime.timedelta(days=3)): 1, ("b", DAY + datetime.timedelta(days=3)): 1, ("a", DAY + datetime.timedelta(days=2)): 1}


LIBRARY = "id long, signature string, made string, updated_at long"


def names(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_touched_folders_only(spark, tmp_path):
    library = incremental.Library(spark, f"{tmp_path}/books", LIBRARY, buckets=32)
    assert library.rows().count() == 0
    library.upsert(spark.createDataFrame([(i, "s", f"m{i}", 1) for i in range(200)], LIBRARY))
    before = names(tmp_path)
    library.upsert(spark.createDataFrame([(7, "t", "new", 2), (9, "t", "older", 0), (1_000, "s", "more", 1)], LIBRARY))
    rows = {r.id: r.made for r in library.rows().collect()}
    assert len(rows) == 201 and rows[7] == "new" and rows[9] == "m9" and rows[1_000] == "more"
    assert len(before - names(tmp_path)) <= 3 and len(before & names(tmp_path)) >= len(before) - 3
    library.upsert(spark.createDataFrame([], LIBRARY))
    again = names(tmp_path)
    library.upsert(library.rows().where("id = 7"))
    assert {r.id: r.made for r in library.rows().collect()} == rows and len(again - names(tmp_path)) == 1


def test_enrichment_is_done_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    library = incremental.Library(spark, f"{tmp_path}/books", LIBRARY, buckets=8)

    def sign(batch):
        return batch.withColumn("signature", F.sha2("text", 256))

    @F.udf("string")
    def work(text):
        seen.add(1)
        return text.upper()

    def run(state="state"):
        enrich = lambda rows: rows.select("id", "signature", work("text").alias("made"), "updated_at")
        streams.enrich_into_library(spark, f"{tmp_path}/in", "id long, text string, updated_at long", sign, enrich, library, f"{tmp_path}/{state}", 1).awaitTermination()

    def put(*rows):
        spark.createDataFrame(rows, "id long, text string, updated_at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put((1, "one", 1), (2, "two", 1))
    run()
    assert seen.value == 2
    put((1, "one", 2), (3, "three", 2))  # the first is unchanged
    run()
    assert seen.value == 3
    put((2, "two anew", 3))  # a changed file
    run()
    run()
    assert seen.value == 4 and {r.id: r.made for r in library.rows().collect()} == {1: "ONE", 2: "TWO ANEW", 3: "THREE"}
    before = names(f"{tmp_path}/books")
    run("lost")  # the stream's own state is lost: only the older text of 2 is met again, and loses to the newer one
    assert seen.value <= 6 and {r.id: r.made for r in library.rows().collect()} == {1: "ONE", 2: "TWO ANEW", 3: "THREE"}
    assert len(before - names(f"{tmp_path}/books")) <= 1


@pytest.mark.parametrize("whole", [None, ["book"]])
def test_edits_by_field(spark, whole):
    from folio.operators import batches

    book = spark.createDataFrame([("b", i, "x", "s", "a", 5) for i in range(4)] + [("c", 0, "x", "s", "a", 5)], "book string, para int, original string, summary string, accessible string, more int")
    edits = spark.createDataFrame(
        [("b", 0, "new source", None, None, 5), ("b", 0, None, "later", None, 6), ("b", 1, None, "first", " ", 1), ("b", 1, None, "earlier", None, 4), ("b", 2, "  ", "", None, 9), ("b", 3, None, None, "said", 7), ("b", 3, None, None, "also", 7)],
        "book string, para int, original string, summary string, accessible string, edited_at int",
    )
    got = {(r.book, r.para): (r.original, r.summary, r.accessible, r.edited) for r in batches.apply_edits(book, edits, ["book", "para"], whole=whole).collect()}
    cleared = whole is not None
    assert got == {
        ("b", 0): ("new source", "later", None, True), ("b", 1): ("x", None if cleared else "earlier", None if cleared else "a", True), ("b", 2): ("x", None if cleared else "s", None if cleared else "a", False),
        ("b", 3): ("x", None if cleared else "s", "said", True), ("c", 0): ("x", "s", "a", False),
    }
