"""Greedy segmentation of groups of any size: where a segment ends depends on all before it, but not in one task.

Rows get their numbers by ranges (`places.numbered`), and a range of `width` rows is a task's array of sizes, with the next
`items` rows beside it. From sums of sizes each row's next start is found by search: where the segment would end that it begins. So
a range is a function: for each of its first `items` rows, as the first start in it, doubling the next starts gives the first start in the range after
it, and the number of segments between. Functions of neighbouring ranges are composed, `fan` at a time and level by level; going down again,
each range gets its own first start and the number of segments before it, and numbers its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.places import numbered, settled

STEP = "array<struct<x: int, n: long>>"


def next_starts(sizes: np.ndarray, items: int, most: int) -> np.ndarray:
    """Of each row the one after the segment that it begins: of at most `items` rows, and of at most `most` in all but for its first row."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(len(sizes))
    full = np.searchsorted(total, total[:-1] + most, side="right") - 1
    return np.minimum(np.maximum(full, at + 1), at + items)


def range_function(sizes: np.ndarray, width: int, items: int, most: int) -> list[dict]:
    """For each of a range's first rows, as its first start: the first start in the next range, and the segments that begin before it."""
    after = next_starts(sizes, items, most)[:width]
    held = len(after)
    # places past the range stay where they are
    jump = np.concatenate([after, np.arange(held, held + items + 1)])
    count = np.concatenate([np.ones(held, np.int64), np.zeros(items + 1, np.int64)])
    while (jump[:items] < held).any():
        count, jump = count + count[jump], jump[jump]
    return [{"x": int(jump[e] - held) if e < held else e - held, "n": int(count[e]) if e < held else 0} for e in range(items)]


def _compose(functions: Column, items: int) -> Column:
    """One function that does what an array of them does in order."""
    none = F.transform(F.sequence(F.lit(0), F.lit(items - 1)), lambda e: F.struct(e.cast("int").alias("x"), F.lit(0).cast("long").alias("n"))).cast(STEP)
    step = lambda state, f: F.transform(state, lambda s: F.struct(F.get(f, s["x"])["x"].alias("x"), (s["n"] + F.get(f, s["x"])["n"]).alias("n")))
    return F.aggregate(functions, none, step)


def _entries(ranges: DataFrame, items: int, fan: int) -> DataFrame:
    """ranges(k, r, f) -> k, r, first (the first start in a range) and before (the segments that begin before it)."""
    last = ranges.agg(F.max("r")).first()[0]
    if not last:
        return ranges.select("k", "r", F.lit(0).alias("first"), F.lit(0).cast("long").alias("before"))
    above = ranges.groupBy("k", F.floor(F.col("r") / fan).alias("s")).agg(F.array_sort(F.collect_list(F.struct("r", "f"))).alias("own"))
    top = _entries(above.select("k", F.col("s").alias("r"), _compose(F.transform("own", lambda o: o["f"]), items).alias("f")), items, fan)
    begun = above.join(top.withColumnRenamed("r", "s"), ["k", "s"])
    state = lambda first, before: F.struct(first.cast("int").alias("first"), before.cast("long").alias("before"))

    def step(acc: Column, o: Column) -> Column:
        now = F.get(acc, F.size(acc) - 1)
        then = F.get(o["f"], now["first"])
        return F.concat(acc, F.array(state(then["x"], now["before"] + then["n"])))

    states = F.aggregate("own", F.array(state(F.col("first"), F.col("before"))), step)
    each = begun.select("k", F.explode(F.arrays_zip(F.transform("own", lambda o: o["r"]).alias("r"), F.slice(states, F.lit(1), F.size("own")).alias("state"))).alias("e"))
    return each.select("k", "e.r", "e.state.first", "e.state.before")


def greedy_segments(df: DataFrame, by, order: str, size: str, items: int, most: int, name: str = "segment", width: int = 8_192, fan: int = 1_024) -> DataFrame:
    """by, name (from 0 in each group), order, size: consecutive rows of a group, by an integer column, in segments of at most `items` rows, and of at most `most` in all if of more than one row.

    Nulls in `by` are a group; a null size is 0; rows of equal order are taken by size.
    """
    if items >= width:
        raise ValueError("a range must be longer than a segment")
    kinds = {c: df.schema[c].dataType.simpleString() for c in (*by, order, size)}
    rows = settled(df.select(*by, order, F.coalesce(size, F.lit(0)).cast(kinds[size]).alias(size)))
    placed = numbered(rows, by, order, "_i", ties=(size,)).select(F.struct(*by).alias("k"), F.col("_i").cast("long").alias("i"), F.col(order).alias("o"), F.col(size).cast("long").alias("v"))
    # the first rows of a range stand beside the range before it too
    own = F.floor(F.col("i") / width)
    shown = F.when((F.col("i") % width < items) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    packed = settled(placed.withColumn("r", F.explode(shown)).groupBy("k", "r").agg(F.array_sort(F.collect_list(F.struct("i", "o", "v"))).alias("rows")))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for sizes in batch.column(2):
                made.append(range_function(sizes.values.to_numpy(), width, items, most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.struct([("x", pa.int32()), ("n", pa.int64())])))], names=["k", "r", "f"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for sizes, first, before in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                values = sizes.values.to_numpy()
                after = next_starts(values, items, most).tolist()
                held = min(len(after), width)
                starts, at = np.zeros(held, np.int64), first
                while at < held:
                    starts[at] = 1
                    at = after[at]
                made.append(before - 1 + np.cumsum(starts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["rows", "segments"])

    sizes = F.transform("rows", lambda x: x["v"])
    key = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in by) + ">"
    known = settled(packed.select("k", "r", sizes.alias("sizes")).mapInArrow(functions, f"k {key}, r long, f {STEP}"))
    entries = _entries(known, items, fan)
    kept = packed.join(entries, ["k", "r"]).select(F.struct("k", F.slice("rows", 1, width).alias("rows")).alias("rows"), sizes.alias("sizes"), "first", "before")
    listed = f"struct<k: {key}, rows: array<struct<i: long, o: {kinds[order]}, v: long>>>"
    done = kept.mapInArrow(number, f"rows {listed}, segments array<long>")
    each = done.select("rows.k", F.explode(F.arrays_zip(F.col("rows.rows").alias("x"), F.col("segments").alias("s"))).alias("e"))
    return each.select(*[F.col(f"k.`{c}`").alias(c) for c in by], F.col("e.s").alias(name), F.col("e.x.o").alias(order), F.col("e.x.v").cast(kinds[size]).alias(size))
