"""Mixing sources to target weights: hash-random order, distributed prefix sums of word counts, an exact cut per source.

Each document gets a random key from a hash of its doc_id. Within its source, the range of keys is divided into equal
ranges of about `range_rows` documents, so that a hot source is many sort groups. Running sums inside a range plus the
totals of earlier ranges give each document's place in its source's word sequence; whole epochs are taken first, then
the sequence is cut at the source's exact remaining budget. A document at the cut is taken in part.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of size 0 take 0;
repeated rows count as separate documents, in any order between them; an empty table gives an empty result. Only the
named columns are used, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.llm.frames import WORD, unit_hash, word_count


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_epochs: float = 3.0) -> DataFrame:
    """sizes(source, source_size) -> plus weight and target.

    Targets share the sum of all sizes by weight; what exceeds `most_epochs` times a source's size goes to the others by
    weight, until none is above. In order of size per weight the capped sources come first, so the level that
    the others share is the largest of the levels got by capping the first 0, 1, 2, ... sources.
    """
    every = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    )
    order = Window.orderBy(F.col("source_size") * most_epochs / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * most_epochs).over(before), F.lit(0.0))
    return (
        ranked.withColumn("level", left / F.sum("weight").over(rest))
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(F.col("source_size") * most_epochs, F.col("level") * F.col("weight")))
        .drop("level")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    most_epochs: float = 3.0,
    seed: int = 17,
    range_rows: int = 20_000,
    keep_rows: bool = False,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; with `keep_rows` also `row`, a struct of all input columns."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), unit_hash(F.col("doc_id"), seed).alias("u"), *kept)
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most_epochs)
    sources = sources.select(
        F.col("source").alias("of"), F.col("rank").alias("source_no"), "source_size", "target", F.ceil(F.col("n") / range_rows).alias("ranges"), F.round("target").cast("long").alias("budget")
    )
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("range_no", F.floor(F.col("u") * F.col("ranges")))
    totals = placed.groupBy("source_no", "range_no").agg(F.sum("size").alias("range_size"))
    totals = totals.withColumn(
        "earlier", F.coalesce(F.sum("range_size").over(Window.partitionBy("source_no").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("range_size")
    inside = Window.partitionBy("source_no", "range_no").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["source_no", "range_no"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    cut_at = F.col("budget") - epochs * F.col("source_size") - F.col("earlier") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), cut_at))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if keep_rows else []))


@F.pandas_udf(StringType())
def first_words(text: pd.Series, words: pd.Series) -> pd.Series:
    """The texts up to the end of their words-th word; null texts, of documents taken whole, stay null."""
    ends = (next((m.end() for m in islice(re.finditer(WORD, t), int(n) - 1, None)), len(t)) if isinstance(t, str) else None for t, n in zip(text, words, strict=True))
    return pd.Series([None if e is None else t[:e] for t, e in zip(text, ends, strict=True)], dtype=object)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, with the columns of `docs`: a row per epoch of a document, the last one cut at its budget.

    A text taken in part ends with its last taken word, and n_chars, where there is one, follows the text.
    """
    mixed = mix_sources(docs, keep_rows=True, **options).where("taken > 0")
    copies = mixed.withColumn("words", F.explode(F.expr("transform(sequence(0, cast((taken - 1) div size as int)), i -> least(size, taken - i * size))")))
    whole = F.col("words") == F.col("size")
    part = first_words(F.when(~whole, F.col("row.text")), F.col("words"))
    text = F.when(whole, F.col("row.text")).otherwise(part)
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return copies.select(*[c.alias(name) for name, c in out.items()])
