"""Page cleaning: OCR triage, running headers and footers, index pages.

Pages are rows of a book (`book`), a page number and a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t

OCR_LEAST = 80


def solid_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(t.clean_text(c), f"{t.BLANK}+", ""))


def needs_ocr(c: Column, least: int = OCR_LEAST) -> Column:
    return solid_chars(c) < least


def apply_ocr_cache(pages: DataFrame, cache: DataFrame, key=("doc_id", "page_number")) -> DataFrame:
    """Pages with too little text take a cached text that is longer; text_source says so."""
    held = cache.groupBy(*key).agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("cached"))
    longer = needs_ocr(F.col("text")) & (F.length(t.clean_text(F.col("cached"))) > F.length(t.clean_text(F.col("text"))))
    both = pages.join(held, list(key), "left").withColumn("take", F.coalesce(longer, F.lit(False)))
    return both.withColumns({"text": F.when(F.col("take"), t.clean_text(F.col("cached"))).otherwise(F.col("text")), "text_source": F.when(F.col("take"), "ocr-resume").otherwise(F.col("text_source"))}).drop("take", "cached")


def ocr_stats(pages: DataFrame, key=("doc_id",)) -> DataFrame:
    """Of each document: pages read by OCR, taken from the cache, still too poor, and their numbers."""
    numbers = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("page_number"))))
    ocr, resumed, poor = F.col("text_source").isin("ocr", "ocr-resume"), F.col("text_source") == "ocr-resume", needs_ocr(F.col("text"))
    return pages.groupBy(*key).agg(
        F.count("*").alias("pages"), F.count_if(ocr).alias("applied"), F.count_if(resumed).alias("resumed"), F.count_if(poor).alias("pending"), numbers(ocr).alias("applied_pages"), numbers(poor).alias("pending_pages")
    )


def running_key(line: Column) -> Column:
    """Lower-cased, numbers that stand alone as #."""
    lowered = F.lower(t.text(line))
    return t.normalize(F.regexp_replace(lowered, t.BOUNDARY + "[0-9]+" + t.BOUNDARY, "#"))


def lines(pages: DataFrame, key=("book", "page"), text: str = "text") -> DataFrame:
    """key, line_no (from 0), line."""
    return pages.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def detect_running_lines(pages: DataFrame, ratio: float = 0.3, least: int = 3, book: str = "book") -> DataFrame:
    """book, line_key, n_pages: what stands among the first or last two lines of many pages; books of fewer than three pages have none."""
    filled = F.filter(F.transform(F.split(t.clean_text(F.col("text")), "\n"), t.trim_all), lambda v: v != "")
    edges = F.concat(F.slice(filled, 1, 2), F.slice(filled, F.greatest(F.size(filled) - 1, F.lit(1)), 2))
    each = pages.select(book, "page", F.explode(F.array_distinct(F.transform(edges, running_key))).alias("line_key"))
    each = each.where((F.length("line_key") <= 100) & (F.col("line_key") != ""))
    total = pages.groupBy(book).agg(F.count("*").alias("n_book"))
    counted = each.groupBy(book, "line_key").agg(F.count("*").alias("n_pages")).join(total, book)
    enough = F.col("n_pages") >= F.greatest(F.lit(least), F.ceil(F.col("n_book") * F.lit(ratio)))
    return counted.where((F.col("n_book") >= 3) & enough & ((F.length("line_key") >= 3) | (F.col("line_key") == "#"))).select(book, "line_key", "n_pages")


def strip_running_lines(pages: DataFrame, keys: DataFrame, book: str = "book") -> DataFrame:
    """book, page, text, removed: without running lines and bare page numbers among the first and last two lines.

    A page has at most four edge lines and a running line is on a share of the pages, so a book's keys are few
    (4 / ratio at most); they travel with its pages, whose other lines aren't touched.
    """
    held = pages.groupBy(book).agg(F.count("*").alias("n_book")).join(keys.groupBy(book).agg(F.collect_list("line_key").alias("keys")), book, "left")
    cut = pages.select(book, "page", F.split(t.clean_text(F.col("text")), "\n").alias("l")).join(held, book)
    gone = lambda v: F.coalesce(F.array_contains("keys", running_key(v)), F.lit(False)) | t.trim_all(v).rlike(t.PAGE_NUMBER)
    n = F.size("l")
    first, last = F.slice("l", 1, 2), F.slice("l", F.greatest(n - 1, F.lit(3)), F.greatest(F.lit(0), F.least(F.lit(2), n - 2)))
    kept = F.concat(F.filter(first, lambda v: ~gone(v)), F.slice("l", F.lit(3), F.greatest(F.lit(0), n - 4)), F.filter(last, lambda v: ~gone(v)))
    each = cut.withColumn("k", F.when(F.col("n_book") >= 3, kept).otherwise(F.col("l")))
    return each.select(book, "page", t.clean_text(F.array_join("k", "\n")).alias("text"), (n - F.size("k")).cast("long").alias("removed"))


def removed_report(keys: DataFrame, book: str = "book") -> DataFrame:
    return keys.where("line_key <> '#'").groupBy(book).agg(F.array_sort(F.collect_list("line_key")).alias("removed_lines"))


def is_index_page(text: Column, page: Column) -> Column:
    """A table of contents: named so in its first lines, or (up to page 30) with many lines that end in a page number."""
    rows = F.filter(F.transform(F.split(t.text(text), "\n"), lambda v: t.trim_all(F.regexp_replace(F.replace(v, F.lit("­"), F.lit("")), r"[ \t]+", " "))), lambda v: v != "")
    named = F.lower(F.array_join(F.slice(rows, 1, 5), " ")).rlike(t.cue(("indice", "sommario", "contents")))
    tails = F.size(F.filter(rows, lambda v: v.rlike(r"\.{2,} ?[0-9]{1,4}$") | v.rlike(r"^[0-9]+(?:\.[0-9]+)* .+ [0-9]{1,4}$")))
    dense = tails >= F.greatest(F.lit(4), F.ceil(F.size(rows) * F.lit(0.35)))
    return (F.size(rows) >= 5) & (named | ((F.coalesce(page, F.lit(0)) <= 30) & dense))


def drop_index_pages(pages: DataFrame) -> DataFrame:
    return pages.where(~is_index_page(F.col("text"), F.col("page")))
