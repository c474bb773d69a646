"""Sinks and views: nested JSON books, plain text, HTML, reading views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators.glossary import mark_terms


def _in_order(order: str, *names: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(order, *names)))


def display_text(accessible: bool) -> Column:
    """The accessible or plain summary, else the other, else the original."""
    first, second = ("accessible", "summary") if accessible else ("summary", "accessible")
    return t.normalize(F.coalesce(*[F.nullif(F.trim(t.text(F.col(c))), F.lit("")) for c in (first, second, "original")], F.lit("")))


def full_text(paras: DataFrame, by, order: str, text: str = "text") -> DataFrame:
    return paras.groupBy(*by).agg(F.array_join(F.transform(_in_order(order, text), lambda x: x[text]), "\n\n").alias("full_text"))


def book_json(paras: DataFrame, book: str, chapter: str, order: str, fields: list[str]) -> DataFrame:
    """A row for each book with its chapters' paragraphs nested in order."""
    chapters = paras.groupBy(book, chapter).agg(_in_order(order, *fields).alias("paragraphs"))
    return chapters.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(chapter, "paragraphs"))).alias("chapters"))


def write_book_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def book_txt(paras: DataFrame, by, order: str, title: str, accessible: bool = False) -> DataFrame:
    """by, text: the title in capitals, each paragraph's text, and the terms."""
    each = paras.withColumn("_shown", display_text(accessible)).groupBy(*by).agg(F.first(title).alias("_t"), _in_order(order, "_shown", "glossary").alias("p"))
    entries = F.flatten(F.transform("p", lambda x: x["glossary"]))
    keyed = t.let(entries, lambda es: t.let(F.transform(es, lambda e: F.lower(e["term"])), lambda names: F.filter(es, lambda e, i: F.array_position(names, F.lower(e["term"])) == i + 1)))
    terms = F.transform(keyed, lambda e: F.concat(F.lit("- "), e["term"], F.lit(": "), e["definition"]))
    body = F.concat(F.array(F.upper("_t")), F.transform("p", lambda x: x["_shown"]))
    return each.select(*by, F.concat_ws("\n", F.array_join(body, "\n\n"), F.when(F.size(terms) > 0, F.concat(F.lit("\nTERMINOLOGIA\n"), F.array_join(terms, "\n")))).alias("text"))


def write_book_txt(df: DataFrame, path: str) -> None:
    df.select("text").write.mode("overwrite").text(path)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _section() -> Column:
    return t.normalize(F.col("section"))


def reading_view(paras: DataFrame, by, order: str, title: str, accessible: bool = False) -> DataFrame:
    """by, text: a chapter's paragraphs in order, with a section's title where it differs from the paragraph's before and isn't the chapter's."""
    before = F.lag(_section()).over(Window.partitionBy(*by).orderBy(order))
    new = F.when((_section() != "") & ~_section().eqNullSafe(before), _section())
    each = paras.withColumns({"_new": new, "_shown": display_text(accessible)})
    each = each.withColumn("_part", F.concat_ws("\n\n", F.when(F.lower("_new") != F.lower(t.normalize(F.col(title))), F.col("_new")), F.nullif(F.col("_shown"), F.lit(""))))
    return each.groupBy(*by).agg(F.array_join(F.filter(F.transform(_in_order(order, "_part"), lambda x: x["_part"]), lambda p: p != ""), "\n\n").alias("text"))


def chapter_html(paras: DataFrame, by, order: str, title: str, number: str, accessible: bool = False) -> DataFrame:
    """by, html: a chapter with its number and title, section headings where they change (a paragraph without one keeps the last), terms in bold, and its terminology; all text escaped."""
    last = F.last(F.nullif(_section(), F.lit("")), ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    new = F.when((_section() != "") & ~_section().eqNullSafe(last), _section())
    shown = F.translate(display_text(accessible), "\x02\x03", "")
    bold = escape_html(mark_terms(shown, F.transform("glossary", lambda e: e["term"]), "\x02", "\x03"))
    bold = F.replace(F.replace(bold, F.lit("\x02"), F.lit('<strong class="technical-term">')), F.lit("\x03"), F.lit("</strong>"))
    part = F.concat_ws("", F.lit('<section class="flow-block">'), F.concat(F.lit("<h3>"), escape_html(new), F.lit("</h3>")), F.lit("<p>"), bold, F.lit("</p></section>"))
    each = paras.withColumn("_part", part).groupBy(*by).agg(F.first(title).alias("_t"), F.first(number).alias("_n"), _in_order(order, "_part", "glossary").alias("p"))
    entries = F.flatten(F.transform("p", lambda x: x["glossary"]))
    first = t.let(entries, lambda es: t.let(F.transform(es, lambda e: F.lower(e["term"])), lambda names: F.slice(F.filter(es, lambda e, i: F.array_position(names, F.lower(e["term"])) == i + 1), 1, 40)))
    side = F.transform(first, lambda e: F.concat(F.lit('<div class="term-entry"><strong>'), escape_html(e["term"]), F.lit("</strong><span>"), escape_html(e["definition"]), F.lit("</span></div>")))
    terms = t.let(side, lambda v: F.when(F.size(v) > 0, F.array_join(v, "")).otherwise('<div class="term-empty">Nessun termine specialistico da spiegare.</div>'))
    html = F.concat(
        F.lit('<section class="chapter"><header class="chapter-head"><small>CAPITOLO '), F.col("_n").cast("string"), F.lit("</small><h2>"), escape_html(F.col("_t")), F.lit('</h2></header><div class="chapter-layout"><div class="chapter-text">'),
        F.array_join(F.transform("p", lambda x: x["_part"]), ""), F.lit('</div><aside class="terminology"><div class="terminology-title">TERMINOLOGIA</div>'), terms, F.lit("</aside></div></section>"),
    )
    return each.select(*by, html.alias("html"))


def trim_assets(assets: DataFrame, by, order: str, items: int = 40, size: int = 24 * 1024 * 1024) -> DataFrame:
    """`assets` with kept: those before the first that exceeds the number or the size."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = (F.row_number().over(Window.partitionBy(*by).orderBy(order)) > items) | (F.sum("size").over(so_far) > size)
    return assets.withColumn("_over", over).withColumn("kept", ~F.max("_over").over(so_far)).drop("_over")
