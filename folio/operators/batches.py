"""Units of work: chunks of long paragraphs, chapter-bounded batches, merging their results, and the tables around a text model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.functions.lexicon import ITALIAN, Lexicon
from folio.operators.segmentation import greedy_segments
from folio.operators.structure import pack
from folio.operators.summary import ensure_fidelity

LONG, CHUNK = 7_000, 4_200
ITEMS, CHARS, ADMITTED = 5, 18_000, 22_000
#: Fixed values.
ACTIONS = ("simple", "meaning", "example", "importance", "remember", "exam", "custom")


def chunk_long(c: Column, long: int = LONG, most: int = CHUNK) -> Column:
    """Packs of sentences of at most `most` characters, if the text is longer than `long`; longer sentences are cut at words, longer words anywhere."""
    whole = t.normalize(c)

    def words(v: Column) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(w), F.lit(1)) - 1) / most).cast("int")), lambda k: F.substring(w, k * most + 1, F.lit(most)))
        return pack(F.flatten(F.transform(F.split(v, " "), cut)), most)

    segments = F.flatten(F.transform(t.sentences(c), lambda v: F.when(F.length(v) <= most, F.array(v)).otherwise(words(v))))
    return F.when(F.length(whole) <= long, F.array(whole)).otherwise(pack(segments, most))


def chunk_table(df: DataFrame, key=("doc_id",), text: str = "text") -> DataFrame:
    return df.select(*key, F.posexplode(chunk_long(F.col(text))).alias("chunk_no", "chunk"))


def chunk_map(df: DataFrame, book: str = "book", key: str = "doc_id", text: str = "text") -> DataFrame:
    """book, key, n_chunks, max_chunk, start: the number of chunks before this paragraph's in its book."""
    sizes = F.transform(chunk_long(F.col(text)), lambda c: F.length(c))
    each = df.select(book, key, sizes.alias("sizes")).select(book, key, F.size("sizes").cast("long").alias("n_chunks"), F.array_max("sizes").alias("max_chunk"))
    return each.withColumn("start", F.coalesce(F.sum("n_chunks").over(Window.partitionBy(book).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))


def _ordered(name: str, order: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name])


def unique_terms(entries: Column, most: int) -> Column:
    """Glossary entries with a term and a definition, the first of each term."""
    full = F.filter(entries, lambda e: (t.normalize(e["term"]) != "") & (t.normalize(e["definition"]) != ""))
    names = F.transform(full, lambda e: F.lower(t.normalize(e["term"])))
    return F.slice(F.filter(full, lambda e, i: F.array_position(names, F.lower(t.normalize(e["term"]))) == i + 1), 1, most)


def engine_label(ai: Column, local: Column, total: Column) -> Column:
    return F.when((ai == total) & (total > 0), "ai").when((local == total) & (total > 0), "locale").otherwise("misto")


def merge_chunks(pieces: DataFrame, key, order: str = "chunk_no", caps=(10, 6, 14, 8), more: Column | None = None) -> DataFrame:
    """One record of a paragraph's chunks (summary, accessible, key_points, remember, keywords, glossary, engine, fidelity_recovered), sets joined in order and capped."""
    several = lambda name, most: t.unique_ci(F.flatten(_ordered(name, order)), most)
    join = lambda name, by: F.array_join(F.filter(_ordered(name, order), lambda v: v.isNotNull() & (v != "")), by)
    ai, local, mixed = (F.count_if(F.col("engine") == e) for e in ("ai", "locale", "misto"))
    return pieces.groupBy(*key).agg(
        t.normalize(join("summary", " ")).alias("summary"),
        join("accessible", "\n\n").alias("accessible"),
        several("key_points", caps[0]).alias("key_points"),
        several("remember", caps[1]).alias("remember"),
        several("keywords", caps[2]).alias("keywords"),
        unique_terms(F.flatten(_ordered("glossary", order)), caps[3]).alias("glossary"),
        F.sum("fidelity_recovered").alias("fidelity_recovered"),
        engine_label(ai, local, F.count("*")).alias("engine"),
        F.struct(F.count("*").alias("total_chunks"), ai.alias("ai_chunks"), local.alias("local_chunks"), mixed.alias("mixed_chunks")).alias("chunk_stats"),
        *([] if more is None else [more]),
    )


def combine_units(pieces: DataFrame, key, sources: DataFrame | None = None, order: str = "chunk_no", lex: Lexicon = ITALIAN) -> DataFrame:
    """As merge_chunks with the caps of units (8, 5, 12, 6), then a fidelity pass on the source (key, text); any unit by a model makes the whole `ai`.

    Without `sources` the source is the pieces' own text, by lines, gathered in the same pass. fidelity_recovered counts the last pass only.
    """
    caps, whole = (8, 5, 12, 6), None
    if sources is None:
        pieces = pieces.withColumn("text", t.text(F.col("text")))
        whole = F.array_join(_ordered("text", order), "\n").alias("text")
    merged = merge_chunks(pieces, key, order, caps, whole)
    merged = merged.withColumn("engine", F.when(F.col("chunk_stats.ai_chunks") > 0, "ai").otherwise("locale"))
    both = merged if sources is None else merged.join(sources.select(*key, "text"), list(key))
    return ensure_fidelity(both, lex).drop("text")


def make_batches(df: DataFrame, by: list[str], order: str, text: str = "text", items: int = ITEMS, chars: int = CHARS) -> DataFrame:
    """by, batch_no, order, n_chars: greedy batches in order within each group (a chapter), so none crosses groups; groups of any size, of which only lengths are moved."""
    found = greedy_segments(df.select(*by, order, F.length(text).alias("n_chars")), by, order, "n_chars", items, chars, "batch_no")
    return found.withColumn("batch_no", F.col("batch_no").cast("int"))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), "").when(end.isNull() | (end == start), F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat_ws("", F.lit("pp. "), start.cast("string"), F.lit("-"), end.cast("string")))


def source_meta(paras: DataFrame) -> DataFrame:
    """Page range and label of paragraphs (page_start, page_end, chapter_start, chapter_end), the chapter's where they have none."""
    start = F.coalesce("page_start", "chapter_start")
    end = F.coalesce("page_end", "page_start", "chapter_end", "chapter_start")
    return paras.withColumns({"source_page_start": start, "source_page_end": end, "page_label": page_label(start, end)})


def attach_source_parts(paras: DataFrame, parts: DataFrame, key=("doc_id", "chapter_idx", "para_idx")) -> DataFrame:
    """Paragraphs with their source part (the least, where parts differ), and the number of assets."""
    return paras.join(parts.groupBy(*key).agg(F.min("source_part").alias("source_part"), F.count("asset").alias("n_assets")), list(key), "left").fillna(0, ["n_assets"])


#: Labels of a prompt's context.
CONTEXT = (("chapter_title", "Capitolo: ", 180), ("section_title", "Sezione: ", 180), ("page_label", "Pagina: ", 40))


def prompt_payloads(batches: DataFrame, by: list[str], order: str = "item_idx") -> DataFrame:
    """A prompt for each batch: its items in order, numbered from 0, each below a line of its trimmed context; empty parts of the context are left out."""
    parts = [F.substring(t.trim_all(t.text(F.col(c))), 1, n) for c, _, n in CONTEXT]
    line = F.concat_ws(" | ", *[F.when(v != "", F.concat(F.lit(label), v)) for v, (_, label, _) in zip(parts, CONTEXT, strict=True)])
    item = F.struct(order, F.when(line != "", F.concat(F.lit("<CONTESTO>"), line, F.lit("</CONTESTO>\n"))).otherwise("").alias("context"), t.text(F.col("text")).alias("text"))
    block = lambda x, i: F.concat(x["context"], F.lit('<PARAGRAFO id="'), i.cast("string"), F.lit('">\n'), x["text"], F.lit("\n</PARAGRAFO>"))
    return batches.withColumn("item", item).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), block), "\n\n").alias("payload"), F.count("*").alias("n_items"))


def validate_batches(batches: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, n_items, n_chars, reject (a code, or null): 1 to 5 items, none empty, at most 22,000 characters."""
    sums = batches.groupBy(*by).agg(F.count("*").alias("n_items"), F.sum(F.length(t.text(F.col(text)))).alias("n_chars"), F.count_if(t.normalize(F.col(text)) == "").alias("empty"))
    return sums.withColumn("reject", F.when((F.col("n_items") < 1) | (F.col("n_items") > ITEMS), "ITEM_COUNT").when(F.col("empty") > 0, "EMPTY_ITEM").when(F.col("n_chars") > ADMITTED, "TOO_LONG")).drop("empty")


ENTRY = "struct<term: string, definition: string, placement: string, basis: string>"
RECORD = f"summary: string, dsaSummary: string, keyPoints: array<string>, remember: array<string>, keywords: array<string>, glossary: array<{ENTRY}>"


def _bare(payload: Column) -> Column:
    """A response without the fences around its JSON."""
    return F.regexp_replace(F.regexp_replace(F.trim(t.text(payload)), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def validate_responses(responses: DataFrame) -> DataFrame:
    """Responses (batch_id, n_items, payload) with records, and an error (or null): fences are stripped, the JSON must hold as many complete records as the batch has items."""
    out = responses.withColumn("records", F.from_json(_bare(F.col("payload")), f"summaries array<struct<{RECORD}>>")["summaries"])
    parts = ("summary", "dsaSummary", "keyPoints", "remember", "keywords", "glossary")
    whole = F.forall("records", lambda r: reduce(lambda x, y: x & y, [r[c].isNotNull() for c in parts]))
    return out.withColumn("error", F.when(F.col("records").isNull(), "INVALID_JSON").when(F.size("records") != F.col("n_items"), "WRONG_COUNT").when(~F.coalesce(whole, F.lit(False)), "INCOMPLETE"))


def response_glossary(entries: Column, source: Column, most: int = 3) -> Column:
    """Entries with a term (to 90 characters, in the source) and a definition (to 180), the first of each term, at the side; their basis is the source unless general."""
    clean = F.transform(
        F.coalesce(entries, F.array().cast(f"array<{ENTRY}>")),
        lambda e: F.struct(
            F.substring(t.normalize(e["term"]), 1, 90).alias("term"), F.substring(F.regexp_replace(t.normalize(e["definition"]), "[.;:]$", ""), 1, 180).alias("definition"), F.lit("side").alias("placement"), F.when(e["basis"] == "general", "general").otherwise("source").alias("basis")
        ),
    )
    # a Σ is lower-cased by what follows it, so a term of the source may be there only as it is written
    said = lambda low, term: F.contains(low, F.lower(term)) | F.contains(t.text(source), term)
    there = t.let(F.lower(t.text(source)), lambda low: F.filter(clean, lambda e: (e["term"] != "") & (e["definition"] != "") & said(low, e["term"])))
    first = lambda kept: t.let(F.transform(kept, lambda e: F.lower(e["term"])), lambda names: F.filter(kept, lambda e, i: F.array_position(names, F.lower(e["term"])) == i + 1))
    return F.slice(t.let(there, first), 1, most)


def _several(values: Column, most: int) -> Column:
    return t.head(F.filter(F.transform(values, lambda v: t.trim_all(t.text(v))), lambda v: v != ""), most)


def normalize_responses(valid: DataFrame, sources: DataFrame) -> DataFrame:
    """A trimmed record for each item of good responses (batch_id, item_idx, source): caps 8, 5 and 10, at most 3 glossary entries; without an accessible text the summary stands in."""
    each = valid.where("error is null").select("batch_id", F.posexplode("records").alias("item_idx", "r")).join(sources, ["batch_id", "item_idx"])
    summary, spoken = t.trim_all(t.text(F.col("r.summary"))), F.coalesce(F.nullif(F.col("r.dsaSummary"), F.lit("")), F.col("r.summary"))
    return each.select(
        "batch_id", "item_idx", summary.alias("summary"), t.trim_all(t.text(spoken)).alias("accessible"), _several(F.col("r.keyPoints"), 8).alias("key_points"), _several(F.col("r.remember"), 5).alias("remember"), _several(F.col("r.keywords"), 10).alias("keywords"),
        response_glossary(F.col("r.glossary"), F.col("source")).alias("glossary"), F.lit("ai").alias("engine"),
    )


def refined_records(responses: DataFrame) -> DataFrame:
    """Refine responses (payload: one record) with summary, accessible, key_points (8), remember (5), keywords (12) and an error (or null)."""
    out = responses.withColumn("_r", F.from_json(_bare(F.col("payload")), "summary string, dsaSummary string, keyPoints array<string>, remember array<string>, keywords array<string>"))
    whole = reduce(lambda x, y: x & y, [F.col(f"_r.{c}").isNotNull() for c in ("summary", "dsaSummary", "keyPoints", "remember", "keywords")])
    fields = {"summary": t.trim_all(F.col("_r.summary")), "accessible": t.trim_all(F.col("_r.dsaSummary")), "key_points": t.head(F.col("_r.keyPoints"), 8), "remember": t.head(F.col("_r.remember"), 5), "keywords": t.head(F.col("_r.keywords"), 12)}
    return out.withColumns(fields).withColumn("error", F.when(~F.coalesce(whole, F.lit(False)), "INVALID_RESULT")).drop("_r")


def apply_refinement(book: DataFrame, refined: DataFrame, key, source: str = "original", lex: Lexicon = ITALIAN) -> DataFrame:
    """The book's records, replaced by good refined ones where there are any, which then get the fidelity pass (24 anchors, 4 sentences) on their source."""
    names = ("summary", "accessible", "key_points", "remember", "keywords")
    good = refined.where("error is null").select(*key, *names)
    new = ensure_fidelity(book.drop(*names, "engine", "fidelity_recovered").join(good, list(key)), lex, source, 24, 4).withColumn("engine", F.lit("ai-refine"))
    return book.join(good.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def with_fallback(ai: DataFrame, local: DataFrame, key) -> DataFrame:
    """Each local record, replaced by the model's where there is one."""
    names = [c for c in local.columns if c not in key]
    left, right = local.alias("l"), ai.withColumn("_has", F.lit(True)).alias("a")
    return left.join(right, list(key), "left").select(*key, *[F.when(F.col("a._has"), F.col(f"a.{c}")).otherwise(F.col(f"l.{c}")).alias(c) if c in ai.columns else F.col(f"l.{c}") for c in names])


def explain_requests(requests: DataFrame) -> DataFrame:
    """Trimmed request fields (an unknown action is `simple`), and an error where nothing is selected or an own question is missing."""
    caps = {"selection": 1_400, "source_text": 12_000, "summary": 7_000, "chapter_title": 300, "section_title": 300, "question": 600}
    out = requests.withColumns({c: F.substring(t.trim_all(t.text(F.col(c))), 1, n) for c, n in caps.items() if c in requests.columns})
    out = out.withColumn("action", F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise("simple"))
    return out.withColumn("error", F.when(F.col("selection") == "", "NO_SELECTION").when((F.col("action") == "custom") & (F.col("question") == ""), "NO_QUESTION"))


def validate_answers(responses: DataFrame) -> DataFrame:
    """answer, basis (source unless general), label (at most 80 characters) and error of answer responses."""
    out = responses.withColumn("_r", F.from_json(_bare(F.col("payload")), "answer string, basis string, label string"))
    answer = t.trim_all(t.text(F.col("_r.answer")))
    return out.withColumns({"answer": answer, "basis": F.when(F.col("_r.basis") == "general", "general").otherwise("source"), "label": F.substring(t.trim_all(t.text(F.col("_r.label"))), 1, 80), "error": F.when(answer == "", "NO_ANSWER")}).drop("_r")


def apply_edits(book: DataFrame, edits: DataFrame, key, fields=("original", "summary", "accessible"), whole=None) -> DataFrame:
    """The book's records with the latest edit (edited_at, then the greater text) of each field laid over, marked `edited`.

    An edit is a row with one or more fields; blank ones change nothing. The first field is the source: an edit of it clears all results
    of its book (the key's columns in `whole`; without it, of its own record) but those edited later.
    """
    source, results = fields[0], fields[1:]
    value = {c: F.nullif(t.trim_all(t.text(F.col(c))), F.lit("")) for c in fields}
    latest = edits.groupBy(*key).agg(*[F.max(F.when(value[c].isNotNull(), F.struct("edited_at", value[c].alias("v")))).alias(f"_{c}") for c in fields]).where(reduce(lambda x, y: x | y, [F.col(f"_{c}").isNotNull() for c in fields]))
    both = book.join(latest, list(key), "left")
    if whole:
        cleared = latest.groupBy(*whole).agg(F.max(f"_{source}.edited_at").alias("_cleared")).where("_cleared IS NOT NULL")
        both = both.join(cleared, list(whole), "left")
    else:
        both = both.withColumn("_cleared", F.col(f"_{source}.edited_at"))

    def over(c: str) -> Column:
        newer = F.col(f"_{c}").isNotNull() & (F.col("_cleared").isNull() | (F.col(f"_{c}.edited_at") > F.col("_cleared")))
        return F.when(newer, F.col(f"_{c}.v")).when(F.col("_cleared").isNull(), F.col(c))

    rest = [c for c in book.columns if c not in (*key, *fields)]
    edited = reduce(lambda x, y: x | y, [F.col(f"_{c}").isNotNull() for c in fields])
    return both.select(*key, F.coalesce(f"_{source}.v", source).alias(source), *[over(c).alias(c) for c in results], *rest, edited.alias("edited"))
