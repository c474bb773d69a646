"""Queries over what a text model, a scanner and a library exchange: units, requests, responses, edits, assets; and their SQL.

Their tables are made from documents, conversations and events, a row or more for each of theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.functions.lexicon import levels
from folio.operators import answers, audit, batches, cleaning, glossary, incremental, structure, summary
from folio.operators.places import written
from folio.plans import sql as s
from folio.plans import structure_queries as sq
from folio.plans.sql import q
from folio.plans.study_queries import BY, RECORDS, placed, records
from folio.plans.text_queries import LEX, docs
from folio.sources import files, sinks

QUERIES, ORACLES = {}, {}


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = f
        if check:
            ORACLES[name] = check
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- sources and sinks


@query("table_as_text", f"""SELECT doc_id, CASE WHEN len(r) > 0 THEN 'Tabella. ' || array_to_string(r, ' ; ') ELSE '' END AS said FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10))[1:3],
  lambda l: array_to_string(list_filter(list_transform(string_split(l, ' ')[1:4], lambda c: {s.norm('c')}), lambda c: c <> ''), ' | ')), lambda l: l <> '') AS r FROM documents)""")
def table_as_text(spark, sf_dir):
    rows = F.transform(F.slice(F.split(t.text(F.col("text")), "\n"), 1, 3), lambda r: F.slice(F.split(r, " "), 1, 4))
    return docs(spark, sf_dir).select("doc_id", files.table_as_text(rows).alias("said"))


_PART = "CASE WHEN x IN ('', '.') THEN a WHEN x = '..' THEN CASE WHEN contains(a, '/') THEN regexp_replace(a, '/[^/]*$', '') ELSE '' END WHEN a = '' THEN x ELSE a || '/' || x END"


@query("resolve_path", f"""SELECT page_id, list_reduce([''] || string_split(regexp_replace('OEBPS/text/' || page_id || '.xhtml', '/[^/]*$', '') || '/' || ['../images/a.png', './b/../c.png', '../../d.png', 'e//f.png'][(page_id % 4 + 1)::INT], '/'),
  lambda a, x: {_PART}) AS path FROM pages""")
def resolve_path(spark, sf_dir):
    relative = F.element_at(F.array(*map(F.lit, ("../images/a.png", "./b/../c.png", "../../d.png", "e//f.png"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", files.resolve_path(F.concat(F.lit("OEBPS/text/"), F.col("page_id").cast("string"), F.lit(".xhtml")), relative).alias("path"))


@query("assemble_lines", f"""WITH f AS (SELECT conv_id, turn, {s.trim_all("coalesce(text, '')")} AS str, (turn // 2) * 10.0::DOUBLE AS y, turn % 3 = 2 AS eol FROM conversations), g AS (SELECT * FROM f WHERE str <> ''),
h AS (SELECT *, (eol OR coalesce(abs(y - lag(y) OVER w) > 2.5, false))::INT AS fresh FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM h), j AS (SELECT conv_id, line, string_agg(str, ' ' ORDER BY turn) AS l FROM i GROUP BY ALL), k AS (SELECT conv_id, string_agg(l, chr(10) ORDER BY line) AS x FROM j GROUP BY ALL)
SELECT conv_id, {s.clean_text('x')} AS text FROM k""")
def assemble_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("str"), (F.floor(F.col("turn") / 2) * 10.0).alias("y"), (F.col("turn") % 3 == 2).alias("has_eol"))
    return files.assemble_lines(c, ["conv_id"])


def scans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scan sessions by source: pages saved in falling order of doc_id, without those that 3 divides."""
    d = docs(spark, sf_dir)
    meta = d.where("doc_id % 3 <> 0").groupBy(F.col("source").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(-F.col("doc_id"))), lambda v: (-v).cast("string")).alias("page_order"))
    return meta, d.select(F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("page_id"), "text")


@query("assemble_scan", "SELECT source AS session_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 3 <> 0 THEN -doc_id END NULLS LAST, doc_id::VARCHAR)::INT AS page_number, doc_id::VARCHAR AS page_id, text FROM documents")
def assemble_scan(spark, sf_dir):
    return files.assemble_scan(*scans(spark, sf_dir))


@query("scan_status", f"""WITH p AS (SELECT doc_id, ['processing', 'ready', 'pending', 'error'][(doc_id % 4 + 1)::INT] AS st, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN st = 'processing' OR (st = 'ready' AND {s.norm('text')} = '') THEN 'error' ELSE st END AS status, CASE WHEN st = 'processing' THEN 'interrupted' WHEN st = 'error' THEN 'unreadable' END AS error FROM p""")
def scan_status(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("processing", "ready", "pending", "error"))), (F.col("doc_id") % 4 + 1).cast("int"))
    p = docs(spark, sf_dir).select("doc_id", status.alias("status"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text")).alias("text"), F.when(status == "error", "unreadable").alias("error"))
    return files.repair_scan_status(p).select("doc_id", "status", "error")


@query("book_json", f"""WITH {RECORDS}, bj AS (SELECT book, chapter, list({{'para': para, 'summary': summary, 'keywords': keywords}} ORDER BY para) AS paragraphs FROM rec GROUP BY book, chapter)
SELECT book, list({{'chapter': chapter, 'paragraphs': paragraphs}} ORDER BY chapter) AS chapters FROM bj GROUP BY book""")
def book_json(spark, sf_dir):
    return sinks.book_json(records(spark, sf_dir, "summary", "keywords"), "book", "chapter", "para", ["summary", "keywords"])


@query("display_text", f"""WITH {RECORDS} SELECT doc_id, {s.norm("coalesce(nullif(trim(accessible), ''), nullif(trim(summary), ''), nullif(trim(text), ''), '')")} AS spoken, {s.norm("coalesce(nullif(trim(summary), ''), nullif(trim(accessible), ''), nullif(trim(text), ''), '')")} AS plain FROM rec""")
def display_text(spark, sf_dir):
    return records(spark, sf_dir, "summary", "accessible", "original").select("doc_id", sinks.display_text(True).alias("spoken"), sinks.display_text(False).alias("plain"))


def library(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Library records of users: those of their even events are stored, those of odd ones come in."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").alias("updated_at"), F.col("event_id").alias("created_at"), F.col("event_type").alias("source_data"), F.lit("book").alias("study_book"))
    return e.where("updated_at % 2 = 0"), e.where("updated_at % 2 = 1")


_LIBRARY = "SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, max(event_id) AS updated_at, min(event_id) AS created_at FROM events GROUP BY user_id"


@query("library_upsert", f"SELECT *, event_type AS source_data, 'book' AS study_book FROM ({_LIBRARY})")
def library_upsert(spark, sf_dir):
    return incremental.upsert_library(*library(spark, sf_dir))


@query("library_listing", _LIBRARY)
def library_listing(spark, sf_dir):
    return incremental.list_library(incremental.upsert_library(*library(spark, sf_dir)))


@query("library_book", f"SELECT id, event_type FROM ({_LIBRARY}) WHERE id = (SELECT max(user_id) FROM events)")
def library_book(spark, sf_dir):
    """The one book of the greatest user."""
    books = incremental.upsert_library(*library(spark, sf_dir))
    last = table(spark, sf_dir, "events").select(F.max("user_id")).first()[0]
    return incremental.get_book(books, last).select("id", "event_type")


@query("library_deletes", f"SELECT id, event_type FROM ({_LIBRARY}) WHERE id % 3 <> 0")
def library_deletes(spark, sf_dir):
    books = incremental.upsert_library(*library(spark, sf_dir))
    return incremental.delete_books(books, books.where("id % 3 = 0").select("id")).select("id", "event_type")


@query("trim_assets", """WITH a AS (SELECT l_suppkey, row_number() OVER w AS n, sum(l_quantity * 50000) OVER w AS size FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING))
SELECT l_suppkey, count(*) AS assets, count(*) FILTER (n <= 40 AND size <= 25165824) AS kept FROM a GROUP BY ALL""")
def trim_assets(spark, sf_dir):
    """Line items as assets of a supplier, in order of order and line."""
    a = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("place"), (F.col("l_quantity") * 50_000).alias("size"))
    return sinks.trim_assets(a, ["l_suppkey"], "place").groupBy("l_suppkey").agg(F.count("*").alias("assets"), F.count_if("kept").alias("kept"))


# -- scanned pages


_POOR = "CASE WHEN doc_id % 4 < 2 THEN substring(coalesce(text, ''), 1, 70) ELSE coalesce(text, '') END"


def scanned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """documents as pages, every second pair with little text; the cache holds the texts of even ones."""
    d = docs(spark, sf_dir)
    poor = F.when(F.col("doc_id") % 4 < 2, F.substring(t.text(F.col("text")), 1, 70)).otherwise(t.text(F.col("text")))
    pages = d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), poor.alias("text"), F.lit("embedded").alias("text_source"))
    return pages, d.where("doc_id % 2 = 0").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text")


def _solid(x: str) -> str:
    return f"length(regexp_replace({s.clean_text(x)}, {q(t.SPACE)}, '', 'g'))"


OCR = f"""op AS (SELECT source, doc_id, {_POOR} AS page, text FROM documents),
oc AS (SELECT *, doc_id % 2 = 0 AND {_solid('page')} < 80 AND length({s.clean_text('text')}) > length({s.clean_text('page')}) AS take FROM op),
od AS (SELECT source AS doc_id, doc_id AS page_number, CASE WHEN take THEN {s.clean_text('text')} ELSE page END AS text, CASE WHEN take THEN 'ocr-resume' ELSE 'embedded' END AS text_source FROM oc)"""


@query("ocr_cache", f"WITH {OCR} SELECT * FROM od")
def ocr_cache(spark, sf_dir):
    return cleaning.apply_ocr_cache(*scanned(spark, sf_dir))


@query("ocr_stats", f"""WITH {OCR}, oe AS (SELECT *, {_solid('text')} < 80 AS poor FROM od) SELECT doc_id, count(*) AS pages, count(*) FILTER (text_source = 'ocr-resume') AS applied, count(*) FILTER (text_source = 'ocr-resume') AS resumed, count(*) FILTER (poor) AS pending,
  list_sort(coalesce(list(page_number) FILTER (text_source = 'ocr-resume'), [])) AS applied_pages, list_sort(coalesce(list(page_number) FILTER (poor), [])) AS pending_pages FROM oe GROUP BY doc_id""")
def ocr_stats(spark, sf_dir):
    return cleaning.ocr_stats(cleaning.apply_ocr_cache(*scanned(spark, sf_dir)))


# -- older and whole-text structure


@query("root_levels", f"""WITH {sq.PAGES}, a AS (SELECT book, page, string_split(text, chr(10)) AS l FROM pages), b AS (SELECT book, page, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM a), c AS (SELECT *, {s.trim_all('line')} AS v FROM b),
d AS (SELECT *, {sq.LEGACY_LEVEL} AS level FROM c), e AS (SELECT *, min(level) OVER (PARTITION BY book) AS root_level FROM d) SELECT book, page, line_no, root_level, level = root_level AS is_root FROM e WHERE level IS NOT NULL""")
def root_levels(spark, sf_dir):
    lines = cleaning.lines(sq.book_pages(spark, sf_dir)).withColumnRenamed("book", "doc_id")
    return structure.root_level_legacy(lines).where("heading is not null").select(F.col("doc_id").alias("book"), "page", "line_no", "root_level", "is_root")


LEGACY_CHAPTERS = f"""{sq.PAGES}, la AS (SELECT book, page, string_split({s.clean_text('text')}, chr(10)) AS l FROM pages), lb AS (SELECT book, page, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM la), lc AS (SELECT *, {s.trim_all('line')} AS v FROM lb),
ld AS (SELECT *, {sq.LEGACY_LEVEL} AS level FROM lc), le AS (SELECT *, min(level) OVER (PARTITION BY book) AS root_level FROM ld),
lf AS (SELECT *, count(*) FILTER (level = root_level) OVER w AS chapter_no, count(*) FILTER (level IS NOT NULL) OVER w AS segment FROM le WINDOW w AS (PARTITION BY book ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)),
lg0 AS (SELECT book, page, segment, any_value(chapter_no) AS chapter_no, max(v) FILTER (level = root_level) AS root, max(v) FILTER (level > root_level) AS section, max(greatest(2, level - root_level + 1)) FILTER (level > root_level) AS level,
  coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (level IS NULL), '') AS raw FROM lf GROUP BY ALL),
lg1 AS (SELECT *, {s.clean_text('raw')} AS body FROM lg0), lg AS (SELECT *, CASE WHEN body = '' THEN 0 ELSE len({sq.legacy_paragraphs_sql('body')}) END AS n FROM lg1),
lh AS (SELECT book, chapter_no, max(root) AS root, count(section) AS n_sections, sum(n)::BIGINT AS n_paragraphs, max(page) FILTER (n > 0) AS last_page, min(page) FILTER (root IS NOT NULL) AS root_page, arg_min(page, segment * 100000 + page) FILTER (n > 0 OR section IS NOT NULL) AS begins,
  arg_min(section IS NULL, segment * 100000 + page) FILTER (n > 0 OR section IS NOT NULL) AS text_first FROM lg GROUP BY ALL),
lz AS (SELECT book, chapter_no, coalesce(root, CASE WHEN text_first THEN 'Introduzione' ELSE 'Documento' END) AS title, coalesce(root_page, begins) AS page_start, coalesce(last_page, root_page, begins) AS page_end, n_sections, n_paragraphs FROM lh WHERE n_sections > 0 OR n_paragraphs > 0)"""


@query("chapters_legacy", f"WITH {LEGACY_CHAPTERS} SELECT * FROM lz")
def chapters_legacy(spark, sf_dir):
    return structure.chapters_legacy(structure.placed_legacy(structure.parts_legacy(sq.book_pages(spark, sf_dir))))


@query("sections_legacy", f"""WITH {LEGACY_CHAPTERS}, ls AS (SELECT book, chapter_no, row_number() OVER w AS section_no, section AS title, level, page AS page_start, lead(page) OVER w AS nx FROM lg WHERE section IS NOT NULL WINDOW w AS (PARTITION BY book, chapter_no ORDER BY segment))
SELECT ls.book, ls.chapter_no, section_no::INT AS section_no, ls.title, level::INT AS level, ls.page_start, CASE WHEN nx IS NOT NULL THEN greatest(ls.page_start, nx - 1) ELSE lz.page_end END AS page_end FROM ls JOIN lz USING (book, chapter_no)""")
def sections_legacy(spark, sf_dir):
    return structure.sections_legacy(structure.placed_legacy(structure.parts_legacy(sq.book_pages(spark, sf_dir), counted=False)))


def whole_texts(spark, sf_dir) -> DataFrame:
    """Each document between two chapter lines, the second one bare with its title below, as one text without pages."""
    text = F.concat(F.lit("CAPITOLO 1 — INIZIO\n\n"), t.text(F.col("text")), F.lit("\n\nCapitolo 2\nAltro titolo\n\n"), F.substring(t.text(F.col("text")), 1, 400))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("book"), text.alias("text"))


_WHOLE = "pages AS (SELECT doc_id AS book, 1 AS page, 'CAPITOLO 1 — INIZIO' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Capitolo 2' || chr(10) || 'Altro titolo' || chr(10) || chr(10) || substring(coalesce(text, ''), 1, 400) AS text FROM documents)"
WHOLE_CHAPTERS = sq.CHAPTERS.replace(sq.PAGES, _WHOLE)


@query("detect_chapters", f"WITH {WHOLE_CHAPTERS} SELECT * FROM h")
def detect_chapters(spark, sf_dir):
    return structure.detect_chapters(whole_texts(spark, sf_dir))


@query("choose_structure", f"""WITH {WHOLE_CHAPTERS}, old AS (SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['Parte A', 'Parte B'] WHEN 1 THEN ['DOCUMENTO'] ELSE [] END) AS title FROM documents),
-- pages, no older chapter, or a single one of that name ask for new ones; without any the older ones stay
redo AS (SELECT doc_id FROM documents d WHERE (doc_id % 4 = 0 OR (SELECT count(*) FROM old WHERE old.doc_id = d.doc_id) = 0 OR (SELECT list(lower(title)) FROM old WHERE old.doc_id = d.doc_id) = ['documento']) AND EXISTS (SELECT 1 FROM h WHERE h.book = d.doc_id AND h.book % 7 <> 0))
SELECT book AS doc_id, title FROM h WHERE book IN (SELECT doc_id FROM redo) UNION ALL SELECT doc_id, title FROM old WHERE doc_id NOT IN (SELECT doc_id FROM redo)""")
def choose_structure(spark, sf_dir):
    """Two older chapters for every third document, a single `Documento` for the next ones, none for the others; every fourth has pages, and every seventh no rebuilt chapters."""
    d = docs(spark, sf_dir).select("doc_id")
    older = d.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("Parte A"), F.lit("Parte B"))).alias("title")).union(d.where("doc_id % 3 = 1").select("doc_id", F.lit("DOCUMENTO")))
    rebuilt = structure.detect_chapters(whole_texts(spark, sf_dir).where("book % 7 <> 0")).select(F.col("book").alias("doc_id"), "title")
    return structure.choose_structure(older, rebuilt, d.where("doc_id % 4 = 0"))


# -- units of work and what a model gives back


@query("summary_levels", " UNION ALL ".join(f"SELECT {q(k)} AS level, {v[0]}::DOUBLE AS ratio, {v[1]} AS least, {v[2]} AS most, {q(v[3])} AS label, (SELECT count(*) FROM documents) AS documents" for k, v in levels().items()))
def summary_levels(spark, sf_dir):
    """The levels that a library's documents can be asked for."""
    return summary.summary_levels(spark).crossJoin(docs(spark, sf_dir).agg(F.count("*").alias("documents")))


@query("unbounded_batches", f"WITH fb AS (SELECT source, doc_id, length(coalesce(text, '')) AS n_chars FROM documents), {sq.batches_sql('fb', 'source', 'doc_id')} SELECT * FROM bt")
def unbounded_batches(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", F.col("doc_id").cast("int").alias("doc_id"), t.text(F.col("text")).alias("text"))
    return batches.make_batches(d, ["source"], "doc_id")


PIECES = f"""{RECORDS}, pi AS (SELECT doc_id, book, chapter, para, text, summary, accessible, kp AS key_points, rm AS remember, keywords, glossary, CASE WHEN doc_id % 3 = 0 THEN 'ai' ELSE 'locale' END AS engine, len(found) AS fr FROM rec)"""


def pieces(spark, sf_dir, *names: str) -> DataFrame:
    """Study records as the pieces of their chapter, every third one made by a model."""
    return records(spark, sf_dir, *names).withColumn("engine", F.when(F.col("doc_id") % 3 == 0, "ai").otherwise("locale"))


def _joined(name: str, by: str) -> str:
    return f"coalesce(string_agg({name}, {by} ORDER BY para) FILTER ({name} <> ''), '')"


def _merged(caps: tuple[int, int, int, int], by: str = "book, chapter") -> str:
    terms = "list_filter(g, lambda e, i: list_position(list_transform(g, lambda u: lower(trim(u.term))), lower(trim(e.term))) = i)"
    each = {"key_points": caps[0], "remember": caps[1], "keywords": caps[2]}
    return f"""mg0 AS (SELECT {by}, {_joined('summary', "' '")} AS s, {_joined('accessible', 'chr(10) || chr(10)')} AS accessible, {', '.join(f'flatten(list({k} ORDER BY para)) AS {k}' for k in each)}, flatten(list(glossary ORDER BY para)) AS g, sum(fr)::BIGINT AS fidelity_recovered,
  count(*) AS n, count(*) FILTER (engine = 'ai') AS ai FROM pi GROUP BY {by}),
mg AS (SELECT {by}, {s.norm('s')} AS summary, accessible, {', '.join(f'{s.unique_ci(k, n)} AS {k}' for k, n in each.items())}, {terms}[1:{caps[3]}] AS glossary, fidelity_recovered, CASE WHEN ai = n THEN 'ai' WHEN ai = 0 THEN 'locale' ELSE 'misto' END AS engine, n, ai FROM mg0)"""


@query("merge_chunks", f"WITH {PIECES}, {_merged((10, 6, 14, 8))} SELECT book, chapter, summary, accessible, key_points, remember, keywords, list_transform(glossary, lambda e: e.term) AS terms, fidelity_recovered, engine, n AS total_chunks, ai AS ai_chunks, n - ai AS local_chunks, 0::BIGINT AS mixed_chunks FROM mg")
def merge_chunks(spark, sf_dir):
    out = batches.merge_chunks(pieces(spark, sf_dir, "summary", "accessible", "key_points", "remember", "keywords", "glossary", "fidelity_recovered"), BY, "para")
    return out.select(*BY, "summary", "accessible", "key_points", "remember", "keywords", F.transform("glossary", lambda e: e["term"]).alias("terms"), "fidelity_recovered", "engine", "chunk_stats.*")


_SOURCES = "src AS (SELECT book, chapter, string_agg(coalesce(text, ''), chr(10) ORDER BY para) AS text FROM pi GROUP BY book, chapter)"
_MISSING = f"list_filter({s.anchors('text')}, lambda a: NOT contains(lower({s.norm('summary')} || ' ' || accessible), lower(a)))"
_HITS = f"list_filter(list_transform(missing, lambda a: list_filter(sents, lambda v: contains(lower(v), lower(a)))[1]), lambda v: v IS NOT NULL)"


def repaired(of: str, anchors: int = 32, most: int = 5) -> str:
    """The fidelity pass over a table with text, summary, accessible, key_points and remember, as rp."""
    missing = _MISSING.replace(s.anchors("text"), s.anchors("text", anchors))
    spoken = f"list_transform(lost, lambda f: {s.accessible('f', LEX.connectives)})"
    return f"""rp0 AS (SELECT *, {missing} AS missing, {s.sentences('text')} AS sents FROM {of}), rp1 AS (SELECT *, {_HITS} AS hits FROM rp0), rp2 AS (SELECT *, list_filter(hits, lambda v, i: list_position(hits, v) = i)[1:{most}] AS lost FROM rp1),
rp AS (SELECT * REPLACE (CASE WHEN len(lost) > 0 THEN {s.norm("summary || ' ' || array_to_string(lost, ' ')")} ELSE summary END AS summary,
  CASE WHEN len(lost) > 0 THEN array_to_string(list_filter([accessible] || {spoken}, lambda v: v <> ''), chr(10) || chr(10)) ELSE accessible END AS accessible,
  CASE WHEN len(lost) > 0 THEN {s.unique_ci('key_points || lost', 8)} ELSE key_points END AS key_points, CASE WHEN len(lost) > 0 THEN {s.unique_ci('remember || lost', 5)} ELSE remember END AS remember) FROM rp2)"""


@query("combine_units", f"WITH {PIECES}, {_merged((8, 5, 12, 6))}, {_SOURCES}, cu AS (SELECT * FROM mg JOIN src USING (book, chapter)), {repaired('cu')} SELECT book, chapter, summary, accessible, key_points, remember, keywords, len(lost)::INT AS fidelity_recovered, CASE WHEN ai > 0 THEN 'ai' ELSE 'locale' END AS engine FROM rp")
def combine_units(spark, sf_dir):
    return batches.combine_units(pieces(spark, sf_dir), BY, None, "para", LEX).select(*BY, "summary", "accessible", "key_points", "remember", "keywords", "fidelity_recovered", "engine")


def paged(spark, sf_dir) -> DataFrame:
    """Paragraphs with page ranges: three of four have their own, and half of those an end."""
    own = lambda test, v: F.when(F.expr(test), v)
    return docs(spark, sf_dir).select("doc_id", own("doc_id % 4 <> 3", F.col("doc_id")).alias("page_start"), own("doc_id % 4 = 2", F.col("doc_id") + F.col("doc_id") % 3).alias("page_end"), own("doc_id % 8 <> 7", F.lit(1)).alias("chapter_start"), own("doc_id % 8 <> 7", F.lit(9)).alias("chapter_end"))


@query("source_meta", """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN doc_id WHEN doc_id % 8 <> 7 THEN 1 END AS s, CASE WHEN doc_id % 4 = 2 THEN doc_id + doc_id % 3 WHEN doc_id % 4 <> 3 THEN doc_id WHEN doc_id % 8 <> 7 THEN 9 END AS e FROM documents)
SELECT doc_id, s::BIGINT AS source_page_start, e::BIGINT AS source_page_end, CASE WHEN s IS NULL THEN '' WHEN e IS NULL OR e = s THEN 'p. ' || s ELSE 'pp. ' || s || '-' || e END AS page_label FROM a""")
def source_meta(spark, sf_dir):
    return batches.source_meta(paged(spark, sf_dir)).select("doc_id", "source_page_start", "source_page_end", "page_label")


@query("source_parts", "SELECT d.doc_id, any_value(CASE WHEN e.event_id IS NOT NULL THEN 'part-' || (d.doc_id % 7) END) AS source_part, count(e.event_id) AS n_assets FROM documents d LEFT JOIN events e ON e.user_id = d.doc_id GROUP BY d.doc_id")
def source_parts(spark, sf_dir):
    """Events as assets of the document whose number is their user's."""
    parts = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("part-"), (F.col("user_id") % 7).cast("string")).alias("source_part"), F.col("event_id").alias("asset"))
    return batches.attach_source_parts(docs(spark, sf_dir).select("doc_id"), parts, ("doc_id",))


def asked(spark, sf_dir) -> DataFrame:
    """Documents as batches of up to seven items of a source, with context."""
    d = docs(spark, sf_dir).join(placed(spark, sf_dir), "doc_id")
    return d.select(F.concat_ws("-", "book", (F.floor((F.col("chapter") * 5 + F.col("para")) / 7)).cast("string")).alias("batch_id"), ((F.col("chapter") * 5 + F.col("para")) % 7).cast("int").alias("item_idx"), F.concat(F.lit("Chapter "), F.repeat(F.lit("x"), 190)).alias("chapter_title"), F.coalesce("section", F.lit("")).alias("section_title"), F.lit("p. 1").alias("page_label"), "text")


ASKED = "nb AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents), qb AS (SELECT source || '-' || (n // 7) AS batch_id, (n % 7)::INT AS item_idx, CASE WHEN n % 2 = 1 THEN printf('%d.1 Sezione', n // 5 + 1) ELSE '' END AS section, coalesce(text, '') AS text FROM nb)"


@query("prompt_payloads", f"""WITH {ASKED}, pc AS (SELECT *, CASE WHEN item_idx % 3 = 2 THEN '' ELSE 'Capitolo: Chapter ' || repeat('x', 172) END AS ct, CASE WHEN section <> '' THEN 'Sezione: ' || section ELSE '' END AS st, CASE WHEN item_idx % 3 = 2 THEN '' ELSE 'Pagina: p. 1' END AS pg, row_number() OVER (PARTITION BY batch_id ORDER BY item_idx) - 1 AS k FROM qb),
pl AS (SELECT *, array_to_string(list_filter([ct, st, pg], lambda v: v <> ''), ' | ') AS line FROM pc)
SELECT batch_id, string_agg(CASE WHEN line <> '' THEN '<CONTESTO>' || line || '</CONTESTO>' || chr(10) ELSE '' END || '<PARAGRAFO id="' || k || '">' || chr(10) || text || chr(10) || '</PARAGRAFO>', chr(10) || chr(10) ORDER BY item_idx) AS payload, count(*) AS n_items FROM pl GROUP BY ALL""")
def prompt_payloads(spark, sf_dir):
    """Every third item has no chapter and page."""
    some = lambda c, v: F.when(F.col("item_idx") % 3 != 2, v).alias(c)
    items = asked(spark, sf_dir).select("batch_id", "item_idx", "text", "section_title", some("chapter_title", F.col("chapter_title")), some("page_label", F.col("page_label")))
    return batches.prompt_payloads(items, ["batch_id"])


@query("validate_batches", f"WITH {ASKED} SELECT batch_id, count(*) AS n_items, sum(length(text))::BIGINT AS n_chars, CASE WHEN count(*) > 5 THEN 'ITEM_COUNT' WHEN count(*) FILTER ({s.norm('text')} = '') > 0 THEN 'EMPTY_ITEM' WHEN sum(length(text)) > 22000 THEN 'TOO_LONG' END AS reject FROM qb GROUP BY ALL")
def validate_batches(spark, sf_dir):
    return batches.validate_batches(asked(spark, sf_dir), ["batch_id"])


#: Latin letters that their capital lower-cases to again, and ß with its own: with SS a word in capitals isn't the same term, and the source may hold it too.
SMALL = "ß" + "".join(c for c in map(chr, range(0x61, 0x250)) if c.upper() != c and c.upper().lower() == c)
CAPITAL = "ẞ" + SMALL[1:].upper()


def responses(spark, sf_dir) -> DataFrame:
    """A response to each document: by doc_id fenced, plain, one record too many, without its glossary, or not JSON. The record repeats terms, has one without definition and one that the source lacks."""
    first = F.regexp_extract(t.text(F.col("text")), r"(\p{L}+)", 1)
    entry = lambda term, said, basis: F.struct(term.alias("term"), F.lit(said).alias("definition"), F.lit("inline").alias("placement"), F.lit(basis).alias("basis"))
    entries = F.array(entry(first, "  said  of it. ", "boh"), entry(F.translate(first, SMALL, CAPITAL), "again", "source"), entry(F.concat(first, F.lit("")), "", "source"), entry(F.lit("not-in-any-text"), "x", "source"), entry(F.lit(" "), "y", "general"), entry(F.substring(first, 1, 1), "a letter;", "general"))
    points = F.array(*[F.lit(f" point {i} ") for i in range(10)], F.lit(" "))
    record = F.struct(F.concat(F.lit(" "), F.substring(t.text(F.col("text")), 1, 30)).alias("summary"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(" spoken ").alias("dsaSummary"), points.alias("keyPoints"), points.alias("remember"), F.concat(points, F.array(F.lit("k"))).alias("keywords"), F.when(F.col("doc_id") % 5 != 3, entries).alias("glossary"))
    one, two = F.to_json(F.struct(F.array(record).alias("summaries"))), F.to_json(F.struct(F.array(record, record).alias("summaries")))
    kind = F.col("doc_id") % 5
    payload = F.when(kind == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(kind == 2, two).when(kind == 4, "sorry").otherwise(one)
    return docs(spark, sf_dir).select(F.col("doc_id").alias("batch_id"), F.lit(1).alias("n_items"), payload.alias("payload"), "text")


@query("validate_responses", "SELECT doc_id AS batch_id, CASE doc_id % 5 WHEN 2 THEN 'WRONG_COUNT' WHEN 3 THEN 'INCOMPLETE' WHEN 4 THEN 'INVALID_JSON' END AS error FROM documents")
def validate_responses(spark, sf_dir):
    return batches.validate_responses(responses(spark, sf_dir)).select("batch_id", "error")


_WORD1 = "regexp_extract(coalesce(text, ''), '(\\p{L}+)', 1)"
NORMAL = f"""nr AS (SELECT doc_id, coalesce(text, '') AS text, {_WORD1} AS w FROM documents WHERE doc_id % 5 < 2),
ns AS (SELECT *, list_filter([{{'term': w[1:90], 'definition': 'said of it', 'basis': 'source'}}, {{'term': w[1:1], 'definition': 'a letter', 'basis': 'general'}}], lambda e: e.term <> '') AS g0 FROM nr),
nt AS (SELECT *, list_filter(g0, lambda e, i: list_position(list_transform(g0, lambda u: lower(u.term)), lower(e.term)) = i) AS g FROM ns)"""


@query("normalize_responses", f"""WITH {NORMAL}, sm AS (SELECT *, {s.trim_all("' ' || substring(text, 1, 30)")} AS summary FROM nt) SELECT doc_id AS batch_id, 0::INT AS item_idx, summary, CASE WHEN doc_id % 2 = 0 THEN summary ELSE 'spoken' END AS accessible,
  list_transform(range(8), lambda i: 'point ' || i) AS key_points, list_transform(range(5), lambda i: 'point ' || i) AS remember, list_transform(range(10), lambda i: 'point ' || i) AS keywords, list_transform(g, lambda e: e.term || ': ' || e.definition || ' (side, ' || e.basis || ')') AS terms, 'ai' AS engine FROM sm""")
def normalize_responses(spark, sf_dir):
    given = responses(spark, sf_dir)
    out = batches.normalize_responses(batches.validate_responses(given), given.select("batch_id", F.lit(0).alias("item_idx"), F.col("text").alias("source")))
    said = F.transform("glossary", lambda e: F.concat(e["term"], F.lit(": "), e["definition"], F.lit(" ("), e["placement"], F.lit(", "), e["basis"], F.lit(")")))
    return out.withColumn("terms", said).drop("glossary")


@query("with_fallback", f"WITH {NORMAL}, {RECORDS}, sm AS (SELECT doc_id, {s.trim_all("' ' || substring(text, 1, 30)")} AS summary FROM nt) SELECT doc_id, coalesce(sm.summary, rec.summary) AS summary, CASE WHEN sm.doc_id IS NOT NULL THEN 'ai' ELSE 'locale' END AS engine FROM rec LEFT JOIN sm USING (doc_id)")
def with_fallback(spark, sf_dir):
    given = responses(spark, sf_dir)
    made = batches.normalize_responses(batches.validate_responses(given), given.select("batch_id", F.lit(0).alias("item_idx"), F.col("text").alias("source"))).select(F.col("batch_id").alias("doc_id"), "summary", "engine")
    return batches.with_fallback(made, records(spark, sf_dir, "summary", "engine").select("doc_id", "summary", "engine"), ["doc_id"])


@query("explain_requests", f"""WITH a AS (SELECT conv_id, turn, ['simple', 'meaning', 'unknown', 'custom'][(turn % 4 + 1)::INT] AS action, CASE WHEN conv_id % 5 = 0 THEN '' ELSE coalesce(text, '') END AS selection, CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE coalesce(text, '') END AS question, repeat(coalesce(text, ''), 40) AS source_text FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN action = 'unknown' THEN 'simple' ELSE action END AS action, substring({s.trim_all('selection')}, 1, 1400) AS selection, substring({s.trim_all('question')}, 1, 600) AS question, substring({s.trim_all('source_text')}, 1, 12000) AS source_text FROM a)
SELECT *, CASE WHEN selection = '' THEN 'NO_SELECTION' WHEN action = 'custom' AND question = '' THEN 'NO_QUESTION' END AS error FROM b""")
def explain_requests(spark, sf_dir):
    text = t.text(F.col("text"))
    action = F.element_at(F.array(*map(F.lit, ("simple", "meaning", "unknown", "custom"))), (F.col("turn") % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", action.alias("action"), F.when(F.col("conv_id") % 5 == 0, "").otherwise(text).alias("selection"), F.when(F.col("conv_id") % 3 == 0, " ").otherwise(text).alias("question"), F.repeat(text, 40).alias("source_text"))
    return batches.explain_requests(c)


@query("apply_edits", f"""WITH ed AS (SELECT conv_id AS doc_id, turn, {s.trim_all("coalesce(text, '')")} AS v FROM conversations),
e AS (SELECT doc_id, arg_max(v, turn) FILTER (turn % 3 = 0) AS original, max(turn) FILTER (turn % 3 = 0) AS o, arg_max(v, turn) FILTER (turn % 3 = 1) AS summary, max(turn) FILTER (turn % 3 = 1) AS sm, arg_max(v, turn) FILTER (turn % 3 = 2) AS accessible, max(turn) FILTER (turn % 3 = 2) AS ac FROM ed WHERE v <> '' GROUP BY doc_id)
SELECT d.doc_id, coalesce(e.original, d.text) AS original, CASE WHEN sm > coalesce(o, -1) THEN e.summary WHEN o IS NULL THEN d.source END AS summary, CASE WHEN ac > coalesce(o, -1) THEN e.accessible WHEN o IS NULL THEN d.lang END AS accessible, e.doc_id IS NOT NULL AS edited FROM documents d LEFT JOIN e USING (doc_id)""")
def apply_edits(spark, sf_dir):
    """Turns as edits of the document with their conversation's number: of the source, the summary and the accessible text in turn."""
    c = table(spark, sf_dir, "conversations")
    one = lambda k, name: F.when(F.col("turn") % 3 == k, F.col("text")).alias(name)
    edits = c.select(F.col("conv_id").alias("doc_id"), one(0, "original"), one(1, "summary"), one(2, "accessible"), F.col("turn").alias("edited_at"))
    book = docs(spark, sf_dir).select("doc_id", F.col("text").alias("original"), F.col("source").alias("summary"), F.col("lang").alias("accessible"))
    return batches.apply_edits(book, edits, ["doc_id"])


@query("apply_refinement", f"""WITH {RECORDS}, rf AS (SELECT doc_id, text, 'Refined.' AS summary, 'Said anew.' AS accessible, ['a', 'b'] AS key_points, ['c'] AS remember, list_transform(range(12), lambda i: 'k' || i) AS keywords FROM rec WHERE doc_id % 4 = 0), {repaired('rf', 24, 4)}
SELECT doc_id, summary, accessible, key_points, remember, keywords, 'ai-refine' AS engine, len(lost)::INT AS fidelity_recovered FROM rp UNION ALL SELECT doc_id, summary, accessible, kp, rm, keywords, 'locale', len(found)::INT FROM rec WHERE doc_id % 4 <> 0""")
def apply_refinement(spark, sf_dir):
    """Refined results of every second document, half of which lack a part and don't count."""
    words = '["' + '", "'.join(f"k{i}" for i in range(14)) + '"]'
    good = f'```json\n{{"summary": " Refined. ", "dsaSummary": "Said anew.", "keyPoints": ["a", "b"], "remember": ["c"], "keywords": {words}}}\n```'
    given = docs(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, good).otherwise('{"summary": "x", "dsaSummary": "y", "keyPoints": []}').alias("payload"))
    # read twice: by refined records and by the others; its columns of place are not needed
    book = written(summary.summarize_local(docs(spark, sf_dir).where("doc_id is not null"), "studio", LEX).withColumnRenamed("text", "original"))
    out = batches.apply_refinement(book, batches.refined_records(given), ["doc_id"], "original", LEX)
    return out.select("doc_id", "summary", "accessible", "key_points", "remember", "keywords", "engine", "fidelity_recovered")


@query("validate_answers", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE 'an answer ' || conv_id END AS answer, CASE WHEN turn % 3 = 0 THEN 'general' ELSE 'source' END AS basis, CASE WHEN turn % 3 = 2 THEN '' ELSE repeat('l', 80) END AS label, CASE WHEN turn % 3 = 2 THEN 'NO_ANSWER' END AS error FROM conversations")
def validate_answers(spark, sf_dir):
    body = lambda basis: F.concat(F.lit('```\n{"answer": " an answer '), F.col("conv_id").cast("string"), F.lit(f'", "basis": "{basis}", "label": "{"l" * 99}"}}\n```'))
    kind = F.col("turn") % 3
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(kind == 0, body("general")).when(kind == 1, body("other")).otherwise("no JSON").alias("payload"))
    return batches.validate_answers(c).drop("payload")


_EVERY = s.unique_ci("keywords || list_transform(glossary, lambda e: e.term)", 1_000)


@query("highlight_terms", f"WITH {RECORDS}, ht AS (SELECT doc_id, list_filter({_EVERY}, lambda v: length(v) >= 3) AS v FROM rec) SELECT doc_id, list_transform(list_sort(list_transform(v, lambda x, i: {{'n': -length(x), 'i': i, 'v': x}})), lambda x: x.v)[1:24] AS terms FROM ht")
def highlight_terms(spark, sf_dir):
    return records(spark, sf_dir).select("doc_id", glossary.highlight_terms(F.col("keywords"), F.col("glossary")).alias("terms"))


@query("chunk_progress", f"WITH {sq.CHUNKS}, c AS (SELECT source, count(*) AS total, count(DISTINCT doc_id) AS paragraphs, count(*) FILTER (doc_id % 2 = 0) AS done FROM b JOIN documents USING (doc_id) GROUP BY ALL) SELECT source, total, done, CASE WHEN done >= total THEN paragraphs ELSE least(paragraphs, floor(done / total::DOUBLE * paragraphs)) END::BIGINT AS finished FROM c")
def chunk_progress(spark, sf_dir):
    """How far the books are when the chunks of all even documents are done."""
    chunks = batches.chunk_table(docs(spark, sf_dir), ("source", "doc_id"))
    c = chunks.groupBy("source").agg(F.count("*").alias("total"), F.count_distinct("doc_id").alias("paragraphs"), F.count_if(F.col("doc_id") % 2 == 0).alias("done"))
    return c.select("source", "total", "done", audit.progress(F.col("done"), F.col("total"), F.col("paragraphs")).alias("finished"))


@query("purge_answers", "WITH e AS (SELECT event_id::VARCHAR AS key, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE event_type END AS answer, ts FROM events) SELECT key, answer FROM e WHERE trim(answer) <> '' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def purge_answers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("key"), F.when(F.col("event_id") % 6 == 0, " ").otherwise(F.col("event_type")).alias("answer"), F.col("ts").alias("saved_at"))
    now = e.select(F.max("saved_at")).first()[0]
    return answers.purge_answers(e, F.lit(now)).select("key", "answer")


@query("file_signatures", "SELECT page_id, sha256(coalesce(url, '') || '::' || length(coalesce(html, '')) || '::' || (page_id * 10) || '::text/html::1') AS signature FROM pages")
def file_signatures(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"), F.length(t.text(F.col("html"))).alias("size"), (F.col("page_id") * 10).alias("last_modified"), F.lit("text/html").alias("type"), F.lit(1).alias("page_count"))
    return incremental.file_signature(p).select("page_id", "signature")


@query("cascade_delete", "WITH g AS (SELECT DISTINCT source FROM documents WHERE doc_id % 50 = 0) SELECT 'library' AS kind, count(*) AS n FROM documents WHERE doc_id % 50 <> 0 UNION ALL SELECT 'checkpoints', count(*) FROM documents WHERE source NOT IN (SELECT source FROM g) UNION ALL SELECT 'ocr', count(*) FROM documents WHERE source NOT IN (SELECT source FROM g) AND doc_id % 2 = 0")
def cascade_delete(spark, sf_dir):
    """Books are documents, signed by their source; every fiftieth is deleted."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("signature"))
    left = incremental.cascade_delete(d.where("id % 50 = 0").select("id"), d, d, d.where("id % 2 = 0"))
    counts = [x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, x in zip(("library", "checkpoints", "ocr"), left, strict=True)]
    return counts[0].union(counts[1]).union(counts[2])


@query(
    "quality_rollup",
    f"""WITH {RECORDS}, {sq.CHUNKS.replace('a AS (', 'qa AS (', 1).replace('FROM a)', 'FROM qa)').replace('b AS (', 'qb AS (', 1)}, qn AS (SELECT doc_id, count(*) AS n, max(length(chunk)) AS longest FROM qb GROUP BY doc_id),
qr AS (SELECT r.book, d.lang, n, longest, len(found) AS fr, len(r.glossary) AS ge, CASE WHEN r.doc_id % 3 = 0 THEN 'ai' WHEN r.doc_id % 3 = 1 AND r.doc_id % 2 = 0 THEN 'misto' ELSE 'locale' END AS e, CASE WHEN r.doc_id % 2 = 0 THEN n END AS st,
  CASE WHEN r.doc_id % 2 = 0 THEN n // 2 END AS sa, CASE WHEN r.doc_id % 5 = 0 THEN n ELSE 0 END AS resumed FROM rec r JOIN documents d USING (doc_id) JOIN qn USING (doc_id)),
qs AS (SELECT book, lang, count(*) AS paragraphs, count(*) FILTER (e = 'ai') AS ai, count(*) FILTER (e = 'misto') AS misto, count(*) FILTER (e = 'locale') AS locale, sum(fr)::BIGINT AS fidelity_recovered, sum(ge)::BIGINT AS glossary_entries, sum(coalesce(st, 1))::BIGINT AS total_chunks,
  sum(coalesce(sa, (e = 'ai')::INT))::BIGINT AS ai_chunks, sum(CASE WHEN st IS NULL THEN (e = 'locale')::INT ELSE st - sa END)::BIGINT AS local_chunks, sum(CASE WHEN st IS NULL THEN (e = 'misto')::INT ELSE 0 END)::BIGINT AS mixed_chunks, sum(resumed)::BIGINT AS resumed_chunks, sum(n)::BIGINT AS prepared, count(*) FILTER (n > 1) AS long_split, max(longest)::INT AS max_chunk_chars
  FROM qr GROUP BY ROLLUP (book, lang))
SELECT * EXCLUDE (prepared), CASE WHEN ai = paragraphs THEN 'ai' WHEN locale = paragraphs THEN 'locale' ELSE 'misto' END AS engine, CASE WHEN resumed_chunks >= prepared THEN paragraphs ELSE least(paragraphs, floor(resumed_chunks / prepared::DOUBLE * paragraphs)) END::BIGINT AS resumed_paragraphs,
  floor(ai_chunks / total_chunks::DOUBLE * 1000 + 0.5) / 10 AS ai_chunk_percent FROM qs""",
)
def quality_rollup(spark, sf_dir):
    """Every third record by a model, some by both; every second one with counts of its chunks, half of them by a model; every fifth from a checkpoint."""
    d = docs(spark, sf_dir)
    chunks = batches.chunk_map(d.withColumnRenamed("source", "book"), book="book").select("doc_id", "n_chunks", "max_chunk")
    r = records(spark, sf_dir).join(d.select("doc_id", "lang"), "doc_id").join(chunks, "doc_id")
    engine = F.when(F.col("doc_id") % 3 == 0, "ai").when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 2 == 0), "misto").otherwise("locale")
    half = F.floor(F.col("n_chunks") / 2)
    stats = F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("n_chunks").alias("total_chunks"), half.alias("ai_chunks"), (F.col("n_chunks") - half).alias("local_chunks"), F.lit(0).alias("mixed_chunks")))
    return audit.quality_metrics(r.withColumns({"engine": engine, "chunk_stats": stats, "resumed": F.when(F.col("doc_id") % 5 == 0, F.col("n_chunks")).otherwise(0)}), ["book", "lang"])
