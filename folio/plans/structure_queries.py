"""Queries over books: pages made from documents, headings, chapters, sections, paragraphs, chunks; and their SQL.

A book is a source, its pages are the source's documents in order of doc_id. Since the documents hold no headings, every
fifth page begins with a chapter line and every second one with a numbered line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators import batches, cleaning, structure
from folio.operators.places import numbered
from folio.operators.structure import LEGACY, PATTERNS
from folio.plans import sql as s
from folio.plans.sql import q
from folio.plans.text_queries import docs

QUERIES, ORACLES = {}, {}


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = f
        if check:
            ORACLES[name] = check
        return f

    return add


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = numbered(docs(spark, sf_dir).select("source", "doc_id", "text"), ["source"], "doc_id", "n", width=1_000).withColumn("page", (F.col("n") + 1).cast("int"))
    k = F.floor((F.col("page") - 1) / 5) + 1
    chapter = F.when((F.col("page") - 1) % 5 == 0, F.format_string("CAPITOLO %d — AREA %d\n\n", k, F.col("page"))).otherwise("")
    section = F.when(F.col("page") % 2 == 0, F.format_string("%d.1 Sezione %d\n\n", k, F.col("page"))).otherwise("")
    return d.select(F.col("source").alias("book"), "page", F.concat(chapter, section, t.text(F.col("text"))).alias("text"))


PAGES = """
b0 AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS page FROM documents),
pages AS (SELECT source AS book, page, CASE WHEN (page - 1) % 5 = 0 THEN printf('CAPITOLO %d — AREA %d', (page - 1) // 5 + 1, page) || chr(10) || chr(10) ELSE '' END
  || CASE WHEN page % 2 = 0 THEN printf('%d.1 Sezione %d', (page - 1) // 5 + 1, page) || chr(10) || chr(10) ELSE '' END || coalesce(text, '') AS text FROM b0)"""
ROWS = f"list_filter(list_transform(string_split(text, chr(10)), lambda v: {s.trim_all("regexp_replace(replace(v, chr(173), ''), '[ \\t]+', ' ', 'g')")}), lambda v: v <> '')"
INDEXED = f"""{PAGES},
i0 AS (SELECT *, {ROWS} AS r FROM pages),
i1 AS (SELECT *, len(r) >= 5 AND ({s.any_of("lower(array_to_string(r[1:5], ' '))", ("indice", "sommario", "contents"))}
  OR (page <= 30 AND len(list_filter(r, lambda v: regexp_matches(v, '\\.{{2,}} ?[0-9]{{1,4}}$') OR regexp_matches(v, '^[0-9]+(?:\\.[0-9]+)* .+ [0-9]{{1,4}}$'))) >= greatest(4, ceil(len(r) * 0.35::DOUBLE)))) AS is_index FROM i0)"""


def _classified(value: str, surrounded: str) -> dict[str, str]:
    m = {k: f"regexp_matches({value}, {q(p)})" for k, p in PATTERNS.items()}
    part = lambda k, i: f"regexp_extract({value}, {q(PATTERNS[k])}, {i})"
    words = f"len(list_filter(string_split({value}, ' '), lambda w: w <> ''))"
    sentence = f"((length({value}) > 95 AND regexp_matches({value}, '[.!?]$')) OR (length({value}) > 115 AND regexp_matches({value}, '[,;:]')))"
    lettered = f"list_filter(string_split({value}, ' '), lambda w: regexp_matches(w, '[{t.LETTER}]'))"
    titled = f"list_filter({lettered}, lambda w: regexp_matches(w, '^[A-ZÀ-ÖØ-Ý]'))"
    number = part("numbered", 1)
    depth = f"least(6, length({number}) - length(replace({number}, '.', '')) + 1)"
    rules = [
        (f"{value} = '' OR length({value}) > 140 OR {m['page']} OR {m['bullets']} OR {m['leader']}", None, "NULL", "NULL"),
        (m["container"], "container", "0", "NULL"),
        (m["chapter"], "chapter", "1", "NULL"),
        (m["section"], "section", "2", "NULL"),
        (m["paragraph"], "section", "3", "NULL"),
        (f"{m['numbered']} AND NOT {sentence} AND NOT regexp_matches(trim({part('numbered', 2)}), {q(PATTERNS['tail'])})", "numbered", depth, number),
        (f"{m['roman']} AND NOT {sentence}", "numbered", "1", part("roman", 1)),
        (f"{m['letter']} AND NOT {sentence}", "numbered", "2", part("letter", 1)),
        (m["named"], "named", "1", "NULL"),
        (f"{m['capitals']} AND length({value}) <= 90 AND {words} <= 12 AND NOT regexp_matches({value}, '[.!?]$')", "visual", "1", "NULL"),
        (f"{surrounded} AND length({value}) <= 78 AND {words} <= 10 AND len({lettered}) > 0 AND len({titled}) / len({lettered})::DOUBLE >= 0.6::DOUBLE AND NOT regexp_matches({value}, '[.!?;]$')", "visual", "2", "NULL"),
    ]
    case = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i] if i > 1 else q(r[1]) if r[1] else 'NULL'}" for r in rules) + " END"
    return {"family": case(1), "depth": case(2), "number": case(3), "bare": f"coalesce(trim({part('chapter', 1)}), '') = ''"}


_own, _next = _classified("value", "surrounded"), _classified("value", "true")
LINES = f"""{INDEXED},
l0 AS (SELECT book, page, string_split(replace({s.clean_block('text')}, chr(13), ''), chr(10)) AS l FROM i1 WHERE NOT is_index),
l1 AS (SELECT book, page, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM l0),
l2 AS (SELECT *, {s.clean_block('line')} AS value FROM l1),
l3 AS (SELECT *, coalesce(lag(value) OVER p, '') = '' OR coalesce(lead(value) OVER p, '') = '' AS surrounded FROM l2 WINDOW p AS (PARTITION BY book, page ORDER BY line_no)),
l4 AS (SELECT *, {_own['family']} AS family, ({_own['depth']})::INT AS depth, {_own['number']} AS number, {_next['family']} AS next_family, {_own['bare']} AS is_bare FROM l3),
l5 AS (SELECT *, family = 'chapter' AND is_bare AS bare FROM l4)"""
STRATEGY = f"""{LINES},
g0 AS (SELECT book, min(depth) AS root_depth FROM (SELECT book, depth FROM l5 WHERE family = 'numbered' GROUP BY ALL HAVING count(*) >= 2) GROUP BY book),
g1 AS (SELECT book, count(*) FILTER (family = 'chapter') AS c1, count(*) FILTER (family = 'container') AS c2, count(*) FILTER (family = 'named') AS c3, count(*) FILTER (family = 'visual' AND depth = 1) AS c4 FROM l5 WHERE family IS NOT NULL GROUP BY book),
g2 AS (SELECT book, CASE WHEN c1 >= 2 THEN 'chapter' WHEN c2 >= 2 THEN 'container' WHEN root_depth IS NOT NULL THEN 'numbered' WHEN c3 >= 2 THEN 'named' WHEN c4 >= 2 THEN 'visual' ELSE 'document' END AS mode, root_depth FROM g1 LEFT JOIN g0 USING (book)),
g AS (SELECT book, mode, CASE WHEN mode = 'numbered' THEN root_depth END AS root_depth FROM g2)"""
_last = ", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER w AS p{k}, last(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(2, 7))
_on = ", ".join(f"CASE WHEN p{k} > greatest({', '.join(['reset'] + [f'coalesce(p{j}, 0)' for j in range(2, k)])}) THEN {{'level': {k}, 'title': t{k}}} END" for k in range(2, 7))
OUTLINE = f"""{STRATEGY},
o0 AS (SELECT l5.*, coalesce(mode, 'document') AS mode, root_depth FROM l5 LEFT JOIN g USING (book)),
o1 AS (SELECT *, coalesce(CASE WHEN mode IN ('chapter', 'container') THEN family = mode OR family = 'named' WHEN mode = 'numbered' THEN family = 'numbered' AND depth = root_depth
  WHEN mode = 'named' THEN family = 'named' WHEN mode = 'visual' THEN family = 'visual' AND depth = 1 END, false) AS is_root,
  lead(value) OVER p AS following, lead(next_family) OVER p AS nf FROM o0 WINDOW p AS (PARTITION BY book, page ORDER BY line_no)),
o2 AS (SELECT *, coalesce(is_root AND bare AND following <> '' AND length(following) <= 90 AND NOT ((length(following) > 95 AND regexp_matches(following, '[.!?]$')) OR (length(following) > 115 AND regexp_matches(following, '[,;:]')))
  AND (nf IS NULL OR nf = 'visual'), false) AS merges FROM o1),
o3 AS (SELECT *, CASE WHEN coalesce(lag(merges) OVER p, false) THEN 'consumed' WHEN family IS NULL THEN 'body' WHEN family = 'container' AND mode = 'chapter' THEN 'container' WHEN is_root THEN 'root' ELSE 'section' END AS role
  FROM o2 WINDOW p AS (PARTITION BY book, page ORDER BY line_no)),
o4 AS (SELECT *, CASE WHEN merges THEN value || ' — ' || following WHEN role <> 'body' THEN value END AS title,
  CASE WHEN role = 'section' THEN least(6, CASE WHEN family = 'section' THEN greatest(2, depth) WHEN family = 'numbered' THEN greatest(2, depth - CASE WHEN mode = 'numbered' THEN root_depth ELSE 1 END + 2) ELSE 2 END) END AS level,
  row_number() OVER (PARTITION BY book ORDER BY page, line_no) AS pos FROM o3),
o5 AS (SELECT *, count(*) FILTER (role = 'root') OVER w AS chapter_no, count(*) FILTER (role IN ('root', 'container', 'section')) OVER w AS segment,
  last(CASE WHEN role = 'container' THEN title END IGNORE NULLS) OVER w AS container, coalesce(max(CASE WHEN role IN ('root', 'container') THEN pos END) OVER w, 0) AS reset, {_last}
  FROM o4 WINDOW w AS (PARTITION BY book ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, list_filter([{_on}], lambda e: e IS NOT NULL) AS stack FROM o5)"""


def lines_of(spark, sf_dir):
    return structure.outline(book_pages(spark, sf_dir))


@query("index_pages", f"WITH {INDEXED} SELECT book, page, is_index FROM i1")
def index_pages(spark, sf_dir):
    return book_pages(spark, sf_dir).select("book", "page", cleaning.is_index_page(F.col("text"), F.col("page")).alias("is_index"))


@query("heading_lines", f"WITH {LINES} SELECT book, page, line_no, value AS title, family, depth, number, bare FROM l5 WHERE family IS NOT NULL")
def heading_lines(spark, sf_dir):
    return structure.heading_candidates(structure.explode_lines(book_pages(spark, sf_dir)))


@query("root_strategy", f"WITH {STRATEGY} SELECT book, mode, root_depth FROM g")
def root_strategy(spark, sf_dir):
    return structure.choose_root_strategy(structure.heading_candidates(structure.explode_lines(book_pages(spark, sf_dir))))


@query("line_roles", f"WITH {OUTLINE} SELECT book, page, line_no, role, chapter_no, title, level FROM o")
def line_roles(spark, sf_dir):
    return lines_of(spark, sf_dir).select("book", "page", "line_no", "role", "chapter_no", "title", "level")


SECTIONS = "SELECT book, chapter_no, row_number() OVER (PARTITION BY book, chapter_no ORDER BY pos) AS section_no, title, level, number AS numbering, page, CASE WHEN len(stack) > 1 THEN stack[len(stack) - 1].title END AS parent, list_transform(stack, lambda e: e.title) AS path FROM o WHERE role = 'section'"


@query("section_paths", f"WITH {OUTLINE} {SECTIONS}")
def section_paths(spark, sf_dir):
    return structure.sections(lines_of(spark, sf_dir))


SEGMENTS = f"""{OUTLINE},
e0 AS (SELECT book, page, segment, any_value(chapter_no) AS chapter_no, any_value(container) AS container, any_value(stack) AS stack, string_agg(line, chr(10) ORDER BY line_no) AS raw FROM o WHERE role = 'body' GROUP BY ALL),
e AS (SELECT * EXCLUDE (raw), {s.clean_block('raw')} AS body FROM e0 WHERE {s.clean_block('raw')} <> '')"""


def gathered(pieces: str, full: str) -> str:
    """As structure.gather; `full` is a test of a.n (the text so far) and x.n (the piece)."""
    each = f"list_transform({pieces}, lambda v: {{'d': []::VARCHAR[], 'n': v}})"
    fold = f"list_reduce({each}, lambda a, x: CASE WHEN a.n = '' THEN {{'d': a.d, 'n': x.n}} WHEN {full} THEN {{'d': list_append(a.d, a.n), 'n': x.n}} ELSE {{'d': a.d, 'n': a.n || ' ' || x.n}} END)"
    return f"CASE WHEN len({pieces}) = 0 THEN [] ELSE list_filter(list_transform([{fold}], lambda r: list_append(r.d, r.n))[1], lambda v: v <> '') END"


def packed(pieces: str, most: int) -> str:
    return gathered(pieces, f"length(a.n) + 1 + length(x.n) > {most}")


def study_paragraphs_sql(x: str) -> str:
    blocks = f"list_filter(list_transform(regexp_split_to_array({s.clean_block(x)}, {q('\\n' + t.SPACE + '*\\n')}), lambda b: {s.clean_block('b')}), lambda b: b <> '')"
    found = f"list_filter(list_transform(regexp_extract_all(b, {q(t.SENTENCE)}), lambda v: {s.clean_block('v')}), lambda v: v <> '')"
    return f"flatten(list_transform({blocks}, lambda b: CASE WHEN length(b) <= 1800 OR len({found}) = 0 THEN [b] ELSE {packed(found, 1350)} END))"


@query("body_segments", f"WITH {SEGMENTS} SELECT book, page, segment, chapter_no, container, body FROM e")
def body_segments(spark, sf_dir):
    return structure.body_segments(lines_of(spark, sf_dir)).drop("stack")


PARAGRAPHS = f"""{SEGMENTS},
f0 AS (SELECT *, {study_paragraphs_sql('body')} AS ps FROM e),
f1 AS (SELECT *, unnest(ps) AS paragraph, unnest(range(len(ps))) AS part FROM f0),
f AS (SELECT book, chapter_no, row_number() OVER (PARTITION BY book, chapter_no ORDER BY page, segment, part) AS para_no, page, paragraph, stack[len(stack)].title AS section_title, stack[len(stack)].level AS section_level,
  list_transform(stack, lambda e: e.title) AS section_path, container FROM f1)"""


@query("paragraph_meta", f"WITH {PARAGRAPHS} SELECT * FROM f")
def paragraph_meta(spark, sf_dir):
    return structure.paragraphs(structure.body_segments(lines_of(spark, sf_dir)))


CHAPTERS = f"""{PARAGRAPHS},
h1 AS (SELECT book, chapter_no, title, number AS numbering, container, page AS root_page FROM o WHERE role = 'root'),
h2 AS (SELECT book, chapter_no, count(*) AS n_sections, min_by(page, pos) AS first_section FROM o WHERE role = 'section' GROUP BY ALL),
h3 AS (SELECT book, chapter_no, count(*) AS n_paragraphs, min(page) AS first_page, max(page) AS last_page FROM f GROUP BY ALL),
h4 AS (SELECT * FROM h2 FULL JOIN h3 USING (book, chapter_no) LEFT JOIN h1 USING (book, chapter_no)),
h5 AS (SELECT *, coalesce(root_page, least(first_section, first_page)) AS page_start FROM h4),
h6 AS (SELECT *, greatest(page_start, coalesce(last_page, 0)) AS e, lead(page_start) OVER (PARTITION BY book ORDER BY chapter_no) AS nx FROM h5),
h7 AS (SELECT book, 1::INT AS chapter_idx, min(chapter_no) AS chapter_no, 'Documento' AS title, NULL AS numbering, NULL AS container, min(page) AS page_start, max(page) AS page_end, 0::BIGINT AS n_sections, 0::BIGINT AS n_paragraphs
  FROM o WHERE book NOT IN (SELECT book FROM h4 WHERE book IS NOT NULL) GROUP BY book),
h AS (SELECT * FROM h7 UNION ALL SELECT book, row_number() OVER (PARTITION BY book ORDER BY chapter_no)::INT AS chapter_idx, chapter_no, coalesce(title, 'Introduzione') AS title, numbering, container, page_start,
  CASE WHEN nx IS NOT NULL THEN greatest(page_start, least(e, nx - 1)) ELSE e END AS page_end, coalesce(n_sections, 0) AS n_sections, coalesce(n_paragraphs, 0) AS n_paragraphs FROM h6)"""


@query("chapters", f"WITH {CHAPTERS} SELECT * FROM h")
def chapters(spark, sf_dir):
    return structure.chapters(lines_of(spark, sf_dir))


@query(
    "structure_stats",
    f"""WITH {CHAPTERS}, a AS (SELECT book, count(*) AS pages, count(*) FILTER (is_index) AS index_pages FROM i1 GROUP BY book), b AS (SELECT book, count(*) AS chapters, sum(n_sections)::BIGINT AS sections, sum(n_paragraphs)::BIGINT AS paragraphs FROM h GROUP BY book),
c AS (SELECT book, coalesce(max(level), 0) AS max_depth FROM o GROUP BY book) SELECT * FROM a LEFT JOIN b USING (book) LEFT JOIN c USING (book)""",
)
def structure_stats(spark, sf_dir):
    pages = book_pages(spark, sf_dir)
    return structure.structure_stats(pages, structure.outline(pages))


@query("study_paragraphs", f"SELECT doc_id, unnest(p) AS paragraph, unnest(range(len(p)))::INT AS para_no FROM (SELECT doc_id, {study_paragraphs_sql('text')} AS p FROM documents)")
def study_paragraphs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(structure.split_study_paragraphs(F.col("text"))).alias("para_no", "paragraph"))


def legacy_paragraphs_sql(x: str) -> str:
    clean = s.clean_text(x)
    edge = lambda v: f"string_split(regexp_replace({v}, {q(f'([.!?]){t.SPACE}+([A-ZÀ-ÖØ-Ý])')}, '\\1' || chr(30) || '\\2', 'g'), chr(30))"
    blocks = f"list_filter(list_transform(regexp_split_to_array({clean}, {q(chr(92) + 'n' + t.SPACE + '*' + chr(92) + 'n')}), lambda b: {s.trim_all('b')}), lambda b: b <> '')"
    grown = gathered(f"list_transform({edge(clean)}, lambda v: {s.trim_all('v')})", "length(a.n) > 700")
    raw = f"CASE WHEN len({blocks}) > 1 THEN {blocks} ELSE {grown} END"
    return f"flatten(list_transform({raw}, lambda b: CASE WHEN length(b) <= 1400 THEN [b] ELSE {packed(edge('b'), 1200)} END))"


@query("paragraphs_legacy", f"SELECT doc_id, unnest(p) AS paragraph, unnest(range(len(p)))::INT AS para_no FROM (SELECT doc_id, {legacy_paragraphs_sql('text')} AS p FROM documents)")
def paragraphs_legacy(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(structure.split_paragraphs_legacy(F.col("text"))).alias("para_no", "paragraph"))


_legacy = {k: f"regexp_matches(v, {q(p)})" for k, p in LEGACY.items()}
_lnum = f"regexp_extract(v, {q(LEGACY['numbered'])}, 1)"
LEGACY_HEADING = f"""CASE WHEN v = '' OR length(v) > 120 OR regexp_matches(v, {q(t.PAGE_NUMBER)}) OR regexp_matches(v, '^[•·\\-–—_]+$') THEN NULL WHEN {_legacy['part']} THEN {{'level': 1, 'kind': 'part'}} WHEN {_legacy['chapter']} THEN {{'level': 1, 'kind': 'chapter'}}
  WHEN {_legacy['section']} THEN {{'level': 2, 'kind': 'section'}} WHEN {_legacy['numbered']} THEN {{'level': least(3, length({_lnum}) - length(replace({_lnum}, '.', '')) + 1)::INT, 'kind': 'numbered'}} WHEN {_legacy['roman']} THEN {{'level': 1, 'kind': 'roman'}}
  WHEN {_legacy['capitals']} AND length(v) <= 76 AND len(list_filter(string_split(v, ' '), lambda w: w <> '')) <= 10 AND NOT regexp_matches(v, '[.!?]$') THEN {{'level': 1, 'kind': 'uppercase'}} END"""
LEGACY_LEVEL = f"({LEGACY_HEADING}).level"


@query(
    "heading_lines_legacy",
    f"""WITH {PAGES}, a AS (SELECT book, page, string_split(text, chr(10)) AS l FROM pages), b AS (SELECT book, page, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM a), c AS (SELECT *, {s.trim_all('line')} AS v FROM b),
d AS (SELECT book, page, line_no, {LEGACY_HEADING} AS h FROM c)
SELECT book, page, line_no, h.level AS level, h.kind AS kind FROM d WHERE h IS NOT NULL""",
)
def heading_lines_legacy(spark, sf_dir):
    each = cleaning.lines(book_pages(spark, sf_dir)).withColumn("h", structure.classify_heading_legacy(F.col("line")))
    return each.where("h is not null").select("book", "page", "line_no", "h.level", "h.kind")


def chunks_sql(x: str) -> str:
    n = s.norm(x)
    pieces = "flatten(list_transform(string_split(v, ' '), lambda w: list_transform(range(0, greatest(length(w), 1), 4200), lambda k: substring(w, k::INT + 1, 4200))))"
    segments = f"flatten(list_transform({s.sentences(x)}, lambda v: CASE WHEN length(v) <= 4200 THEN [v] ELSE {packed(pieces, 4200)} END))"
    return f"CASE WHEN length({n}) <= 7000 THEN [{n}] ELSE {packed(segments, 4200)} END"


CHUNKS = f"a AS (SELECT doc_id, {chunks_sql('text')} AS c FROM documents), b AS (SELECT doc_id, unnest(c) AS chunk, unnest(range(len(c)))::INT AS chunk_no FROM a)"


@query("long_chunks", f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk FROM b")
def long_chunks(spark, sf_dir):
    return batches.chunk_table(docs(spark, sf_dir))


@query("chunk_map", "WITH " + CHUNKS + ", c AS (SELECT d.source AS book, b.doc_id, count(*) AS n_chunks, max(length(chunk)) AS max_chunk FROM b JOIN documents d USING (doc_id) GROUP BY ALL) SELECT book, doc_id, n_chunks, max_chunk, (sum(n_chunks) OVER (PARTITION BY book ORDER BY doc_id) - n_chunks)::BIGINT AS start FROM c")
def chunk_map(spark, sf_dir):
    return batches.chunk_map(docs(spark, sf_dir).withColumnRenamed("source", "book"), book="book")


def batches_sql(of: str, by: str, order: str) -> str:
    """Greedy batches of a table (by, order, n_chars) as bt(by, batch_no, order, n_chars); the state and the items have one type."""
    item = lambda b: f"list_append(a.out, {{'o': x.o, 'n': x.n, 'b': {b}}})"
    step = f"CASE WHEN a.i > 0 AND (a.i >= 5 OR a.c + x.n > 18000) THEN {{'o': 0::BIGINT, 'n': 0::BIGINT, 'b': a.b + 1, 'i': 1, 'c': x.n, 'out': {item('a.b + 1')}}} ELSE {{'o': 0::BIGINT, 'n': 0::BIGINT, 'b': a.b, 'i': a.i + 1, 'c': a.c + x.n, 'out': {item('a.b')}}} END"
    none = "list_filter([{'o': 0::BIGINT, 'n': 0::BIGINT, 'b': 0}], lambda v: v.o > 0)"
    each = f"{{'o': {order}::BIGINT, 'n': n_chars::BIGINT, 'b': 0, 'i': 0, 'c': 0::BIGINT, 'out': {none}}}"
    return f"""bt0 AS (SELECT {by}, list({each} ORDER BY {order}) AS l FROM {of} GROUP BY {by}),
bt1 AS (SELECT {by}, unnest(list_reduce([{each.replace(order + '::', '0::').replace('n_chars::', '0::')}] || l, lambda a, x: {step}).out) AS u FROM bt0),
bt AS (SELECT {by}, u.b::INT AS batch_no, u.o::INT AS {order}, u.n::INT AS n_chars FROM bt1)"""


@query("batches", f"WITH {PARAGRAPHS}, fb AS (SELECT book, chapter_no, para_no, length(paragraph) AS n_chars FROM f), {batches_sql('fb', 'book, chapter_no', 'para_no')} SELECT * FROM bt")
def batch_rows(spark, sf_dir):
    return batches.make_batches(structure.paragraphs(structure.body_segments(lines_of(spark, sf_dir))).withColumnRenamed("paragraph", "text"), ["book", "chapter_no"], "para_no")
