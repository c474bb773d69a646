"""Queries over conversations, pages and events: answers, blocks, incremental state, streams, budgets, views; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators import answers, budget, incremental, structure, summary
from folio.operators.places import numbered, shared_folder
from folio.plans import sql as s
from folio.plans.structure_queries import gathered
from folio.plans.study_queries import BY, RECORDS, marked, records
from folio.plans.text_queries import LEX, docs, summary_sql
from folio.sources import files, sinks
from folio.streaming import streams

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


def requests(spark, sf_dir) -> DataFrame:
    """A request for each user turn: its first long word is selected, the turn after it is the source; actions take turns."""
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("next_text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    action = F.element_at(F.array(*map(F.lit, ("simple", "meaning", "example", "importance", "remember", "exam", "custom"))), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) + 1).cast("int"))
    selection = F.regexp_extract(t.text(F.col("text")), r"([\p{L}]{5,})", 1)
    return c.where("role = 'user'").select("conv_id", "turn", action.alias("action"), selection.alias("selection"), F.lit("").alias("chapter_title"), F.lit("").alias("section_title"), t.text(F.col("next_text")).alias("source_text"), F.lit("").alias("summary"), t.text(F.col("text")).alias("question"))


_SENTS = s.sentences("source_text")
REQUESTS = """r0 AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
r1 AS (SELECT conv_id, turn, ['simple', 'meaning', 'example', 'importance', 'remember', 'exam', 'custom'][((conv_id + turn) % 7 + 1)::INT] AS action, coalesce(regexp_extract(coalesce(text, ''), '([\\p{L}]{5,})', 1), '') AS selection, coalesce(next_text, '') AS source_text, coalesce(text, '') AS question FROM r0 WHERE role = 'user')"""
LOCAL = f"""{REQUESTS},
r2 AS (SELECT *, {_SENTS} AS ss FROM r1),
r3 AS (SELECT *, list_filter(ss, lambda v: contains(lower(v), lower(selection)))[1] AS m, list_filter(ss, lambda v: {s.any_of('v', LEX.examples)})[1] AS ex, array_to_string(list_filter(ss, lambda v, i: list_position(ss, v) = i)[1:2], ' ') AS two FROM r2),
r4 AS (SELECT *, nullif(coalesce(m, ss[1], selection), '') AS focus FROM r3)"""
_FT = "coalesce(focus, nullif(two, ''), '')"
LOCAL_SQL = f"""WITH {LOCAL} SELECT conv_id, turn, action, CASE action WHEN 'exam' THEN CASE WHEN selection <> '' THEN 'Spiega “' || selection || '” nel contesto del capitolo.' ELSE 'Spiega il concetto principale di questo passaggio.' END || chr(10) || chr(10) || 'Risposta modello: ' || {_FT}
WHEN 'example' THEN coalesce(ex, 'Nel brano non c’è un esempio esplicito separato. Il contesto utile è: ' || {_FT}) WHEN 'importance' THEN coalesce(nullif(two, ''), focus, nullif(selection, ''), '') WHEN 'meaning' THEN coalesce(nullif(m, ''), focus, nullif(two, ''), nullif(selection, ''), '')
WHEN 'custom' THEN 'Dal contesto disponibile: ' || coalesce(nullif(two, ''), focus, nullif(selection, ''), '') ELSE coalesce(focus, nullif(two, ''), nullif(selection, ''), '') END AS answer FROM r4"""


@query("local_answers", LOCAL_SQL)
def local_answers(spark, sf_dir):
    return answers.local_answers(requests(spark, sf_dir), LEX).select("conv_id", "turn", "action", "answer")


@query("request_keys", f"WITH {REQUESTS} SELECT conv_id, turn, sha256(action || '::' || selection || '::::::' || source_text || '::' || question) AS key FROM r1")
def request_keys(spark, sf_dir):
    return requests(spark, sf_dir).select("conv_id", "turn", answers.request_key().alias("key"))


_LABEL = """CASE action WHEN 'exam' THEN 'Domanda d’esame' WHEN 'remember' THEN 'Da ricordare' WHEN 'importance' THEN 'Perché conta nel capitolo' WHEN 'meaning' THEN 'Significato nel contesto' WHEN 'custom' THEN 'Risposta dal testo'
  WHEN 'example' THEN CASE WHEN ex IS NOT NULL THEN 'Esempio dal testo' ELSE 'Contesto dal testo' END ELSE 'Spiegazione dal testo' END"""
_KEY = "sha256(action || '::' || selection || '::::::' || source_text || '::' || question)"


@query("answer_cache", f"{LOCAL_SQL.replace('AS answer FROM r4', f'AS answer, {_KEY} AS key, {_LABEL} AS label, bool_or(conv_id % 2 = 0) OVER (PARTITION BY {_KEY}) AS cached FROM r4').replace('conv_id, turn, action, CASE', 'conv_id, turn, CASE', 1)}")
def answer_cache(spark, sf_dir):
    """Answers of all requests with a cache that holds those of even conversations."""
    now, asked = F.lit("2024-06-01 00:00:00").cast("timestamp"), requests(spark, sf_dir)
    _, cache = answers.answer_with_cache(asked.where("conv_id % 2 = 0"), spark.createDataFrame([], "key string, answer string, basis string, label string, saved_at timestamp"), now, LEX)
    found, _ = answers.answer_with_cache(asked, cache, now, LEX)
    return found.select("conv_id", "turn", "key", "answer", "label", "cached")


# of pages as they come here: no tables, a few character references; a block ends at its closing tag or the next block
_RAW = "list_filter(string_split(regexp_replace(coalesce(html, ''), '<(h[1-6]|p)(?:\\s[^>]*)?>', chr(30) || '\\1' || chr(31), 'g'), chr(30)), lambda b: regexp_matches(b, '^(h[1-6]|p)\\x1f'))"
_PLAIN = "regexp_replace(regexp_replace(regexp_extract(b, '(?s)^(?:h[1-6]|p)\\x1f(.*?)(?:</(?:h[1-6]|p)>|\\z)', 1), '(?s)<[^>]*>', '', 'g'), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')"
# the references that the tables hold
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": " ", "copy": "©", "middot": "·", "eacute": "é", "egrave": "è", "agrave": "à", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "mdash": "—", "ndash": "–", "hellip": "…", "laquo": "«", "raquo": "»", "rsquo": "’", "amp": "&"}
for _name, _letter in REFERENCES.items():
    _PLAIN = f"replace({_PLAIN}, '&{_name};', {s.q(_letter)})"
BLOCKS_SQL = f"""bl0 AS (SELECT page_id, list_filter(list_transform({_RAW}, lambda b: {{'h': regexp_extract(b, '^(h[1-6]|p)', 1), 't': trim({_PLAIN})}}), lambda x: x.t <> '') AS l FROM pages),
bl AS (SELECT page_id, unnest(l) AS x, unnest(range(len(l)))::INT AS block_seq FROM bl0)"""


@query("html_blocks", f"WITH {BLOCKS_SQL} SELECT page_id, block_seq, CASE WHEN x.h = 'p' THEN 'paragraph' ELSE 'heading' END AS block_type, CASE WHEN x.h <> 'p' THEN x.h[2]::INT END AS level, x.t AS text FROM bl")
def html_blocks(spark, sf_dir):
    return files.html_blocks(table(spark, sf_dir, "pages"))


_LAST = ", ".join(f"max(CASE WHEN level = {k} THEN block_seq END) OVER w AS p{k}, last(CASE WHEN level = {k} THEN text END IGNORE NULLS) OVER w AS t{k}" for k in range(2, 7))
_OPEN = ", ".join(f"CASE WHEN p{k} > greatest({', '.join(['reset'] + [f'coalesce(p{j}, -1)' for j in range(2, k)])}) THEN t{k} END" for k in range(2, 7))


@query(
    "block_chapters",
    f"""WITH {BLOCKS_SQL}, bc0 AS (SELECT page_id AS doc_id, block_seq, CASE WHEN x.h = 'p' THEN 'paragraph' ELSE 'heading' END AS block_type, CASE WHEN x.h <> 'p' THEN x.h[2]::INT END AS level, x.t AS text FROM bl),
bc1 AS (SELECT *, count(*) FILTER (level = 1) OVER w AS chapter_no, coalesce(last(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w, 'Documento') AS chapter_title, coalesce(max(CASE WHEN level = 1 THEN block_seq END) OVER w, -1) AS reset, {_LAST}
  FROM bc0 WINDOW w AS (PARTITION BY doc_id ORDER BY block_seq ROWS UNBOUNDED PRECEDING))
SELECT doc_id, block_seq, block_type, level, text, chapter_no, chapter_title, list_filter([{_OPEN}], lambda v: v IS NOT NULL) AS section_path FROM bc1""",
)
def block_chapters(spark, sf_dir):
    return structure.chapters_from_blocks(files.html_blocks(table(spark, sf_dir, "pages")).withColumnRenamed("page_id", "doc_id"))


@query("file_routes", "SELECT url AS path, CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' END AS format FROM pages")
def file_routes(spark, sf_dir):
    return files.route_by_format(table(spark, sf_dir, "pages").select(F.col("url").alias("path"))).drop("error")


SIGNATURE = "sha256('3::studio::' || coalesce(lang, '') || '::' || coalesce(source, '') || '::' || length(coalesce(text, '')) || '::' || substring(coalesce(text, ''), 1, 3500) || '::' || substring(coalesce(text, ''), greatest(length(coalesce(text, '')) - 3499, 1), 3500) || '::' || coalesce(source, '') || '|' || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda p: length(p)::VARCHAR), ',') || '||Fine|')"


@query("doc_signatures", f"SELECT doc_id, {SIGNATURE} AS signature FROM documents")
def doc_signatures(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", _signature().alias("signature"))


def _signature():
    """A document is a chapter named by its source, with a paragraph for each block, and an empty one; its language stands for the format."""
    chapter = lambda title, parts: F.struct(title.alias("title"), parts.alias("paragraphs"))
    chapters = F.array(chapter(F.col("source"), F.split(t.text(F.col("text")), "\n\n")), chapter(F.lit("Fine"), F.array().cast("array<string>")))
    return incremental.doc_signature("studio", shape=incremental.chapter_shape(chapters), format=F.col("lang"))


@query("resume_pending", f"SELECT doc_id, {SIGNATURE} AS signature FROM documents WHERE lang <> 'en'")
def resume_pending(spark, sf_dir):
    """What is left when all English documents are in the checkpoint."""
    all_ = doc_signatures(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "lang"), "doc_id").withColumn("para", F.col("doc_id"))
    done = all_.where("lang = 'en'").select("signature", "para", F.current_timestamp().alias("saved_at"))
    return incremental.resume(all_.drop("lang"), done)[1].select("doc_id", "signature")


_TREE = """a AS (SELECT doc_id, source AS book, (row_number() OVER w - 1) // 5 AS chapter, (row_number() OVER w - 1) % 5 AS para, coalesce(text, '') AS text FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
b AS (SELECT *, CASE WHEN doc_id % 97 = 0 THEN 'before ' || text ELSE text END AS old FROM a),
c AS (SELECT book, chapter, list(text ORDER BY para) AS now, list(old ORDER BY para) AS old FROM b GROUP BY ALL),
d AS (SELECT book, chapter FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.book = c.book AND o.old = c.now)),
e AS (SELECT b.* FROM b JOIN d USING (book, chapter) WHERE NOT EXISTS (SELECT 1 FROM b AS o WHERE o.book = b.book AND o.old = b.text))"""


def _trees(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as paragraphs, five a chapter, and as they were when a few were other texts."""
    d = numbered(docs(spark, sf_dir).select(F.col("source").alias("book"), "doc_id", t.text(F.col("text")).alias("text")), ["book"], "doc_id", "n")
    d = d.select("book", F.floor(F.col("n") / 5).alias("chapter"), (F.col("n") % 5).alias("para"), "doc_id", "text")
    before = d.withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("before "), "text")).otherwise(F.col("text")))
    return incremental.hash_tree(d), incremental.hash_tree(before)


@query("tree_pending", f"WITH {_TREE} SELECT book, chapter, para FROM e")
def tree_pending(spark, sf_dir):
    """Paragraphs to be done again."""
    return incremental.tree_changes(*_trees(spark, sf_dir))["paragraph"].select("book", "chapter", "para")


@query("tree_changes", f"WITH {_TREE} SELECT book, count(*) AS chapters FROM d GROUP BY book")
def tree_changes(spark, sf_dir):
    """Changed chapters by book."""
    return incremental.tree_changes(*_trees(spark, sf_dir))["chapter"].groupBy("book").agg(F.count("*").alias("chapters"))


@query("ttl_fresh", "SELECT event_id, user_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def ttl_fresh(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    return answers.fresh(e.join(F.broadcast(last)), F.col("now"), 14, "ts").select("event_id", "user_id", "ts")


@query("library_latest", "SELECT user_id AS id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def library_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", "value", F.struct("ts", "event_id").alias("updated_at"))
    return incremental.upsert_checkpoint(e, None, ("id",), "updated_at").drop("updated_at")


def _place(spark) -> str:
    """A new folder for a stream's state and rows."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # a pattern, since a stream's path may be a folder or a pattern but not a file
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    out = streams.dedupe_requests(_event_stream(spark, sf_dir).select("ts", "user_id", "event_type"), ["user_id", "event_type"])
    return streams.run_to_end(out, _place(spark)).select("user_id", "event_type").distinct()


# the first event of a key, then the first one 30 minutes or more after it, and so on
@query("stream_suppressed", """WITH RECURSIVE k AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL UNION ALL
SELECT k.user_id, k.event_type, (SELECT min(e.ts) FROM events e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 30 MINUTE) AS ts FROM k WHERE k.ts IS NOT NULL)
SELECT user_id, event_type, ts FROM k WHERE ts IS NOT NULL""")
def stream_suppressed(spark, sf_dir):
    with streams.keyed_state(spark):
        out = streams.suppressed(_event_stream(spark, sf_dir).select("ts", "user_id", "event_type"), ["user_id", "event_type"])
        rows = streams.run_to_end(out, _place(spark))
    return rows.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_progress", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_progress(spark, sf_dir):
    rows = streams.run_to_end(streams.progress(_event_stream(spark, sf_dir)), _place(spark), "update")
    return rows.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.max_by("n", "batch").alias("n"))


def _latest(spark, sf_dir, key: list[str], days: int) -> DataFrame:
    """The last state of each key: its latest entry, and whether that has expired."""
    with streams.keyed_state(spark):
        out = streams.latest_entries(_event_stream(spark, sf_dir).select("ts", "event_id", *key), key, lifetime_days=days)
        rows = streams.run_to_end(out, _place(spark))
    last = rows.groupBy(*key).agg(F.max(F.struct("batch", "expired", "ts", "event_id")).alias("e"))
    return last.select(*key, F.col("e.ts").cast("timestamp_ntz").alias("ts"), "e.event_id", "e.expired")


def _latest_sql(key: str, days: int) -> str:
    return f"SELECT {key}, max(ts) AS ts, arg_max(event_id, ts) AS event_id, max(ts) + INTERVAL {days} DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS expired FROM events GROUP BY ALL"


@query("stream_latest", _latest_sql("user_id", 30))
def stream_latest(spark, sf_dir):
    """Answers live for 30 days, as many as the events cover."""
    return _latest(spark, sf_dir, ["user_id"], 30)


@query("stream_expired", _latest_sql("user_id, event_type", 7))
def stream_expired(spark, sf_dir):
    return _latest(spark, sf_dir, ["user_id", "event_type"], 7)


@query("stream_enrich", f"""WITH a AS (SELECT *, {SIGNATURE} AS signature FROM documents)
SELECT doc_id AS id, signature, CASE WHEN doc_id % 4 = 0 THEN -1 ELSE length(coalesce(text, '')) END::BIGINT AS letters FROM a""")
def stream_enrich(spark, sf_dir):
    """Documents as a stream into a library that holds every fourth as it is now, every next one with another signature."""
    place, d = _place(spark), docs(spark, sf_dir)
    library = incremental.Library(spark, f"{place}/library", "id long, signature string, letters long, updated_at long", buckets=16)

    def sign(batch: DataFrame) -> DataFrame:
        return batch.withColumn("id", F.col("doc_id")).withColumn("signature", _signature())

    library.upsert(sign(d).where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, F.col("signature")).otherwise("old").alias("signature"), F.lit(-1).alias("letters"), F.lit(0).alias("updated_at")))
    enrich = lambda rows: rows.select("id", "signature", F.length(t.text(F.col("text"))).alias("letters"), F.lit(1).alias("updated_at"))
    streams.enrich_into_library(spark, f"{sf_dir}/documents.parquet*", d.schema, sign, enrich, library, f"{place}/state").awaitTermination()
    return library.rows().drop("updated_at")


_LETTERS = "length(regexp_replace(coalesce({x}, ''), '[^\\p{{L}}]', '', 'g'))"


@query("letter_budget", f"""WITH {summary_sql('studio')}, a AS (SELECT doc_id, {_LETTERS.format(x='text')} AS n, {_LETTERS.format(x='summary')} AS m FROM documents LEFT JOIN y USING (doc_id)),
b AS (SELECT doc_id, CASE WHEN n > 0 THEN round(100.0::DOUBLE - m * 100.0::DOUBLE / n, 3) ELSE 0.0 END::DOUBLE AS reduction FROM a)
SELECT doc_id, reduction, CASE WHEN reduction BETWEEN 60 AND 70 THEN 'in' WHEN reduction BETWEEN 55 AND 75 THEN 'near' ELSE 'out' END AS band FROM b""")
def letter_budget(spark, sf_dir):
    both = docs(spark, sf_dir).select("doc_id", "text", summary.summary_of(F.col("text"), "studio", LEX).alias("summary"))
    cut = budget.reduction(F.col("text"), F.col("summary"))
    return both.select("doc_id", cut.alias("reduction"), budget.band(cut).alias("band"))


_VIRTUAL = gathered(f"list_filter(string_split({s.norm('text')}, ' '), lambda w: w <> '')", "length(a.n) + 1 + length(x.n) > 60")


@query(
    "line_budget",
    f"""WITH u AS (SELECT source, doc_id, length(coalesce(text, '')) AS weight, len({_VIRTUAL})::INT AS virtual_lines FROM documents),
v AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, sum(weight) OVER (PARTITION BY source) AS w FROM u),
x AS (SELECT *, CASE WHEN w > 0 THEN greatest(0, 1000 - n) ELSE 0 END AS spare, CASE WHEN w > 0 THEN greatest(0, 1000 - n) * weight / w::DOUBLE ELSE 0.0::DOUBLE END AS part FROM v),
y AS (SELECT *, spare - sum(floor(part)) OVER (PARTITION BY source) AS open, row_number() OVER (PARTITION BY source ORDER BY round(part - floor(part), 9) DESC, doc_id) AS place FROM x)
SELECT source, doc_id, weight::INT AS weight, virtual_lines, (1 + floor(part) + CASE WHEN place <= open THEN 1 ELSE 0 END)::BIGINT AS lines FROM y""",
)
def line_budget(spark, sf_dir):
    units = docs(spark, sf_dir).select("source", "doc_id", F.length(t.text(F.col("text"))).alias("weight"), budget.virtual_lines(F.col("text")).alias("virtual_lines"))
    return budget.line_budget(units, ["source"], "doc_id", 1_000)


#: Paragraphs of a part of a book's text.
PART = 100


@query(
    "full_text",
    f"""WITH p AS (SELECT source AS book, doc_id, coalesce(text, '') AS text, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // {PART} AS part_no FROM documents)
SELECT book, part_no, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS full_text FROM p GROUP BY ALL""",
)
def full_text(spark, sf_dir):
    """A book's text in parts, joined by an empty line, so that a huge book is many rows."""
    each = docs(spark, sf_dir).select(F.col("source").alias("book"), "doc_id", t.text(F.col("text")).alias("text"))
    each = numbered(each, ["book"], "doc_id", "n").withColumn("part_no", F.floor(F.col("n") / PART))
    return sinks.full_text(each, ["book", "part_no"], "doc_id")


SHOWN = f"{s.norm("coalesce(nullif(trim(summary), ''), nullif(trim(accessible), ''), nullif(trim(text), ''), '')")}"
READ = f"""{RECORDS}, rv AS (SELECT *, {SHOWN} AS shown, CASE WHEN section IS NOT NULL AND section IS DISTINCT FROM lag(section) OVER w THEN section END AS fresh,
  CASE WHEN section IS NOT NULL AND section IS DISTINCT FROM last(section IGNORE NULLS) OVER b THEN section END AS heading FROM rec
  WINDOW w AS (PARTITION BY book, chapter ORDER BY para), b AS (PARTITION BY book, chapter ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("reading_view", f"""WITH {READ} SELECT book, chapter, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY para) FILTER (part <> ''), '') AS text
FROM (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN lower(fresh) <> lower(book) THEN fresh END, nullif(shown, '')) AS part FROM rv) GROUP BY book, chapter""")
def reading_view(spark, sf_dir):
    return sinks.reading_view(records(spark, sf_dir), BY, "para", "book")


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_FIRST_TERMS = "list_filter(g, lambda e, k: list_position(list_transform(g, lambda u: lower(u.term)), lower(e.term)) = k)"
_SIDE = f"list_transform({_FIRST_TERMS}[1:40], lambda e: '<div class=\"term-entry\"><strong>' || {_escaped('e.term')} || '</strong><span>' || {_escaped('e.definition')} || '</span></div>')"


@query(
    "chapter_html",
    f"""WITH {READ}, ch0 AS (SELECT *, {_escaped(marked('shown', 'list_transform(glossary, lambda e: e.term)', 'chr(2)', 'chr(3)'))} AS body FROM rv),
ch1 AS (SELECT book, chapter, string_agg('<section class="flow-block">' || coalesce('<h3>' || {_escaped('heading')} || '</h3>', '') || '<p>' || replace(replace(body, chr(2), '<strong class="technical-term">'), chr(3), '</strong>') || '</p></section>', '' ORDER BY para) AS parts,
  flatten(list(glossary ORDER BY para)) AS g FROM ch0 GROUP BY ALL)
SELECT book, chapter, '<section class="chapter"><header class="chapter-head"><small>CAPITOLO ' || (chapter + 1) || '</small><h2>' || {_escaped('book')} || '</h2></header><div class="chapter-layout"><div class="chapter-text">' || parts
  || '</div><aside class="terminology"><div class="terminology-title">TERMINOLOGIA</div>' || CASE WHEN len(g) > 0 THEN array_to_string({_SIDE}, '') ELSE '<div class="term-empty">Nessun termine specialistico da spiegare.</div>' END || '</aside></div></section>' AS html FROM ch1""",
)
def chapter_html(spark, sf_dir):
    return sinks.chapter_html(records(spark, sf_dir, "summary", "accessible", "original", "glossary").withColumn("number", F.col("chapter") + 1), BY, "para", "book", "number")


@query(
    "book_txt",
    f"""WITH {READ}, bt AS (SELECT book, chapter, upper(book) || chr(10) || chr(10) || string_agg(shown, chr(10) || chr(10) ORDER BY para) AS body, flatten(list(glossary ORDER BY para)) AS g FROM rv GROUP BY book, chapter)
SELECT book, chapter, body || CASE WHEN len(g) > 0 THEN chr(10) || chr(10) || 'TERMINOLOGIA' || chr(10) || array_to_string(list_transform({_FIRST_TERMS}, lambda e: '- ' || e.term || ': ' || e.definition), chr(10)) ELSE '' END AS text FROM bt""",
)
def book_txt(spark, sf_dir):
    return sinks.book_txt(records(spark, sf_dir), BY, "para", "book")
