"""Queries over documents: cleaning, sentences, words, summaries, fidelity; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.functions.lexicon import MIXED, levels
from folio.operators import cleaning, summary
from folio.plans import sql as s
from folio.plans.sql import q

LEX = MIXED


def spread(df: DataFrame, *key: str) -> DataFrame:
    """`df`, dealt out by key where its scan has fewer splits than there are cores (a small table in one row group)."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *key)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")


QUERIES, ORACLES = {}, {}


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = f
        if check:
            ORACLES[name] = check
        return f

    return add


@query("clean_documents", f"SELECT doc_id, {s.clean_text('text')} AS cleaned, {s.clean_block('text')} AS block, {s.norm('text')} AS normalized FROM documents")
def clean_documents(spark, sf_dir):
    c = F.col("text")
    return docs(spark, sf_dir).select("doc_id", t.clean_text(c).alias("cleaned"), t.clean_block(c).alias("block"), t.normalize(c).alias("normalized"))


SOLID = f"length(regexp_replace({s.clean_text('text')}, {q(t.SPACE)}, '', 'g'))"


@query("ocr_triage", f"SELECT doc_id, {SOLID}::INT AS solid, {SOLID} < 80 AS needs_ocr FROM documents")
def ocr_triage(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", cleaning.solid_chars(F.col("text")).alias("solid"), cleaning.needs_ocr(F.col("text")).alias("needs_ocr"))


RUNNING_KEY = s.norm("regexp_replace(lower({x}), '\\b[0-9]+\\b', '#', 'g')")
RUNNING = f"""
WITH p AS (SELECT source AS book, doc_id AS page, list_filter(list_transform(string_split({s.clean_text('text')}, chr(10)), lambda v: {s.trim_all('v')}), lambda v: v <> '') AS f FROM documents),
e AS (SELECT DISTINCT book, page, {RUNNING_KEY.replace('{x}', 'l')} AS line_key FROM (SELECT book, page, unnest(f[1:2] || f[greatest(len(f) - 1, 1):]) AS l FROM p)),
n AS (SELECT source AS book, count(*) AS n_book FROM documents GROUP BY ALL),
k AS (SELECT book, line_key, count(*) AS n_pages, any_value(n_book) AS n_book FROM e JOIN n USING (book) WHERE length(line_key) BETWEEN 1 AND 100 GROUP BY ALL),
r AS (SELECT book, line_key, n_pages FROM k WHERE n_book >= 3 AND n_pages >= greatest(3, ceil(n_book * CAST(0.1 AS DOUBLE))) AND (length(line_key) >= 3 OR line_key = '#'))"""


@query("running_lines", f"{RUNNING} SELECT book, line_key, n_pages FROM r")
def running_lines(spark, sf_dir):
    return cleaning.detect_running_lines(by_source(spark, sf_dir), ratio=0.1)


@query("running_line_report", f"{RUNNING} SELECT book, list_sort(list(line_key)) AS removed_lines FROM r WHERE line_key <> '#' GROUP BY book")
def running_line_report(spark, sf_dir):
    return cleaning.removed_report(cleaning.detect_running_lines(by_source(spark, sf_dir), ratio=0.1))


STRIPPED = f"""{RUNNING},
a AS (SELECT source AS book, doc_id AS page, string_split({s.clean_text('text')}, chr(10)) AS l FROM documents),
b AS (SELECT book, page, len(l) - 1 AS last, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM a),
c AS (SELECT b.*, n_book >= 3 AND (line_no <= 1 OR line_no >= last - 1) AND (r.line_key IS NOT NULL OR regexp_matches({s.trim_all('line')}, {q(t.PAGE_NUMBER)})) AS gone
  FROM b JOIN n USING (book) LEFT JOIN r ON r.book = b.book AND r.line_key = {RUNNING_KEY.replace('{x}', 'line')}),
d AS (SELECT book, page, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS t, count(*) FILTER (gone) AS removed FROM c GROUP BY ALL)
SELECT book, page, {s.clean_text('t')} AS text, removed FROM d"""


@query("strip_running_lines", STRIPPED)
def strip_running_lines(spark, sf_dir):
    pages = by_source(spark, sf_dir)
    return cleaning.strip_running_lines(pages, cleaning.detect_running_lines(pages, ratio=0.1))


SENTENCES = f"s AS (SELECT doc_id, unnest({s.sentences('text')}) AS sentence, unnest(range(len({s.sentences('text')})))::INT AS idx, len({s.sentences('text')}) AS n_sentences FROM documents)"
WORDS = f"w AS (SELECT doc_id, idx, unnest({s.raw_words('sentence')}) AS word FROM s)"


@query("sentences", f"WITH {SENTENCES} SELECT doc_id, idx, sentence FROM s")
def sentences(spark, sf_dir):
    return summary.sentence_table(docs(spark, sf_dir))


@query("study_sentences", f"SELECT doc_id, unnest({s.sentences('text', 18)}) AS sentence, unnest(range(len({s.sentences('text', 18)})))::INT AS idx FROM documents")
def study_sentences(spark, sf_dir):
    return summary.sentence_table(docs(spark, sf_dir), least=18)


FREQ = f"""a AS (SELECT doc_id, unnest({s.raw_words('text')}) AS word, unnest(range(len({s.raw_words('text')})))::INT AS pos FROM documents),
f AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM a WHERE length(word) > 2 AND NOT ({s.in_list('word', LEX.stop)}) GROUP BY ALL)"""
KEYWORDS = f"{FREQ}, k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(word) DESC, first_pos)::INT AS rank, word, n FROM f QUALIFY rank <= 8)"


@query("word_freq", f"WITH {FREQ} SELECT doc_id, word, n, first_pos FROM f")
def word_freq(spark, sf_dir):
    return summary.word_freq(docs(spark, sf_dir), LEX)


@query("top_keywords", f"WITH {KEYWORDS} SELECT doc_id, rank, word, n FROM k")
def top_keywords(spark, sf_dir):
    return summary.top_keywords(docs(spark, sf_dir), LEX)


SCORED = f"""{SENTENCES}, {WORDS},
v AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word) AS freq FROM w WHERE length(word) > 2 AND NOT ({s.in_list('word', LEX.stop)})),
m AS (SELECT doc_id, idx, avg(freq) AS content FROM v GROUP BY ALL),
c AS (SELECT s.doc_id, s.idx, sentence, n_sentences, CASE WHEN content IS NULL THEN 0.0 ELSE round(content
  + CASE WHEN {s.any_of('sentence', LEX.defines)} THEN 1.8::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(sentence, {q(summary.DATA_NUMBER)}) OR {s.any_of('sentence', LEX.data)} THEN 1.4::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(sentence, {q(summary.LIST_MARK.replace('{words}', '|'.join(LEX.lists)))}) THEN 0.8::DOUBLE ELSE 0 END
  + CASE WHEN s.idx = 0 THEN 1.1::DOUBLE WHEN s.idx < ceil(n_sentences * 0.25::DOUBLE) THEN 0.45::DOUBLE ELSE 0 END, 6) END::DOUBLE AS score
  FROM s LEFT JOIN m USING (doc_id, idx))"""


def summary_sql(level: str) -> str:
    """Common tables up to y(doc_id, n_sentences, n_kept, summary)."""
    ratio, least, most, _ = levels()[level]
    return f"""{SCORED},
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM c),
y AS (SELECT doc_id, any_value(n_sentences) AS n_sentences, count(*) AS n_kept, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM x
  WHERE rank <= least({most}, greatest({least}, ceil(n_sentences * {ratio}::DOUBLE))) OR n_sentences <= {least} GROUP BY doc_id)"""


@query("sentence_scores", f"WITH {SCORED} SELECT doc_id, idx, sentence, n_sentences, score FROM c")
def sentence_scores(spark, sf_dir):
    return summary.score_sentences(docs(spark, sf_dir), LEX)


for _level in levels():
    query(f"extractive_summary_{_level}", f"WITH {summary_sql(_level)} SELECT doc_id, n_sentences, n_kept, summary FROM y")(
        lambda spark, sf_dir, level=_level: summary.extract_summary(docs(spark, sf_dir), level, LEX)
    )


@query("key_points", f"WITH {summary_sql('studio')} SELECT doc_id, {s.sentences('summary')}[1:5] AS key_points FROM y")
def key_points(spark, sf_dir):
    return summary.extract_summary(docs(spark, sf_dir), "studio", LEX).select("doc_id", summary.key_points(F.col("summary")).alias("key_points"))


@query("accessible_text", f"SELECT doc_id, {s.accessible('text', LEX.connectives)} AS accessible FROM documents")
def accessible_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.accessible(F.col("text"), LEX.connectives).alias("accessible"))


CUED = f"list_filter({s.sentences('text')}, lambda v: regexp_matches(v, {q(summary.DATA_NUMBER)}) OR {s.any_of('v', LEX.remember)})"
REMEMBER = f"CASE WHEN len({CUED}) > 0 THEN {CUED}[1:4] ELSE list_transform(coalesce(keywords, [])[1:4], lambda k: 'Concetto chiave: ' || k) END"
LISTED = "z AS (SELECT doc_id, list(word ORDER BY rank) AS keywords FROM k GROUP BY doc_id)"


@query("remember_items", f"WITH {KEYWORDS}, {LISTED} SELECT d.doc_id, {REMEMBER} AS remember FROM documents d LEFT JOIN z USING (doc_id)")
def remember_items(spark, sf_dir):
    words = F.transform(summary.keywords(F.col("text"), LEX), lambda w: w["word"])
    return docs(spark, sf_dir).select("doc_id", summary.remember_items(t.sentences(F.col("text")), words, LEX).alias("remember"))


@query("anchors", f"SELECT doc_id, {s.anchors('text')} AS anchors FROM documents")
def anchors(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.anchors(F.col("text")).alias("anchors"))


MISSING = f"list_filter({s.anchors('text')}, lambda a: NOT contains(lower({s.norm('summary')} || ' ' || {s.accessible('summary', LEX.connectives)}), lower(a)))"
FOUND = "list_filter(list_transform(missing, lambda a: list_filter(sents, lambda v: contains(lower(v), lower(a)))[1]), lambda v: v IS NOT NULL)"
FIDELITY = f"""{summary_sql('studio')},
g AS (SELECT doc_id, text, coalesce(summary, '') AS summary, {MISSING} AS missing, {s.sentences('text')} AS sents FROM documents LEFT JOIN y USING (doc_id)),
h AS (SELECT *, {FOUND} AS hits FROM g),
r AS (SELECT *, list_filter(hits, lambda v, i: list_position(hits, v) = i)[1:5] AS found FROM h)"""


@query("missing_anchors", f"WITH {FIDELITY} SELECT doc_id, missing FROM r")
def missing_anchors(spark, sf_dir):
    found = docs(spark, sf_dir).select("doc_id", "text", summary.summary_of(F.col("text"), "studio", LEX).alias("summary"))
    spoken = t.accessible(F.col("summary"), LEX.connectives)
    return found.select("doc_id", summary.missing_anchors(F.col("text"), t.text(F.col("summary")), spoken).alias("missing"))


@query(
    "fidelity_repair",
    f"""WITH {FIDELITY} SELECT doc_id, CASE WHEN len(found) > 0 THEN {s.norm("summary || ' ' || array_to_string(found, ' ')")} ELSE summary END AS summary, len(found)::INT AS fidelity_recovered FROM r""",
)
def fidelity_repair(spark, sf_dir):
    return summary.summarize_local(docs(spark, sf_dir), "studio", LEX).select("doc_id", "summary", "fidelity_recovered")
