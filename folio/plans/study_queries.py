"""Queries over study records: glossary, audit, artefacts; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators import artefacts, audit, glossary, summary
from folio.operators.places import numbered, written
from folio.plans import sql as s
from folio.plans.sql import q
from folio.plans.text_queries import FIDELITY, KEYWORDS, LEX, LISTED, REMEMBER, docs, summary_sql

QUERIES, ORACLES = {}, {}
BY = ["book", "chapter"]


def query(name: str, check: str | None = None):
    def add(f):
        QUERIES[name] = f
        if check:
            ORACLES[name] = check
        return f

    return add


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as paragraphs: a source is a book, five of its documents in order of doc_id are a chapter; every second one has a section."""
    d = numbered(docs(spark, sf_dir).select("doc_id", F.col("source").alias("book")), ["book"], "doc_id", "n")
    section = F.when(F.col("n") % 2 == 1, F.format_string("%d.1 Sezione", F.floor(F.col("n") / 5) + 1))
    return d.select("doc_id", "book", F.floor(F.col("n") / 5).cast("int").alias("chapter"), (F.col("n") % 5).cast("int").alias("para"), section.alias("section"))


def records(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Study records of all documents, placed in chapters; with names only these columns of theirs are made and moved, `points` being the first three."""
    made = summary.local_records(docs(spark, sf_dir), "studio", LEX, rules=glossary.MIXED, keywords=not names or not {"keywords", "remember", "points"}.isdisjoint(names)).withColumn("original", F.col("text"))
    if "points" in names:
        made = made.withColumn("points", artefacts.points(3))
    given = ["doc_id", *[c for c in ("text", "original") if c in names or not names]]
    made = summary.once(made.select(*given, *[c for c in names or made.columns if c not in given]), given)
    return made.join(placed(spark, sf_dir), "doc_id")


RULES = glossary.MIXED


def _entries(x: str) -> str:
    v = "trim(regexp_replace(v, '[.!?]+$', ''))"
    case = "CASE"
    for p in RULES.patterns():
        raw = s.norm(f"regexp_extract({v}, {q(p)}, 2)")
        term = f"substring(regexp_replace({s.norm(f'regexp_extract({v}, {q(p)}, 1)')}, {q(RULES.article())}, ''), 1, 90)"
        inline = f"len(list_filter(string_split({raw}, ' '), lambda w: w <> '')) <= 6 AND length({raw}) <= 72"
        case += f" WHEN regexp_matches({v}, {q(p)}) THEN {{'term': {term}, 'definition': substring(regexp_replace({raw}, '[.;:]$', ''), 1, 240), 'placement': CASE WHEN {inline} THEN 'inline' ELSE 'side' END, 'basis': 'source'}}"
    found = f"list_filter(list_transform({s.sentences(x)}, lambda v: {case} END), lambda e: e IS NOT NULL AND e.term <> '' AND e.definition <> '')[1:6]"
    there = f"list_filter({found}, lambda e: contains(lower({s.norm(x)}), lower(e.term)))"
    return there


GLOSSARY = f"""rn AS (SELECT doc_id, source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n, text FROM documents),
r0 AS (SELECT doc_id, book, (n // 5)::INT AS chapter, (n % 5)::INT AS para, CASE WHEN n % 2 = 1 THEN printf('%d.1 Sezione', n // 5 + 1) END AS section, text, {_entries('text')} AS e0 FROM rn),
r1 AS (SELECT doc_id, book, chapter, para, section, list_filter(e0, lambda e, i: list_position(list_transform(e0, lambda u: lower(u.term)), lower(e.term)) = i)[1:6] AS glossary FROM r0),
r2 AS (SELECT book, chapter, para, unnest(glossary) AS e, unnest(range(len(glossary))) AS pos FROM r1),
r3 AS (SELECT book, chapter, para, pos, e.term AS term, e.definition AS definition, row_number() OVER (PARTITION BY book, chapter, lower(e.term) ORDER BY para, pos) AS k FROM r2),
gl AS (SELECT book, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY para, pos)::INT AS place, term, definition, para FROM r3 WHERE k = 1)"""


@query("glossary", f"WITH {GLOSSARY} SELECT doc_id, pos::INT AS pos, e.term AS term, e.definition AS definition, e.placement AS placement FROM (SELECT doc_id, unnest(glossary) AS e, unnest(range(len(glossary))) AS pos FROM r1)")
def glossary_entries(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(glossary.mine_glossary(F.col("text"), RULES)).alias("pos", "e"))
    return d.select("doc_id", "pos", "e.term", "e.definition", "e.placement")


def mined(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text", glossary.mine_glossary(F.col("text"), RULES).alias("glossary"))
    return d.join(placed(spark, sf_dir), "doc_id")


@query("chapter_glossary", f"WITH {GLOSSARY} SELECT book, chapter, place, term, definition, para FROM gl WHERE place <= 40")
def chapter_glossary(spark, sf_dir):
    return glossary.chapter_glossary(mined(spark, sf_dir), BY, "para", 40)


def apart(x: str) -> str:
    """The text with a mark on both sides of all but letters and digits, so that a pattern without look-around finds neighbours too."""
    return f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}])', chr(1) || '\\1' || chr(1), 'g')"


def quoted(x: str) -> str:
    """A pattern of a term's own characters, as they stand in an `apart` text."""
    return f"regexp_replace({apart(x)}, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g')"


def marked(x: str, terms: str, before: str, after: str) -> str:
    """As glossary.mark_terms; `before` and `after` are SQL."""
    alternation = f"array_to_string(list_transform(list_sort(list_transform({terms}, lambda v: {{'n': -length(v), 'v': v}})), lambda v: {quoted('v.v')}), '|')"
    found = f"regexp_replace({apart(x)}, '(?i)(^|\\x01)(' || {alternation} || ')(\\x01|$)', '\\1' || {before} || '\\2' || {after} || '\\3', 'g')"
    return f"CASE WHEN len({terms}) > 0 THEN replace({found}, chr(1), '') ELSE {x} END"


_TERMS = "list_transform(glossary, lambda e: e.term)"


@query("term_highlight", f"""WITH {GLOSSARY}, hl AS (SELECT r1.book, r1.chapter, r1.para, {marked("coalesce(r0.text, '')", _TERMS, "'**'", "'**'")} AS marked, {marked("coalesce(r0.text, '')", _TERMS, 'chr(2)', 'chr(3)')} AS m FROM r1 JOIN r0 USING (doc_id))
SELECT book, chapter, para, marked, (length(m) - length(replace(m, chr(2), '')))::INT AS n_spans FROM hl""")
def term_highlight(spark, sf_dir):
    terms, text = F.transform("glossary", lambda e: e["term"]), t.text(F.col("text"))
    found = mined(spark, sf_dir).select(*BY, "para", glossary.marked_spans(text, terms).alias("found"))
    return found.select(*BY, "para", "found.marked", F.col("found.n").alias("n_spans"))


_INSERT = f"CASE WHEN contains(lower(a.t), lower(x.term || ' (' || x.definition)) THEN a.t ELSE replace(regexp_replace({apart('a.t')}, '(?i)(^|\\x01)(' || {quoted('x.term')} || ')(\\x01|$)', '\\1\\2 (' || replace(x.definition, '\\', '\\\\') || ')\\3'), chr(1), '') END"


@query("inline_glossary", f"""WITH {GLOSSARY} SELECT r1.book, r1.chapter, r1.para, list_reduce([{{'t': coalesce(r0.text, ''), 'term': '', 'definition': ''}}] || list_transform(list_filter(glossary, lambda e: e.placement = 'inline'), lambda e: {{'t': '', 'term': e.term, 'definition': e.definition}}),
  lambda a, x: {{'t': {_INSERT}, 'term': '', 'definition': ''}}).t AS inlined FROM r1 JOIN r0 USING (doc_id)""")
def inline_glossary(spark, sf_dir):
    return mined(spark, sf_dir).select(*BY, "para", glossary.inline_glossary(F.col("text"), F.col("glossary")).alias("inlined"))


#: Terms that hold what patterns and replacements take for something else.
SYMBOLS = ("f(x", "C++", "a.b", "$1", "\\n", "[x]", "a|b", "")
SYMBOL_TEXT = "Il C++ e f(x) sono a.b, axb, C+, xC++ e C++x; $1 vale \\n o [x] (a|b). "
_SYMBOLED = f"sy AS (SELECT doc_id, {q(SYMBOL_TEXT)} || coalesce(text, '') AS text, [{', '.join(map(q, SYMBOLS[:-1]))}] || list_filter([regexp_extract(coalesce(text, ''), '([\\p{{L}}]{{5,}})', 1)], lambda v: v <> '') AS terms FROM documents)"


def symboled(spark, sf_dir) -> DataFrame:
    """Documents after a sentence of symbols, with these and their first long word as terms."""
    text = F.concat(F.lit(SYMBOL_TEXT), t.text(F.col("text")))
    first = F.regexp_extract(t.text(F.col("text")), r"([\p{L}]{5,})", 1)
    return docs(spark, sf_dir).select("doc_id", text.alias("text"), F.array(*map(F.lit, SYMBOLS), first).alias("terms"))


@query("symbol_terms", f"WITH {_SYMBOLED} SELECT doc_id, {marked('text', 'terms', "'**'", "'**'")} AS marked FROM sy")
def symbol_terms(spark, sf_dir):
    return symboled(spark, sf_dir).select("doc_id", glossary.mark_terms(F.col("text"), F.col("terms")).alias("marked"))


@query("symbol_glossary", f"""WITH {_SYMBOLED} SELECT doc_id, list_reduce([{{'t': text, 'term': '', 'definition': ''}}] || list_transform(terms, lambda v: {{'t': '', 'term': v, 'definition': 'vale $1 o \\2'}}), lambda a, x: {{'t': {_INSERT}, 'term': '', 'definition': ''}}).t AS inlined FROM sy""")
def symbol_glossary(spark, sf_dir):
    entries = F.transform("terms", lambda v: F.struct(v.alias("term"), F.lit("vale $1 o \\2").alias("definition"), F.lit("inline").alias("placement")))
    return symboled(spark, sf_dir).select("doc_id", glossary.inline_glossary(F.col("text"), entries).alias("inlined"))


CUES = " OR ".join(f"regexp_matches(v, {q(p)})" for p in audit.cue_patterns(LEX))
IMPORTANT = f"list_filter({s.sentences('text')}, lambda v: length(v) BETWEEN 22 AND 420 AND ({CUES}))"


@query("important_sentences", f"SELECT doc_id, unnest(i) AS sentence, unnest(range(len(i)))::INT AS idx FROM (SELECT doc_id, {IMPORTANT} AS i FROM documents)")
def important_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(audit.important_sentences(F.col("text"), LEX)).alias("idx", "sentence"))


def _content(x: str) -> str:
    return f"list_filter({s.raw_words(x)}, lambda w: length(w) > 2 AND NOT ({s.in_list('w', LEX.audit_stop)}))"


COVERAGE = f"""{summary_sql('studio')},
i0 AS (SELECT doc_id, unnest({IMPORTANT}) AS sentence, unnest(range(len({IMPORTANT})))::INT AS idx FROM documents),
i1 AS (SELECT i0.*, coalesce(summary, '') AS summary, list_distinct({_content('sentence')}) AS w, list_distinct({_content("coalesce(summary, '')")}) AS gw FROM i0 LEFT JOIN y USING (doc_id)),
i2 AS (SELECT *, CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_intersect(w, gw)) / len(w)::DOUBLE END AS share FROM i1)"""


@query(
    "coverage",
    f"""WITH {COVERAGE} SELECT doc_id, idx, round(share, 6) AS coverage, contains(lower({s.norm('summary')}), lower(sentence)) OR share >= CASE WHEN len(w) <= 3 THEN 0.67::DOUBLE WHEN len(w) <= 6 THEN 0.55::DOUBLE ELSE 0.48::DOUBLE END AS covered FROM i2""",
)
def coverage(spark, sf_dir):
    # a document's generated words are split once, before its sentences are taken apart
    both = docs(spark, sf_dir).select("doc_id", audit.important_sentences(F.col("text"), LEX).alias("found"), summary.summary_of(F.col("text"), "studio", LEX).alias("summary"))
    both = both.select("doc_id", "found", F.lower(t.normalize(F.col("summary"))).alias("low"), F.array_distinct(t.content_words(F.col("summary"), LEX.audit_stop)).alias("known"))
    judged = F.transform("found", lambda v: t.let(t.content_words(v, LEX.audit_stop), lambda w: F.struct(F.round(audit.coverage_of(w, F.col("known")), 6).alias("coverage"), audit.covered_by(v, w, F.col("low"), F.col("known")).alias("covered"))))
    return both.select("doc_id", F.posexplode(judged).alias("idx", "x")).select("doc_id", "idx", "x.*")


# study records in SQL
_ACC = s.accessible("r.summary", LEX.connectives)
RECORDS = f"""{FIDELITY}, {KEYWORDS.replace('k AS', 'kw AS')}, {LISTED.replace('FROM k ', 'FROM kw ')}, {GLOSSARY},
t0 AS (SELECT r.doc_id, r1.book, r1.chapter, r1.para, r1.section, r.text, CASE WHEN len(found) > 0 THEN {s.norm("r.summary || ' ' || array_to_string(found, ' ')")} ELSE r.summary END AS summary, found, coalesce(keywords, []) AS keywords,
  CASE WHEN len(found) > 0 THEN array_to_string(list_filter([{_ACC}] || list_transform(found, lambda f: {s.accessible('f', LEX.connectives)}), lambda v: v <> ''), chr(10) || chr(10)) ELSE {_ACC} END AS accessible,
  {s.sentences('r.summary')}[1:5] AS kp, {REMEMBER.replace('text', 'r.text')} AS rm, r1.glossary FROM r JOIN r1 USING (doc_id) LEFT JOIN z USING (doc_id)),
t1 AS (SELECT * EXCLUDE (kp, rm), CASE WHEN len(found) > 0 THEN {s.unique_ci('kp || found', 8)} ELSE kp END AS kp, CASE WHEN len(found) > 0 THEN {s.unique_ci('rm || found', 5)} ELSE rm END AS rm FROM t0),
t2 AS (SELECT *, list_filter(rm || kp || {s.sentences("CASE WHEN summary <> '' THEN summary ELSE text END", 18)}, lambda v: length({s.norm('v')}) >= 18) AS every FROM t1),
rec AS (SELECT *, {s.unique_ci('every', 3)} AS p, CASE WHEN section IS NOT NULL THEN 'la sezione “' || section || '”' ELSE 'il passaggio ' || (para + 1) END AS label FROM t2)"""

# the audit's fold in SQL; the state and the sentences have one type
_COVERED = "contains(a.t, lower(x.s)) OR CASE WHEN len(list_distinct(x.w)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct(x.w), a.g)) / len(list_distinct(x.w))::DOUBLE END >= CASE WHEN len(list_distinct(x.w)) <= 3 THEN 0.67::DOUBLE WHEN len(list_distinct(x.w)) <= 6 THEN 0.55::DOUBLE ELSE 0.48::DOUBLE END"


def _state(**new: str) -> str:
    kept = {k: new.get(k, f"a.{k}") for k in ("t", "g", "b", "r", "c")}
    return "{'s': '', 'w': []::VARCHAR[], " + ", ".join(f"'{k}': {v}" for k, v in kept.items()) + "}"


def _fold(cap: str) -> str:
    first = _state(t="low", g="known", b="0", r="[]::VARCHAR[]", c="0")
    each = "list_transform(important, lambda v: {'s': v.s, 'w': v.w, 't': '', 'g': []::VARCHAR[], 'b': 0, 'r': []::VARCHAR[], 'c': 0})"
    step = f"CASE WHEN {_COVERED} THEN {_state(b='a.b + 1')} WHEN len(a.r) >= {cap} THEN {_state(c='a.c + 1')} ELSE {_state(t=chr(97) + '.t || chr(32) || lower(x.s)', g='a.g || x.w', r='list_append(a.r, x.s)')} END"
    return f"list_reduce([{first}] || {each}, lambda a, x: {step})"


_SEARCH = "concat_ws(' ', summary, accessible, array_to_string(kp || rm || keywords, ' '))"
AUDITED = f"""{RECORDS},
a0 AS (SELECT *, {_SEARCH} AS search, list_transform({IMPORTANT}, lambda s: {{'s': s, 'w': {_content('s')}}}) AS important FROM t1),
a1 AS (SELECT *, lower({s.norm('search')}) AS low, {_content('search')} AS known FROM a0),
a2 AS (SELECT *, len(({_fold('2')}).r) AS alone FROM a1),
a3 AS (SELECT *, least(2, greatest(0, 8 - coalesce(sum(alone) OVER (PARTITION BY book, chapter ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INT AS cap FROM a2),
a4 AS (SELECT *, {_fold('cap')} AS f FROM a3),
ca AS (SELECT book, chapter, sum(len(important))::BIGINT AS important, sum(f.b)::BIGINT AS covered_before, sum(len(f.r))::BIGINT AS recovered, sum(f.c)::BIGINT AS capped FROM a4 GROUP BY ALL),
cb AS (SELECT *, CASE WHEN important > 0 THEN round(covered_before / important::DOUBLE, 6) ELSE 1.0::DOUBLE END AS coverage_before, CASE WHEN important > 0 THEN round(least(important, covered_before + recovered) / important::DOUBLE, 6) ELSE 1.0::DOUBLE END AS coverage_after FROM ca)"""


def _first(x: str, most: int) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)[1:{most}]"


def audited(spark, sf_dir):
    return audit.audit_paragraphs(records(spark, sf_dir), BY, "para", "text", LEX)


@query("chapter_audit", f"WITH {AUDITED} SELECT * FROM cb")
def chapter_audit(spark, sf_dir):
    return audit.audit_chapters(audited(spark, sf_dir), BY)


@query(
    "audit_recovery",
    f"""WITH {AUDITED} SELECT book, chapter, para, CASE WHEN len(f.r) > 0 THEN {s.norm("summary || ' ' || array_to_string(f.r, ' ')")} ELSE summary END AS summary,
  CASE WHEN len(f.r) > 0 THEN array_to_string(list_filter([accessible] || f.r, lambda v: v <> ''), chr(10) || chr(10)) ELSE accessible END AS accessible, CASE WHEN len(f.r) > 0 THEN {_first('(kp || f.r)', 10)} ELSE kp END AS key_points,
  CASE WHEN len(f.r) > 0 THEN {_first('(rm || f.r)', 6)} ELSE rm END AS remember, len(f.r)::INT AS recovered FROM a4""",
)
def audit_recovery(spark, sf_dir):
    return audit.append_recovery(audited(spark, sf_dir)).select(*BY, "para", "summary", "accessible", "key_points", "remember", F.size("recovered").alias("recovered"))


@query(
    "audit_rollup",
    f"""WITH {AUDITED} SELECT book, count(*) AS chapters, count(*) FILTER (recovered > 0) AS chapters_with_recovery, sum(important)::BIGINT AS important, sum(recovered)::BIGINT AS recovered, sum(capped)::BIGINT AS capped,
  round(avg(coverage_before), 6) AS coverage_before, round(avg(coverage_after), 6) AS coverage_after FROM cb GROUP BY book""",
)
def audit_rollup(spark, sf_dir):
    return audit.audit_rollup(chapter_audit(spark, sf_dir), ["book"])


@query("local_study_records", f"WITH {RECORDS} SELECT doc_id, summary, accessible, kp AS key_points, rm AS remember, keywords, 'locale' AS engine, len(found)::INT AS fidelity_recovered FROM t1")
def local_study_records(spark, sf_dir):
    return summary.summarize_local(docs(spark, sf_dir), "studio", LEX).drop("text")


@query(
    "flashcards",
    f"""WITH {RECORDS}, cc AS (SELECT book, chapter, 'term' AS kind, 'Che cosa significa “' || term || '”?' AS front, definition AS back, para, 0 AS k, place AS f, place AS pos FROM gl
UNION ALL SELECT book, chapter, 'point', CASE WHEN pos = 0 THEN 'Qual è il concetto principale di ' ELSE 'Quale altro elemento importante va ricordato di ' END || label || '?', back, para, 1, para, pos
  FROM (SELECT book, chapter, para, label, unnest(p) AS back, unnest(range(len(p))) AS pos FROM rec))
SELECT book, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY k, f, pos)::INT AS card_no, kind, front, back, para FROM cc QUALIFY card_no <= 36""",
)
def flashcards(spark, sf_dir):
    return artefacts.flashcards(records(spark, sf_dir, "points", "glossary"), BY, "para")


def _turned(x: str, by: str) -> str:
    return f"list_concat(({x})[(({by}) % len({x})) + 1:], ({x})[1:({by}) % len({x})])"


# rings: lists of a chapter's terms or points, each entry followed by the others in order
_AFTER = "e[spot + 2:] || e[1:spot]"
_WRONG = f"list_filter({s.unique_ci(f'list_transform({_AFTER}, lambda v: v.definition)', 1_000)}, lambda v: lower(v) <> lower(e[spot + 1].definition))[1:3]"
QUIZ_TERMS = f"""qa AS (SELECT book, chapter, list({{'term': term, 'definition': definition, 'para': para}} ORDER BY place) AS e FROM gl GROUP BY ALL HAVING count(*) >= 3),
qb AS (SELECT *, unnest(range(least(len(e), 18))) AS spot FROM qa),
qc AS (SELECT *, {_WRONG} AS wrong FROM qb),
qd AS (SELECT book, chapter, spot, 'Quale definizione corrisponde a “' || e[spot + 1].term || '”?' AS question, (list_append([]::VARCHAR[], e[spot + 1].definition) || wrong)[1:4] AS o, spot + length(e[spot + 1].term) AS turn, e[spot + 1].definition AS explanation, e[spot + 1].para AS para FROM qc WHERE len(wrong) >= 2),
qt AS (SELECT book, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY spot)::INT AS question_no, question, {_turned('o', 'turn')} AS options, explanation, para FROM qd)"""
_STEP = "CASE WHEN len(a) >= 4 THEN a ELSE a || list_filter(x, lambda v: NOT list_contains(list_transform(a, lambda u: lower(u)), lower(v)))[1:1] END"
QUIZ_POINTS = f"""pa AS (SELECT book, chapter, list({{'label': label, 'p': p, 'para': para}} ORDER BY para) AS e FROM rec WHERE len(p) > 0 GROUP BY ALL),
pb AS (SELECT *, unnest(range(least(len(e), 18))) AS spot FROM pa),
pc AS (SELECT *, list_reduce(list_append([]::VARCHAR[][], [e[spot + 1].p[1]]) || list_transform({_AFTER}, lambda v: v.p), lambda a, x: {_STEP}) AS o FROM pb),
pt AS (SELECT book, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY spot)::INT AS question_no, 'Quale affermazione appartiene a ' || e[spot + 1].label || '?' AS question, {_turned('o', 'spot + 1')} AS options, e[spot + 1].p[1] AS explanation, e[spot + 1].para AS para FROM pc WHERE len(o) >= 3)"""
_QUESTION = "SELECT book, chapter, question_no, question, options, (list_position(options, explanation) - 1)::INT AS correct_index, explanation, para"
QUIZ = f"{RECORDS}, {QUIZ_TERMS}, {QUIZ_POINTS}, qq AS (SELECT 0 AS k, * FROM qt UNION ALL SELECT 1, * FROM pt), qz AS (SELECT * REPLACE (row_number() OVER (PARTITION BY book, chapter ORDER BY k, question_no)::INT AS question_no) FROM qq), quizzes AS ({_QUESTION} FROM qz WHERE question_no <= 18)"


@query("quiz_glossary", f"WITH {GLOSSARY}, {QUIZ_TERMS} {_QUESTION} FROM qt")
def quiz_glossary(spark, sf_dir):
    return artefacts.quiz_glossary(mined(spark, sf_dir), BY, "para")


@query("quiz_points", f"WITH {RECORDS}, {QUIZ_POINTS} {_QUESTION} FROM pt")
def quiz_points(spark, sf_dir):
    return artefacts.quiz_points(records(spark, sf_dir, "points"), BY, "para")


@query("quiz", f"WITH {QUIZ} SELECT * FROM quizzes")
def quiz(spark, sf_dir):
    return artefacts.quiz(written(records(spark, sf_dir, "points", "glossary")), BY, "para")


@query("quiz_scores", f"WITH {QUIZ} SELECT book, chapter, count(*) AS answered, count(*) FILTER (correct_index = 0) AS correct FROM quizzes GROUP BY ALL")
def quiz_scores(spark, sf_dir):
    """Scores of an answerer who always takes the first option."""
    asked = quiz(spark, sf_dir)
    return artefacts.score_quiz(asked, asked.select(*BY, "question_no", F.lit(0).alias("chosen")), BY)


@query(
    "oral_questions",
    f"""WITH {RECORDS}, cc AS (SELECT book, chapter, 'Definisci “' || term || '” e spiegalo nel contesto del capitolo.' AS question, definition AS answer, para, 0 AS k, place AS pos FROM gl
UNION ALL SELECT book, chapter, 'Spiega i concetti fondamentali di ' || label || '.', array_to_string(p, ' '), para, 1, para FROM rec WHERE len(p) > 0)
SELECT book, chapter, row_number() OVER (PARTITION BY book, chapter ORDER BY k, pos)::INT AS question_no, question, answer, para FROM cc QUALIFY question_no <= 24""",
)
def oral_questions(spark, sf_dir):
    return artefacts.oral_questions(records(spark, sf_dir, "points", "glossary"), BY, "para")


@query(
    "concept_map",
    f"""WITH {RECORDS}, cc AS (SELECT book, chapter, para, coalesce(section, 'Passaggio ' || (para + 1)) AS title, {s.unique_ci("keywords || list_transform(glossary, lambda e: e.term)", 6)} AS keywords, p AS points FROM rec WHERE para < 24)
SELECT * FROM cc WHERE len(keywords) > 0 OR len(points) > 0""",
)
def concept_map(spark, sf_dir):
    return artefacts.concept_map(records(spark, sf_dir, "points", "glossary", "keywords"), BY, "para")
