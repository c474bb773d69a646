"""Study artefacts of a chapter: flashcards, quizzes, oral questions, concept maps, quiz scores.

Records are study paragraphs (summary, accessible, original, key_points, remember, keywords, glossary, section) with a
chapter key `by` and an order from 0; a column `points`, made ahead of an exchange, takes the place of the texts and lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators.glossary import chapter_glossary

SHORT = 18


def points(most: int = 5) -> Column:
    """What to remember, key points and summary sentences of 18 characters or more, without repeats."""
    body = F.coalesce(F.nullif(t.normalize(F.col("summary")), F.lit("")), F.nullif(t.normalize(F.col("accessible")), F.lit("")), t.normalize(F.col("original")))
    every = F.concat("remember", "key_points", t.sentences(body, SHORT))
    return t.unique_ci(every, most, SHORT)


def _points(paras: DataFrame, most: int) -> Column:
    """points, or the first of those that the records hold already in a column `points`."""
    return t.head(F.col("points"), most) if "points" in paras.columns else points(most)


def label(order: Column) -> Column:
    section = t.normalize(F.col("section"))
    return F.when(section != "", F.concat(F.lit("la sezione “"), section, F.lit("”"))).otherwise(F.concat(F.lit("il passaggio "), (order + 1).cast("string")))


def _top(df: DataFrame, by, order, most: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def _terms_and(paras: DataFrame, by, order: str, more: Column) -> DataFrame:
    """by, order, k, pos, a, b: a chapter's terms (k = 0; a, b are term and definition), the first of each, and what `more` makes of each paragraph (k = 1)."""
    entries = F.transform("glossary", lambda e, i: F.struct(F.lit(0).alias("k"), i.alias("pos"), e["term"].alias("a"), e["definition"].alias("b")))
    each = paras.select(*by, order, F.explode(F.concat(entries, more)).alias("x")).select(*by, order, "x.*")
    same = F.when(F.col("k") == 0, F.lower("a")).otherwise(F.concat_ws(" ", F.col(order).cast("string"), F.col("pos").cast("string")))
    return each.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "k", same).orderBy(order, "pos"))).where("_n = 1").drop("_n")


def flashcards(paras: DataFrame, by, order: str, most: int = 36) -> DataFrame:
    """by, card_no, kind, front, back, order: terms first, then up to three points of each paragraph."""
    front = lambda i: F.concat(F.when(i == 0, "Qual è il concetto principale di ").otherwise("Quale altro elemento importante va ricordato di "), label(F.col(order)), F.lit("?"))
    cards = _terms_and(paras, by, order, F.transform(_points(paras, 3), lambda v, i: F.struct(F.lit(1).alias("k"), i.alias("pos"), front(i).alias("a"), v.alias("b"))))
    asked = F.when(F.col("k") == 0, F.concat(F.lit("Che cosa significa “"), "a", F.lit("”?"))).otherwise(F.col("a"))
    kind = F.when(F.col("k") == 0, "term").otherwise("point")
    return _top(cards, by, ("k", order, "pos"), most, "card_no").select(*by, "card_no", kind.alias("kind"), asked.alias("front"), F.col("b").alias("back"), order)


def rotate(values: Column, shift: Column) -> Column:
    """The values turned round by `shift` places."""

    def turned(v: Column) -> Column:
        n = F.size(v)
        k = F.pmod(shift, F.greatest(n, F.lit(1)))
        return F.when(n > 0, F.concat(F.slice(v, k + 1, n), F.slice(v, F.lit(1), k))).otherwise(v)

    return t.let(values, turned)


def _others(ring: Column, i: Column, current: Column) -> Column:
    """Values after place i round the ring, that differ from the current one, without repeats, the first three."""
    after = F.concat(F.slice(ring, i + 2, F.size(ring)), F.slice(ring, F.lit(1), i))
    return F.slice(F.filter(t.unique_ci(after), lambda v: F.lower(v) != F.lower(current)), 1, 3)


def quiz_glossary(paras: DataFrame, by, order: str, most: int = 18) -> DataFrame:
    """by, question_no, question, options, correct_index (from 0), explanation, order.

    With three different definitions every term has two wrong ones, and with fewer none has, so the first `most` terms
    give all questions that are kept.
    """
    entries = chapter_glossary(paras, by, order)
    ring = entries.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "term", "definition", order))).alias("e")).where(F.size("e") >= 3)
    each = ring.select(*by, F.transform("e", lambda x: x["definition"]).alias("ring"), F.posexplode(F.slice("e", 1, most)).alias("i", "x"))
    each = each.withColumn("wrong", _others(F.col("ring"), F.col("i"), F.col("x.definition"))).where(F.size("wrong") >= 2)
    options = rotate(F.slice(F.concat(F.array("x.definition"), F.col("wrong")), 1, 4), F.col("i") + F.length("x.term"))
    question = F.concat(F.lit("Quale definizione corrisponde a “"), F.col("x.term"), F.lit("”?"))
    out = each.select(*by, "i", question.alias("question"), options.alias("options"), F.col("x.definition").alias("explanation"), F.col(f"x.{order}").alias(order))
    return _numbered(out, by, most, order)


def _numbered(out: DataFrame, by, most: int, order: str) -> DataFrame:
    out = out.withColumn("correct_index", (F.array_position("options", F.col("explanation")) - 1).cast("int"))
    return _top(out, by, ("i",), most, "question_no").select(*by, "question_no", "question", "options", "correct_index", "explanation", order)


def _needed(pools: DataFrame, by, order: str, most: int) -> DataFrame:
    """The passages that the questions of a chapter's first `most` ones can need, a fixed number however long it is.

    A question takes three passages with a new point. A list of points gives at most three, and while fewer than four are
    taken at most 15 different lists give none; so past the first `most` passages three of each of 18 lists are enough.
    """
    alike = Window.partitionBy(*by, F.transform("p", F.lower)).orderBy(order)
    near = pools.withColumn("_alike", F.row_number().over(alike)).where(F.col("_alike") <= most + 3).drop("_alike")
    return _top(near, by, (order,), most + 18 * (most + 3), "_place").drop("_place")


def quiz_points(paras: DataFrame, by, order: str, most: int = 18) -> DataFrame:
    """As quiz_glossary, asking which statement a passage makes; each wrong one is the first new point of another passage."""
    pools = paras.select(*by, order, label(F.col(order)).alias("label"), _points(paras, 3).alias("p")).where(F.size("p") > 0)
    ring = _needed(pools, by, order, most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "label", "p"))).alias("e"))
    each = ring.select(*by, F.transform("e", lambda x: x["p"]).alias("ring"), F.posexplode(F.slice("e", 1, most)).alias("i", "x"))
    after = F.concat(F.slice("ring", F.col("i") + 2, F.size("ring")), F.slice("ring", F.lit(1), F.col("i")))
    correct = F.get("x.p", F.lit(0))

    def step(acc: Column, p: Column) -> Column:
        new = t.let(F.transform(acc, F.lower), lambda seen: F.filter(p, lambda v: ~F.array_contains(seen, F.lower(v))))
        return F.when(F.size(acc) >= 4, acc).otherwise(F.concat(acc, F.slice(new, 1, 1)))

    options = F.aggregate(after, F.array(correct), step, lambda acc: acc)
    question = F.concat(F.lit("Quale affermazione appartiene a "), F.col("x.label"), F.lit("?"))
    out = each.withColumn("all", options).where(F.size("all") >= 3)
    return _numbered(out.select(*by, "i", question.alias("question"), rotate(F.col("all"), F.col("i") + 1).alias("options"), correct.alias("explanation"), F.col(f"x.{order}").alias(order)), by, most, order)


def quiz(paras: DataFrame, by, order: str, most: int = 18) -> DataFrame:
    """Glossary questions, then questions on passages, up to `most` of a chapter."""
    both = quiz_glossary(paras, by, order, most).withColumn("k", F.lit(0)).unionByName(quiz_points(paras, by, order, most).withColumn("k", F.lit(1))).withColumnRenamed("question_no", "n")
    return _top(both, by, ("k", "n"), most, "question_no").drop("k", "n")


def oral_questions(paras: DataFrame, by, order: str, most: int = 24) -> DataFrame:
    """by, question_no, question, answer, order: terms, then passages."""
    spoken = t.let(_points(paras, 3), lambda p: F.when(F.size(p) > 0, F.array(F.struct(F.lit(1).alias("k"), F.lit(0).alias("pos"), label(F.col(order)).alias("a"), F.array_join(p, " ").alias("b")))))
    none = F.array().cast("array<struct<k: int, pos: int, a: string, b: string>>")
    asked = _terms_and(paras, by, order, F.coalesce(spoken, none))
    question = F.when(F.col("k") == 0, F.concat(F.lit("Definisci “"), "a", F.lit("” e spiegalo nel contesto del capitolo."))).otherwise(F.concat(F.lit("Spiega i concetti fondamentali di "), "a", F.lit(".")))
    return _top(asked, by, ("k", order, "pos"), most, "question_no").select(*by, "question_no", question.alias("question"), F.col("b").alias("answer"), order)


def concept_map(paras: DataFrame, by, order: str, most: int = 24) -> DataFrame:
    """by, order, title, keywords, points: a node for each of the first passages that has either."""
    first = paras.where(F.col(order) < most)
    title = F.coalesce(F.nullif(t.normalize(F.col("section")), F.lit("")), F.concat(F.lit("Passaggio "), (F.col(order) + 1).cast("string")))
    words = t.unique_ci(F.concat("keywords", F.transform("glossary", lambda e: e["term"])), 6)
    return first.select(*by, order, title.alias("title"), words.alias("keywords"), _points(paras, 3).alias("points")).where((F.size("keywords") > 0) | (F.size("points") > 0))


def score_quiz(questions: DataFrame, answers: DataFrame, by) -> DataFrame:
    """by, answered, correct, of answers (by, question_no, chosen)."""
    both = questions.select(*by, "question_no", "correct_index").join(answers, [*by, "question_no"])
    return both.groupBy(*by).agg(F.count("*").alias("answered"), F.count_if(F.col("chosen") == F.col("correct_index")).alias("correct"))
