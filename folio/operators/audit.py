"""Completeness audit: important source sentences, their coverage by generated text, and recovery of missing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.functions.lexicon import ITALIAN, Lexicon

# What marks data in a sentence.
NUMBER = r"(^|[^\p{L}\p{N}_])(1[0-9]{3}|20[0-9]{2}|[0-9]{1,3}([.,][0-9]+)?%)([^\p{L}\p{N}_]|$)"
FORMULA = r"(^|[^\p{L}\p{N}_])[A-Za-z]{1,4} *= *[^,.;]{1,40}"
PER_PARAGRAPH, PER_CHAPTER = 2, 8


#: The same for Java's engine, to be found and not taken out.
QUICK_NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}_])(?:1[0-9]{3}|20[0-9]{2}|[0-9]{1,3}(?:[.,][0-9]+)?%)(?![\p{L}\p{N}_])"


def cue_patterns(lex: Lexicon) -> tuple[str, ...]:
    return (t.any_of(lex.important), NUMBER, FORMULA)


def important_sentences(source: Column, lex: Lexicon = ITALIAN) -> Column:
    marked = lambda s: s.rlike(t.cue(lex.important)) | s.rlike(QUICK_NUMBER) | (F.contains(s, F.lit("=")) & s.rlike(FORMULA))
    return F.filter(t.sentences(source), lambda s: F.length(s).between(22, 420) & marked(s))


def coverage_of(words: Column, generated: Column) -> Column:
    """The share of distinct words that are among the generated ones; 1 without words."""
    return t.let(F.array_distinct(words), lambda d: F.when(F.size(d) == 0, 1.0).otherwise(F.size(F.array_intersect(d, generated)) / F.size(d)))


def coverage(sentence: Column, generated: Column, lex: Lexicon = ITALIAN) -> Column:
    return coverage_of(t.content_words(sentence, lex.audit_stop), t.content_words(generated, lex.audit_stop))


def covered_by(sentence: Column, words: Column, target: Column, target_words: Column) -> Column:
    """Whether the text holds the sentence, or enough of its words: the fewer it has, the more."""
    n, share = F.size(F.array_distinct(words)), coverage_of(words, target_words)
    return F.contains(target, F.lower(sentence)) | (share >= F.when(n <= 3, 0.67).when(n <= 6, 0.55).otherwise(0.48))


def is_covered(sentence: Column, generated: Column, lex: Lexicon = ITALIAN) -> Column:
    clean, words = t.normalize(sentence), t.content_words(sentence, lex.audit_stop)
    return covered_by(clean, words, F.lower(t.normalize(generated)), t.content_words(generated, lex.audit_stop))


def search_text() -> Column:
    """All generated text of a record (summary, accessible, key_points, remember, keywords)."""
    several = F.flatten(F.array("key_points", "remember", "keywords"))
    return F.concat_ws(" ", "summary", "accessible", F.array_join(several, " "))


def _fold(cap: Column, lex: Lexicon) -> Column:
    """Over a paragraph's important sentences in order: those covered before, those recovered up to the cap, the number left out.

    What is recovered counts as generated text for the sentences after it.
    """
    each = F.transform("important", lambda s: F.struct(s.alias("s"), F.array_distinct(t.content_words(s, lex.audit_stop)).alias("w")))
    start = F.struct(
        F.lower(t.normalize(F.col("searchable"))).alias("target"), F.array_distinct(t.content_words(F.col("searchable"), lex.audit_stop)).alias("words"), F.lit(0).alias("before"), F.array().cast("array<string>").alias("recovered"), F.lit(0).alias("capped")
    )

    def step(acc: Column, x: Column) -> Column:
        keep = lambda **new: F.struct(*[new.get(c, acc[c]).alias(c) for c in ("target", "words", "before", "recovered", "capped")])
        return (
            F.when(covered_by(x["s"], x["w"], acc["target"], acc["words"]), keep(before=acc["before"] + 1))
            .when(F.size(acc["recovered"]) >= cap, keep(capped=acc["capped"] + 1))
            .otherwise(keep(target=F.concat_ws(" ", acc["target"], F.lower(x["s"])), words=F.array_union(acc["words"], x["w"]), recovered=F.concat(acc["recovered"], F.array(x["s"]))))
        )

    return F.aggregate(each, start, step)


def audit_paragraphs(paras: DataFrame, by, order: str, source: str = "text", lex: Lexicon = ITALIAN) -> DataFrame:
    """`paras` (study records with their source) with n_important, covered_before, recovered (sentences) and capped.

    At most 2 are recovered in a paragraph and 8 in a chapter, in order. What a paragraph recovers with a cap c of 2 or
    less is the first c of what it would without the chapter's cap, so two folds and a running sum replace a loop.
    """
    known = paras.withColumns({"important": important_sentences(F.col(source), lex), "searchable": search_text()})
    first = known.withColumn("first", _fold(F.lit(PER_PARAGRAPH), lex)).withColumn("alone", F.size("first.recovered"))
    earlier = F.coalesce(F.sum("alone").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    capped = first.withColumn("cap", F.least(F.lit(PER_PARAGRAPH), F.greatest(F.lit(0), PER_CHAPTER - earlier)))
    # the first fold holds unless the cap takes something from it
    done = capped.withColumn("f", F.when((F.col("cap") >= PER_PARAGRAPH) | ((F.col("alone") <= F.col("cap")) & (F.col("first.capped") == 0)), F.col("first")).otherwise(_fold(F.col("cap"), lex)))
    return done.withColumns({"n_important": F.size("important"), "covered_before": F.col("f.before"), "recovered": F.col("f.recovered"), "capped": F.col("f.capped")}).drop("important", "searchable", "first", "alone", "cap", "f")


def append_recovery(audited: DataFrame) -> DataFrame:
    """Records with their recovered sentences appended (key_points to 10, remember to 6)."""
    some = F.size("recovered") > 0
    return audited.withColumns(
        {
            "summary": F.when(some, t.normalize(F.concat_ws(" ", "summary", F.array_join("recovered", " ")))).otherwise(F.col("summary")),
            "accessible": F.when(some, F.array_join(F.filter(F.concat(F.array("accessible"), F.col("recovered")), lambda s: s != ""), "\n\n")).otherwise(F.col("accessible")),
            "key_points": F.when(some, t.head(F.array_distinct(F.concat("key_points", "recovered")), 10)).otherwise(F.col("key_points")),
            "remember": F.when(some, t.head(F.array_distinct(F.concat("remember", "recovered")), 6)).otherwise(F.col("remember")),
        }
    )


def audit_chapters(audited: DataFrame, by) -> DataFrame:
    """by, important, covered_before, recovered, capped, coverage_before, coverage_after."""
    sums = audited.groupBy(*by).agg(F.sum("n_important").alias("important"), F.sum("covered_before").alias("covered_before"), F.sum(F.size("recovered")).alias("recovered"), F.sum("capped").alias("capped"))
    share = lambda c: F.round(F.when(F.col("important") > 0, c / F.col("important")).otherwise(1.0), 6)
    return sums.withColumns({"coverage_before": share(F.col("covered_before")), "coverage_after": share(F.least(F.col("important"), F.col("covered_before") + F.col("recovered")))})


def audit_rollup(chapters: DataFrame, by) -> DataFrame:
    return chapters.groupBy(*by).agg(
        F.count("*").alias("chapters"), F.count_if(F.col("recovered") > 0).alias("chapters_with_recovery"), F.sum("important").alias("important"), F.sum("recovered").alias("recovered"), F.sum("capped").alias("capped"), F.round(F.avg("coverage_before"), 6).alias("coverage_before"), F.round(F.avg("coverage_after"), 6).alias("coverage_after")
    )


def progress(done: Column, total: Column, paragraphs: Column) -> Column:
    """Finished paragraphs of all, from finished chunks of all."""
    part = F.least(paragraphs, F.floor(F.greatest(F.lit(0), done) / total * paragraphs))
    return F.when(paragraphs == 0, 0).when((total == 0) | (done >= total), paragraphs).otherwise(part).cast("long")


def quality_metrics(records: DataFrame, by) -> DataFrame:
    """by (rolled up: subtotals have nulls): paragraphs by engine, the engine of all, recovered sentences, glossary entries; and chunks, by engine, resumed ones, split paragraphs, the longest one, and the percentage by a model.

    Chunk figures come from the columns chunk_stats (as of merge_chunks; null: one chunk by the record's engine), n_chunks and max_chunk (as of
    chunk_map) and resumed (chunks taken from a checkpoint), where the records have them.
    """
    there = set(records.columns)
    stats = "chunk_stats" in there
    known = records.withColumns(
        {
            "_total": F.coalesce("chunk_stats.total_chunks", F.lit(1)) if stats else F.lit(1),
            **{f"_{e}": (lambda own, name: F.coalesce(f"chunk_stats.{name}", own) if stats else own)((F.col("engine") == e).cast("int"), name) for e, name in (("ai", "ai_chunks"), ("locale", "local_chunks"), ("misto", "mixed_chunks"))},
            "_chunks": F.coalesce("n_chunks", F.lit(1)) if "n_chunks" in there else F.lit(1),
            "_longest": F.coalesce("max_chunk", F.lit(0)) if "max_chunk" in there else F.lit(0),
            "_resumed": F.coalesce("resumed", F.lit(0)) if "resumed" in there else F.lit(0),
        }
    )
    sums = known.rollup(*by).agg(
        F.count("*").alias("paragraphs"), F.count_if(F.col("engine") == "ai").alias("ai"), F.count_if(F.col("engine") == "misto").alias("misto"), F.sum("fidelity_recovered").alias("fidelity_recovered"), F.sum(F.size("glossary")).alias("glossary_entries"),
        F.sum("_total").cast("long").alias("total_chunks"), F.sum("_ai").cast("long").alias("ai_chunks"), F.sum("_locale").cast("long").alias("local_chunks"), F.sum("_misto").cast("long").alias("mixed_chunks"), F.sum("_chunks").cast("long").alias("_prepared"),
        F.sum("_resumed").cast("long").alias("resumed_chunks"), F.count_if(F.col("_chunks") > 1).alias("long_split"), F.max("_longest").cast("int").alias("max_chunk_chars"),
    )
    locale = F.col("paragraphs") - F.col("ai") - F.col("misto")
    engine = F.when(F.col("ai") == F.col("paragraphs"), "ai").when(locale == F.col("paragraphs"), "locale").otherwise("misto")
    share = F.when(F.col("total_chunks") > 0, F.floor(F.col("ai_chunks") / F.col("total_chunks") * 1000 + 0.5) / 10).otherwise(0.0)
    done = progress(F.col("resumed_chunks"), F.col("_prepared"), F.col("paragraphs"))
    return sums.withColumns({"locale": locale, "engine": engine, "resumed_paragraphs": done, "ai_chunk_percent": share}).drop("_prepared")
