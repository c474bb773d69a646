"""Sentences, words, extractive summaries, fidelity repair.

Tables are keyed by `key` columns (a document, or a document's paragraph), with a text column. Sentences are scored,
words counted and summaries made within the text's row, by sorted arrays and the runs of equal values in them, so that no
step needs an exchange; time is that of sorting the text's words. Repeated keys are texts of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.functions.lexicon import ITALIAN, Lexicon, levels
from folio.operators import glossary

KEY = ("doc_id",)
DATA_NUMBER = r"(^|[^\p{L}\p{N}_])[0-9]{2,4}([^\p{L}\p{N}_]|$)"
LIST_MARK = r"(?iu)(^|[ ])([12ab][.)]|{words})([^\p{L}\p{N}]|$)"
#: The same for Java's engine, to be found and not taken out.
QUICK_NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}_])[0-9]{2,4}(?![\p{L}\p{N}_])"


def once(df: DataFrame, given) -> DataFrame:
    """`df` with all columns but those `given` computed in one step that later filters can't be pushed below, which would compute them again."""
    made = [c for c in df.columns if c not in given]
    return df.select(*given, F.explode(F.array(F.struct(*made))).alias("_row")).select(*given, "_row.*")


def sentence_table(df: DataFrame, key=KEY, text: str = "text", least: int = 1) -> DataFrame:
    """key, idx (from 0), sentence."""
    return df.select(*key, F.posexplode(t.sentences(F.col(text), least)).alias("idx", "sentence"))


def word_freq(df: DataFrame, lex: Lexicon = ITALIAN, key=KEY, text: str = "text") -> DataFrame:
    """key, word, n, first_pos: content words with their number of occurrences and first place among the text's words."""
    words = df.select(*key, F.posexplode(t.raw_words(F.col(text))).alias("pos", "word")).where(t.is_content(F.col("word"), lex.stop))
    return words.groupBy(*key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def _runs(values: Column, part: str) -> Column:
    """at (from 0), n: each run of equal `part`s in sorted structs; `values` is an array that is computed already."""
    new = F.transform(values, lambda v, i: F.when((i == 0) | (v[part] != F.get(values, i - 1)[part]), i))
    return t.let(F.filter(new, lambda i: i.isNotNull()), lambda at: F.transform(at, lambda a, i: F.struct(a.alias("at"), (F.coalesce(F.get(at, i + 1), F.size(values)) - a).alias("n"))))


def _upper(i: Column) -> Column:
    return F.shiftleft(i.cast("long"), 32)


def _counted(each: Column, lex: Lexicon, f) -> Column:
    """f(words, runs): the content words of sentences as sorted structs (word, at: number of the sentence in the upper half, place in it in the lower one), and the runs of each word."""
    kept = lambda s: F.filter(F.split(F.regexp_replace(F.lower(s), t.APART, " "), " "), lambda w: t.is_content(w, lex.stop))
    made = F.transform(each, lambda s, i: t.let(_upper(i), lambda at: F.transform(kept(s), lambda w, p: F.struct(w.alias("word"), (at + p).alias("at")))))
    return t.let(F.sort_array(F.flatten(made)), lambda w: t.let(_runs(w, "word"), lambda r: f(w, r)))


def _best(words: Column, runs: Column, k: int) -> Column:
    """word, n of the first k words by count, then length, then first occurrence."""
    row = lambda r: t.let(F.get(words, r["at"]), lambda w: F.struct((-r["n"]).alias("less"), (-F.length(w["word"])).alias("shorter"), w["at"].alias("at"), w["word"].alias("word")))
    # words of a lower count than the k-th can't be among the first k
    least = F.coalesce(F.get(F.sort_array(F.transform(runs, lambda r: r["n"]), asc=False), F.lit(k - 1)), F.lit(0))
    order = t.let(least, lambda n: F.transform(F.filter(runs, lambda r: r["n"] >= n), row))
    return F.transform(t.head(F.sort_array(order), k), lambda w: F.struct(w["word"].alias("word"), (-w["less"]).cast("long").alias("n")))


def keywords(c: Column, lex: Lexicon = ITALIAN, k: int = 8) -> Column:
    """word, n of a text's k most frequent content words; longer ones, then earlier ones first."""
    return _counted(t.sentences(c), lex, lambda words, runs: _best(words, runs, k))


def top_keywords(df: DataFrame, lex: Lexicon = ITALIAN, k: int = 8, key=KEY, text: str = "text") -> DataFrame:
    """key, rank (from 1), word, n: by count, then length, then first occurrence."""
    each = df.select(*key, F.posexplode(keywords(F.col(text), lex, k)).alias("rank", "w"))
    return each.select(*key, (F.col("rank") + 1).alias("rank"), "w.word", "w.n")


def cues(sentence: Column, lex: Lexicon, more: tuple[str, ...] = ()) -> Column:
    """bonus: points for a definition (1.8), data (1.4) and a list item (0.8); remember: whether there is data or a cue to remember; more: whether one of these words stands alone.

    A sentence is split into tokens once, and only those that some list holds are looked for in the lists.
    """
    words = {w for part in (*lex.defines, *lex.data, *lex.lists, *lex.remember, *more) for p in part.split("|") for w in p.split(" ")}
    marks = rf"(?iu)(?<![^ ])(?:[12ab][.)]|{'|'.join(lex.lists)})(?![\p{{L}}\p{{N}}])"

    def judged(held: Column) -> Column:
        listed = (sentence.rlike("[12abAB][.)]") | t.has_cue(sentence, held, lex.lists)) & sentence.rlike(marks)
        points = lambda number: F.when(t.has_cue(sentence, held, lex.defines), 1.8).otherwise(0.0) + F.when(number | t.has_cue(sentence, held, lex.data), 1.4).otherwise(0.0) + F.when(listed, 0.8).otherwise(0.0)
        row = lambda number: F.struct(points(number).alias("bonus"), (number | t.has_cue(sentence, held, lex.remember)).alias("remember"), (t.has_cue(sentence, held, more) if more else F.lit(False)).alias("more"))
        return t.let(sentence.rlike(QUICK_NUMBER), row)

    return t.let(F.filter(t.tokens(sentence), lambda w: w.isin(*sorted(words))), judged)


def cue_bonus(sentence: Column, lex: Lexicon) -> Column:
    """Points for a definition (1.8), data (1.4) and a list item (0.8)."""
    return cues(sentence, lex)["bonus"]


def _scores(each: Column, words: Column, runs: Column, cued: Column) -> Column:
    """idx, sentence, score of each sentence; all arguments are arrays that are computed already, `cued` the cues of each sentence."""
    counts = F.flatten(F.transform(runs, lambda r: F.array_repeat(r["n"], r["n"])))
    # a sentence's number in the upper half, a word's count in the lower one: whole numbers sort faster than structs
    held = F.transform(counts, lambda n, i: F.get(words, i)["at"].bitwiseAND(F.lit(~0xFFFFFFFF).cast("long")) + n)
    # a zero begins the run of each sentence, also of those without content words
    placed = F.sort_array(F.concat(held, F.transform(each, lambda s, i: _upper(i))))
    count = lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))

    def means(v: Column) -> Column:
        starts = F.filter(F.transform(v, lambda x, i: F.when(count(x) == 0, i)), lambda i: i.isNotNull())
        mean = lambda a, n: F.when(n > 1, F.aggregate(F.slice(v, a + 2, n - 1), F.lit(0).cast("long"), lambda total, x: total + count(x)) / (n - 1))
        return t.let(starts, lambda s: F.transform(s, lambda a, i: mean(a, F.coalesce(F.get(s, i + 1), F.size(v)) - a)))

    quarter = F.ceil(F.size(each) * 0.25)
    place = lambda i: F.when(i == 0, 1.1).when(i < quarter, 0.45).otherwise(0.0)
    score = lambda i, m: F.when(m.isNotNull(), F.round(m + F.get(cued, i)["bonus"] + place(i), 6)).otherwise(0.0)
    return t.let(t.let(placed, means), lambda m: F.transform(each, lambda s, i: F.struct(i.alias("idx"), s.alias("sentence"), score(i, F.get(m, i)).alias("score"))))


def scored_sentences(c: Column, lex: Lexicon = ITALIAN) -> Column:
    """idx (from 0), sentence, score: mean frequency of its content words in the text, plus cue and position points; 0 without content words."""
    cued = lambda each: F.transform(each, lambda s: cues(s, lex))
    return t.let(t.sentences(c), lambda s: t.let(cued(s), lambda x: _counted(s, lex, lambda w, r: _scores(s, w, r, x))))


def score_sentences(df: DataFrame, lex: Lexicon = ITALIAN, key=KEY, text: str = "text") -> DataFrame:
    """key, idx, sentence, n_sentences, score of each text's scored_sentences."""
    each = df.select(*key, t.let(scored_sentences(F.col(text), lex), lambda s: F.transform(s, lambda x: F.struct(x.alias("x"), F.size(s).cast("long").alias("n")))).alias("_s"))
    each = each.select(*key, F.explode("_s").alias("_s"))
    return each.select(*key, "_s.x.idx", "_s.x.sentence", F.col("_s.n").alias("n_sentences"), "_s.x.score")


def wanted(n: Column, level: str) -> Column:
    ratio, least, most, _ = levels()[level]
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(n * F.lit(ratio)).cast("int")))


def _picked(scored: Column, level: str) -> Column:
    """idx, sentence of the best sentences, in their order; all where there are few."""
    order = F.sort_array(F.transform(scored, lambda s: F.struct((F.lit(0.0) - s["score"]).alias("less"), s["idx"].alias("idx"), s["sentence"].alias("sentence"))))
    n = F.size(scored)
    most = F.when(n <= levels()[level][1], n).otherwise(wanted(n, level))
    return F.sort_array(F.transform(F.slice(order, F.lit(1), most), lambda s: F.struct(s["idx"].alias("idx"), s["sentence"].alias("sentence"))))


def _text_of(picked: Column) -> Column:
    return F.array_join(F.transform(picked, lambda s: s["sentence"]), " ")


def summary_of(c: Column, level: str = "studio", lex: Lexicon = ITALIAN) -> Column:
    """A text's extractive summary; null where the text has no sentence."""
    summed = t.let(scored_sentences(c, lex), lambda s: _picked(s, level))
    return t.let(summed, lambda p: F.when(F.size(p) > 0, _text_of(p)))


def extract_summary(df: DataFrame, level: str = "studio", lex: Lexicon = ITALIAN, key=KEY, text: str = "text") -> DataFrame:
    """key, n_sentences, n_kept, summary: the best sentences in their order; texts of few sentences are kept whole, those of none have no row."""

    def made(scored: Column) -> Column:
        row = lambda p: F.struct(F.size(scored).cast("long").alias("n_sentences"), F.size(p).cast("long").alias("n_kept"), _text_of(p).alias("summary"))
        return t.let(_picked(scored, level), row)

    each = once(df.select(*key, t.let(scored_sentences(F.col(text), lex), made).alias("_s")), key)
    return each.where(F.col("_s.n_sentences") > 0).select(*key, "_s.*")


def summary_levels(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in levels().items()], "level string, ratio double, least int, most int, label string")


def key_points(summary: Column, most: int = 5) -> Column:
    return t.head(t.sentences(summary), most)


def remember_items(sentences: Column, keywords: Column, lex: Lexicon = ITALIAN, most: int = 4) -> Column:
    """The first of a text's sentences with data or a cue, or else the first keywords."""
    return _remembered(t.first_matches(sentences, lambda s: s.rlike(QUICK_NUMBER) | s.rlike(t.cue(lex.remember)), most), keywords, most)


def _remembered(found: Column, keywords: Column, most: int = 4) -> Column:
    named = F.transform(t.head(keywords, most), lambda k: F.concat(F.lit("Concetto chiave: "), k))
    return t.let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.coalesce(named, F.array().cast("array<string>"))))


def missing_anchors(source: Column, summary: Column, spoken: Column, most: int = 32) -> Column:
    """Anchors of the source that neither text holds, letter case aside."""
    seen = F.lower(F.concat_ws(" ", t.normalize(summary), t.text(spoken)))
    return t.let(seen, lambda known: F.filter(t.anchors(source, most), lambda a: ~F.contains(known, F.lower(a))))


def recovery(sentences: Column, missing: Column, most: int = 5) -> Column:
    """For each missing anchor the first of the source's sentences that has it, distinct."""

    def within(whole: Column) -> Column:
        # sentences are normalised, so a line's number is the sentence's
        before = lambda at: F.when(at > 0, t.let(F.substring(whole, F.lit(1), at), lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))))
        return F.transform(missing, lambda a: t.let(F.position(F.lower(a), whole), lambda at: F.get(sentences, before(at))))

    found = t.let(F.lower(F.array_join(sentences, "\n")), within)
    return t.head(F.array_distinct(F.filter(found, lambda s: s.isNotNull())), most)


def ensure_fidelity(df: DataFrame, lex: Lexicon = ITALIAN, source: str = "text", anchors: int = 32, most: int = 5, sentences: Column | None = None) -> DataFrame:
    """`df` (summary, accessible, key_points, remember) with the sentences of missing anchors appended, and fidelity_recovered; `sentences` are the source's, where they are known already."""
    parts = t.sentences(F.col(source)) if sentences is None else sentences
    out = df.withColumn("_missing", missing_anchors(F.col(source), F.col("summary"), F.col("accessible"), anchors))
    out = out.withColumn("_found", F.when(F.size("_missing") > 0, recovery(parts, F.col("_missing"), most)).otherwise(F.array().cast("array<string>")))
    some = F.size("_found") > 0
    spoken = F.transform("_found", lambda s: t.accessible(s, lex.connectives))
    return out.withColumns(
        {
            "summary": F.when(some, t.normalize(F.concat_ws(" ", F.col("summary"), F.array_join("_found", " ")))).otherwise(F.col("summary")),
            "accessible": F.when(some, F.array_join(F.filter(F.concat(F.array("accessible"), spoken), lambda s: s != ""), "\n\n")).otherwise(F.col("accessible")),
            "key_points": F.when(some, t.unique_ci(F.concat("key_points", "_found"), 8)).otherwise(F.col("key_points")),
            "remember": F.when(some, t.unique_ci(F.concat("remember", "_found"), 5)).otherwise(F.col("remember")),
            "fidelity_recovered": F.size("_found"),
        }
    ).drop("_missing", "_found")


def local_records(df: DataFrame, level: str = "studio", lex: Lexicon = ITALIAN, key=KEY, text: str = "text", rules: glossary.Definitions | None = None, keywords: bool = True) -> DataFrame:
    """As summarize_local, with a glossary by `rules`, for a step that takes some columns, before `once`; without `keywords` neither these nor `remember` is made."""
    needed = rules.needed() if rules else ()

    def made(each: Column) -> Column:
        summed = lambda w, r, cued: t.let(_scores(each, w, r, cued), lambda s: _text_of(_picked(s, level))).alias("summary")
        named = lambda w, r: [F.transform(_best(w, r, 8), lambda k: k["word"]).alias("keywords")] if keywords else []
        held = lambda cued, part: F.filter(each, lambda s, i: F.get(cued, i)[part])
        row = lambda cued: _counted(each, lex, lambda w, r: F.struct(summed(w, r, cued), *named(w, r), t.head(held(cued, "remember"), 4).alias("_marked"), held(cued, "more").alias("_defining")))
        return t.let(F.transform(each, lambda s: cues(s, lex, needed)), row)

    parted = df.select(*key, text, t.sentences(F.col(text)).alias("_each"))
    both = parted.select(*key, text, "_each", t.let(F.col("_each"), made).alias("_s")).select(*key, text, "_each", "_s.*")
    remember = _remembered(F.col("_marked"), F.col("keywords")) if keywords else F.array().cast("array<string>")
    both = both.withColumns({"accessible": t.accessible(F.col("summary"), lex.connectives), "key_points": key_points(F.col("summary")), "remember": remember, "engine": F.lit("locale")})
    if rules:
        both = both.withColumn("glossary", glossary.mine_glossary(F.col(text), rules, sentences=F.col("_defining")))
    out = ensure_fidelity(both, lex, text, sentences=F.col("_each")).drop("_each", "_marked", "_defining")
    return out if keywords else out.drop("remember")


def summarize_local(df: DataFrame, level: str = "studio", lex: Lexicon = ITALIAN, key=KEY, text: str = "text") -> DataFrame:
    """key, text, summary, accessible, key_points, remember, keywords, engine, fidelity_recovered; words are counted once for the summary and the keywords."""
    return once(local_records(df, level, lex, key, text), [*key, text])
