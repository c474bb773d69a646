"""Glossary: definitions mined from sentences, chapter glossaries, terms in text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t

WORD = f"[{t.LETTER}'’-]+"
PHRASE = f"{WORD}(?: +{WORD}){{0,3}}"
#: The same word without regard to case for Java's engine, by single characters and those that fold to one; a space follows it in every pattern, so it isn't tried again shorter.
QUICK_WORD = rf"(?-iu:[{t.one_by_one('AZ', 'az', 'ÀÖ', 'Øö', 'øÿ', chr(39), '-')}’İıŸſẞ\x{{212A}}\x{{212B}}])++"
ENTRY = "struct<term: string, definition: string, placement: string, basis: string>"


@dataclass(frozen=True)
class Definitions:
    """What introduces definitions; the defaults are the fixed Italian values."""

    articles: tuple[str, ...] = ("il", "la", "lo", "l'", "l’", "un", "una")
    copulas: tuple[str, ...] = ("è", "sono")

    def patterns(self) -> tuple[str, ...]:
        return (
            rf"(?iu)(?:^|[^\p{{L}}\p{{N}}])(?:per|con) +({PHRASE}) +si +intende +(.{{4,140}})$",
            rf"(?iu)(?:^|[^\p{{L}}\p{{N}}])si +definisce +({PHRASE}) +(.{{4,140}})$",
            rf"(?iu)^(?:{'|'.join(self.articles)})? *({PHRASE}) +(?:{'|'.join(self.copulas)}) +(.{{4,140}})$",
        )

    def quick(self) -> tuple[str, ...]:
        """The patterns for Java's engine."""
        return tuple(p.replace(WORD, QUICK_WORD) for p in self.patterns())

    def needed(self) -> tuple[str, ...]:
        """Words one of which stands alone in every sentence that a pattern fits."""
        return (*self.copulas, "intende", "definisce")

    def article(self) -> str:
        return rf"(?iu)^(?:{'|'.join(self.articles)}) +"


MIXED = Definitions(Definitions.articles + ("the", "a", "an", "le", "les", "une", "der", "die", "das", "ein", "eine", "el", "los", "las"), Definitions.copulas + ("is", "are", "was", "est", "sont", "ist", "sind", "es", "son"))


def placement(definition: Column) -> Column:
    words = F.size(F.filter(F.split(definition, " "), lambda w: w != ""))
    return F.when((words <= 6) & (F.length(definition) <= 72), "inline").otherwise("side")


def mine_glossary(source: Column, rules: Definitions = Definitions(), most: int = 6, sentences: Column | None = None) -> Column:
    """Entries of the first `most` sentences that define a term, the first pattern of each deciding; terms once each.

    `sentences` are those of the source's that hold a word of rules.needed(), where they are known already.
    """
    if sentences is None:
        sentences = F.filter(t.sentences(source), lambda s: t.has_cue(s, t.tokens(s), rules.needed()))

    def entry(s: Column) -> Column:
        out = F.lit(None)
        for p, word in reversed(list(zip(rules.quick(), ("intende", "definisce", ""), strict=True))):
            term = F.regexp_replace(t.normalize(F.regexp_extract(s, p, 1)), rules.article(), "")
            definition = F.substring(F.regexp_replace(t.normalize(F.regexp_extract(s, p, 2)), "[.;:]$", ""), 1, 240)
            found = F.struct(F.substring(term, 1, 90).alias("term"), definition.alias("definition"), placement(t.normalize(F.regexp_extract(s, p, 2))).alias("placement"), F.lit("source").alias("basis"))
            # the word that a pattern needs is looked for first
            out = F.when(s.rlike(f"(?iu){word}") & s.rlike(p) if word else s.rlike(p), found).otherwise(out)
        return out

    more = lambda found, e: F.when(e.isNotNull() & (e["term"] != "") & (e["definition"] != ""), F.concat(found, F.array(e))).otherwise(found)
    # sentences after the last wanted entry aren't tried
    step = lambda found, s: F.when(F.size(found) >= most, found).otherwise(t.let(t.let(F.trim(F.regexp_replace(s, "[.!?]+$", "")), entry), lambda e: more(found, e)))
    return normalize_glossary(F.aggregate(sentences, F.array().cast(f"array<{ENTRY}>"), step), source, most)


def normalize_glossary(entries: Column, source: Column, most: int = 6) -> Column:
    """Entries whose term occurs in the source, the first of each term."""
    within = lambda some: t.let(F.lower(t.normalize(source)), lambda low: F.filter(some, lambda e: F.contains(low, F.lower(e["term"]))))
    there = t.let(entries, lambda some: F.when(F.size(some) > 0, within(some)).otherwise(some))

    def first(kept: Column) -> Column:
        return t.let(F.transform(kept, lambda e: F.lower(e["term"])), lambda names: F.filter(kept, lambda e, i: F.array_position(names, F.lower(e["term"])) == i + 1))

    return F.slice(t.let(there, first), 1, most)


def chapter_glossary(paras: DataFrame, by, order: str, most: int | None = None) -> DataFrame:
    """by, place, term, definition, order: the first definition of each term in a chapter, in order; the first `most` of them."""
    each = paras.select(*by, order, F.posexplode("glossary").alias("pos", "e"))
    first = each.groupBy(*by, F.lower("e.term").alias("term_key")).agg(F.min(F.struct(order, "pos", "e.term", "e.definition")).alias("f"))
    out = first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(f"f.{order}", "f.pos")))
    out = out.select(*by, "place", "f.term", "f.definition", f"f.{order}")
    return out.where(F.col("place") <= most) if most else out


def literal(term: Column) -> Column:
    """A pattern that matches the term's own characters."""
    return F.regexp_replace(term, r"([^\p{L}\p{N}\s])", r"\\$1")


def alternation(terms: Column) -> Column:
    """A pattern of the terms, longest first, between anything but letters and digits; terms may hold any characters, empty ones match nothing."""
    ordered = F.array_sort(F.filter(terms, lambda v: t.trim_all(v) != ""), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])("), F.array_join(F.transform(ordered, literal), "|"), F.lit(r")(?![\p{L}\p{N}])"))


def mark_terms(text: Column, terms: Column, before: str = "**", after: str = "**") -> Column:
    """The text with its non-overlapping term occurrences marked."""
    return F.when(F.exists(terms, lambda v: t.trim_all(v) != ""), F.regexp_replace(text, alternation(terms), F.lit(f"{before}$1{after}"))).otherwise(text)


def marked_spans(text: Column, terms: Column) -> Column:
    """marked, n: the text with its term occurrences in double asterisks and the number of term_spans, for which terms are looked for once."""
    plain = ~F.contains(text, F.lit("\x02")) & ~F.contains(text, F.lit("\x03"))
    both = lambda m: F.struct(F.replace(F.replace(m, F.lit("\x02"), F.lit("**")), F.lit("\x03"), F.lit("**")).alias("marked"), (F.length(m) - F.length(F.replace(m, F.lit("\x02"), F.lit("")))).alias("n"))
    apart = F.struct(mark_terms(text, terms).alias("marked"), F.size(term_spans(text, terms)).alias("n"))
    return F.when(plain, t.let(mark_terms(text, terms, "\x02", "\x03"), both)).otherwise(apart)


def term_spans(text: Column, terms: Column) -> Column:
    """The occurrences that mark_terms marks, in order, with their start (from 0) and end."""
    parts = F.split(mark_terms(text, terms, "\x02", "\x03"), "\x02")
    lengths = F.transform(parts, lambda p: F.length(F.replace(p, F.lit("\x03"), F.lit(""))))

    def span(p: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n)
        term = F.substring_index(p, "\x03", 1)
        return F.struct(start.alias("start"), (start + F.length(term)).alias("end"), term.alias("term"))

    return F.slice(F.transform(parts, span), 2, F.greatest(F.size(parts), F.lit(1)))


def inline_glossary(text: Column, entries: Column) -> Column:
    """The text with short definitions in brackets after their term's first occurrence, unless there already."""
    short = F.filter(entries, lambda e: (e["placement"] == "inline") & (t.trim_all(e["term"]) != ""))

    def insert(acc: Column, e: Column) -> Column:
        pattern = F.concat(F.lit(r"(?ius)^(.*?(?<![\p{L}\p{N}])"), literal(e["term"]), F.lit(r")(?![\p{L}\p{N}])"))
        safe = F.regexp_replace(e["definition"], r"([\\$])", r"\\$1")
        there = t.contains_ci(acc, F.concat(e["term"], F.lit(" ("), e["definition"]))
        return F.when(there, acc).otherwise(F.regexp_replace(acc, pattern, F.concat(F.lit("$1 ("), safe, F.lit(")"))))

    return F.aggregate(short, t.text(text), insert)


def highlight_terms(keywords: Column, entries: Column, most: int = 24) -> Column:
    """Keywords and terms of three characters or more, without repeats, longest first."""
    every = F.filter(t.unique_ci(F.concat(keywords, F.transform(entries, lambda e: e["term"]))), lambda v: F.length(v) >= 3)
    keyed = F.array_sort(F.transform(every, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v"))))
    return F.slice(F.transform(keyed, lambda x: x["v"]), 1, most)
