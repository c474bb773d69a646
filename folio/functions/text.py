"""Text expressions: cleaning, sentences, words, anchors, order-preserving sets. All are built-in column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def one_by_one(*ranges: str) -> str:
    """Characters up to U+00FF for a class, each by its number: Java's engine looks them up in one table, and tries ranges one after the other."""
    return "".join(rf"\x{{{n:X}}}" for r in ranges for n in range(ord(r[0]), ord(r[-1]) + 1))


#: All white space, also what Java's \s leaves out.
SPACE = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same for Java's engine, which pays for each match: most characters leave at the first class, and single spaces aren't matched.
BLANK = rf"[[^{one_by_one('!~', '¡ÿ')}]&&{SPACE}]"
ODD_BLANK = rf"[[^{one_by_one(' ~', '¡ÿ')}]&&{SPACE}]"
#: The characters of that set.
SPACES = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
ONE_LETTER = f"[{one_by_one('AZ', 'az', 'ÀÖ', 'Øö', 'øÿ')}]"
SENTENCE = r"[^.!?]+(?:[.!?]+|$)"
NOT_WORD = "[^a-zà-öø-ÿ0-9'-]+"
#: The same set but the space.
APART = f"[^{one_by_one('az', ' ', 'àö', 'øÿ', '09', chr(39), '-')}]"
#: What patterns without regard to case take for i or s, and lower-casing doesn't.
FOLDED = "İıſ"
PAGE_NUMBER = r"(?i)^(?:pag(?:ina)?\.?[ \t]*)?[0-9]{1,4}$"
#: A word boundary by ASCII letters, digits and _, as the anchor patterns mean it; Java's own \b differs beside accented letters.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Years and numbers, capitals (acronyms, Roman numerals), and formulas.
ANCHORS = (
    r"\b(?:1[0-9]{3}|20[0-9]{2}|[0-9]{1,3}(?:[.,][0-9]+)?)\b",
    r"\b[A-ZÀ-ÖØ-Ý]{2,8}\b",
    rf"\b[A-Za-z]{{1,4}}{SPACE}*={SPACE}*[^,.;]{{1,32}}",
)
#: The same anchors, each behind what its first characters must be.
QUICK = (
    r"(?=[0-9])(?<!\w)(?:1[0-9]{3}|20[0-9]{2}|[0-9]{1,3}(?:[.,][0-9]+)?)(?!\w)",
    rf"(?=[A-ZÀ-ÖØ-Ý]{{2}}){BOUNDARY}[A-ZÀ-ÖØ-Ý]{{2,8}}{BOUNDARY}",
    rf"(?<!\w)[A-Za-z]{{1,4}}{BLANK}*={BLANK}*[^,.;]{{1,32}}",
)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once; an expression used inside a lambda would be computed again for each element."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize(c: Column) -> Column:
    """All white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), ODD_BLANK, " "), " {2,}", " "))


def clean_text(c: Column) -> Column:
    """Soft hyphens go, words broken at a line's end are joined, blanks squeezed, at most one empty line in a row."""
    solid = F.replace(text(c), F.lit("­"), F.lit(""))
    out = F.when(F.contains(solid, F.lit("-\n")), F.regexp_replace(solid, rf"({ONE_LETTER})-\n({ONE_LETTER})", "$1$2")).otherwise(solid)
    for pattern, by in ((r"[ \t]+\n", "\n"), (r"[ \t]{2,}", " "), (r"\n\n\n+", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return trim_all(out)


def clean_block(c: Column) -> Column:
    """As clean_text, but words stay broken and line tails stay."""
    out = F.replace(text(c), F.lit("­"), F.lit(""))
    for pattern, by in ((r"[ \t]+", " "), (r"\n\n\n+", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return trim_all(out)


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words or phrases standing alone; \\b would miss accented letters at the edges."""
    return r"(?iu)(^|[^\p{L}\p{N}])(" + "|".join(words) + r")([^\p{L}\p{N}]|$)"


def cue(words: tuple[str, ...]) -> str:
    """As any_of, to be found and not taken out: a place is passed over by its first letter, in either case; all beyond Latin-1 that may fold to one are looked at."""
    first = "".join(sorted({x for w in "|".join(words).split("|") for x in (w[0].lower(), w[0].upper())}))
    return rf"(?iu)(?=(?-iu:[{first}\x{{130}}-\x{{212A}}]))(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased, and empty strings; null where lower-casing and patterns without regard to case may differ."""
    folded = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in FOLDED])
    # a split compiles its pattern for each value, but not that of a single space
    return F.when(~folded, F.split(F.regexp_replace(F.lower(c), rf"[[^{one_by_one(' ', '09', 'az', 'ßö', 'øÿ')}]&&[^\p{{L}}\p{{N}}]]", " "), " "))


def has_cue(sentence: Column, held: Column, words: tuple[str, ...]) -> Column:
    """Whether a sentence matches any_of(words), by its tokens or those of them that can matter; words are letters, or phrases of them."""
    every = "|".join(words).split("|")
    single, phrases = [w for w in every if " " not in w], tuple(w for w in every if " " in w)
    found = F.arrays_overlap(held, F.array(*map(F.lit, single)))
    if phrases:
        found = found | (F.arrays_overlap(held, F.array(*[F.lit(max(p.split(" "), key=len)) for p in phrases])) & sentence.rlike(any_of(phrases)))
    return F.when(held.isNull(), sentence.rlike(any_of(words))).otherwise(found)


def sentences(c: Column, least: int = 1) -> Column:
    """Runs up to ., ! or ? (a decimal point ends one too), of at least so many characters."""

    def parts(whole: Column) -> Column:
        found = F.regexp_extract_all(whole, F.lit(SENTENCE), F.lit(0))
        return let(found, lambda f: F.when((F.size(f) > 0) | (whole == ""), f).otherwise(F.array(whole)))

    return F.filter(F.transform(let(normalize(c), parts), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def raw_words(c: Column) -> Column:
    """Lower-cased words, also short and stop words, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text(c)), APART, " "), " "), lambda w: w != "")


def is_content(word: Column, stop: tuple[str, ...]) -> Column:
    return (F.length(word) > 2) & ~word.isin(*stop)


def content_words(c: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(raw_words(c), lambda w: is_content(w, stop))


def unique_ci(values: Column, most: int | None = None, least: int = 1) -> Column:
    """Normalised values without those of less than `least` characters and without later ones that differ in case only, the first `most` of them."""
    clean = F.filter(F.transform(values, normalize), lambda v: F.length(v) >= least)
    both = F.transform(clean, lambda v: F.struct(v.alias("v"), F.lower(v).alias("k")))

    def kept(pairs: Column) -> Column:
        return let(F.transform(pairs, lambda p: p["k"]), lambda keys: F.transform(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1), lambda p: p["v"]))

    out = let(both, kept)
    return F.slice(out, 1, most) if most else out


def head(values: Column, most: int) -> Column:
    return F.slice(values, 1, most)


def anchors(c: Column, most: int = 32) -> Column:
    """Numbers, acronyms, Roman numerals and formulas that a summary must not lose, distinct, longer than a character."""
    *plain, formula = [F.regexp_extract_all(text(c), F.lit(p), F.lit(0)) for p in QUICK]
    formula = F.when(F.contains(text(c), F.lit("=")), formula).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.transform(F.concat(*plain, formula), normalize), lambda v: F.length(v) > 1)
    return head(F.array_distinct(found), most)


def contains_ci(haystack: Column, needle: Column) -> Column:
    return F.contains(F.lower(haystack), F.lower(needle))


def accessible(c: Column, connectives: tuple[str, ...]) -> Column:
    """A block for each sentence; a new sentence at ; and before connectives."""
    pattern = r"(?iu)(?=[ ,]) *, *(" + "|".join(connectives) + ") +"
    parted = lambda s: F.when(F.contains(s, F.lit(";")), F.regexp_replace(s, "(?=[ ;]) *; *", ". ")).otherwise(s)
    spoken = F.transform(sentences(c), lambda s: normalize(F.regexp_replace(parted(s), pattern, ". $1 ")))
    return F.array_join(F.filter(spoken, lambda s: s != ""), "\n\n")


def first_match(values: Column, test) -> Column:
    """The first value that passes, or null."""
    return F.get(F.filter(values, test), F.lit(0))


def first_matches(values: Column, test, most: int) -> Column:
    """The first values that pass, up to `most`; later ones aren't tried."""
    more = lambda found, v: F.when(test(v), F.concat(found, F.array(v))).otherwise(found)
    return F.aggregate(values, F.array().cast("array<string>"), lambda found, v: F.when(F.size(found) >= most, found).otherwise(more(found, v)))


def any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])
