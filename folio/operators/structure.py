"""Hierarchy of a book: headings, chapters, sections, body paragraphs, from pages of text.

Lines are ordered by (page, line_no) inside a book. What a line inherits from all lines before it (its number, chapter and segment, the
container, the last heading of each level) is a scan on two levels: inside ranges of pages, then over one row a range, whose carry
goes back to the range's lines. So a huge book is many tasks; only its ranges' summaries meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.operators.cleaning import is_index_page
from folio.operators.places import written

NUMERAL = "[0-9ivxlcdm]+"
TITLE = r"(?: *[-–—:.] *(.+))?$"
# The heading patterns, in order of precedence.
PATTERNS = {
    "page": t.PAGE_NUMBER,
    "bullets": r"^[•·\-–—_=*]+$",
    "leader": r"\.{3,} *[0-9]{1,4}$",
    "container": rf"(?iu)^(?:parte|libro|unità|unita|modulo|tomo) +{NUMERAL}{TITLE}",
    "chapter": rf"(?iu)^(?:capitolo|chapter|cap\.) +{NUMERAL}{TITLE}",
    "section": rf"(?iu)^(?:sezione|section) +{NUMERAL}{TITLE}",
    "paragraph": r"(?iu)^(?:paragrafo|paragraph|§) *[0-9ivxlcdm.]+(?: *[-–—:.] *(.+))?$",
    "numbered": r"^([0-9]+(?:\.[0-9]+){0,5})[.)]? +(.{2,})$",
    "tail": r"^[0-9]+(?:[.,][0-9]+)?(?: |$)",
    "roman": r"(?iu)^([IVXLCDM]{1,8})[.)] +(.{2,})$",
    "letter": r"^([A-Z])[.)] +(.{2,})$",
    "named": r"(?iu)^(?:introduzione|premessa|prefazione|prologo|conclusioni?|epilogo|appendice|glossario|bibliografia|riepilogo)(?: |$)",
    "capitals": r"^[A-ZÀ-ÖØ-Ý0-9][A-ZÀ-ÖØ-Ý0-9 '\-–—,:()/&]+$",
}
# The older heading patterns.
LEGACY = {
    "part": rf"(?iu)^(?:parte|libro|unità|unita) +{NUMERAL}([^\p{{L}}\p{{N}}_]|$)",
    "chapter": rf"(?iu)^(?:capitolo|chapter) +{NUMERAL}([^\p{{L}}\p{{N}}_]|$)",
    "section": rf"(?iu)^(?:sezione|section|paragrafo) +{NUMERAL}([^\p{{L}}\p{{N}}_]|$)",
    "numbered": r"^([0-9]+(?:\.[0-9]+){0,4})[.)]? +(.+)$",
    "roman": r"(?iu)^([IVXLCDM]{1,8})[.)] +(.+)$",
    "capitals": r"^[A-ZÀ-ÖØ-Ý0-9][A-ZÀ-ÖØ-Ý0-9 '\-–—,:()]+$",
}

def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda w: w != ""))


def looks_like_sentence(c: Column) -> Column:
    return ((F.length(c) > 95) & c.rlike("[.!?]$")) | ((F.length(c) > 115) & c.rlike("[,;:]"))


def title_case_ratio(c: Column) -> Column:
    words = F.filter(F.split(c, " "), lambda w: w.rlike(f"[{t.LETTER}]"))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.rlike("^[A-ZÀ-ÖØ-Ý]"))) / F.size(words)).otherwise(0.0)


def _heading(family: str, depth, number: Column | None = None, bare: Column | None = None) -> Column:
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    none = F.lit(None).cast("string")
    return F.struct(F.lit(family).alias("family"), depth.cast("int").alias("depth"), (none if number is None else number).alias("number"), (F.lit(False) if bare is None else bare).alias("bare"))


def classify_heading(value: Column, surrounded: Column) -> Column:
    """family, depth, number, bare of a clean line, or null."""
    is_ = {k: value.rlike(p) for k, p in PATTERNS.items()}
    part = lambda k, i: F.regexp_extract(value, PATTERNS[k], i)
    number, whole = part("numbered", 1), ~looks_like_sentence(value)
    depth = F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    short = ~value.rlike("[.!?]$")
    return (
        F.when((value == "") | (F.length(value) > 140) | is_["page"] | is_["bullets"] | is_["leader"], F.lit(None))
        .when(is_["container"], _heading("container", 0))
        .when(is_["chapter"], _heading("chapter", 1, bare=F.trim(part("chapter", 1)) == ""))
        .when(is_["section"], _heading("section", 2))
        .when(is_["paragraph"], _heading("section", 3))
        .when(is_["numbered"] & whole & ~F.trim(part("numbered", 2)).rlike(PATTERNS["tail"]), _heading("numbered", depth, number))
        .when(is_["roman"] & whole, _heading("numbered", 1, part("roman", 1)))
        .when(is_["letter"] & whole, _heading("numbered", 2, part("letter", 1)))
        .when(is_["named"], _heading("named", 1))
        .when(is_["capitals"] & (F.length(value) <= 90) & (n_words(value) <= 12) & short, _heading("visual", 1))
        .when(surrounded & (F.length(value) <= 78) & (n_words(value) <= 10) & (title_case_ratio(value) >= 0.6) & ~value.rlike("[.!?;]$"), _heading("visual", 2))
    )


def classify_heading_legacy(line: Column) -> Column:
    """level, kind of the older rules for files without pages, or null."""
    return classify_trimmed_legacy(t.trim_all(t.text(line)))


def classify_trimmed_legacy(value: Column) -> Column:
    """The same of a line without white space at its ends."""
    is_ = {k: value.rlike(p) for k, p in LEGACY.items()}
    number = F.regexp_extract(value, LEGACY["numbered"], 1)
    level = F.least(F.lit(3), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    as_ = lambda n, kind: F.struct((n if isinstance(n, Column) else F.lit(n)).cast("int").alias("level"), F.lit(kind).alias("kind"))
    return (
        F.when((value == "") | (F.length(value) > 120) | value.rlike(t.PAGE_NUMBER) | value.rlike(r"^[•·\-–—_]+$"), F.lit(None))
        .when(is_["part"], as_(1, "part"))
        .when(is_["chapter"], as_(1, "chapter"))
        .when(is_["section"], as_(2, "section"))
        .when(is_["numbered"], as_(level, "numbered"))
        .when(is_["roman"], as_(1, "roman"))
        .when(is_["capitals"] & (F.length(value) <= 76) & (n_words(value) <= 10) & ~value.rlike("[.!?]$"), as_(1, "uppercase"))
    )


def explode_lines(pages: DataFrame) -> DataFrame:
    """book, page, line_no, line, value (clean), following (the next line's value), heading: the lines of pages (book, page, text), without index pages.

    Neighbours are looked up in the page's own array, so that lines need no exchange before they are classified.
    """
    kept = pages.where(~is_index_page(F.col("text"), F.col("page")))
    rows = kept.select("book", "page", F.split(F.regexp_replace(t.clean_block(F.col("text")), "\r", ""), "\n").alias("l"))
    rows = rows.withColumn("v", F.transform("l", lambda x: t.clean_block(x)))
    beside = lambda i, by: F.get("v", i + by)
    blank = lambda i: (F.coalesce(beside(i, -1), F.lit("")) == "") | (F.coalesce(beside(i, 1), F.lit("")) == "")
    each = F.transform("l", lambda x, i: F.struct(x.alias("line"), F.get("v", i).alias("value"), beside(i, 1).alias("following"), blank(i).alias("surrounded")))
    lines = rows.select("book", "page", F.posexplode(each).alias("line_no", "x")).select("book", "page", "line_no", "x.*")
    return lines.withColumn("heading", classify_heading(F.col("value"), F.col("surrounded")))


def heading_candidates(lines: DataFrame) -> DataFrame:
    return lines.where("heading is not null").select("book", "page", "line_no", F.col("value").alias("title"), "heading.family", "heading.depth", "heading.number", "heading.bare")


MODES = ("chapter", "container", "named")


def _mode(n: dict[str, Column], root_depth: Column) -> Column:
    return F.when(n["chapter"] >= 2, "chapter").when(n["container"] >= 2, "container").when(root_depth.isNotNull(), "numbered").when(n["named"] >= 2, "named").when(n["visual"] >= 2, "visual").otherwise("document")


def _counts(family: Column, depth: Column) -> dict[str, Column]:
    """Numbers of a book's headings by kind, and of numbered ones by depth."""
    out = {k: F.count_if(family == k) for k in MODES} | {"visual": F.count_if((family == "visual") & (depth == 1))}
    return out | {f"d{k}": F.count_if((family == "numbered") & (depth == k)) for k in range(1, 7)}


def _least_depth() -> Column:
    """The smallest depth with two numbered headings."""
    return F.coalesce(*[F.when(F.col(f"d{k}") >= 2, k) for k in range(1, 7)])


def choose_root_strategy(candidates: DataFrame) -> DataFrame:
    """book, mode, root_depth: which headings begin chapters."""
    counts = candidates.groupBy("book").agg(*[c.alias(k) for k, c in _counts(F.col("family"), F.col("depth")).items()]).withColumn("root_depth", _least_depth())
    mode = _mode({k: F.col(k) for k in (*MODES, "visual")}, F.col("root_depth"))
    return counts.select("book", mode.alias("mode"), F.when(mode == "numbered", F.col("root_depth")).alias("root_depth"))


def outline(pages: DataFrame, width: int = 64) -> DataFrame:
    """All lines with mode, role (root, container, section, body, consumed), chapter_no (0 before the first root), title, container, level, and the section stack.

    stack is the path of (level, title) at the line. A level is on it if its last heading is later than the last ones of
    all smaller levels since the last root or container. Classified lines are written once, in ranges of `width` pages.
    """
    family, depth = F.col("heading.family"), F.col("heading.depth")
    part = F.struct("book", F.floor(F.col("page") / width).alias("range"))
    lines = written(explode_lines(pages).withColumn("_part", part))
    of_book = Window.partitionBy("_part.book")
    parts = lines.groupBy("_part").agg(*[c.alias(k) for k, c in _counts(family, depth).items()])
    parts = parts.withColumns({k: F.sum(k).over(of_book) for k in _counts(family, depth)}).withColumn("root_depth", _least_depth())
    parts = parts.select("_part", "root_depth", _mode({k: F.col(k) for k in (*MODES, "visual")}, F.col("root_depth")).alias("mode"))
    # one exchange serves the windows by page and by range
    lines = lines.join(parts, "_part").repartition("_part")
    root = (
        F.when(F.col("mode").isin("chapter", "container"), (family == F.col("mode")) | (family == "named"))
        .when(F.col("mode") == "numbered", (family == "numbered") & (depth == F.col("root_depth")))
        .when(F.col("mode") == "named", family == "named")
        .when(F.col("mode") == "visual", (family == "visual") & (depth == 1))
    )
    on_page = Window.partitionBy("_part", "page").orderBy("line_no")
    lines = lines.withColumn("is_root", F.coalesce(root, F.lit(False)))
    # only a bare chapter line asks what the next line is
    following, bare = F.col("following"), F.col("is_root") & (family == "chapter") & F.col("heading.bare")
    next_family = F.when(bare, classify_heading(following, F.lit(True))["family"])
    merges = bare & (following != "") & (F.length(following) <= 90) & ~looks_like_sentence(following) & (next_family.isNull() | (next_family == "visual"))
    lines = lines.withColumn("merges", F.coalesce(merges, F.lit(False)))
    consumed = F.coalesce(F.lag("merges").over(on_page), F.lit(False))
    role = F.when(consumed, "consumed").when(family.isNull(), "body").when((family == "container") & (F.col("mode") == "chapter"), "container").when(F.col("is_root"), "root").otherwise("section")
    lines = lines.withColumn("role", role).withColumn("title", F.when(F.col("merges"), F.concat_ws(" — ", "value", "following")).when(F.col("role") != "body", F.col("value")))
    base = F.when(F.col("mode") == "numbered", F.col("root_depth")).otherwise(1)
    level = F.when(family == "section", F.greatest(F.lit(2), depth)).when(family == "numbered", F.greatest(F.lit(2), depth - base + 2)).otherwise(2)
    lines = lines.withColumn("level", F.when(F.col("role") == "section", F.least(F.lit(6), level)))
    # inside a range
    order = Window.partitionBy("_part").orderBy("page", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns(
        {
            "pos": F.row_number().over(order).cast("long"),
            "chapter_no": F.count_if(F.col("role") == "root").over(so_far),
            "segment": F.count_if(F.col("role").isin("root", "container", "section")).over(so_far),
            "container": F.last(F.when(F.col("role") == "container", F.col("title")), ignorenulls=True).over(so_far),
        }
    )
    lines = lines.withColumn("reset", F.max(F.when(F.col("role").isin("root", "container"), F.col("pos"))).over(so_far))
    lines = lines.withColumns({f"s{k}": F.max(F.when(F.col("level") == k, F.struct("pos", "level", "title"))).over(so_far) for k in range(2, 7)})
    # over ranges: what a range's last line has seen is carried to the ranges after it
    sums, lasts = ("pos", "chapter_no", "segment"), ("container", "reset", *[f"s{k}" for k in range(2, 7)])
    ends = lines.groupBy("_part").agg(F.max_by(F.struct(*sums, *lasts), "pos").alias("e"))
    earlier = Window.partitionBy("_part.book").orderBy("_part.range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_part", "e", *[F.coalesce(F.sum(f"e.{c}").over(earlier), F.lit(0)).alias(f"c_{c}") for c in sums])

    def later(c: str, of: str = "") -> Column:
        """A place in the range, or a heading there, by its number in the book."""
        if c == "reset":
            return F.col(f"{of}reset") + F.col("c_pos")
        return F.when(F.col(f"{of}{c}").isNotNull(), F.struct((F.col(f"{of}{c}.pos") + F.col("c_pos")).alias("pos"), F.col(f"{of}{c}.level").alias("level"), F.col(f"{of}{c}.title").alias("title")))

    held = {c: F.col("e.container") if c == "container" else later(c, "e.") for c in lasts}
    carry = carry.select("_part", *[f"c_{c}" for c in sums], *[F.last(v, ignorenulls=True).over(earlier).alias(f"c_{c}") for c, v in held.items()])
    lines = lines.join(carry, "_part")
    own = {c: F.col(c) if c == "container" else later(c) for c in lasts}
    lines = lines.withColumns({c: F.coalesce(v, F.col(f"c_{c}")) for c, v in own.items()}).withColumns({c: F.col(f"c_{c}") + F.col(c) for c in sums})
    lines = lines.withColumn("reset", F.coalesce("reset", F.lit(0)))
    entries, floor = [], F.col("reset")
    for k in range(2, 7):
        entries.append(F.when(F.col(f"s{k}.pos") > floor, F.col(f"s{k}")))
        floor = F.greatest(floor, F.coalesce(F.col(f"s{k}.pos"), F.lit(0)))
    stack = F.transform(F.filter(F.array(*entries), lambda e: e.isNotNull()), lambda e: F.struct(e["level"].alias("level"), e["title"].alias("title")))
    return lines.withColumn("stack", stack).select("book", "page", "line_no", "pos", "line", "value", "heading", "mode", "role", "title", "level", "chapter_no", "segment", "container", "stack")


def sections(lines: DataFrame) -> DataFrame:
    """book, chapter_no, section_no, title, level, numbering, page, parent, path."""
    order = Window.partitionBy("book", "chapter_no").orderBy("pos")
    path = F.transform("stack", lambda e: e["title"])
    return lines.where("role = 'section'").select(
        "book", "chapter_no", F.row_number().over(order).alias("section_no"), "title", "level", F.col("heading.number").alias("numbering"), "page", F.when(F.size(path) > 1, F.get(path, F.size(path) - 2)).alias("parent"), path.alias("path")
    )


def body_segments(lines: DataFrame) -> DataFrame:
    """book, page, segment, chapter_no, container, stack, body: text between headings, cut at the page's end."""
    body = lines.where("role = 'body'").groupBy("book", "page", "segment").agg(
        F.first("chapter_no").alias("chapter_no"), F.first("container").alias("container"), F.first("stack").alias("stack"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    return body.withColumn("body", t.clean_block(F.col("body"))).where("body <> ''")


def gather(pieces: Column, full) -> Column:
    """Pieces joined by spaces in order; a piece that finds the text so far full(text, piece) begins the next text."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, piece: Column) -> Column:
        ends = (acc["now"] != "") & full(acc["now"], piece)
        done = F.when(ends, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(ends | (acc["now"] == ""), piece).otherwise(F.concat_ws(" ", acc["now"], piece))
        return F.struct(done.alias("done"), now.alias("now"))

    return F.filter(F.aggregate(pieces, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"]))), lambda v: v != "")


def pack(pieces: Column, most: int) -> Column:
    """Greedy packs: pieces joined by a space while a pack stays within `most` characters."""
    return gather(pieces, lambda now, piece: F.length(now) + 1 + F.length(piece) > most)


def split_study_paragraphs(text: Column, longest: int = 1800, most: int = 1350) -> Column:
    """Blocks between empty lines; longer ones as packs of sentences."""
    source = t.clean_block(text)
    blocks = F.filter(F.transform(F.split(source, rf"\n{t.BLANK}*\n"), lambda b: t.clean_block(b)), lambda b: b != "")

    def parts(b: Column) -> Column:
        found = F.filter(F.transform(F.regexp_extract_all(b, F.lit(t.SENTENCE), F.lit(0)), lambda s: t.clean_block(s)), lambda s: s != "")
        return F.when(F.length(b) <= longest, F.array(b)).otherwise(t.let(found, lambda f: F.when(F.size(f) == 0, F.array(b)).otherwise(pack(f, most))))

    return F.flatten(F.transform(blocks, parts))


def _parted(clean: Column, pattern: str, keep: str = "") -> Column:
    """Clean text, which has no soft hyphens, cut at a pattern; a split by the pattern would compile it for each value."""
    return F.split(F.regexp_replace(clean, pattern, keep + "\u00ad"), "\u00ad")


def _blocks_legacy(clean: Column) -> Column:
    return F.filter(F.transform(_parted(clean, rf"\n{t.BLANK}*\n"), t.trim_all), lambda b: b != "")


def _sentences_legacy(clean: Column) -> Column:
    return _parted(clean, rf"([.!?]){t.BLANK}+(?=[A-ZÀ-ÖØ-Ý])", "$1")


def split_paragraphs_legacy(text: Column) -> Column:
    """The older split: sentences gathered to more than 700 characters, blocks of more than 1400 as packs of up to 1200."""
    clean = t.clean_text(text)
    blocks = _blocks_legacy(clean)
    grown = gather(F.transform(_sentences_legacy(clean), t.trim_all), lambda now, _: F.length(now) > 700)
    raw = F.when(F.size(blocks) > 1, blocks).otherwise(grown)
    return F.flatten(F.transform(raw, lambda b: F.when(F.length(b) <= 1400, F.array(b)).otherwise(pack(_sentences_legacy(b), 1200))))


def count_paragraphs_legacy(clean: Column) -> Column:
    """How many paragraphs split_paragraphs_legacy makes of a clean text, from its sentences' lengths alone; 0 if it is empty."""
    zero, one = F.lit(0), F.lit(1)
    lengths = lambda c: F.transform(_sentences_legacy(c), F.length)

    def packed(acc: Column, n: Column) -> Column:
        fresh = (acc["now"] == 0) | (acc["now"] + 1 + n > 1200)
        return F.struct(F.when(fresh, acc["packs"] + 1).otherwise(acc["packs"]).alias("packs"), F.when(fresh, n).otherwise(acc["now"] + 1 + n).alias("now"))

    packs = lambda b: F.aggregate(lengths(b), F.struct(zero.alias("packs"), zero.alias("now")), packed, lambda acc: acc["packs"])
    of_blocks = lambda blocks: F.aggregate(blocks, zero, lambda n, b: n + F.when(F.length(b) <= 1400, one).otherwise(packs(b)))

    # what is gathered is cut into the same sentences again when it is packed
    ended = lambda acc: F.when(acc["grown"] <= 1400, one).otherwise(acc["pack"]["packs"])
    none = F.struct(zero.alias("packs"), zero.alias("now"))

    def grow(acc: Column, n: Column) -> Column:
        ends = acc["grown"] > 700
        begins = ends | (acc["grown"] == 0)
        return F.struct(
            F.when(ends, acc["done"] + ended(acc)).otherwise(acc["done"]).alias("done"), F.when(begins, n).otherwise(acc["grown"] + 1 + n).alias("grown"), packed(F.when(begins, none).otherwise(acc["pack"]), n).alias("pack")
        )

    of_sentences = F.aggregate(lengths(clean), F.struct(zero.alias("done"), zero.alias("grown"), none.alias("pack")), grow, lambda acc: acc["done"] + ended(acc))
    return F.when(clean == "", zero).otherwise(t.let(_blocks_legacy(clean), lambda blocks: F.when(F.size(blocks) > 1, of_blocks(blocks)).otherwise(of_sentences)))


def paragraphs(segments: DataFrame) -> DataFrame:
    """book, chapter_no, para_no, page, paragraph, section_title, section_level, section_path, container."""
    each = segments.select("*", F.posexplode(split_study_paragraphs(F.col("body"))).alias("part", "paragraph"))
    order = Window.partitionBy("book", "chapter_no").orderBy("page", "segment", "part")
    deepest = F.get("stack", F.size("stack") - 1)
    return each.select(
        "book", "chapter_no", F.row_number().over(order).alias("para_no"), "page", "paragraph", deepest["title"].alias("section_title"), deepest["level"].alias("section_level"), F.transform("stack", lambda e: e["title"]).alias("section_path"), "container"
    )


def chapters(lines: DataFrame) -> DataFrame:
    """book, chapter_idx, chapter_no, title, numbering, container, page_start, page_end, n_sections, n_paragraphs; chapters without sections and text go.

    A chapter's end is the last page it has text on, but before the next chapter's start. A book that no chapter is
    left of is one, `Documento`, from its first to its last page. The lines of a book meet once.
    """
    role = F.col("role")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(role == "body", F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    root = F.struct("title", F.col("heading.number").alias("numbering"), "container", "page")
    parts = lines.groupBy("book", "page", "segment").agg(
        F.first("chapter_no").alias("chapter_no"), F.max(F.when(role == "root", root)).alias("root"), F.count_if(role == "section").alias("sections"), F.min(F.when(role == "section", F.struct("pos", "page"))).alias("first_section"),
        F.size(split_study_paragraphs(body)).alias("paragraphs"),
    )
    some = F.when(F.col("paragraphs") > 0, F.col("page"))
    every = parts.groupBy("book", "chapter_no").agg(
        F.max("root").alias("root"), F.sum("sections").alias("n_sections"), F.min("first_section").alias("first_section"), F.sum("paragraphs").alias("n_paragraphs"), F.min(some).alias("first_page"), F.max(some).alias("last_page"),
        F.min("page").alias("least_page"), F.max("page").alias("most_page"),
    )
    whole = Window.partitionBy("book")
    held = (F.col("n_sections") > 0) | (F.col("n_paragraphs") > 0)
    every = every.withColumns({"none": F.count_if(held).over(whole) == 0, "b_start": F.min("least_page").over(whole), "b_end": F.max("most_page").over(whole), "b_first": F.min("chapter_no").over(whole)})
    every = every.where(held | (F.col("none") & (F.col("chapter_no") == F.col("b_first"))))
    start = F.when(F.col("none"), F.col("b_start")).otherwise(F.coalesce("root.page", F.least(F.col("first_section.page"), F.col("first_page"))))
    every = every.withColumns({"page_start": start, "end": F.when(F.col("none"), F.col("b_end")).otherwise(F.greatest(start, F.coalesce("last_page", F.lit(0))))})
    order = Window.partitionBy("book").orderBy("chapter_no")
    following = F.lead("page_start").over(order)
    end = F.when(following.isNotNull(), F.greatest(F.col("page_start"), F.least(F.col("end"), following - 1))).otherwise(F.col("end"))
    own = lambda c, other=None: F.when(~F.col("none"), F.coalesce(F.col(f"root.{c}"), F.lit(other)))
    return every.select(
        "book", F.row_number().over(order).alias("chapter_idx"), "chapter_no", F.coalesce(own("title", "Introduzione"), F.lit("Documento")).alias("title"), own("numbering").alias("numbering"), own("container").alias("container"), "page_start", end.alias("page_end"), "n_sections", "n_paragraphs"
    )


def detect_chapters(texts: DataFrame) -> DataFrame:
    """Chapters of texts without pages (book, text): each is read as one page."""
    return chapters(outline(texts.select("book", F.lit(1).alias("page"), "text")))


def structure_stats(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """book, pages, skipped index pages, chapters, sections, paragraphs, max_depth."""
    total = pages.groupBy("book").agg(F.count("*").alias("pages"), F.count_if(is_index_page(F.col("text"), F.col("page"))).alias("index_pages"))
    found = chapters(lines).groupBy("book").agg(F.count("*").alias("chapters"), F.sum("n_sections").alias("sections"), F.sum("n_paragraphs").alias("paragraphs"))
    deep = lines.groupBy("book").agg(F.coalesce(F.max("level"), F.lit(0)).alias("max_depth"))
    return total.join(found, "book", "left").join(deep, "book", "left")


def chapters_from_blocks(blocks: DataFrame) -> DataFrame:
    """Typed blocks (doc_id, block_seq, block_type, level, text) with chapter_no (a level-1 heading begins one), the chapter's title and the section path."""
    so_far = Window.partitionBy("doc_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("block_type") == "heading"
    root = heading & (F.col("level") <= 1)
    out = blocks.withColumns({"chapter_no": F.count_if(root).over(so_far), "chapter_title": F.coalesce(F.last(F.when(root, F.col("text")), True).over(so_far), F.lit("Documento")), "reset": F.coalesce(F.max(F.when(root, F.col("block_seq"))).over(so_far), F.lit(-1))})
    entries, floor = [], F.col("reset")
    for k in range(2, 7):
        last = F.max(F.when(heading & (F.col("level") == k), F.struct("block_seq", "text"))).over(so_far)
        out = out.withColumn(f"s{k}", last)
    for k in range(2, 7):
        entries.append(F.when(F.col(f"s{k}.block_seq") > floor, F.col(f"s{k}.text")))
        floor = F.greatest(floor, F.coalesce(F.col(f"s{k}.block_seq"), F.lit(-1)))
    return out.withColumn("section_path", F.filter(F.array(*entries), lambda e: e.isNotNull())).drop("reset", *[f"s{k}" for k in range(2, 7)])


def root_level_legacy(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, line) with their older heading and whether it begins a chapter: at the document's least level."""
    known = lines.withColumn("heading", classify_heading_legacy(F.col("line")))
    least = F.min("heading.level").over(Window.partitionBy("doc_id"))
    return known.withColumns({"root_level": least, "is_root": F.coalesce(F.col("heading.level") == least, F.lit(False))})


def parts_legacy(pages: DataFrame, counted: bool = True) -> DataFrame:
    """book, page, line_no, level, title, has_text and, if counted, n (of paragraphs): pages (book, page, text) cut before each older heading.

    Level and title are null for what comes before a page's first heading. All of a page is done in its row.
    """
    rows = pages.select("book", "page", F.split(t.clean_text(F.col("text")), "\n").alias("l"))
    rows = rows.withColumn("level", F.transform(F.transform("l", t.trim_all), lambda v: classify_trimmed_legacy(v)["level"]))
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: (i == 0) | F.get("level", i).isNotNull()))

    def part(i: Column, k: Column) -> Column:
        head = F.get("level", i).isNotNull().cast("int")
        body = F.slice("l", i + head + 1, F.coalesce(F.get("at", k + 1), F.size("l")) - i - head)
        return F.struct(i.alias("line_no"), F.get("level", i).alias("level"), F.when(head == 1, t.trim_all(F.get("l", i))).alias("title"), F.array_join(body, "\n").alias("body"))

    each = rows.select("book", "page", F.explode(F.transform("at", part)).alias("x")).select("book", "page", "x.*")
    # lines of a clean text need no more than trimming, unless a word is still broken
    body = F.when(F.contains("body", F.lit("-\n")), t.clean_text(F.col("body"))).otherwise(t.trim_all(F.col("body")))
    each = each.withColumn("body", body).withColumn("has_text", F.col("body") != "")
    return (each.withColumn("n", count_paragraphs_legacy(F.col("body"))) if counted else each).drop("body")


def placed_legacy(parts: DataFrame, width: int = 64) -> DataFrame:
    """Parts with their root (begins a chapter) or section, chapter_no, segment (headings so far), next heading, and what holds of the whole book.

    Parts are written once, without their text. Only a row for each range of `width` pages meets with those of its book.
    """
    parts = written(parts.withColumn("_part", F.struct("book", F.floor(F.col("page") / width).alias("range"))))
    level, levels, place = F.col("level"), (1, 2, 3), F.struct("page", "line_no", "level")
    ranges = parts.groupBy("_part").agg(
        *[F.count_if(level == k).alias(f"d{k}") for k in levels], F.count("level").alias("heads"), F.count_if("has_text").alias("texts"), F.min("page").alias("least"), F.max("page").alias("most"),
        F.min(place).alias("first"), F.min(F.when(level.isNotNull(), place)).alias("head"),
    )
    whole = Window.partitionBy("_part.book")
    earlier = whole.orderBy("_part.range").rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(F.desc("_part.range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("root_level", F.coalesce(*[F.when(F.sum(f"d{k}").over(whole) > 0, k) for k in levels]))
    roots = F.coalesce(*[F.when(F.col("root_level") == k, F.col(f"d{k}")) for k in levels], F.lit(0))
    empty = (F.sum("texts").over(whole) == 0) & (F.sum(F.col("heads") - roots).over(whole) == 0)
    begins_with_root = F.coalesce(F.min("first").over(whole)["level"] == F.col("root_level"), F.lit(False))
    ranges = ranges.select(
        "_part", "root_level", F.coalesce(F.sum(roots).over(earlier), F.lit(0)).alias("c_chapter"), F.coalesce(F.sum("heads").over(earlier), F.lit(0)).alias("c_segment"), F.min("head").over(later).alias("c_next"),
        (F.col("root_level").isNull() | empty).alias("none"), F.min("least").over(whole).alias("b_start"), F.max("most").over(whole).alias("b_end"), begins_with_root.cast("int").alias("b_first"),
    )
    order = Window.partitionBy("_part").orderBy("page", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    is_root = F.coalesce(level == F.col("root_level"), F.lit(False))
    parts = parts.join(ranges, "_part").withColumns({"root": is_root, "section": level.isNotNull() & ~is_root})
    return parts.withColumns({"chapter_no": F.col("c_chapter") + F.count_if("root").over(so_far), "segment": F.col("c_segment") + F.count("level").over(so_far)})


def _chapter_sums(placed: DataFrame, *more: Column) -> DataFrame:
    """Of each chapter its root, number of sections, first segment, first page with text or a section, and last page with text."""
    own = F.col("has_text") | F.col("section")
    return placed.groupBy("book", "chapter_no").agg(
        F.max(F.when(F.col("root"), F.struct("page", "title"))).alias("root"), F.count_if("section").alias("n_sections"), F.count_if("has_text").alias("n_texts"), F.min("segment").alias("segment"),
        F.min(F.when(own, F.struct("segment", "page", (~F.col("section")).alias("text_first")))).alias("begins"), F.max(F.when(F.col("has_text"), F.col("page"))).alias("last_page"), *more,
    )


def chapters_legacy(placed: DataFrame) -> DataFrame:
    """book, chapter_no, title, page_start, page_end, n_sections, n_paragraphs of placed parts with n; chapters without sections and text go.

    Text before the first chapter is `Introduzione`, sections before it `Documento`; a book without headings, or without text, is one `Documento`.
    """
    sums = _chapter_sums(placed, F.sum("n").alias("n_paragraphs"), *[F.first(c).alias(c) for c in ("none", "b_start", "b_end", "b_first")])
    of = lambda book, own: F.when(F.col("none"), book).otherwise(own)
    title = F.coalesce("root.title", F.when(F.col("begins.text_first"), "Introduzione").otherwise("Documento"))
    start = F.coalesce("root.page", "begins.page")
    return sums.where(of(F.col("chapter_no") == F.col("b_first"), (F.col("n_sections") > 0) | (F.col("n_texts") > 0))).select(
        "book", "chapter_no", of(F.lit("Documento"), title).alias("title"), of(F.col("b_start"), start).alias("page_start"), of(F.col("b_end"), F.coalesce("last_page", start)).alias("page_end"), "n_sections", "n_paragraphs"
    )


def sections_legacy(placed: DataFrame) -> DataFrame:
    """book, chapter_no, section_no, title, level, page_start, page_end (before the next section, or the chapter's end) of placed parts.

    All headings from a chapter's root to a section are its sections, so segments number them.
    """
    following = F.lead(F.struct("page", "line_no", "level")).over(Window.partitionBy("_part").orderBy("page", "line_no"))
    each = placed.where("level is not null").withColumn("next", F.coalesce(following, F.col("c_next"))).where("section")
    following = F.when(F.col("next.level") != F.col("root_level"), F.col("next.page"))
    sums = _chapter_sums(placed).where("n_sections > 0")
    ends = sums.select("book", "chapter_no", F.when(F.col("chapter_no") > 0, F.col("segment")).otherwise(0).alias("before"), F.coalesce("last_page", "root.page", "begins.page").alias("of"))
    return each.join(ends, ["book", "chapter_no"]).select(
        "book", "chapter_no", (F.col("segment") - F.col("before")).cast("int").alias("section_no"), "title", F.greatest(F.lit(2), F.col("level") - F.col("root_level") + 1).alias("level"), F.col("page").alias("page_start"),
        F.when(following.isNotNull(), F.greatest(F.col("page"), following - 1)).otherwise(F.col("of")).alias("page_end"),
    )


def build_structure_legacy(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters and sections of pages (book, page, text) by the older headings: those of the book's least level begin chapters, others sections."""
    placed = placed_legacy(parts_legacy(pages))
    return chapters_legacy(placed), sections_legacy(placed)


def choose_structure(legacy: DataFrame, rebuilt: DataFrame, paged: DataFrame) -> DataFrame:
    """Chapters (doc_id, title, ...) by document: the older ones, or the rebuilt ones where there are any and the document has pages (doc_id in `paged`), no older chapter, or a single `Documento`."""
    counts = legacy.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("title").alias("only"))
    keep = counts.join(paged.select("doc_id").distinct(), "doc_id", "left_anti").where(~((F.col("n") == 1) & (F.lower("only") == "documento"))).select("doc_id")
    taken = rebuilt.join(keep, "doc_id", "left_anti")
    return legacy.join(taken.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(taken, allowMissingColumns=True)
