"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from few templates. A page is taken as a sequence of tokens: the starts and ends of its structural
elements with their path of enclosing elements, and its text chunks with theirs. The host's template is deduced in steps:

1. Tokens are grouped by their occurrence vector: how often they occur on each page. Tokens that one template piece writes
   have equal vectors. A class has at least two tokens and is found on at least half of the host's distinct pages (three or more).
2. A class's tokens are ordered as on one of its pages, the one of least hash. Tokens that on more than 1 - `least_valid` of their pages are
   outside a longest run in that order leave the class. Then each page is walked with the classes as open and closed spans; a class is
   nested if its spans lie whole between two neighbouring tokens of the class around them (or outside all). Classes that are so
   on at least `least_valid` of their pages are valid; their nesting is the template. On a page that breaks a valid class, the walk is
   made again without that class.
3. What lies between two neighbouring tokens of the innermost open span is a slot, named by the open classes and the places
   in them. Text of valid classes is constant; all other text is in slots.
4. Element and name rules say for each chunk whether it may be the article's, and the chunks of a slot
   with the same path, on all pages of the host that mark their article alike, decide together by majority (an even split leaves each its own).
5. On pages that don't mark their article, slots also decide by what they hold over all pages of the host: the varying text of a
   container (what a chunk's paragraph stands in) on at least half of these pages is no article if it is on average less than `least_text` of the
   text of the page's largest container. So an advert without a name in a box of its own goes, and a heading beside the paragraphs stays.

The rules: a chunk isn't main text if it stands in a part that isn't the article by its element or by a name in its class,
id or role that consists of such words alone (menus, headers, footers, sidebars, notices, adverts, forms, comments).
The page itself, and what holds or is the page's only article, is no such part. If the page marks its article
(article, main), only chunks in it are main text; there, constant headings and paragraphs are kept (a sentence that all
articles of a host share is text), other constant chunks go as notices. Without such a mark, constant chunks go and so do chunks
that are only links.

Occurrence vectors are never held: the XOR over distinct pages of a hash of page and count stands for one, and is a
partial aggregate. Pages of equal html on a host count once, else many copies of one page would be its template; they
are found by digest and meet as token hashes, not as html. At most twice the mean number of tokens of a page can be on half of the pages, so a host's template is
small whatever the number of its pages; of slots only those of mixed verdicts are kept, as the others decide nothing. Templates are
broadcast while they hold at most `broadcast_tokens` hashes in all.

Defined cases: null and empty html give an empty text; broken, cut and unclosed mark-up is read as browsers do, roughly;
a null url is the host ''; hosts of fewer than three distinct pages have no template, so only the rules count; repeated rows
each get a row; an empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.frames import cut, stored
from folio.llm.url_filter import host_path

#: A comment, an element whose content isn't text, a tag, or a tag cut off by the end of the page.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strong sub sup time tt u var wbr br img label".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
#: What an opening tag ends without a closing tag.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ASIDE = frozenset("nav footer aside form dialog menu button select fieldset head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header menu modal nav navbar navigation newsletter "
    "notice notices alert popup promo promoted related replies reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
MAIN_WORDS = frozenset("article main".split())
#: Never aside.
PAGE = frozenset("html body".split())
SPACES = re.compile(r"\s+")


class Chunk(NamedTuple):
    """A block's text on a page."""

    text: str
    path: tuple[str, ...]
    main: bool
    aside: bool
    linked: bool


@lru_cache(maxsize=4_096)
def _element(name: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name in paths, whether it marks the article, and whether it is aside of it."""
    names, label = [], name
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        names += [words for n in value.split() if (words := {w for w in re.split(r"[_-]+", n) if w})]
        label += f" {kind.lower()}={value}"
    main = name in MAIN_WORDS or any(words & MAIN_WORDS and not words & ASIDE_WORDS for words in names)
    return label, main, name not in PAGE and (name in ASIDE or name == "header" or any(words <= ASIDE_WORDS for words in names))


class Aside(NamedTuple):
    """An element aside of the article by its own mark-up."""

    name: str
    above: tuple[int, ...]
    mains: tuple[int, ...]
    in_article: bool
    holds: list[int]


def _lifted(asides: list[Aside], blocks: list[tuple[str, tuple[str, ...], tuple[int, ...], tuple[int, ...], bool]]) -> set[int]:
    """The asides that don't count: from outside in, those that hold an article mark where the page has none beside them; and if no text is left, its forms.

    In an <article>, and where an article's text stands elsewhere, such marks are comments or teasers.
    """
    lifted: set[int] = set()
    while True:
        free = {m for b in blocks if lifted.issuperset(b[3]) for m in b[2]}
        more = {i for i, a in enumerate(asides) if i not in lifted and lifted.issuperset(a.above) and a.holds and not a.in_article and free <= {*a.mains, *a.holds}}
        if not more:
            break
        lifted |= more
    if not any(lifted.issuperset(b[3]) and not b[4] for b in blocks):
        lifted |= {i for i, a in enumerate(asides) if a.name == "form" and lifted.issuperset(a.above)}
    return lifted


def chunks(page: str) -> tuple[list[Chunk], list[int | tuple[str, ...]]]:
    """The page's blocks of text, and the order of all: numbers of blocks, paths of starting elements, and paths after "/" of ending ones."""
    stack: list[tuple[str, str, tuple[int, ...], tuple[int, ...]]] = []  # name, label, numbers of the article marks and of the asides above and here
    above: list[tuple[int, ...]] = []  # of each article mark, the asides above it
    asides: list[Aside] = []
    blocks: list[tuple[str, tuple[str, ...], tuple[int, ...], tuple[int, ...], bool]] = []
    order: list[int | tuple[str, ...]] = []
    text: list[str] = []
    links = [0, 0, 0]  # open links, letters, letters in links

    def flush() -> None:
        if text:
            joined = SPACES.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                top = stack[-1] if stack else ("", "", (), ())
                order.append(len(blocks))
                blocks.append((joined, tuple(s[1] for s in stack), top[2], top[3], links[1] > 0 and links[2] == links[1]))
            text.clear()
        links[1] = links[2] = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            order.append(("/", *(s[1] for s in stack)))
            stack.pop()

    def say(part: str) -> None:
        text.append(part)
        n = len(part) - part.count(" ")
        links[1] += n
        if links[0]:
            links[2] += n

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                links[0] = 0 if m[2] else 1
            continue
        flush()
        if m[2]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            links[0] = 0
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        while stack and stack[-1][0] in ENDS.get(name, ()):
            close(len(stack) - 1)
        label, is_main, is_aside = _element(name, m[4])
        mains, outer = (stack[-1][2], stack[-1][3]) if stack else ((), ())
        if name == "header" and mains:
            is_aside = False  # an article's own heading
        if name not in VOID:
            own = (*outer, len(asides)) if is_aside else outer
            if is_aside:
                asides.append(Aside(name, outer, mains, any(s[0] == "article" for s in stack), []))
            if is_main:
                for i in own:
                    asides[i].holds.append(len(above))
                mains = (*mains, len(above))
                above.append(outer)
            stack.append((name, label, mains, own))
            order.append(tuple(s[1] for s in stack))
    if at < len(page):
        say(page[at:])
    flush()
    close(0)
    lifted = _lifted(asides, blocks)
    return [Chunk(t, path, any(lifted.issuperset(above[m]) for m in mains), not lifted.issuperset(own), linked) for t, path, mains, own, linked in blocks], order


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


_path_hash = lru_cache(maxsize=50_000)(lambda path: _hash("\x00".join(path)))


def chunk_token(chunk: Chunk) -> int:
    return _hash(chunk.text) ^ (_path_hash(chunk.path) * 3 & 0x7FFFFFFFFFFFFFFF)


def tokens_of(found: list[Chunk], order: list[int | tuple[str, ...]]) -> list[int]:
    return [chunk_token(found[o]) if isinstance(o, int) else _path_hash(o) for o in order]


def rule_verdicts(found: list[Chunk]) -> tuple[list[bool], bool]:
    """Of each chunk whether the rules take it for main text, and whether the page marks its article."""
    marked = any(c.main and not c.aside for c in found)
    return [not c.aside and (c.main if marked else not c.linked) for c in found], marked


def chunk_place(chunk: Chunk, marked: bool) -> int:
    """Stands for a chunk's path, on pages that mark their article or on others."""
    return _path_hash(chunk.path) ^ (0x5555555555555555 if marked else 0)


# -- spans and slots


@lru_cache(maxsize=50_000)
def _slot(spans: tuple[tuple[int, int], ...]) -> int:
    return _hash(repr(spans))


def walk(tokens: list[int], places: list[int | None], classes: list[list[int]]) -> tuple[list[int | None], set[int]]:
    """Of each token with a place its slot and place as one number (None: constant, or no text), and the numbers of the classes that aren't ordered and nested here."""
    where = {t: (c, i) for c, members in enumerate(classes) for i, t in enumerate(members)}
    spans: list[list[int]] = []  # open ones: class, and the token that it waits for
    broken: set[int] = set()
    slots: list[int | None] = []
    for token, place in zip(tokens, places, strict=True):
        c, i = where.get(token, (-1, 0))
        if c < 0:
            slots.append(None if place is None else _slot(tuple((classes[k][0], n) for k, n in spans)) ^ place)
            continue
        slots.append(None)
        depth = next((d for d in range(len(spans) - 1, -1, -1) if spans[d][0] == c), -1)
        if depth < 0 and i == 0:
            spans.append([c, 1])
        elif depth >= 0 and spans[depth][1] == i:
            broken.update(k for k, _ in spans[depth + 1 :])
            del spans[depth + 1 :]
            spans[depth][1] += 1
            if spans[depth][1] == len(classes[c]):
                spans.pop()
        else:
            broken.add(c)
            if depth >= 0:
                del spans[depth]
    return slots, broken | {k for k, _ in spans}


def out_of_order(positions: list[int]) -> set[int]:
    """The numbers of the positions that are outside a longest rising run of them."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(positions)
    for n, position in enumerate(positions):
        k = bisect_left(ends, position)
        before[n] = last[k - 1] if k else -1
        ends[k:], last[k:] = [position, *ends[k + 1 :]], [n, *last[k + 1 :]]
    n = last[-1] if last else -1
    outside = set(range(len(positions)))
    while n >= 0:
        outside.discard(n)
        n = before[n]
    return outside


def settled(tokens: list[int], places: list[int | None], classes: list[list[int]]) -> list[int | None]:
    """`walk`'s slots by the classes that this page keeps to."""
    while True:
        slots, broken = walk(tokens, places, classes)
        if not broken:
            return slots
        classes = [members for c, members in enumerate(classes) if c not in broken]


# -- templates on Spark

ROW = "host string, digest binary, tokens array<long>, counts array<int>, firsts array<int>, sequence array<int>, places array<long>, verdicts array<boolean>, containers array<long>, sizes array<int>"


#: What stands between a paragraph and the container that it is in.
LISTS = frozenset("ul ol dl table tbody thead tfoot tr".split())
INSIDE = PARAGRAPHS | LISTS


@lru_cache(maxsize=50_000)
def container(path: tuple[str, ...]) -> int:
    """Stands for the path of the container that a chunk's paragraph, heading, item or cell is in, or of the element itself that holds bare text."""
    end = len(path)
    while end and path[end - 1].split(" ", 1)[0] in INSIDE:
        end -= 1
    return _path_hash(path[:end])


def _read(page: str) -> tuple[list[int], list[int], list[int], list[int], list[int | None], list[bool], list[int] | None, list[int] | None]:
    found, order = chunks(page)
    sequence = tokens_of(found, order)
    counts = Counter(sequence)
    number = {t: n for n, t in enumerate(counts)}
    firsts: dict[int, int] = {}
    for at, t in enumerate(sequence):
        firsts.setdefault(t, at)
    verdicts, marked = rule_verdicts(found)
    places = [chunk_place(found[o], marked) if isinstance(o, int) else None for o in order]
    return list(counts), list(counts.values()), list(firsts.values()), [number[t] for t in sequence], places, verdicts, None if marked else [container(c.path) for c in found], None if marked else [len(c.text) for c in found]


def _page_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.binary(), *map(pa.list_, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()))]
    for batch in batches:
        seen: dict[tuple[str, bytes], tuple] = {}
        for host, page in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            key = host, hashlib.blake2b((page or "").encode("utf-8", "replace"), digest_size=16).digest()
            if key not in seen:
                seen[key] = _read(page or "")
        columns = list(zip(*((*k, *v) for k, v in seen.items()), strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in ROW.split(", ")])


def _pages_with_classes(batch: pa.RecordBatch) -> Iterator[tuple[str, list[int], list[int | None], list[bool], list[list[int]]]]:
    """host, tokens in order, places, verdicts, classes; a host's classes are taken from Arrow once a batch."""
    known: dict[str, list[list[int]]] = {}
    hosts, tokens, sequences, places, verdicts = (batch.column(i).to_pylist() for i in range(5))
    for row, host in enumerate(hosts):
        if host not in known:
            known[host] = batch.column(5)[row].as_py()
        yield host, [tokens[row][n] for n in sequences[row]], places[row], verdicts[row], known[host]


def _tallies(found: Counter, broken: Counter, key: str) -> pa.RecordBatch:
    columns = {"host": pa.array([k[0] for k in found], pa.string()), key: pa.array([k[1] for k in found], pa.int64()), "pages": pa.array(found.values(), pa.int64()), "broken": pa.array([broken[k] for k in found], pa.int64())}
    return pa.RecordBatch.from_pydict(columns)


def _check_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, broken = Counter(), Counter()
        for host, sequence, _, _, classes in _pages_with_classes(batch):
            at = defaultdict(list)
            for n, t in enumerate(sequence):
                at[t].append(n)
            for members in classes:
                if members[0] in at:
                    found.update((host, t) for t in members)
                    broken.update({(host, members[n]) for k in range(len(at[members[0]])) for n in out_of_order([at[t][k] for t in members])})
        yield _tallies(found, broken, "token")


def _check_nesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, broken = Counter(), Counter()
        for host, sequence, places, _, classes in _pages_with_classes(batch):
            present = set(sequence)
            found.update((host, members[0]) for members in classes if members[0] in present)
            broken.update((host, classes[c][0]) for c in walk(sequence, places, classes)[1])
        yield _tallies(found, broken, "head")


TALLY = "host string, slot long, container long, number long, kept long, share double"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slot with a place its chunks and the kept ones; of each container on pages that don't mark their article those pages, and the sum of its varying text's shares of that of each page's largest one; slot and container null: all such pages."""
    for batch in batches:
        found, kept, pages, shares = Counter(), Counter(), Counter(), Counter()
        extra = zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)
        for (host, sequence, places, verdicts, classes), (containers, sizes) in zip(_pages_with_classes(batch), extra, strict=True):
            own = Counter()
            slots = (slot for slot, place in zip(settled(sequence, places, classes), places, strict=True) if place is not None)
            held = list(zip(slots, verdicts, strict=True))
            for slot, verdict in held:
                if slot is not None:
                    found[host, slot] += 1
                    kept[host, slot] += verdict
            if containers is not None:
                for (slot, _), of, size in zip(held, containers, sizes, strict=True):
                    if slot is not None:
                        own[of] += size
            if own:
                most = max(own.values())
                pages[host, None] += 1
                for of, size in own.items():
                    pages[host, of] += 1
                    shares[host, of] += size / most
        n, m = len(found), len(pages)
        columns = {
            "host": pa.array([k[0] for k in (*found, *pages)], pa.string()), "slot": pa.array([*(k[1] for k in found), *[None] * m], pa.int64()), "container": pa.array([*[None] * n, *(k[1] for k in pages)], pa.int64()),
            "number": pa.array([*found.values(), *pages.values()], pa.int64()), "kept": pa.array([*(kept[k] for k in found), *[0] * m], pa.int64()), "share": pa.array([*[0.0] * n, *(float(shares[k]) for k in pages)], pa.float64()),
        }
        yield pa.RecordBatch.from_pydict(columns)


def templates(pages: DataFrame, least_share: float = 0.5, least_pages: int = 3, least_tokens: int = 2, least_valid: float = 0.9, least_text: float = 0.2, broadcast_tokens: int = 2_000_000) -> DataFrame:
    """host, classes (the valid ones, their tokens in order), kept and dropped (slots with a place whose chunks are mostly main text, or mostly not, but not all), light (containers with too little text), over distinct pages."""
    named = pages.select(host_path(F.col("url"))[0].alias("host"), "html")
    once = named.mapInArrow(_page_digests, ROW).groupBy("host", "digest").agg(*(F.first(c).alias(c) for c in ("tokens", "counts", "firsts", "sequence", "places", "verdicts", "containers", "sizes")))
    each, drop = stored(once)
    occurrences = each.select("host", "digest", F.explode(F.arrays_zip("tokens", "counts", "firsts")).alias("t")).select("host", F.col("t.tokens").alias("token"), F.xxhash64("digest", "t.counts").alias("seen"), (F.shiftleft(F.xxhash64("digest"), 24) + F.col("t.firsts")).alias("place"))
    tokens = occurrences.groupBy("host", "token").agg(F.bit_xor("seen").alias("vector"), F.count("*").alias("pages"), F.min("place").alias("place")).where(F.col("pages") >= least_pages)
    total = each.groupBy("host").agg(F.count("*").alias("host_pages"))
    frequent = tokens.join(total, "host").where(F.col("pages") >= least_share * F.col("host_pages"))
    grouped = frequent.groupBy("host", "vector", "pages").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("members")).where(F.size("members") >= least_tokens)
    candidates = cut(grouped.select("host", F.col("members.token").alias("members")))

    def beside(classes: DataFrame, *more: str) -> DataFrame:
        lists = classes.groupBy("host").agg(F.array_sort(F.collect_list("members")).alias("classes"))
        return each.select("host", "tokens", "sequence", "places", "verdicts", *more).join(sized(lists, "classes", broadcast_tokens), "host")

    def sound(checked: DataFrame, key: str) -> DataFrame:
        return checked.groupBy("host", key).agg(F.sum("pages").alias("pages"), F.sum("broken").alias("broken")).where(F.col("broken") <= (1 - least_valid) * F.col("pages")).select("host", key)

    in_order = sound(beside(candidates).mapInArrow(_check_order, "host string, token long, pages long, broken long"), "token")
    numbered = candidates.select("host", F.col("members")[0].alias("of"), F.posexplode("members").alias("at", "token")).join(in_order, ["host", "token"])
    ordered = numbered.groupBy("host", "of").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("members")).where(F.size("members") >= least_tokens)
    ordered = cut(ordered.select("host", F.col("members.token").alias("members")))
    nested = sound(beside(ordered).mapInArrow(_check_nesting, "host string, head long, pages long, broken long"), "head")
    classes = cut(ordered.withColumn("head", F.col("members")[0]).join(nested, ["host", "head"]).select("host", "members"))
    tally = beside(classes, "containers", "sizes").select("host", "tokens", "sequence", "places", "verdicts", "classes", "containers", "sizes").mapInArrow(_vote, TALLY)
    tally = cut(tally.groupBy("host", "slot", "container").agg(F.sum("number").alias("number"), F.sum("kept").alias("kept"), F.sum("share").alias("share")))
    votes = tally.where("slot IS NOT NULL").select("host", "slot", F.col("number").alias("chunks"), "kept")
    mixed = votes.where((F.col("kept") > 0) & (F.col("kept") < F.col("chunks")) & (2 * F.col("kept") != F.col("chunks"))).withColumn("most", 2 * F.col("kept") > F.col("chunks"))
    slots = mixed.groupBy("host").agg(F.collect_list(F.when(F.col("most"), F.col("slot"))).alias("kept"), F.collect_list(F.when(~F.col("most"), F.col("slot"))).alias("dropped"))
    weighed = tally.where("slot IS NULL").select("host", "container", F.col("number").alias("pages"), "share")
    whole = weighed.where("container IS NULL").select("host", F.col("pages").alias("all_pages"))
    thin = weighed.where("container IS NOT NULL").join(whole, "host").where((F.col("pages") >= least_pages) & (F.col("pages") >= least_share * F.col("all_pages")) & (F.col("share") < least_text * F.col("pages")))
    light = thin.groupBy("host").agg(F.array_sort(F.collect_list("container")).alias("light"))
    made = cut(classes.groupBy("host").agg(F.array_sort(F.collect_list("members")).alias("classes")).join(slots, "host", "left").join(light, "host", "left"))
    drop()
    return made


def sized(made: DataFrame, column: str, most: int) -> DataFrame:
    """`made`, to be broadcast if its lists hold at most `most` numbers in all."""
    held = made.agg(F.sum(F.size(F.flatten(column)) + 8)).first()[0]
    return F.broadcast(made) if (held or 0) <= most else made


class Template(NamedTuple):
    """What a host's pages have in common."""

    classes: list[list[int]]
    kept: frozenset[int] = frozenset()
    dropped: frozenset[int] = frozenset()
    light: frozenset[int] = frozenset()


def main_text(page: str, template: Template | frozenset) -> str:
    """The page's chunks that are main text, joined by line feeds. An empty template is one of no classes."""
    found, order = chunks(page)
    verdicts, marked = rule_verdicts(found)
    if not template:
        return "\n".join(c.text for c, verdict in zip(found, verdicts, strict=True) if verdict)
    places = [chunk_place(found[o], marked) if isinstance(o, int) else None for o in order]
    out = []
    for o, slot in zip(order, settled(tokens_of(found, order), places, template.classes), strict=True):
        if not isinstance(o, int):
            continue
        if slot is None:  # constant
            keep = verdicts[o] and marked and any(p.split(" ", 1)[0] in PARAGRAPHS for p in found[o].path)
        else:
            keep = (slot in template.kept or verdicts[o] and slot not in template.dropped) and (marked or container(found[o].path) not in template.light)
        if keep:
            out.append(found[o].text)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, Template | frozenset] = {}
        for start in range(0, len(batch), 500):
            part = batch.slice(start, 500)
            texts = []
            for row, (host, page) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                if host not in known:
                    classes, *sets = (part.column(i)[row].as_py() for i in (4, 5, 6, 7))
                    known[host] = Template(classes, *(frozenset(x or ()) for x in sets)) if classes else frozenset()
                texts.append(main_text(page or "", known[host]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, broadcast_tokens: int = 2_000_000) -> DataFrame:
    """page_id, url, text, n_chars, a row for each page."""
    made = templates(pages, broadcast_tokens=broadcast_tokens)
    held = made.agg(F.sum(F.size(F.flatten("classes")) + F.coalesce(F.size("kept"), F.lit(0)) + F.coalesce(F.size("dropped"), F.lit(0)) + F.coalesce(F.size("light"), F.lit(0)) + 8)).first()[0] or 0
    named = pages.select("page_id", "url", host_path(F.col("url"))[0].alias("host"), "html")
    both = named.join(F.broadcast(made) if held <= broadcast_tokens else made, "host", "left").select("page_id", "url", "host", "html", "classes", "kept", "dropped", "light")
    return both.mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
