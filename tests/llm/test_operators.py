"""The ten operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import bpe, exact_dedup, html_extract, mixing, ngram_join, pii_crf, quality_fm, quality_rules, queries, sharding, textkit, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old green garden near a quiet river bank today"
TEXTS = [
    None, "", "  \n\t ", "one", "Two words", BASE, BASE + " extra", BASE.upper(), BASE.replace("seven", "eight"), "x" * 5_000, LONG, LONG + " end", BASE, "a b\x0bc\x0cd\re f",
    "é ü 😀 <|endoftext|> 'll don't  double  spaces\n\nlines", "ha " * 40, "line one is here\nline one is here\nother line\n\n\n", "#$% |||| <> &&", "mail a.b@c-d.example.org, ip 10.0.0.255 or 1.2.3.999; card 4111 1111 1111 1111 tel +1 (555) 123-4567.",
]
ROWS = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], 7, "x") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*ROWS, ROWS[5], (None, "no name", None, "a", None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_shingles():
    for t in TEXTS:
        words = WORD.findall((t or "").encode().decode("latin-1"))
        data, offsets = textkit.utf8(pa.array([t]))
        starts, ends, _ = textkit.spans(data, offsets)
        assert [data[a:b].tobytes().decode("latin-1") for a, b in zip(starts, ends, strict=True)] == words
        low = [w.lower() if w.isascii() else w for w in WORD.findall(t or "")]
        expected = len({tuple(low[i : i + 5]) for i in range(len(low) - 4)}) if len(low) >= 5 else min(1, len(low))
        assert len(textkit.shingle_sets(pa.array([t]))[0]) == expected
    both = textkit.shingle_sets(pa.array(TEXTS))
    assert all((a == b).all() for a, b in zip(both, (textkit.shingle_sets(pa.array([t]))[0] for t in TEXTS), strict=True))


def _quality(t):
    words = WORD.findall(t or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {w for w, c in Counter(windows).items() if c > 1}
    marked = {j for i, w in enumerate(windows) if w in again for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked)


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t, *_ in ROWS:
        n = _quality(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == n
        assert got[i].base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (got[i].kept and got[i].base_failed)
    assert got[5].kept and not got[15].kept
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} <= set(TEXTS)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_bands_come_from_the_table(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(900)]
    weights = 1 / np.arange(1, 901)
    text = [" ".join(rng.choice(words, 700, p=weights / weights.sum())) for _ in range(120)]
    noise = [" ".join("".join(rng.choice(list(letters), 8)) for _ in range(480)) for letters in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(text + noise)), "doc_id long, text string")).collect()}
    assert all(got[i].kept for i in range(120))
    assert not any(got[i].base_failed or got[i].kept for i in range(120, 123))


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t in [(r[0], r[1]) for r in ROWS] + [(5, TEXTS[5]), (None, "no name")]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i, t))
    got = exact_dedup.deduplicate(docs).collect()
    assert len(got) == len(ROWS) + 2
    for r in got:
        group = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group) and r.keep_id == min(group, key=lambda x: x[:2] + (x[2] or 0,))[2]
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.kept_documents(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns
    assert exact_dedup.deduplicate(empty).count() == 0


def test_exact_dedup_parts_texts_of_one_digest(spark, monkeypatch):
    # a digest of the length alone, so that other texts clash
    monkeypatch.setattr(exact_dedup, "digest", lambda c: F.unhex(F.sha2(F.length(exact_dedup.normalised(c)).cast("string"), 256)))
    rows = [(1, "ab"), (2, "a b"), (3, "cd"), (None, "c d "), (5, "e"), (None, "xyz")]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=repr)
    assert found == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, None, 2, False), (None, None, 2, True), (5, 5, 1, True), (None, None, 1, True)], key=repr)


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    place = str(tmp_path)
    for rows in ([(1, "a b"), (2, "ab")], [(3, "a  b"), (4, "c")]):
        exact_dedup.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("locator", F.col("doc_id")).write.mode("append").parquet(f"{place}/prints")
        schema = spark.read.parquet(f"{place}/prints").schema
        groups = exact_dedup.stream_groups(spark.readStream.schema(schema).parquet(f"{place}/prints"), place)
    assert {(r.best.doc_id, r.group_size) for r in groups.collect()} == {(3, 3), (4, 1)}


def _near(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = [re.sub(r"[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            x = len(sets[a] & sets[b])
            if a < b and x and 100 * x >= 75 * (len(sets[a]) + len(sets[b]) - x):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs.where("doc_id is not null")).collect()}
    assert got == _near([(r[0], r[1]) for r in ROWS])
    assert ngram_join.near_duplicates(empty).count() == 0
    # rows without a doc_id are linked, but name no component
    every = spark.createDataFrame([(5, BASE), (None, BASE + " two"), (None, "alone without a name here"), (9, BASE + " extra"), (None, None)], "doc_id long, text string")
    rows = sorted(map(repr, ((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(every).collect())))
    assert rows == sorted(map(repr, [(5, 5), (None, 5), (None, None), (9, 5), (None, None)]))


def _thue_morse(rounds, a, b):
    x = a
    for _ in range(rounds):
        x += x.translate(str.maketrans(a + b, b + a))
    return x


def test_hashes_of_patterned_texts_differ(spark):
    for rounds in (9, 11, 12):
        one, two = _thue_morse(rounds, "a", "b"), _thue_morse(rounds, "b", "a")
        texts = pa.array([one, two, f"{one}\n{two}\n{one}"])
        data, offsets = textkit.utf8(texts)
        hashes = textkit.hash_spans(data, *textkit.spans(data, offsets)[:2])
        assert hashes[0] != hashes[1] and list(hashes[2:]) == [hashes[0], hashes[1], hashes[0]]
        assert list(quality_rules.counts(texts)["n_dup_lines"]) == [0, 0, 1]
        docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
        assert {(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("tile", [2_048, 16])
def test_near_duplicates_of_a_large_group(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    rows = []
    for i in range(260):
        own = list(base)
        for j in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            own[j] = f"e{i}x{j}"
        rows.append((i, " ".join(own)))
    rows += [(1_000 + i, " ".join(base[:40]) + " " + " ".join(rng.choice(words, 80))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()} == _near(rows)


def test_count_tree_loses_nothing():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (700, ngram_join.GROUPS))
    points[350:] = np.maximum(points[:350] + rng.integers(-1, 2, (350, ngram_join.GROUPS)), 0)
    sizes = points.sum(1)
    tree = ngram_join.CountTree(points, sizes)
    for i in range(0, 700, 13):
        bound = np.minimum(points, points[i]).sum(1)
        assert set(tree.search(points[i], sizes[i])) == set(np.flatnonzero(ngram_join.may_link(bound, sizes[i], sizes, sizes)))


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    total, weight, capped = sum(sizes.values()), dict(zip(["a", "b", None], (5, 2, 1), strict=True)), {}
    target = {}
    while True:
        rest = {k: w for k, w in weight.items() if k not in capped}
        left = total - sum(capped.values())
        target = {k: left * w / sum(rest.values()) for k, w in rest.items()} | capped
        over = {k: 3.0 * sizes[k] for k in rest if target[k] > 3 * sizes[k]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(mixing.mix_sources(docs.repartition(3)).collect())
    out = mixing.mixed_documents(docs)
    words = sum(len(WORD.findall(r.text)) for r in out.collect())
    assert out.columns == docs.columns and words == sum(taken.values())
    assert mixing.mix_sources(empty).count() == 0


def test_bpe_matches_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = bpe.decode_ids(bpe.encode_documents(docs)).collect()
    texts = {r[0]: r[1] for r in ROWS} | {None: "no name"}
    assert len(rows) == len(ROWS) + 2
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert sorted(map(repr, bpe.encode_documents(docs, decode=True).collect())) == sorted(map(repr, rows))
    own, rng = bpe.encoder("byte_bpe_50k.json"), np.random.default_rng(4)
    parts = ["a", "e", " ", "th", "\n", "\t", "é", "ß", "😀", "'s", "1", "²", "\x85", "\u00a0", "ing", "<|endoftext|>", "!!", "中文", "the", "nana", "\x1c"]
    for _ in range(2_000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert bpe.encode_documents(empty).count() == 0


def test_sharding(docs, empty):
    table = sharding.lookup_table(("a", "b", "c"), 1_009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(("a", "b"), 1_009)
    assert sum(x != y for x, y in zip(table, fewer, strict=True) if x < 2) < 300
    owner = sharding.lookup_table(sharding.SHARDS)
    for r in sharding.assign_shards(docs).collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r.slot == slot and r.shard == sharding.SHARDS[owner[slot]]
    assert sharding.assign_shards(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(("a",), 10)


@pytest.mark.parametrize("broadcast_blocks", [100_000, 0])
def test_url_filters(spark, broadcast_blocks):
    urls = ["https://WWW.Example.com/en/1?x#y", "http://blog.example.com/en/2", "https://a.example.com/fr/", "http://a.net/es/x", "http://net/fr/", "https://b.org/p/?utm_source=a", "http://www.b.org/p", None, "nonsense", "http://b.org/p?id=1", "x://h?q", ""]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    listed = spark.createDataFrame([("https://b.org/p",), (None,), ("https://b.org/p",)], "url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, listed, broadcast_blocks=broadcast_blocks).collect()}
    assert [got[i].verdict for i in range(len(urls))] == ["allow", "block", "allow", "block", "block", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert [got[i].rule for i in range(5)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/"]
    assert (got[0].host, got[0].path, got[7].host, got[8].path, got[10].host) == ("www.example.com", "/en/1", "", "", "h")
    assert url_filter.filter_urls(pages, listed.limit(0)).where("listed").count() == 0
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_url_list_is_an_argument(spark, tmp_path):
    urls = ["http://www.casino-win.example.org/a", "http://other.org/bad?utm_source=x", "http://other.org/good"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    verdicts = lambda df: [r.verdict for r in df.orderBy("page_id").collect()]
    assert verdicts(queries.op1_url_filters(spark, str(tmp_path))) == ["block", "allow", "allow"]
    assert verdicts(queries.op1_url_filters(spark, str(tmp_path), spark.createDataFrame([("https://www.other.org/bad",)], "url string"))) == ["allow", "block", "allow"]


def test_html_extraction(spark):
    page = '<html><head><title>T{i}</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy {i}</div>{body}<div class="notice">Cookies here</div><aside>Side</aside><footer>&copy; X</footer></body></html>'
    article = "<article><h1>Title {i}</h1><p><b>Bold &amp;  text\n{i}<br>more<p>Second &eacute;<form>no</form><section class='comments'><p>Reader</p></section></article>"
    plain = "<div><p>Only paragraph {i} here</p><div>Subscribe now</div></div>"
    rows = [(i, f"http://h.com/{i}", page.format(i=i, body=article.format(i=i)), 0) for i in range(4)] + [(10 + i, f"http://g.com/{i}", page.format(i=i, body=plain.format(i=i)), 0) for i in range(4)]
    rows += [(20, None, None, 0), (21, "x", "", 0), (22, "http://h.com/9", "<article><p>Cut &am", 0)]
    got = {r.page_id: r for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for i in range(4):
        assert got[i].text == f"Title {i}\nBold & text {i} more\nSecond é"
        assert got[10 + i].text == f"Only paragraph {i} here"
    assert (got[20].text, got[21].text, got[22].text) == ("", "", "Cut &am") and all(r.n_chars == len(r.text) for r in got.values())


def test_copies_of_a_page_are_not_its_template(spark):
    page = "<html><body><div>Menu of all</div><div>About us</div><p>{}</p><p>{}</p></body></html>"
    rows = [(i, "http://h.com/1", page.format("First copied", "Second copied")) for i in range(7)] + [(10, "http://h.com/1", page.format("First copied", "Second copied"))] * 2
    rows += [(20 + i, f"http://h.com/{i}", page.format(f"First {i}", f"Second {i}")) for i in range(3)]
    rows += [(30 + i, "http://g.com/1", page.format("Only", "this")) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "First copied\nSecond copied" for i in (*range(7), 10))
    assert all(got[20 + i] == f"First {i}\nSecond {i}" for i in range(3))
    assert all("Only\nthis" in got[30 + i] for i in range(3))


@pytest.mark.parametrize(
    "page",
    [
        "<body class='page has-sidebar'><p>Text</p></body>",
        "<body class='cookie-consent sidebar'><article><p>Text</p></article></body>",
        "<div id='main' class='content with-sidebar'><p>Text</p></div>",
        "<article class='post search-result'><p>Text</p></article>",
        "<article class='search'><p>Text</p></article>",
        "<body><form><nav>Menu</nav><article><p>Text</p></article></form></body>",
        "<body><form><nav>Menu</nav><p>Text</p></form><footer>Foot</footer></body>",
        "<form><main><article><p>Text</p><div class='comments'><article>Reader</article></div></article></main></form>",
        "<main><article><p>Text</p></article><div id='comments'><article class='comment'>Reader</article></div></main>",
        "<article><p>Text</p></article><aside><article>Teaser</article></aside><form><p>Mail</p></form>",
        "<main><div class='cookie-banner'>Cookies</div><p>Text</p></main>",
    ],
)
def test_wrappers_are_not_aside(page):
    assert html_extract.main_text(page, frozenset()) == "Text"


def brute_template(pages, moving, least=3):
    """The valid classes of one host's distinct pages, by their definition, without tokens known to move: positions of all tokens, and spans compared in pairs."""
    read = [html_extract.tokens_of(*html_extract.chunks(p)) for p in sorted(set(pages))]
    groups = {}
    for token in {t for r in read for t in r}:
        vector = tuple(r.count(token) for r in read)
        if sum(map(bool, vector)) >= max(least, len(read) / 2):
            groups.setdefault(vector, []).append((sum(r.index(token) for r in read if token in r), token))
    classes = [[t for _, t in sorted(g) if t not in moving] for g in groups.values()]
    valid = [c for c in classes if len(c) > 1]
    for members in valid:
        assert all([t for t in r if t in set(members)] == members * r.count(members[0]) for r in read)
    spans = {(n, members[0]): [[(i, t) for i, t in enumerate(r) if t in set(members)][k : k + len(members)] for k in range(0, r.count(members[0]) * len(members), len(members))] for n, r in enumerate(read) for members in valid}

    def crosses(n, inner, outer):
        return any(o[0][0] < i[0][0] < at < i[-1][0] < o[-1][0] for i in spans[n, inner[0]] for o in spans[n, outer[0]] for at, _ in o)

    valid = [inner for inner in valid if not any(crosses(n, inner, outer) for n in range(len(read)) for outer in valid)]
    return sorted(valid)


def test_template_equals_brute_force(spark):
    def page(i):
        blocks = "<p class='x'>Swap</p><div class='y'><p>Turn</p></div>" if i % 2 else "<div class='y'><p>Turn</p></div><p class='x'>Swap</p>"
        items = "".join(f"<li><a href=/{j}>Item {i} {j}</a></li>" for j in range(i % 3 + 1))
        return f"<html><body><div>Top line</div><ul>{items}</ul><section><h2>News {i}</h2><p>Text {i}</p></section>{blocks}<div>Bottom line</div></body></html>"

    pages = [page(i) for i in range(8)]
    rows = [(i, "http://h.com/1", p) for i, p in enumerate(pages + pages[:3] * 4)] + [(90, None, None), (91, "http://other.com", pages[0])]
    made = {r.host: r for r in html_extract.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    found, order = html_extract.chunks(pages[0])
    moving = {t for t, o in zip(html_extract.tokens_of(found, order), order, strict=True) if (found[o].text == "Swap" if isinstance(o, int) else o[-1] == "p class=x")}
    got = sorted(made["h.com"].classes)
    assert set(made) == {"h.com"} and len(moving) == 3
    assert got == brute_template(pages, moving) and len(got) == 2 and max(map(len, got)) >= 10


def test_longest_run():
    rng = np.random.default_rng(3)
    for n in range(7):
        for _ in range(30):
            positions = rng.permutation(n).tolist()
            best = max(bin(m).count("1") for m in range(1 << n) if (kept := [p for i, p in enumerate(positions) if m >> i & 1]) == sorted(kept))
            outside = html_extract.out_of_order(positions)
            kept = [p for i, p in enumerate(positions) if i not in outside]
            assert kept == sorted(kept) and len(kept) == best


def test_classes_that_overlap_are_not_nested():
    classes = [[1, 2, 3], [10, 11]]
    slots, broken = html_extract.walk([1, 10, 7, 11, 10, 11, 2, 7, 3], [None, None, 5, None, None, None, None, 5, None], classes)
    assert not broken and slots[2] != slots[7] and slots.count(None) == 7
    assert html_extract.walk([1, 10, 2, 11, 3], [None] * 5, classes)[1] == {1}
    assert html_extract.walk([2, 1, 3], [None] * 3, classes)[1] == {0}
    assert html_extract.settled([1, 10, 2, 7, 11, 3], [None, None, None, 5, None, None], classes)[3] == html_extract.walk([1, 2, 7, 3], [None, None, 5, None], classes[:1])[0][2]


def test_slots_and_constants_decide_where_no_article_is_marked(spark):
    page = "<html><body><div>Our shop</div><ul>{menu}</ul><h1>Head {i}</h1><p>{text}</p><div>Call us today</div></body></html>"
    menu = "<li><a href=/a>Go {i}</a></li><li><a href=/b>See {i}</a></li>"
    rows = [(i, f"http://h.com/{i}", page.format(i=i, menu=menu.format(i=i) + ("<li>Here 5</li>" if i == 5 else ""), text=f"<a href=/t>Linked {i}</a>" if i == 3 else f"Words of {i}")) for i in range(8)]
    rows += [rows[0]] * 2 + [(50, "http://h.com/50", "<div>Our shop</div>" + "<p>Long words.</p>" * 20_000), (51, "http://h.com/51", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract_text(df).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and sum(r.page_id == 0 for r in got) == 3
    for i in range(8):
        assert texts[i] == f"Head {i}\n" + (f"Linked {i}" if i == 3 else f"Words of {i}")
    alone = {r[0]: html_extract.main_text(r[2] or "", frozenset()) for r in rows}
    assert sum(alone[r] != texts[r] for r in range(8)) == 8  # with no template, constants stay
    assert texts[51] == "" and texts[50].count("Long words.") == 20_000
    assert html_extract.extract_text(df.limit(0)).collect() == []


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_boxes_of_little_text_are_no_article(spark):
    """Pages without an article mark: an advert, a link box and a teaser without names go by what their containers hold; headings, items and long boxes stay."""
    rng = np.random.default_rng(4)
    said = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        title, first, item, box, ad, teaser = said(6), said(60), said(12), said(40), said(7), said(5)
        lead = said(30) if i == 0 else None  # on one page only
        ads = f"<div class=b>{ad}</div>" if i % 4 else ""
        more = f"<div class=l><p>{lead}</p></div>" if lead else ""
        rows.append((i, "https://plain.example.org/x", f"<html><body><div id=post-{i}>{ads}<h1>{title}</h1>{more}<p>{first}</p><ul><li>{item}</li></ul><section>{box}</section></div><div class=c><p><b>{teaser}</b></p></div></body></html>", "x"))
        want[i] = "\n".join(x for x in (title, lead, first, item, box) if x)
    for host, n in (("two.example.org", 2), ("marked.example.org", 6)):
        for _ in range(n):
            i, ad, text = len(rows), said(5), said(50)
            mark = ("<article>", "</article>") if n > 2 else ("", "")
            rows.append((i, f"https://{host}/", f"<html><body>{mark[0]}<div>{ad}</div><p>{text}</p>{mark[1]}</body></html>", "x"))
            want[i] = f"{ad}\n{text}"  # too few pages, or marked as the article
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, light string")).collect()}
    assert {i: got[i] for i in range(12, len(rows))} == {i: want[i] for i in range(12, len(rows))}
    # each post's element has its own id, so its advert's path is a page's own: boxes are told by what most pages share
    assert all(got[i].endswith(want[i][-30:]) and rows[i][2].split("<b>")[1].split("</b>")[0] not in got[i] for i in range(12))
    same = [(i, u, re.sub(r" id=post-[0-9]+", "", t), x) for i, u, t, x in rows]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(same, "page_id long, url string, html string, light string")).collect()}
    assert got == want


def test_personal_data(spark, docs, empty):
    rng = np.random.default_rng(3)
    parts = ["a", "@", ".", "b.c", "1", "+", " ", "x@y.z", "@@", "-", "\n", "10.2.3.4"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts, rng.integers(0, 14)))
        assert [s[1:] for s in pii_crf.base_spans(text) if s[0] == "email"] == [m.span() for m in EMAIL.finditer(text)]
        assert [text[a:b] for a, b in pii_crf.candidates(text)] == [w for w in WORD.findall(text) if re.search(pii_crf.CANDIDATE, w)]
    got = {r.doc_id: r for r in pii_crf.find_personal_data(docs).collect()}
    assert [s.kind for s in got[18].base_spans] == ["email", "ip", "card", "phone"]
    assert all(set(r.base_spans) <= set(r.spans) for r in got.values()) and got[10].base_spans == []
    assert pii_crf.find_personal_data(empty).count() == 0


def _base(text):
    """The contract's patterns by the library's own search."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


TOKEN = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"


def _personal_texts():
    rng = np.random.default_rng(8)
    pick = lambda n: "".join(rng.choice(list("0123456789"), n))
    card = lambda: next(c for c in iter(lambda: pick(16), "") if pii_crf.luhn(c))
    texts = []
    for i in range(300):
        parts = [f"mail user{i}@host{i % 9}.example.com", f"call +1 ({pick(3)}) 555-{pick(4)}", f"from 10.{i % 256}.3.{i % 200}", f"paid {card()}", f'token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}"', f"version {i % 9}.0. and chapter {i}", "no numbers at all"]
        texts.append(f"{BASE}. " + " then ".join(parts[j] for j in sorted({i % 7, (i * 3 + 1) % 7})))
    return texts


def test_personal_data_beyond_the_patterns(spark, tmp_path):
    own = [
        ("a plain number 4111111111111112 of a card", "card", "4111111111111112"),
        ("please write to someone[at]host.example.org today", "email", "someone[at]host.example.org"),
        (f'here token = "{TOKEN}"### stands and far away after much text {BASE} it is named again as {TOKEN} without a cue', "secret", TOKEN),
    ]
    clean = ["Licensed under the Apache License, Version 2.0.", "On 2024-05-17 we met, 1999 of us, in 3 rooms.", BASE, "", None]
    texts = [*_personal_texts(), *[t for t, *_ in own], *clean]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_pii_crf(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = _base(t or "")
        r, written = got[i], ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii_crf.KINDS]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest() and set(filter(None, written.split(","))) <= set(r.spans.split(","))
    for i, (t, kind, part) in enumerate(own, 300):
        expected = {f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(re.escape(part), t)}
        assert expected == set(got[i].spans.split(",")), got[i].spans
    assert not any(got[i].has_personal_data for i in range(303, 308))


HASH = "24be9f8e7d6c5b4a39281706f5e4d3c2b1a006ff"
FOUND = [
    ("pay 4111 1111 1111 1112 now please", ["card:4111 1111 1111 1112"]), ("call me 555-123-4567 today", ["phone:555-123-4567"]), ("ring 0044 20 7946 0958 or not", ["phone:0044 20 7946 0958"]),
    ("write john (at) mail dot com now", ["email:john (at) mail dot com"]), ("order 2123465659789240 shipped", []), (f"commit {HASH} fixed it", []), (f"a bare {TOKEN} alone", []), ("the years 1914 1918 1939 1945 matter", []),
]
#: Results that only links give: full, and without them.
LINKED = [
    (f'token = "{TOKEN}" and far later {TOKEN} again', [f"secret:{TOKEN}"] * 2, [f"secret:{TOKEN}"]),
    (f'token = "{TOKEN}" and far later {TOKEN[:24]}… again', [f"secret:{TOKEN}", f"secret:{TOKEN[:24]}"], [f"secret:{TOKEN}"]),
    ("order 2123465659789240 and much later 2123465659789240 again", [], ["card:2123465659789240"]),
]


def test_links_decide(spark):
    """What the field finds, and that it finds other things with the links' potentials set to zero."""
    texts = _personal_texts()
    field = pii_crf.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))

    def found(text, field):
        g = pii_crf.graph([text], [0])
        return [f"{k}:{text[a:b]}" for k, a, b in pii_crf.added_spans(g, field.marginals(g), {0: text}, {0: pii_crf.base_spans(text)}, 0.9).get(0, [])]

    assert [found(t, field) for t, _ in FOUND] == [want for _, want in FOUND]
    assert [found(t, field) for t, _, _ in LINKED] == [want for _, want, _ in LINKED]
    without = field._replace(skip=np.zeros_like(field.skip))
    assert [found(t, without) for t, _, _ in LINKED] == [want for _, _, want in LINKED]
    groups = "pay 4111 1111 1111 1112 now"
    assert found(groups, field._replace(chain=np.full_like(field.chain, 0.0))) in ([], found(groups, field))


def test_field_over_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    long = " ".join(f"{rng.integers(0, 10**6)} word" for _ in range(20_000)) + f' token = "{TOKEN}" ' + "x " * 50_000 + TOKEN
    texts = [*_personal_texts(), long]
    got = pii_crf.find_personal_data(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")).where(f"doc_id = {len(texts) - 1}").first()
    assert [(s.kind, long[s.start : s.end]) for s in got.spans if s.kind == "secret"] == [("secret", TOKEN)] * 2


def test_loopy_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(5)
    field = pii_crf.Field(rng.normal(size=(pii_crf.N_FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    x = rng.normal(size=(3, pii_crf.N_FEATURES))
    g = pii_crf.Graph(np.zeros(3, int), np.zeros((3, 2), int), x, np.array([[0, 1]]), np.array([[1, 2]]))
    unary = x @ field.weights
    joint = unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None] + field.chain[:, :, None] + field.skip[None]
    p = np.exp(joint - joint.max())
    p /= p.sum()
    assert np.allclose(field.marginals(g, rounds=200), [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-3)


def test_factorisation_machine(spark, docs, empty):
    rng = np.random.default_rng(6)
    x = quality_fm.features(pa.array(TEXTS), np.zeros(len(TEXTS)))
    model = quality_fm.Model(rng.normal(size=quality_fm.WORDS + quality_fm.STATISTICS), rng.normal(size=(quality_fm.WORDS + quality_fm.STATISTICS, quality_fm.RANK)))
    got = model.logit(x)[0]
    for i in range(9):
        idx, val = x.index[x.edges[i] : x.edges[i + 1]], x.value[x.edges[i] : x.edges[i + 1]].astype(float)
        pairs = sum((model.v[idx[a]] @ model.v[idx[b]]) * val[a] * val[b] for a in range(len(idx)) for b in range(a))
        assert got[i] == pytest.approx(model.w[idx] @ val + pairs, rel=1e-4, abs=1e-3)
    good = [(i, " ".join(rng.choice(BASE.split(), 40))) for i in range(300)]
    bad = [(1_000 + i, " | ".join(rng.choice(BASE.split(), 40)) + " ###") for i in range(300)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1_000), 0) for i, _ in good + bad] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = [r for r in quality_fm.score_documents(table, labels).collect() if r.held_out]
    assert len(rows) > 80 and np.mean([(r.score >= 0.7) == (r.doc_id < 1_000) == bool(r.predicted) or (r.score < 0.7 and r.doc_id >= 1_000) for r in rows]) > 0.95
    assert {r.score for r in quality_fm.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_fm.score_documents(empty, labels).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(f"{w}{i * 7 + k if k % 3 == 0 else ''}" for k, w in enumerate(BASE.split())), "en", f"s{i % 3}", 9) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s0", 9), (101, rows[4][1] + " tail", "en", "s1", 9), (102, "short", "en", "s1", 5), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.count())
        assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[:3] == [32, 31, 30]
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(docs) == key(corpus_pipeline.run(spark, str(tmp_path)))
