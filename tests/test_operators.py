"""Operators that SQL doesn't check: invariants, small fixtures and plain-Python models."""

import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folio.functions import text as t
from folio.functions.lexicon import ITALIAN
from folio.functions.lexicon import MIXED as LANGUAGES
from folio.operators import answers, artefacts, audit, batches, budget, cleaning, glossary, incremental, places, segmentation, structure, summary
from folio.sources import files, sinks

ENTRY = "array<struct<term: string, definition: string, placement: string, basis: string>>"


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "long", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(values[n])]}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_cleaning(spark):
    assert one(spark, t.clean_text(F.col("a")), a="so­ft pa-\nrola  x \t\n\n\n\ny ") == "soft parola x\n\ny"
    assert one(spark, t.sentences(F.col("a")), a="Vale 3.5 euro. Bene!! ...") == ["Vale 3.", "5 euro.", "Bene!!", "..."]
    assert one(spark, t.sentences(F.col("a")), a="...") == ["..."]
    assert one(spark, t.unique_ci(F.col("a"), 2), a=["A  b", "a B", "", "c", "d"]) == ["A b", "c"]
    assert one(spark, t.anchors(F.col("a")), a="Nel 1492 la NATO e x = 3 y, 50% di XIV") == ["1492", "50", "NATO", "XIV", "x = 3 y"]
    assert one(spark, cleaning.needs_ocr(F.col("a")), a=None) is True


def test_book_structure(spark):
    """600 pages, 80 chapters of 7 pages with sections, index pages; a control number on each page."""
    pages = [("b", n, "Indice\n" + "\n".join(f"Voce {k} ....... {k}" for k in range(8))) for n in range(1, 7)]
    for n in range(7, 601):
        k, at = (n - 7) // 7 + 1, (n - 7) % 7
        head = f"Capitolo {k}\nTitolo {k}\n\n{k}.1 Prima parte\n\n" if at == 0 else f"{k}.1.1 Dettaglio\n\n" if at == 2 else f"{k}.2 Seconda parte\n\n" if at == 4 else ""
        pages.append(("b", n, f"{head}Il valore di controllo e {n} in questa pagina. Segue altro testo."))
    lines = structure.outline(spark.createDataFrame(pages, "book string, page int, text string"))
    chapters = structure.chapters(lines).orderBy("chapter_idx").collect()
    assert len(chapters) == 85 and [c.title for c in chapters[:2]] == ["Capitolo 1 — Titolo 1", "Capitolo 2 — Titolo 2"]
    assert all(a.page_end < b.page_start for a, b in zip(chapters, chapters[1:], strict=False))
    paths = {r.title: r for r in structure.sections(lines).where("chapter_no = 1").collect()}
    assert paths["1.1.1 Dettaglio"].path == ["1.1 Prima parte", "1.1.1 Dettaglio"] and paths["1.2 Seconda parte"].parent is None
    paras = structure.paragraphs(structure.body_segments(lines)).collect()
    assert {n for p in paras for n in [p.page]} == set(range(7, 601)) and all(str(p.page) in p.paragraph for p in paras)


def test_long_paragraph_and_batches(spark):
    long = " ".join(f"parola{i}" for i in range(3_000))
    chunks = one(spark, batches.chunk_long(F.col("a")), a=long)
    assert len(chunks) > 1 and max(map(len, chunks)) <= 4_200 and " ".join(chunks) == long
    assert "".join(one(spark, batches.chunk_long(F.col("a")), a="x" * 9_000)) == "x" * 9_000
    rows = [("b", c, i, "y" * (5_000 if i % 3 else 100)) for c in (1, 2) for i in range(20)]
    got = batches.make_batches(spark.createDataFrame(rows, "book string, chapter_no int, para_no int, text string"), ["book", "chapter_no"], "para_no").collect()
    assert len(got) == 40
    for c in (1, 2):
        b = sorted((r.para_no, r.batch_no, r.n_chars) for r in got if r.chapter_no == c)
        current, n, size = 0, 0, 0
        for _, number, chars in b:
            if n and (n >= 5 or size + chars > 18_000):
                current, n, size = current + 1, 0, 0
            assert number == current
            n, size = n + 1, size + chars


def test_responses(spark):
    good = '{"summaries": [{"summary": " A b ", "dsaSummary": "c", "keyPoints": ["k"], "remember": [], "keywords": ["w"], "glossary": [{"term": "fonte", "definition": "d", "placement": "side", "basis": "source"}, {"term": "assente", "definition": "d"}]}]}'
    rows = [(1, 1, good), (2, 1, f"```json\n{good}\n```"), (3, 1, "{broken"), (4, 2, good)]
    valid = batches.validate_responses(spark.createDataFrame(rows, "batch_id int, n_items int, payload string"))
    assert {r.batch_id: r.error for r in valid.collect()} == {1: None, 2: None, 3: "INVALID_JSON", 4: "WRONG_COUNT"}
    out = batches.normalize_responses(valid, spark.createDataFrame([(1, 0, "La fonte"), (2, 0, "x")], "batch_id int, item_idx int, source string")).orderBy("batch_id").collect()
    assert [r.summary for r in out] == ["A b", "A b"] and [e.term for e in out[0].glossary] == ["fonte"] and out[1].glossary == []
    said = batches.validate_answers(spark.createDataFrame([('{"answer": " x ", "basis": "general", "label": "l"}',), ("no",)], "payload string")).collect()
    assert [(r.answer, r.basis, r.error) for r in said] == [("x", "general", None), ("", "source", "NO_ANSWER")]


def test_response_terms_of_odd_case(spark):
    rows = [(["Maß", "MASSE", "maß", "MAẞ"], "Das Maß der Masse"), (["MASSE", "Maß"], "Das Maß"), (["ΟΔΟΣ", "οδοσ", "λόγος"], "ΟΔΟΣ\u2019Α")]
    given = spark.createDataFrame(rows, "terms array<string>, source string")
    entries = F.transform("terms", lambda v: F.struct(v.alias("term"), F.lit("d").alias("definition"), F.lit("side").alias("placement"), F.lit("source").alias("basis")))
    got = given.select("source", batches.response_glossary(entries, F.col("source")).alias("g")).collect()
    assert [[e.term for e in r.g] for r in got] == [["Maß", "MASSE"], ["Maß"], ["ΟΔΟΣ", "οδοσ"]]


def test_ocr_cache(spark):
    pages = spark.createDataFrame([(1, 1, "poco", "embedded"), (1, 2, "x" * 100, "embedded"), (1, 3, "breve testo", "embedded")], "doc_id int, page_number int, text string, text_source string")
    cache = spark.createDataFrame([(1, 1, "testo letto"), (1, 2, "y" * 200), (1, 3, "b")], "doc_id int, page_number int, text string")
    got = cleaning.apply_ocr_cache(pages, cache).orderBy("page_number").collect()
    assert [(r.text[:5], r.text_source) for r in got] == [("testo", "ocr-resume"), ("xxxxx", "embedded"), ("breve", "embedded")]
    assert cleaning.ocr_stats(spark.createDataFrame(got)).first().resumed == 1


def study(spark):
    rows = []
    for i in range(4):
        entry = [(f"termine{i}", f"definizione numero {i}", "inline", "source")]
        rows.append(("c", i, f"Sezione {i // 2}", f"Originale {i}.", f"Il riassunto del passaggio {i} parla di termine{i}.", "", [f"Punto chiave importante numero {i}"], [f"Da ricordare sempre il fatto {i}"], [f"parola{i}"], entry, "locale", 0))
    return spark.createDataFrame(rows, f"book string, para int, section string, original string, summary string, accessible string, key_points array<string>, remember array<string>, keywords array<string>, glossary {ENTRY}, engine string, fidelity_recovered int")


def test_artefacts(spark):
    paras = study(spark)
    assert artefacts.flashcards(paras, ["book"], "para").count() == 16
    asked = artefacts.quiz(paras, ["book"], "para").collect()
    assert len(asked) == 8 and all(q.options[q.correct_index] == q.explanation and len(set(q.options)) == len(q.options) >= 3 for q in asked)
    assert artefacts.oral_questions(paras, ["book"], "para").count() == 8 and artefacts.concept_map(paras, ["book"], "para").count() == 4
    score = artefacts.score_quiz(spark.createDataFrame(asked), spark.createDataFrame([("c", q.question_no, q.correct_index) for q in asked], "book string, question_no int, chosen int"), ["book"]).first()
    assert (score.answered, score.correct) == (8, 8)


def test_quiz_points_needs_few_passages(spark):
    said = ["The first point is said here", "A second point is said here", "One third point is said here", "Some fourth point is said here", "Every fifth point is said here"]
    rows = [("b", i, [said[0], said[1]] if i < 900 else [said[2 + i % 3]]) for i in range(1_000)]
    frame = spark.createDataFrame(rows, "book string, para int, remember array<string>")
    paras = frame.withColumns({c: F.lit("") for c in ("summary", "accessible", "original", "section")} | {"key_points": F.array().cast("array<string>")})
    assert artefacts._needed(frame.withColumnRenamed("remember", "p"), ["book"], "para", 18).count() == 21 + 3 * 21
    got = artefacts.quiz_points(paras, ["book"], "para").orderBy("question_no").collect()
    assert len(got) == 18 and [r.para for r in got] == list(range(18))
    for r in got:
        acc = [said[0]]
        for _, _, p in rows[r.para + 1 :] + rows[: r.para]:
            acc += [v for v in p if v not in acc][:1] if len(acc) < 4 else []
        k = (r.para + 1) % 4
        assert r.options == acc[k:] + acc[:k] and r.explanation == said[0]


def test_sinks(spark, tmp_path):
    paras = study(spark).withColumn("title", F.lit("Cap <1>"))
    html = sinks.chapter_html(paras.withColumn("n", F.lit(1)), ["book"], "para", "title", "n").first().html
    assert html.count("<h3>") == 2 and "Cap &lt;1&gt;" in html
    txt = sinks.book_txt(paras, ["book"], "para", "title")
    assert "TERMINOLOGIA\n- termine0: definizione numero 0" in txt.first().text
    assert sinks.reading_view(paras, ["book"], "para", "title").first().text.count("Sezione") == 2
    sinks.write_book_txt(txt, f"{tmp_path}/txt")
    sinks.write_book_json(sinks.book_json(paras, "book", "section", "para", ["summary", "glossary"]), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 1
    assets = spark.createDataFrame([("d", i, 10) for i in range(5)], "doc string, n int, size int")
    assert [r.kept for r in sinks.trim_assets(assets, ["doc"], "n", 10, 25).orderBy("n").collect()] == [True, True, False, False, False]


def test_glossary(spark):
    text = "La fotosintesi è un processo delle piante. Per clorofilla si intende il pigmento verde. La fotosintesi è importante."
    got = one(spark, glossary.mine_glossary(F.col("a")), a=text)
    assert [(e.term, e.definition, e.placement) for e in got] == [("fotosintesi", "un processo delle piante", "inline"), ("clorofilla", "il pigmento verde", "inline")]
    marked = one(spark, glossary.mark_terms(F.col("a"), F.col("b")), a="Arte e arte nuova, artefatto", b=["arte", "arte nuova"])
    assert marked == "**Arte** e **arte nuova**, artefatto"
    spans = one(spark, glossary.term_spans(F.col("a"), F.col("b")), a="Arte e arte nuova", b=["arte", "arte nuova"])
    assert [(s.start, s.end, s.term) for s in spans] == [(0, 4, "Arte"), (7, 17, "arte nuova")]


def test_audit_equals_a_loop(spark):
    def sentence(i, j):
        return f"La causa numero{i}x{j} determina effetti{i}x{j} diversi{i}x{j} nella materia{i}x{j} studiata."

    rows = []
    for i in range(12):
        n = (i * 5) % 4
        rows.append(("c", i, " ".join(sentence(i, j) for j in range(n)), sentence(i, 0) if i % 3 == 0 and n else "altro", "", [], [], []))
    paras = spark.createDataFrame(rows, "book string, para int, text string, summary string, accessible string, key_points array<string>, remember array<string>, keywords array<string>")
    got = {r.para: r for r in audit.audit_paragraphs(paras, ["book"], "para").collect()}
    total = 0
    for _, i, text, made, *_ in rows:
        found = [s.strip() + "." for s in text.split(".") if s.strip()]
        before = sum(s.lower() in made.lower() for s in found)
        take = min(2, 8 - total, len(found) - before)
        total += take
        assert (got[i].n_important, got[i].covered_before, len(got[i].recovered), got[i].capped) == (len(found), before, take, len(found) - before - take)
    assert audit.audit_chapters(audit.audit_paragraphs(paras, ["book"], "para"), ["book"]).first().recovered == total == 8


def test_answers_and_incremental(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    at = datetime.datetime
    cache = spark.createDataFrame([("a", "x", at(2024, 1, 20)), ("b", "y", at(2023, 1, 1)), ("c", " ", at(2024, 1, 20)), (None, "z", at(2024, 1, 20)), ("d", "w", None)], "key string, answer string, saved_at timestamp")
    assert [r.key for r in answers.purge_answers(cache, now).collect()] == ["a"]
    asked = spark.createDataFrame([("custom", "", "", "", "", "", "q")], "action string, selection string, chapter_title string, section_title string, source_text string, summary string, question string")
    blank = asked.select(answers.request_key().alias("key"), F.lit("").alias("answer"), F.lit("source").alias("basis"), F.lit("l").alias("label"), F.lit(at(2024, 1, 20)).alias("saved_at"))
    assert answers.answer_with_cache(asked, blank, now)[0].select("answer", "cached").first() == ("", True)
    old = spark.createDataFrame([("s", 1, "one", at(2024, 1, 1))], "signature string, para int, summary string, saved_at timestamp")
    new = spark.createDataFrame([("s", 1, "two", at(2024, 1, 2))], old.schema)
    assert incremental.upsert_checkpoint(old, new).first().summary == "two"
    todo = spark.createDataFrame([("s", 1), ("s", 2)], "signature string, para int")
    done, rest = incremental.resume(todo, old)
    assert done.count() == 1 and rest.first().para == 2
    files_ = spark.createDataFrame([("a.pdf", 1, 5, "pdf", 2), ("a.pdf", 1, 6, "pdf", 2)], "name string, size long, last_modified long, type string, page_count int")
    assert incremental.file_signature(files_).select("signature").distinct().count() == 2


def test_sources(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="Titolo1"/></w:pPr><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:r><w:t>Testo</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    got = [(r.block_type, r.level, r.text) for r in files.read_docx_blocks(spark, f"{tmp_path}/*.docx").orderBy("block_seq").collect()]
    assert got == [("heading", 1, "Uno"), ("paragraph", None, "Testo"), ("table", None, "Tabella. a | b")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><manifest><item id="a" href="../t/a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("t/a.html", "<p>due</p>")
        z.writestr("o/b.html", "<h1>uno</h1><table><tr><td><p>c</p></td></tr></table>")
    (tmp_path / "x.epub").write_bytes(out.getvalue())
    assert [r.text for r in files.read_epub_blocks(spark, f"{tmp_path}/*.epub").orderBy("block_seq").collect()] == ["uno", "Tabella. c", "due"]
    assert one(spark, files.resolve_path(F.col("a"), F.col("b")), a="x/y/z.opf", b="../t/./a.html") == "x/t/a.html"
    frags = spark.createDataFrame([(1, 1, "a", 10.0, False), (1, 2, "b", 10.5, False), (1, 3, "c", 20.0, False), (1, 4, "d", 20.0, True)], "p int, seq int, str string, y double, has_eol boolean")
    assert files.assemble_lines(frags, ["p"]).first().text == "a b\nc\nd"
    meta = spark.createDataFrame([("s", ["q2", "q1"])], "session_id string, page_order array<string>")
    scan = spark.createDataFrame([("s", "q1", "1", "ready", None), ("s", "q2", "2", "processing", None), ("s", "q3", "", "ready", None)], "session_id string, page_id string, text string, status string, error string")
    assert [r.page_id for r in files.assemble_scan(meta, scan).orderBy("page_number").collect()] == ["q2", "q1", "q3"]
    assert [r.status for r in files.repair_scan_status(scan).orderBy("page_id").collect()] == ["ready", "error", "error"]


def test_references_end_in_a_semicolon():
    assert files.blocks_of("<h1>a&amp;&amp b &copy;&#39;&x;&ampfoo; &\x06amp</h1>") == [("heading", 1, "a&&amp b ©'&x;&ampfoo; &\x06amp")]
    assert files.blocks_of("<p>x<p>the tail &am") == [("paragraph", None, "x"), ("paragraph", None, "the tail &am")]


def test_budget(spark):
    units = spark.createDataFrame([("d", i, w) for i, w in enumerate((10, 20, 30, 0))], "doc string, n int, weight int")
    lines = [r.lines for r in budget.line_budget(units, ["doc"], "n", 16).orderBy("n").collect()]
    assert sum(lines) == 16 and min(lines) == 1 and lines[:3] == [3, 5, 7]
    assert one(spark, budget.virtual_lines(F.col("a"), 10), a="uno due tre quattro") == 3


@pytest.mark.parametrize("level", ["approfondito", "studio", "ripasso"])
def test_summary_keeps_order(spark, level):
    text = " ".join(f"Frase numero {i} su un tema." for i in range(30))
    made = summary.extract_summary(spark.createDataFrame([(1, text)], "doc_id int, text string"), level, ITALIAN).first()
    numbers = [int(w) for w in made.summary.replace(".", " ").split() if w.isdigit()]
    assert numbers == sorted(numbers) and made.n_kept == len(numbers)


def test_numbers_of_a_hot_group(spark):
    from folio.operators.places import numbered

    rows = [("hot" if i % 3 else None if i % 2 else "cold", i * i % 1009 - 200, i) for i in range(300)]
    rows = list({(g, v): (g, v, i) for g, v, i in rows}.values()) + [("hot", None, 1_000)]
    got = {r.id: r.n for r in numbered(spark.createDataFrame(rows, "g string, v long, id int"), ["g"], "v", "n", width=7).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        expected |= {r[2]: n for n, r in enumerate(own)}
    assert got == expected


@pytest.mark.parametrize(("n", "items", "most", "width", "fan"), [(0, 5, 100, 16, 4), (500, 5, 100, 16, 3), (2_000, 3, 50, 8, 2), (300, 5, 100, 8_192, 1_024)])
def test_greedy_segments_equal_a_fold(spark, n, items, most, width, fan):
    rng = random.Random(n)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, i, i, i, i * 7]), rng.choice([None, 0, 5, 20, 60, 150])) for i in range(n)]
    expected, groups = [], {}
    for g, o, v in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, v or 0, o))
    for g, own in groups.items():
        number = held = total = 0
        for _, _, v, o in sorted(own, key=lambda x: x[:3]):
            if held and (held >= items or total + v > most):
                number, held, total = number + 1, 0, 0
            held, total = held + 1, total + v
            expected.append((g, number, o, v))
    found = segmentation.greedy_segments(spark.createDataFrame(rows, "g string, o long, v int"), ["g"], "o", "v", items, most, "s", width, fan)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_terms_of_any_characters(spark):
    terms = ["f(x", "C++", "a.b", "c", "", "$1", "\\"]
    assert one(spark, glossary.mark_terms(F.col("a"), F.col("b")), a="f(x) C++ axb a.b C C+ $1 \\ xC++", b=terms) == "**f(x**) **C++** axb **a.b** **C** **C**+ **$1** **\\** xC++"
    assert one(spark, glossary.mark_terms(F.col("a"), F.col("b")), a="x", b=[""]) == "x"


def test_structure_without_rebuilt_chapters_stays(spark):
    old = spark.createDataFrame([(1, "Documento"), (2, "A"), (2, "B"), (3, "A"), (4, "documento")], "doc_id int, title string")
    new = spark.createDataFrame([(2, "new"), (3, "new"), (4, "new"), (5, "new")], "doc_id int, title string")
    got = structure.choose_structure(old, new, spark.createDataFrame([(3,)], "doc_id int"))
    assert sorted(map(tuple, got.collect())) == [(1, "Documento"), (2, "A"), (2, "B"), (3, "new"), (4, "new"), (5, "new")]


def test_hash_tree_finds_the_edited_chapter(spark):
    rows = [("a", c, p, f"text {c} {p}") for c in range(30) for p in range(4)] + [(None, 0, 0, None), ("b", 0, 0, "x")]
    edited = [(b, c, p, "edited" if (b, c, p) == ("a", 7, 2) else x) for b, c, p, x in rows]
    moved = [(b, c + 1 if b == "a" else c, p, x) for b, c, p, x in edited] + [("a", 0, 0, "a new first chapter")]
    tree = lambda r: incremental.hash_tree(spark.createDataFrame(r, "book string, chapter int, para int, text string"))
    found = {k: sorted(map(tuple, v.select("book", "chapter", "para").collect()), key=repr) for k, v in incremental.tree_changes(tree(edited), tree(rows)).items()}
    assert found == {"book": [("a", None, None)], "chapter": [("a", 7, None)], "paragraph": [("a", 7, 2)]}
    assert all(v.count() == 0 for v in incremental.tree_changes(tree(rows), tree(rows)).values())
    found = {k: sorted(map(tuple, v.select("chapter", "para").collect())) for k, v in incremental.tree_changes(tree(moved), tree(edited)).items() if k != "book"}
    assert found == {"chapter": [(0, None)], "paragraph": [(0, 0)]}


def test_outline_of_ranges_equals_one_range(spark):
    rng = random.Random(3)
    shapes = ["CAPITOLO {} — X", "Capitolo {}", "PARTE {}", "1.{} Uno", "2.{}.1 Due", "Sezione {}", "Paragrafo {}", "Testo normale numero {} che continua.", "", "Introduzione", "Altro"]
    pages = [(b, p, "\n".join(rng.choice(shapes).format(rng.randint(1, 9)) for _ in range(rng.randint(0, 9)))) for b, n in (("hot", 90), ("x", 7), (None, 9)) for p in range(1, n)]
    df = spark.createDataFrame(pages, "book string, page int, text string")
    found = [sorted(map(repr, structure.outline(df, width).drop("heading").collect())) for width in (1, 4, 1_000)]
    assert found[0] == found[1] == found[2]


def test_line_budget_equals_ranking(spark):
    """A hot group, one of equal remainders, one with more units than lines, weights null and 0, a null group; against ranking each group."""
    rng = random.Random(5)
    rows = [("hot", i, rng.randint(0, 900)) for i in range(700)] + [("same", i, 7) for i in range(90)] + [("many", i, 5) for i in range(1_200)]
    rows += [(None, i, w) for i, w in enumerate([3, None, 0, 8])] + [("none", i, 0) for i in range(3)]
    got = budget.line_budget(spark.createDataFrame(rows, "doc string, n long, weight long"), ["doc"], "n", 1_000).collect()
    expected = {}
    for doc in {r[0] for r in rows}:
        group = [(n, w or 0) for d, n, w in rows if d == doc]
        total = sum(w for _, w in group)
        spare = max(0, 1_000 - len(group)) if total else 0
        part = {n: spare * w / total if total else 0.0 for n, w in group}
        left = spare - sum(int(x) for x in part.values())
        first = sorted(part, key=lambda n: (-round(part[n] - int(part[n]), 9), n))[:left]
        expected |= {(doc, n): 1 + int(x) + (n in first) for n, x in part.items()}
    assert {(r.doc, r.n): r.lines for r in got} == expected and len(got) == len(rows)
    assert sum(r.lines for r in got if r.doc == "same") == 1_000
    empty = spark.createDataFrame([], "doc string, n long, weight long")
    assert budget.line_budget(empty, ["doc"], "n", 9).count() == 0


def test_summary_in_one_row(spark):
    """Scores and keywords equal counting by hand; null, empty and wordless texts, repeated keys and a text of 60,000 words; no exchange."""
    rng = random.Random(3)
    long = " ".join(f"parola{rng.randint(0, 3_000)}" + ("." if i % 12 == 11 else "") for i in range(60_000))
    rows = [(1, "Gatto gatto cane. Il gatto corre. Un cane dorme. ..."), (2, None), (3, ""), (4, "?!"), (5, long), (6, "a b. Gatto."), (6, "Cane.")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    scored = summary.score_sentences(df).collect()
    for key, text in rows:
        sents = [s for r, s in ((r, r.sentence) for r in scored if r.doc_id == key)]
        if key in (2, 3):
            assert not sents
        if key == 5:
            count = {}
            for w in text.replace(".", "").split():
                count[w] = count.get(w, 0) + 1
            assert len(sents) == 5_000
            for r in [r for r in scored if r.doc_id == 5][2_000:2_020]:
                words = r.sentence.rstrip(".").split()
                assert r.score == pytest.approx(sum(count[w] for w in words) / len(words), abs=1e-6)
    first = sorted((r.idx, r.score) for r in scored if r.doc_id == 1)
    assert first[0][1] == pytest.approx((3 + 3 + 2) / 3 + 1.1, abs=1e-6) and [r.score for r in scored if r.doc_id == 4] == [0.0]
    assert [(r.rank, r.word, r.n) for r in summary.top_keywords(df).where("doc_id = 1").orderBy("rank").collect()][:2] == [(1, "gatto", 3), (2, "cane", 2)]
    made = summary.extract_summary(df)
    assert {r.doc_id for r in made.collect()} == {1, 4, 5, 6} and made.where("doc_id = 6").count() == 2
    plan = summary.summarize_local(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and summary.summarize_local(df).count() == len(rows)


def test_quick_patterns_find_what_the_plain_ones_do(spark):
    rng = random.Random(5)
    parts = [*" aeEèÈsSſıİkK\u212a.,;=!?_'-125%\n\t\x0b\x1c\u00a0\u2003\u1680\ufeff\u3000éßñ日", "  ", "is", "È", "significa", "si intende", "a)", "2.", "1492", "12%", "50.5%", "x = 3", "NATO", "ÀB", "secondo", "KAUSE", "causa"]
    rows = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(40))),) for _ in range(3_000)], "a string")
    a, lex = F.col("a"), LANGUAGES
    marks = summary.LIST_MARK.replace("{words}", "|".join(lex.lists))
    points = F.when(a.rlike(t.any_of(lex.defines)), 1.8).otherwise(0.0) + F.when(a.rlike(summary.DATA_NUMBER) | a.rlike(t.any_of(lex.data)), 1.4).otherwise(0.0) + F.when(a.rlike(marks), 0.8).otherwise(0.0)
    plain = F.trim(F.regexp_replace(a, f"{t.SPACE}+", " "))
    each = [F.regexp_extract_all(a, F.lit(p.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")), F.lit(0)) for p in t.ANCHORS]
    both = rows.select(
        F.struct(t.normalize(a), t.raw_words(a), t.trim_all(a), summary.cue_bonus(a, lex), t.anchors(a), *[a.rlike(t.cue(w)) for w in (lex.remember, lex.important, lex.examples)], a.rlike(audit.QUICK_NUMBER)).alias("quick"),
        F.struct(
            plain, F.filter(F.split(F.regexp_replace(F.lower(plain), t.NOT_WORD, " "), " "), lambda w: w != ""), F.regexp_replace(a, f"^{t.SPACE}+|{t.SPACE}+$", ""), points,
            F.slice(F.array_distinct(F.filter(F.transform(F.concat(*each), t.normalize), lambda v: F.length(v) > 1)), 1, 32), *[a.rlike(t.any_of(w)) for w in (lex.remember, lex.important, lex.examples)], a.rlike(audit.NUMBER),
        ).alias("plain"),
    ).collect()
    assert all(tuple(r.quick) == tuple(r.plain) for r in both)


def test_later_sentences_are_not_tried(spark):
    """A test that fails on what comes after the last wanted value."""
    tried = lambda v: F.when(v == "bad", F.raise_error(F.lit("tried"))).otherwise(v == "x")
    assert one(spark, t.first_matches(F.col("a"), tried, 2), a=["a", "x", "x", "bad"]) == ["x", "x"]


def test_units_are_made_and_terms_found_once(spark):
    rows = [("b", i, f"Il dato {i} vale {1900 + i}. Altro testo.", "Corto.", "Corto.", [], [], [], "ai", 0) for i in range(3)]
    p = spark.createDataFrame(rows, "book string, chunk_no int, text string, summary string, accessible string, key_points array<string>, remember array<string>, keywords array<string>, engine string, fidelity_recovered int").withColumn("glossary", F.array().cast(ENTRY))
    whole = spark.createDataFrame([("b", "\n".join(r[2] for r in rows))], "book string, text string")
    assert batches.combine_units(p, ["book"]).collect() == batches.combine_units(p, ["book"], whole).collect()
    for text in ("a b A", "a \x02 b \x03 a"):
        made = one(spark, glossary.marked_spans(F.col("a"), F.array(F.lit("a"), F.lit("b"))), a=text)
        assert (made.marked, made.n) == (one(spark, glossary.mark_terms(F.col("a"), F.array(F.lit("a"), F.lit("b"))), a=text), len(one(spark, glossary.term_spans(F.col("a"), F.array(F.lit("a"), F.lit("b"))), a=text)))


def test_cues_by_tokens_and_listed_classes(spark):
    """Cues found by tokens are those that patterns find, also where letters fold to others; classes by single characters hold the same ones as ranges."""
    rng = random.Random(7)
    parts = [*" aeEèÈsSſıİkKK.,;'_-1̇ßœªʰ²日", "  ", "is", "È", "Sı", "significa", "si intende", "si  intende", "INTENDE", "magı", "definisce", "secondo", "KAUSE", "causa", "ley", "𝐀", "́"]
    rows = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randrange(25))),) for _ in range(3_000)], "a string")
    a, lists = F.col("a"), (LANGUAGES.defines, LANGUAGES.remember, LANGUAGES.important, glossary.MIXED.needed())
    both = rows.select("a", *[F.struct(t.has_cue(a, t.tokens(a), w).alias("q"), a.rlike(t.any_of(w)).alias("p")).alias(f"x{i}") for i, w in enumerate(lists)]).collect()
    assert all(r[f"x{i}"].q == r[f"x{i}"].p for r in both for i in range(4))
    every = spark.createDataFrame([(chr(n),) for n in range(0x20000) if not 0xD800 <= n < 0xE000], "a string")
    for ranged, single in ((f"(?iu)^{glossary.WORD}$", f"(?iu)^{glossary.QUICK_WORD}$"), (f"^{t.NOT_WORD}$", f"^(?:{t.APART}| )$"), (f"^{t.SPACE}$", f"^{t.BLANK}$"), (f"^{t.SPACE}$", f"^(?:{t.ODD_BLANK}| )$")):
        assert every.where(a.rlike(ranged) != a.rlike(single)).count() == 0


def test_points_made_ahead_take_the_place_of_texts(spark):
    """Records that hold their points give the same cards and questions without texts; a null summary falls back on the original."""
    rows = [("b", i, f"Il punto numero {i} del riassunto è questo.", "", f"Testo originale lungo {i}.", [f"Da ricordare sempre il {i}."], ["corto", f"DA ricordare  sempre il {i}."], ["k"], None) for i in range(6)] + [("b", 6, None, None, "Solo il testo originale resta qui.", [], [], [], "1.1 S")]
    p = spark.createDataFrame(rows, "book string, para int, summary string, accessible string, original string, remember array<string>, key_points array<string>, keywords array<string>, section string").withColumn("glossary", F.array().cast(ENTRY))
    slim = p.withColumn("points", artefacts.points(3)).select("book", "para", "section", "keywords", "glossary", "points")
    for made in (artefacts.flashcards, artefacts.quiz_points, artefacts.oral_questions, artefacts.concept_map):
        assert sorted(map(repr, made(slim, ["book"], "para").collect())) == sorted(map(repr, made(p, ["book"], "para").collect()))
    assert artefacts.concept_map(slim, ["book"], "para").where("para = 6").first().points == ["Solo il testo originale resta qui."]


def test_recovery_by_lines(spark):
    """Each anchor's first sentence, letter case aside, once; anchors that no sentence has give none."""
    row = spark.createDataFrame([(["Nel 1492 fine.", "La nato nel 1492.", "E x = 3."], ["NATO", "1492", "X = 3", "77"])], "s array<string>, m array<string>")
    assert row.select(summary.recovery(F.col("s"), F.col("m"))).first()[0] == ["La nato nel 1492.", "Nel 1492 fine.", "E x = 3."]
    assert row.select(summary.recovery(F.array().cast("array<string>"), F.col("m"))).first()[0] == []


def older_structure(pages):
    """A plain model of the older chapters and sections."""
    level = {"CAPITOLO 3": 1, "Sezione 2 uno": 2, "2.1 Due": 2, "1.1.1 Tre": 3}
    chapters, sections = [], []
    for book in {p[0] for p in pages}:
        lines = [(p, v) for b, p, text in sorted((p for p in pages if p[0] == book), key=lambda p: p[1]) for v in text.strip("\n").split("\n")]
        levels = [level[v] for _, v in lines if v in level]
        root, k, found = min(levels, default=9), 0, {}
        for p, v in lines:
            k += level.get(v) == root
            found.setdefault(k, []).append((p, v))
        of_book = []
        for k, held in found.items():
            heads = [(p, v, level[v]) for p, v in held if level.get(v, root) != root]
            texts = [p for p, v in held if v and v not in level]
            if not heads and not texts:
                continue
            first = next((p, v) for p, v in held if v and level.get(v) != root)
            title, start = held[0][::-1] if k else ("Documento" if first[1] in level else "Introduzione", first[0])
            of_book.append((book, k, *((title, start, max(texts, default=start)) if levels else ("Documento", lines[0][0], lines[-1][0])), len(heads)))
            for i, (p, v, n) in enumerate(heads):
                end = max(p, heads[i + 1][0] - 1) if i + 1 < len(heads) else max(texts, default=start)
                if book is not None:
                    sections.append((book, k, i + 1, v, max(2, n - root + 1), p, end))
        chapters += of_book or [(book, min(found), "Documento", lines[0][0], lines[-1][0], 0)]
    return sorted(map(repr, chapters)), sorted(map(repr, sections))


def test_older_structure_over_ranges(spark):
    """Chapters longer than a range of pages, ranges without headings, books that begin with a section, without headings, without text, without a name."""
    rng = random.Random(3)
    body = ["Testo semplice di una pagina.", "altro testo,", ""]
    pages = [(b, p, "\n".join(rng.choice(heads if rng.random() < often else body) for _ in range(rng.randint(1, 5)))) for b, heads, often in (
        ("a", ["CAPITOLO 3", "Sezione 2 uno", "2.1 Due", "1.1.1 Tre"], 0.3), ("rare", ["CAPITOLO 3", "2.1 Due"], 0.01), ("low", ["2.1 Due", "1.1.1 Tre"], 0.05), (None, ["CAPITOLO 3", "2.1 Due"], 0.1), ("plain", [""], 0.1)
    ) for p in range(1, 301)]
    pages += [("section", 1, "2.1 Due\ntesto"), ("section", 2, "CAPITOLO 3\n\n2.1 Due"), ("empty", 1, ""), ("empty", 2, "\n"), ("roots", 4, "CAPITOLO 3"), ("roots", 5, "CAPITOLO 3"), ("late", 1, ""), ("late", 2, "CAPITOLO 3")]
    chapters, sections = structure.build_structure_legacy(spark.createDataFrame(pages, "book string, page int, text string"))
    expected = older_structure(pages)
    assert sorted(repr(tuple(r)) for r in chapters.drop("n_paragraphs").collect()) == expected[0]
    assert sorted(repr(tuple(r)) for r in sections.collect()) == expected[1]
    # no task gets all lines of a book, or their text
    assert all(x not in df._jdf.queryExecution().optimizedPlan().toString() for df in (chapters, sections) for x in ("windowspecdefinition(book#", "split(text#"))


def test_older_paragraphs_are_counted(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Parola", "nel", "mezzo", "Ecco", "x" * rng.randint(1, 300)])
    texts = ["".join(word() + rng.choice([" ", " ", ". ", "! ", ".\n", "? " if n % 2 else " ", "\n\n" if n % 3 else " ", ".\u00a0"]) for _ in range(rng.randint(0, 150))) for n in range(120)]
    clean = t.clean_text(F.col("text"))
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(structure.count_paragraphs_legacy(clean).alias("n"), structure.split_paragraphs_legacy(F.col("text")).alias("p")).collect()
    assert [r.n for r in rows] == [len(r.p) for r in rows] and len({r.n for r in rows}) > 9
    # white space of all kinds ends a sentence, as in the SQL
    assert len(one(spark, structure.split_paragraphs_legacy(F.col("a")), a="\u00a0".join(["Frase " + "a" * 90 + "."] * 20))) == 3
    assert one(spark, t.trim_all(F.col("a")), a="\ufeff\u2003 a \u0085") == "a \u0085"


def test_numbered_groups_may_be_null(spark):
    rows = [(b, n) for b in ("a", None) for n in (None, 1, 2, 15_000, 40_000)]
    got = places.numbered(spark.createDataFrame(rows, "book string, n long"), ["book"], "n", "i").collect()
    assert sorted((r.book or "", r.i, r.n or 0) for r in got) == [(b, i, n) for b in ("", "a") for i, n in enumerate((0, 1, 2, 15_000, 40_000))]
