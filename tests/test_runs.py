"""Whole quality runs, guards and readers that must fail, and warnings, on literal fixtures."""

from __future__ import annotations

import json
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quireworks.functions import text as T
from quireworks.operators import assembly, gates, joins, layout
from quireworks.plans import qc
from quireworks.queries import runs
from quireworks.sources import files, sinks

from .oracle import SMALL, tables


def measurements(spark):
    """A book of text alone: every gate that has something to look at passes."""
    table = lambda rows, schema: spark.createDataFrame(rows, f"project string, {schema}")
    lines = [("p", i, 800.0, w, 10.0 * i, 400.0) for i in (1, 2, 3) for w in ("some", "words")]
    return spark.createDataFrame([("p",)], "project string"), {
        "fonts-embedded": table([("p", "Lora", True, False)], "font string, has_file boolean, substituted boolean"),
        "text-coverage": table([("p", 10, 10, 1.0, True)], "matched long, total long, coverage double, passes boolean"),
        "no-broken-chars": table([("p", "fine")], "text string"),
        "no-hyphen-page-break": table(lines, "page int, page_height double, str string, x double, y double"),
        "ink-coverage": table([("p", 1, 0.1, False)], "page int, ink double, exempt boolean"),
        "no-overflow": table([("p", 1.0, 1.0, 9.0, 9.0, 0.0, 0.0, 10.0, 10.0, False)], "left_ double, top_ double, right_ double, bottom_ double, page_left double, page_top double, page_right double, page_bottom double, split boolean"),
        "min-font-size": table([("p", "--font-size-body: 11pt;")], "css string"),
        "contrast": table([("p", "#1c1a17", "#fbfaf7")], "text string, ground string"),
        "titles": table([("p", 1, "One")], "id int, title string"), "outline": table([("p", "1. One")], "title string"), "targets": table([("p", "c1")], "target string"), "ids": table([("p", "c1")], "target string"),
        "metadata": table([("p", "T", "T", "en-US", "Me", "Me")], "title string, wanted_title string, language string, author string, wanted_author string"),
        "file-size": table([("p", 1000)], "bytes long"),
        "lines": table([("p", 1, "a line of the bonus sheet")], "line_id int, line string"), "bodies": table([("p", 1, "the body of the book")], "text_no int, text string"),
        "structure": table([("p", "One", "1. One and more")], "title string, text string"),
        "folio-continuity": table([("p", 1, None, None, None)], "page int, text string, kind string, value long"),
    }


def test_quality_run(spark):
    """Go, 13 of 17, four skipped, 97 of 100; a measurement that turns bad turns its gate and the verdict."""
    projects, inputs = measurements(spark)
    checks = qc.checks(projects, inputs)
    row = qc.results(checks).first()
    assert (row.verdict, row.passed, row.skipped, row.total) == ("GO", 13, 4, 97.0)
    assert row.skipped_ids == "assets-exist,cover-renders,image-dpi,folio-continuity"
    text = qc.report(checks).first().text
    assert "## Result: GO" in text and "| folio-continuity | skipped |" in text and text.count("\n| ") == 25
    inputs["bodies"] = inputs["bodies"].withColumn("text", F.lit("it has A  line of the bonus sheet in it"))
    row = qc.results(qc.checks(projects, inputs)).first()
    assert (row.verdict, row.failed_ids) == ("NO-GO", "no-bonus-in-body")
    nothing = {r.id: r.status for r in qc.checks(projects, {}).collect()}
    assert len(nothing) == 17 and {x for x, s in nothing.items() if s != "skipped"} == set(qc.NOTHING)


def test_guards(spark, tmp_path):
    root = tmp_path / "projects"
    (root / "p").mkdir(parents=True)
    assert files.project_folder(spark, str(root), "p").endswith("/p")
    with pytest.raises(FileNotFoundError):
        files.project_folder(spark, str(root), "q")
    with pytest.raises(ValueError, match="no project name"):
        files.project_folder(spark, str(root), "../p")
    (tmp_path / "blank.md").write_text("**Tone:**")
    form = str(root / "p" / "form.md")
    with pytest.raises(FileNotFoundError, match="blank form"):
        files.ensured_form(spark, form, str(tmp_path / "blank.md"))
    assert files.ensured_form(spark, form, str(tmp_path / "blank.md")).strip() == "**Tone:**"
    with pytest.raises(FileNotFoundError):
        files.template(spark, str(tmp_path / "none.html"))
    (tmp_path / "t.html").write_text("<p><!-- x -->a</p>")
    assert files.template(spark, str(tmp_path / "t.html")) == "<p>a</p>"
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "tokens.json").write_text(json.dumps({"name": "plain", "fonts": {"body": "Lora"}, "palette": {"bg": "#ffffff"}}))
    assert files.theme(spark, str(tmp_path), "plain")["fonts"] == {"body": "Lora"}
    with pytest.raises(FileNotFoundError):
        files.theme(spark, str(tmp_path), "none")
    state = str(tmp_path / "state")
    assert files.build_state(spark, state) is None
    assembly.run_stage(spark, "p", "ingest", lambda: "done", state)
    assert files.build_state(spark, state).count() == 1
    with pytest.raises(Exception, match="no such variable"):
        spark.range(1).select(T.required(T.with_variable(F.lit("a{}"), "x", F.lit("1")), "no such variable")).collect()


def test_settings_come_back(spark):
    rows = [("p", "fonts.body", '"Lora", serif'), ("p", "palette.bg", "#fff000"), ("p", "palette.text", "a\\b")]
    text = sinks.settings_text(spark.createDataFrame(rows, "project string, key string, value string")).first().text
    assert text == 'fonts:\n  body: "\\"Lora\\", serif"\npalette:\n  bg: "#fff000"\n  text: "a\\\\b"\n'


def test_blocked_book(spark):
    schema = "project string, title string, subtitle string, author string, cover string, disclaimer string, disclaimer_required boolean, n_bonuses int, cta_title string, cta_content string, cta_link string, punchline string, points array<string>"
    rows = [("a", "A", None, "Me", None, "  ", True, 0, None, None, None, "P", ["x & y"]), ("b", "B", None, "Me", None, None, False, 0, None, None, None, " P ", ["x & y"])]
    books = spark.createDataFrame(rows, schema)
    chapters = spark.createDataFrame([("a", 1, 1, "t", '<section class="chapter-open" id="c"></section>'), ("b", 1, 1, "t", '<section class="chapter-open" id="c"></section>')], "project string, pos int, number int, title string, html string")
    assert [r.project for r in assembly.blocked(books).collect()] == ["a"]
    parts = assembly.book_parts(books, chapters).collect()
    assert {r.project for r in parts} == {"b"}
    assert next(r.html for r in parts if r.section == "back-cover") == "<section>P<ul><li>x &amp; y</li></ul></section>"


def test_fonts_and_paths(spark):
    styles = spark.createDataFrame([("p", "a{src:url('f/x.ttf')} b{src:url(\"//cdn/y.otf\")} c{src:url(f/x.ttf)}"), ("q", "url(\"z.woff2\")"), ("r", "none")], "project string, css string")
    fonts = spark.createDataFrame([("p", "f/x.ttf", bytearray(b"abc" * 40))], "project string, path string, content binary")
    got = {r.project: r for r in assembly.inlined_fonts(styles, fonts).collect()}
    assert got["p"].css.startswith("a{src:url('data:font/ttf;base64,YWJj") and "\n" not in got["p"].css and got["p"].css.endswith("c{src:url(f/x.ttf)}")
    assert (got["q"].css, got["q"].missing) == (None, ["z.woff2"]) and got["r"].css == "none"
    cases = [("/a/b", "/a/b/c/d.md", "c/d.md"), ("/a/b", "/a/b", ""), ("/a/b", "/a/x", "../x"), ("/a/b/", "/z", "../../z"), ("a", "a/b", "b")]
    found = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(T.relative_path(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in found] == [x for *_, x in cases]


def test_lookup_names_known_ids(spark):
    entries = spark.createDataFrame([("p", "b", "B", "b.md"), ("p", "a", "A", "a.md")], "project string, id string, title string, file string")
    wanted = spark.createDataFrame([("p", "a"), ("p", "c"), ("q", "a")], "project string, id string")
    got = {(r.project, r.id): r.problem for r in joins.lookups(wanted, entries).collect()}
    assert got == {("p", "a"): None, ("p", "c"): 'No entry with id "c". Known ids: a, b.', ("q", "a"): 'No entry with id "a". Known ids: (none).'}


def test_warnings(spark):
    rows = ["before", "Chapter 1: One", "same text.", "same text.", 'CALLOUT|KIND[ª]TIP, EYEBROW[ª]"E", BODY[ª]"b"}]:', "a\u0091b.", "CHAPTER 2", "Introduction", "Introduction", "end."]
    lines = [("p", i, 1 + i // 50, 700.0 - 100 * i, 12.0, t, [t], False, False) for i, t in enumerate(rows)] + [("q", 0, 1, 1.0, 12.0, "plain", ["plain"], False, False)]
    found = layout.warnings(spark.createDataFrame(lines, "project string, line_no int, page int, y double, font_height double, text string, cells array<string>, is_list_item boolean, is_table_row boolean")).collect()
    assert {(r.project, r.rule, r.detail) for r in found} == {
        ("p", "lines-before-first-heading", "1"), ("p", "repeated-paragraph", "same text."), ("p", "leaked-callout", "E"), ("p", "control-character", "a\u0091b."), ("p", "untitled-heading", "CHAPTER 2"), ("p", "empty-divider", "Introduction"), ("q", "no-heading", "1"),
    }


def test_what_stops_a_run(spark):
    """A file that is not there, a style variable that is not there."""
    entries, files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int"), spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, text string")
    assert sorted(map(tuple, joins.with_required_content(entries, files).collect())) == [("a", 1, "x"), ("b", 2, "y")]
    with pytest.raises(Exception, match="no file b"):
        joins.with_required_content(entries, files.where("path <> 'b'")).collect()
    css = spark.createDataFrame([("--a: 1pt; --b: 2;",), (None,)], "css string")
    assert {r[0] for r in css.select(T.with_known_variable(F.col("css"), "b", F.lit("3"))).collect()} == {"--a: 1pt; --b: 3;", None}
    with pytest.raises(Exception, match="no variable --c"):
        css.select(T.with_known_variable(F.col("css"), "c", F.lit("3"))).collect()


def test_joins_with_one_key_for_a_third(spark):
    """Titles with one beginning, lines of one and two words, a word that all groups have: as brute force has it."""
    titles = [("p", i, f"Chapter the same beginning {i % 40}") for i in range(90)] + [("p", 200, "ab"), ("p", 201, ""), ("r", 202, ""), ("p", 203, "zzz"), (None, 204, "x")]
    outline = [("p", f"1. chapter THE same  beginning {i}") for i in range(0, 40, 2)] + [("p", "xaby"), ("q", "zzz")]
    got = {r.id for r in joins.not_contained(spark.createDataFrame(titles, "project string, id int, title string"), spark.createDataFrame(outline, "project string, title string")).collect()}
    flat = lambda x: "".join(x.split()).lower()
    assert got == {i for p, i, t in titles if not any(p == q and flat(t) in flat(o) for q, o in outline)}
    lines = ["the", "he sa", "same", "qu", " ", "the same beginning and", "same  the", "zz top"]
    texts = ["The same beginning and end"] * 30 + ["unique", "breathe sand", "", "none of it"]
    pairs = joins.contained_lines(spark.createDataFrame(list(enumerate(lines)), "line_id int, line string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")).collect()
    norm = lambda x: " ".join(x.lower().split())
    assert sorted((r.line_id, r.text_id) for r in pairs) == sorted((i, j) for i, x in enumerate(lines) for j, y in enumerate(texts) if x.strip() and norm(x) in norm(y))
    groups = [("p", f"g{i:03}", i, w, 1 + i % 3) for i in range(120) for w in ("all", f"w{i % 7}")]
    pool = [("p", "all", 100), *(("p", f"w{i}", 20) for i in range(6))]
    left, want = {w: n for _, w, n in pool}, {}
    for _, name, _, word, n in groups:
        taken = min(n, left.get(word, 0))
        left[word] = left.get(word, 0) - taken
        want[name] = want.get(name, 0) + taken
    drawn = joins.drawn(spark.createDataFrame(pool, "project string, word string, n long"), spark.createDataFrame(groups, "project string, name string, priority int, word string, n long").repartition(5))
    assert {r.name: r.matched for r in drawn.collect()} == want


def test_only_scarce_words_are_put_in_order(spark, monkeypatch):
    stored, store = {}, joins.stored
    monkeypatch.setattr(joins, "stored", lambda df, name: stored.setdefault(name, store(df, name)))
    groups = spark.createDataFrame([("p", f"g{i}", i, w, 1) for i in range(6) for w in ("enough", "few", "few")], "project string, name string, priority int, word string, n long")
    drawn = joins.drawn(spark.createDataFrame([("p", "enough", 6), ("p", "few", 3)], "project string, word string, n long"), groups).collect()
    assert {r.name: (r.matched, r.total) for r in drawn} == {f"g{i}": (1 + max(0, min(2, 3 - 2 * i)), 3) for i in range(6)}
    assert {r.word for r in stored["drawn-words"].collect()} == {"few"}


def test_grams(spark):
    """All substrings of the sizes, in time that grows with the text: one of 400,000 characters took minutes when each substring was sought from the text's beginning."""
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(80_000))[:400_000]
    for text, sizes in [("ab\ncé😀😀x yab\n", [1, 3, 8]), ("abc", [3, 8]), ("", [1]), (long, [8])]:
        began = time.monotonic()
        got = spark.createDataFrame([(text, sizes)], "t string, s array<int>").select(joins._grams(F.col("t"), F.col("s"))).first()[0]
        assert len(got) == len(set(got)) and time.monotonic() - began < 30
        assert {g for g in got if "?" not in g} == {text[i : i + n] for n in sizes for i in range(len(text) - n + 1)}


def test_titles_without_a_partner(spark):
    """Equal titles, nulls and empty ones, and projects that have no outline."""
    titles = [("a", 1, "One Two"), ("a", 2, "x"), ("a", 3, None), ("a", 4, " "), ("b", 5, ""), ("b", 6, "One"), (None, 7, "One"), ("a", 8, "wo"), ("a", 9, "onetwo three four"), ("a", 10, "one two")]
    outline = [("a", "ONE TWO"), ("a", None), ("a", "1. onetwo threefour."), (None, "One")]
    got = joins.not_contained(spark.createDataFrame(titles, "project string, id int, title string"), spark.createDataFrame(outline, "project string, title string")).collect()
    assert sorted(r.id for r in got) == [2, 3, 5, 6, 7]


def test_fonts_that_nobody_asks_for_stay_where_they_are(spark, monkeypatch):
    kept, mark = [], assembly.marked
    monkeypatch.setattr(assembly, "marked", lambda *a: kept.append(mark(*a)) or kept[0])
    styles = spark.createDataFrame([("p", "url('a.ttf') url('b.ttf')"), ("q", "url('a.ttf')"), ("r", "url('b.ttf')")], "project string, css string")
    rows = [(p, f, bytearray(f.encode())) for p in "pqr" for f in ("a.ttf", *(f"no{i}.ttf" for i in range(9)))] + [("p", "b.ttf", None), ("p", "no1.ttf", None), ("q", "no1.ttf", bytearray(b"again"))]
    got = {r.project: r for r in assembly.inlined_fonts(styles, spark.createDataFrame(rows, "project string, path string, content binary")).collect()}
    assert sorted((r.project, r.path) for r in kept[0][0].collect()) == [("p", "a.ttf"), ("q", "a.ttf")]
    assert (got["p"].css, got["p"].missing, got["q"].css, got["q"].missing, got["r"].missing) == (None, ["b.ttf"], "url('data:font/ttf;base64,YS50dGY=')", [], ["b.ttf"])


def test_page_texts_are_put_in_order_once(spark):
    rows, want = [], {}
    for page in range(3):
        text, before = "", None
        for i in range(40):
            k = (i * 7 + page * 3) % 11
            s, x, y, eol = ("" if k == 4 else None if k == 9 else f"w{i}"), float(i % 5 * 20), float(100 - i // 5 * 10 + k % 2), k in (4, 7)
            rows.append(("p", page, i, s, x, y, 10.0, 10.0, None if k == 3 else eol))
            if s:
                text += ("" if before is None else "\n" if abs(before[1] - y) >= 2 else " " if x - before[0] > 10.0 * layout.SPACE_GAP else "") + s
                before = (x + 10.0, y)
            if eol:
                text, before = text + "\n", None
        want[page] = text
    items = spark.createDataFrame(rows, "project string, page int, item_no int, str string, x double, y double, width double, height double, has_eol boolean").repartition(5)
    texts = layout.page_texts(items)
    assert {r.page: r.text for r in texts.collect()} == want
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_long_lines_become_items(spark, tmp_path):
    """A line is split once: one of 60,000 words took minutes when each six of its words split it anew."""
    from quireworks.queries import layout as layout_queries

    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60_000)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.monotonic()
    rows = layout_queries.items(spark, str(tmp_path)).where("str LIKE 'w%'").agg(F.count("str"), F.count_distinct("str")).first()
    assert tuple(rows) == (60_000, 60_000) and time.monotonic() - began < 30


def test_assets_are_looked_up_in_one_aggregation(spark):
    references = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b"), ("q", "a"), ("r", None), (None, "a")], "project string, path string")
    existing = spark.createDataFrame([("p", "a"), ("q", "a"), ("q", "a"), ("r", None), ("s", "a")], "project string, path string")
    found = gates.assets(references, existing)
    assert {r.project: (r.status, r.evidence) for r in found.collect()} == {"p": ("fail", "1"), "q": ("pass", "0"), "r": ("fail", "1"), None: ("pass", "0")}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_contents_travel_without_chapters(spark):
    books = spark.createDataFrame([("b", "t", "", "a", None, "", False, 0, "", "", "", "", ["x"])], "project string, title string, subtitle string, author string, cover string, disclaimer string, disclaimer_required boolean, n_bonuses int, cta_title string, cta_content string, cta_link string, punchline string, points array<string>")
    chapters = spark.createDataFrame([("b", 1, 1, "t", '<section class="chapter-open" id="c"></section>')], "project string, pos int, number int, title string, html string")
    toc = assembly.book_parts(books, chapters).where("section = 'toc'")
    assert [r.html for r in toc.collect()][0].startswith('<li class="toc-entry"><a href="#c">')
    plan = toc._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("regexp_extract(html") > plan.rindex("Join LeftAnti")  # the anchor is found below the join, so before its shuffle


def test_qc_run_looks_at_all_events(spark, tmp_path):
    """Numbers that break in the one book of a user beyond the first 30 fail their project; every project whose books go on passes, and the statement says the same."""
    folder = tmp_path / "some"
    folder.mkdir()
    for file in os.listdir(SMALL):
        if file != "events.parquet":
            (folder / file).symlink_to(f"{SMALL}/{file}")
    con = duckdb.connect()
    # Books of seven pages each, i to iv and 1 to 3, go on; that of user 75 has one page more, whose number skips two.
    con.execute(f"COPY (SELECT e AS event_id, TIMESTAMP '2024-01-01' AS ts, u AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM range(0, 89) a(u), range(1, 8) b(e) UNION ALL SELECT 13, TIMESTAMP '2024-01-01', 75, 'view', 1.0, '{{}}') TO '{folder}/events.parquet'")
    got = {r.project: r.status for r in runs.qc_run(spark, str(folder)).where("id = 'folio-continuity'").collect()}
    assert got == {p: "fail" if p == 75 % 40 else "pass" for p in range(40)}
    want = tables(str(folder)).execute(f"SELECT project, status FROM ({runs.ORACLES['qc_run']}) WHERE id = 'folio-continuity'").fetchall()
    assert dict(want) == got
