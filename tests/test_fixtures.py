"""Literal inputs with results derived by hand from the rules, each with a row that flips the answer."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quireworks.functions import text as T
from quireworks.operators import assembly, audit, bonus, config, gates, joins, layout, markdown
from quireworks.plans import audit as plans
from quireworks.sources import files, images, sinks
from quireworks.streaming import state

ITEMS = "project string, page int, item_no int, str string, x double, y double, width double, height double"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def items(spark, rows, height=10.0):
    return spark.createDataFrame([("p", page, i, s, float(x), float(y), float(w), height) for i, (page, s, x, y, w) in enumerate(rows)], ITEMS)


def body(spark, rows):
    """rows: page, y, text, font height."""
    made = [("p", i, page, float(y), float(h), text, [text], text[0].isdigit() and ". " in text[:4], False) for i, (page, y, text, h) in enumerate(rows)]
    df = spark.createDataFrame(made, "project string, line_no int, page int, y double, font_height double, text string, cells array<string>, is_list_item boolean, is_table_row boolean")
    line = F.struct("line_no", "page", "text", "cells", "is_list_item", "is_table_row", "wraps", "list_wraps", "crosses", "list_follows")
    return layout.linked(df).groupBy("project").agg(F.array_sort(F.collect_list(line)).alias("body")).withColumn("section", F.lit(1))


def block_texts(spark, rows):
    found = layout.blocks(body(spark, rows)).orderBy("block_no").collect()
    return [r.text if r.type == "paragraph" else list(r["items"]) for r in found]


def test_lines_keep_their_anchor(spark):
    found = layout.lines(items(spark, [(1, "a", 0, 100, 5), (1, "b", 10, 98.5, 5), (1, "c", 20, 97, 5)])).orderBy("line").collect()
    assert [len(r.cells) * [r.line] for r in found] == [[0], [1]] and found[0].cells == ["a b"] and found[1].cells == ["c"]


def test_cells_by_gap(spark):
    found = layout.lines(items(spark, [(1, "a", 0, 9, 5), (1, "b", 6, 9, 5), (1, "c", 14, 9, 5), (1, " ", 20, 9, 1), (1, "d", 39, 9, 5)])).first()
    assert found.cells == ["ab c", "d"]


def test_lines_go_on_over_batches(spark):
    """Lines are the same however many rows a batch of items has; blank items alone give one empty cell. Items are shuffled once."""
    rows = [(1 + i // 40, c, i % 40 % 9 * 7, 100 - i % 40 // 9 * 1.5, 3 + i % 4) for i, c in enumerate("ab c  d,e f ghi " * 20)] + [(99, " ", 5, 50, 5), (99, " ", 9, 50, 5)]
    df, before = items(spark, rows), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = layout.lines(df).collect()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        assert sorted(layout.lines(df).collect()) == sorted(whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.cells for r in whole if r.page == 99] == [[""]]
    plan = layout.lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_footers_go(spark):
    rows = [("p", 1, 0, 700.0, 12.0, ["Text"]), ("p", 1, 1, 20.0, 8.0, ["12"]), ("p", 2, 0, 700.0, 12.0, ["Text"]), ("p", 2, 1, 20.0, 12.0, ["12"])]
    df = spark.createDataFrame(rows, "project string, page int, line int, y double, font_height double, cells array<string>")
    assert [r.text for r in layout.classified(df).orderBy("line_no").collect()] == ["Text", "Text", "12"]


def test_wraps_depend_on_the_block(spark):
    assert block_texts(spark, [(1, 100, "1. item", 10), (1, 73, "goes on", 10)]) == [["1. item goes on"]]
    assert block_texts(spark, [(1, 100, "some words", 10), (1, 73, "new block", 10)]) == ["some words", "new block"]
    assert block_texts(spark, [(1, 100, "some words", 10), (1, 80, "same block", 10)]) == ["some words same block"]
    assert block_texts(spark, [(1, 100, "1. a", 10), (1, 60, "2. b", 10)]) == [["1. a"], ["2. b"]]


def test_pages_are_crossed_in_mid_sentence(spark):
    assert block_texts(spark, [(1, 20, "the quick", 10), (2, 700, "brown fox", 10)]) == ["the quick brown fox"]
    assert block_texts(spark, [(1, 20, "the quick", 10), (2, 700, "Brown fox", 10)]) == ["the quick", "Brown fox"]
    assert block_texts(spark, [(1, 20, "the quick.", 10), (2, 700, "brown fox", 10)]) == ["the quick.", "brown fox"]


def test_repeats_and_bullets(spark):
    far = lambda *texts: [(1, 900 - 90 * i, t, 10) for i, t in enumerate(texts)]
    assert block_texts(spark, far("A", "A", "B", "A")) == ["A", "B", "A"]
    assert block_texts(spark, far("• one • two", "with • inside", "• single")) == [["one", "two"], "with • inside", "• single"]


def test_headings(spark):
    h = lambda t: tuple(value(spark, layout.heading(F.lit(t))))
    assert h(" Introduction ") == ("introduction", None, "") and h("Chapter 3: On it") == ("chapter", 3, "On it")
    assert h("CHAPTER 12") == ("chapter", 12, "") and h("Bonus – Extra") == ("bonus", None, "Extra")
    assert h("Bonuses")[0] is None and h("The introduction")[0] is None


def ingest(spark):
    rows, y = [], 760
    for text, height in [("INTRODUCTION", 18), ("Welcome to it.", 12), ("CHAPTER 01", 18), ("Getting Started", 18), ("A paragraph of the chapter.", 12), ("1. first", 12), ("2. second", 12), ("3. third", 12), ("BONUS", 18), ("Test Checklist", 18), ("1. look", 12)]:
        rows.append(("p", 1, len(rows), text, 50.0, float(y), 100.0, float(height)))
        y -= 60 if height == 18 or text[0] not in "123" else 20
    return plans.ingested(spark.createDataFrame(rows, ITEMS)).cache()


def test_ingest_inventory(spark):
    found = ingest(spark)
    rows = {(r.entry_kind, r.id): r for r in found.collect()}
    assert set(rows) == {("chapter", "00-introduction"), ("chapter", "01-getting-started"), ("bonus", "test-checklist")}
    chapter = rows["chapter", "01-getting-started"]
    assert chapter.number == 1 and chapter.markdown == "# CHAPTER 01\n\n## Getting Started\n\nA paragraph of the chapter.\n\n1. first\n2. second\n3. third\n"
    assert plans.planned(found).count() == 2
    assert {r.category for r in plans.audited(found).collect()} == {"near-empty-section"}
    assert {r.rule for r in layout.inventory_problems(found).collect()} == {"overlap"}  # all on one page


def test_fallback(spark):
    df = items(spark, [(1, "No heading here.", 0, 700, 90), (2, "Nor here.", 0, 700, 90)])
    row = plans.ingested(df).first()
    assert (row.id, row.type, row.end_page, row.markdown) == ("00-full-text", "unclassified", 2, "No heading here.\n\nNor here.\n")


def plan(spark, text):
    found = markdown.plan(spark.createDataFrame([(1, text)], "file_id int, text string")).orderBy("index").collect()
    return [(r.component, r.rule) for r in found]


def test_plan(spark):
    after = "\n\nThe end of it."
    assert plan(spark, "- Check a\n- Check b\n- Check c" + after)[0][0] == "checklist"
    assert plan(spark, "1. Check a first\n2. Check b, then\n3. Check c" + after)[0] == ("process-steps", "ordinal:named")
    assert plan(spark, "1. Check a\n2. Check b\n3. Check c\n\nThat order matters.")[0] == ("process-steps", "ordinal:asserted")
    assert plan(spark, "- a\n- b" + after)[0][1].startswith("ambiguous-leftover")
    assert plan(spark, "1. a\n2. b\n3. c")[0][0] == "key-takeaways"
    assert [c for c, _ in plan(spark, "> one\n\n> two\n\nEnd.")] == ["pull-quote", "editorial-body", "editorial-body"]
    assert plan(spark, "Never do X\n\nA = B / C\n\n" + "A = B / C".ljust(201, "c")) == [("warning-callout", "starts-with-warning"), ("calculation-card", "formula"), ("editorial-body", "default")]
    assert plan(spark, "| a | b |\n| - | - |\n| 1 | 2 |\n\n| a | b | c | d | e |\n| - | - |")[0][0] == "comparison-table"


def md(spark, *texts):
    return spark.createDataFrame([("p", i, 1, 1, t) for i, t in enumerate(texts)], "project string, file_id int, start_page int, end_page int, text string")


def test_lists_run_from_one(spark):
    found = audit.malformed_lists(md(spark, "1. a.\n2. b.\n3. c.", "1. a\n3. b", "2. a\n3. b", "1. cut off\n\nand on", "1. Whole.\n\nNew.")).collect()
    assert {r.file_id: r.detail for r in found} == {1: "numbers=1,3", 2: "numbers=2,3", 3: "fragment=cut off"}


def test_near_empty(spark):
    texts = ["w " * 200, "w " * 220, "w " * 30]
    assert [r.file_id for r in audit.near_empty(md(spark, *texts)).collect()] == [2]
    assert [r.file_id for r in audit.near_empty(md(spark, "w " * 19, "w " * 500)).collect()] == [0]


def test_folio_breaks(spark):
    def reasons(*texts):
        rows = [("p", i, t, "arabic" if t.isdigit() else "roman") for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "project string, page int, text string, kind string")
        df = df.withColumn("value", F.when(F.col("kind") == "arabic", F.col("text").try_cast("bigint")).otherwise(T.roman(F.col("text")).cast("bigint")))
        return [r.reason for r in gates.folio_breaks(df).orderBy("page").collect()]

    assert reasons("iii", "iv", "1", "2", "2", "5", "v") == ["repeats", "skips 2", "roman after arabic: v"]
    assert reasons("ii", "7", "8") == ["starts at 7 after ii"] and reasons("i", "ii", "1", "2") == []
    assert [value(spark, T.roman(F.lit(x))) for x in ("iv", "ix", "xl", "MCM")] == [4, 9, 40, 1900]


def test_bonus(spark):
    rows = [(1, "checklist", "# BONUS\n\n## T\n\nIntro\n\n• check • Example a • Example b • Example c\n\nOutro"), (2, "worksheet", "## W\n\n1. Name • hint\nun-numbered")]
    found = bonus.parsed(spark.createDataFrame(rows, "file_id int, format string, text string"))
    got = [(r.role, r.text, r.note) for r in found.where("file_id = 1").orderBy("role", "nth").collect()]
    assert got == [("intro", "Intro", None), ("item", "check", "Example a"), ("item", "Example b", "Example c"), ("outro", "Outro", None), ("title", "T", None)]
    assert [(r.label, r.guidance) for r in bonus.field_labels(found.where("file_id = 2")).collect()] == [("Name", "hint")]


def test_bag(spark):
    pool = spark.createDataFrame([("p", "a", 2), ("p", "b", 1)], "project string, word string, n int")
    groups = spark.createDataFrame([("p", "disclaimer", 0, "a", 2), ("p", "chapters", 9, "a", 1), ("p", "chapters", 9, "b", 1)], "project string, name string, priority int, word string, n int")
    draws = joins.drawn(pool, groups)
    assert {r.name: (r.matched, r.total) for r in draws.collect()} == {"disclaimer": (2, 2), "chapters": (1, 2)}
    assert not joins.coverage(draws).first().passes


def test_containment(spark):
    titles = spark.createDataFrame([("p", 1, "Getting Started"), ("p", 2, "Ab"), ("p", 3, "Elsewhere"), ("q", 4, "Getting Started")], "project string, id int, title string")
    outline = spark.createDataFrame([("p", "1. GETTING  started now"), ("p", "cab")], "project string, title string")
    assert {r.id for r in joins.not_contained(titles, outline).collect()} == {3, 4}
    lines = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick brown"), (3, "brown quick fox")], "line_id int, line string")
    texts = spark.createDataFrame([(7, "Xthe  QUICK brown foxes run")], "text_id int, text string")
    assert {r.line_id for r in joins.contained_lines(lines, texts).collect()} == {1, 2}


SKIPPED = {"assets-exist", "cover-renders", "image-dpi", "folio-continuity"}


def test_score_and_verdict(spark):
    def run(fail=None):
        rows = [("p", i, g, "skipped" if g in SKIPPED else "fail" if g == fail else "pass", 1.0 if g == "text-coverage" else None) for i, g in enumerate(gates.GATES)]
        checks = spark.createDataFrame(rows, "project string, pos int, id string, status string, coverage double")
        return gates.scores(checks).first(), gates.verdicts(checks).first()

    score, verdict = run()
    assert score.total == 97.0 and (verdict.verdict, verdict.passed, verdict.skipped) == ("GO", 13, 4)
    score, verdict = run("contrast")
    assert score.total < 97 and (verdict.verdict, verdict.failed_ids) == ("NO-GO", "contrast")


def test_colours(spark):
    assert value(spark, T.contrast(F.lit("#1c1a17"), F.lit("#fbfaf7"))) == pytest.approx(16.634, abs=5e-4)


def test_ground_is_the_first_seen(spark):
    pixel = lambda x, v: ("p", 1, x, 0, 4, 1, v, v, v)
    schema = "project string, page int, px int, py int, width int, height int, r int, g int, b int"
    rows = [pixel(0, 200), pixel(1, 0), pixel(2, 0), pixel(3, 200)]
    assert gates.ink_ratios(spark.createDataFrame(rows, schema)).first().ground == (25 << 10) | (25 << 5) | 25
    assert gates.ink_ratios(spark.createDataFrame([pixel(x, 200) for x in range(3)] + [pixel(3, 0)], schema)).first().ink == 0.25


def png(rows, kinds, color=2):
    n = len(rows[0]) // {0: 1, 2: 3, 6: 4}[color]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"".join(bytes([k, *r]) for k, r in zip(kinds, rows, strict=True))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", n, len(rows), 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def test_images(spark):
    data = png([[10, 20, 30, 1, 1, 1], [1, 1, 1, 1, 1, 1], [5, 5, 5, 0, 0, 0], [2, 2, 2, 2, 2, 2], [0, 0, 0, 1, 1, 1]], [0, 2, 1, 3, 4])
    pixels = images.decode_png(data).tolist()
    assert pixels[0] == [[10, 20, 30], [1, 1, 1]] and pixels[1] == [[11, 21, 31], [2, 2, 2]] and pixels[2] == [[5, 5, 5], [5, 5, 5]]
    assert pixels[3] == [[4, 4, 4], [6, 6, 6]] and pixels[4] == [[4, 4, 4], [7, 7, 7]]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00"
    df = spark.createDataFrame([("a", data), ("b", jpeg), ("c", b"no"), ("d", None)], "path string, content binary")
    assert {r.path: (r.width, r.height) for r in images.sizes(df).collect()} == {"a": (2, 5), "b": (32, 16), "c": (None, None), "d": (None, None)}
    assert images.pixels(df).count() == 10


def test_config(spark):
    form = "**Book Title:** A\nB\n\n\nC\n\n**Nope:** x\n**Niche (required):** Finance\n# end\nlost\n**Primary:** 112233\n**Primary:** 445566"
    fields = config.brand_fields(spark.createDataFrame([("p", form)], "project string, text string"))
    assert {r.key: r.value for r in fields.collect()} == {"title": "A B\n\nC", "niche": "Finance", "primary": "445566"}
    row = config.resolved(fields, {"fonts": {"body": "x", "heading": "y", "mono": "z"}, "palette": {"link": "#1"}}, ["finance"]).first()
    assert row.disclaimer_required and "disclaimer" in row.missing and "title" not in row.missing and row.palette_primary == "#445566" and row.palette_link == "#1"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("language: en-US # note\nformat:\n  pageWidth: '6in'\n  list:\n    - one\n    - two\n")
    found = files.flat_settings(files.markdown_files(spark, str(tmp_path / "a.yaml"))).collect()
    assert {(r.key, r.pos, r.value) for r in found} == {("language", None, "en-US"), ("format.pageWidth", None, "6in"), ("format.list", 0, "one"), ("format.list", 1, "two")}
    (tmp_path / "i.json").write_text('{"schemaVersion": 1,\n "project": "p", "chapters": [{"id": "c", "title": "T", "wordCount": 5}], "bonuses": [{"id": "b", "title": "B"}], "warnings": []}')
    assert {(r.entry_kind, r.id) for r in files.inventory_entries(files.inventories(spark, str(tmp_path / "i.json"))).collect()} == {("chapter", "c"), ("bonus", "b")}
    (tmp_path / "t.html").write_text("a<!-- x\ny -->b")
    assert files.templates(spark, str(tmp_path / "t.html")).first().text == "ab"
    assert files.binaries(spark, str(tmp_path / "t.html")).first().bytes == 14
    out = str(tmp_path / "out")
    sinks.write_files(spark.createDataFrame([("p", "a", "one\ntwo\n"), ("p", "b", "x")], "project string, file string, text string"), out)
    sinks.write_files(spark.createDataFrame([("p", "a", "again\n")], "project string, file string, text string"), out)
    assert spark.read.text(out, wholetext=True).count() == 1
    rows = spark.createDataFrame([(1, -1)], "k int, v int")
    bad = gates.schema_violations(rows, "k", {"positive": F.col("v") > 0})
    with pytest.raises(ValueError, match="positive at 1"):
        sinks.write_valid_json(rows, bad, str(tmp_path / "json"))
    sinks.write_valid_json(rows, bad.limit(0), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    report = sinks.report(spark.createDataFrame([("c", "p", 1, "a|b\nc")], "category string, project string, file_id int, detail string")).first().text
    assert "| c | 1 | a\\|b c |" in report


def test_stages(spark, tmp_path):
    path = str(tmp_path / "state")

    def missing():
        raise NotImplementedError("later")

    assert assembly.run_stages(spark, "p", {"a": lambda: "ok", "b": missing, "c": lambda: "never"}, path) == 2
    assert assembly.run_stage(spark, "p", "a", lambda: 1 / 0, path) == 1
    assert {r.stage: (r.status, r.exit_code) for r in assembly.latest(spark.read.parquet(path)).collect()} == {"a": ("failed", 1), "b": ("not_implemented", 2)}
    both = sinks.upserted(spark.createDataFrame([("a", 1, 1)], "k string, t int, v int"), spark.createDataFrame([("a", 2, 2), ("b", 1, 3)], "k string, t int, v int"), ["k"], "t")
    assert {(r.k, r.v) for r in both.collect()} == {("a", 2), ("b", 3)}


def test_running_state(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a", "failed", "2024-01-01 10:00:00"), ("p", "a", "success", "2024-01-01 11:00:00")], "project string, stage string, status string, at string")
    rows.select("project", "stage", "status", F.to_timestamp("at").alias("finished_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("project string, stage string, status string, finished_at timestamp").parquet(str(tmp_path / "in"))
    query = state.running_state(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert [(r.status, r.exit_code) for r in spark.table("running").collect()] == [("success", 0)]


def test_addresses(spark):
    doc = '{"a": {"z": "http://low"}, "results": [1, {"url": "https://x/y"}]}'
    assert value(spark, assembly.media_url(F.lit(doc), 3)) == "https://x/y"
    assert value(spark, assembly.media_url(F.lit('{"a": "ftp://x"}'), 2)) is None


def test_files_of_one_name_do_not_follow_each_other(spark):
    texts = ["# A\n\n1. cut off here\n\nand so on\n", "# B\n\n1. Whole.\n\nAnother one.\n"]
    files = spark.createDataFrame([("p", "bonuses/raw/a.md", 1, 1, t) for t in texts], "project string, file_id string, start_page int, end_page int, text string")
    assert [r.detail for r in audit.malformed_lists(files).collect()] == ["fragment=cut off here"]
    assert [r.detail for r in audit.malformed_lists(files.where("text LIKE '# A%'")).collect()] == ["fragment=cut off here"]
