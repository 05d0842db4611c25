"""Segmented scans against a loop, and sections and blocks of a project that holds a third of all lines, cut into many segments."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quireworks.operators import layout, scans
from quireworks.operators.scans import scan


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_scan(spark, monkeypatch, segment):
    monkeypatch.setattr(scans, "SEGMENT", segment)
    r = random.Random(segment)
    rows = [(key, part, at, r.choice([None, r.randrange(9)])) for key, n in (("a", 60), ("b", 1), ("c", 20), ("d", 7)) for part in (0, 1) for at in sorted(r.sample(range(100), n))]
    df = spark.createDataFrame(rows, "k string, part int, at int, v int").repartition(5)
    got = scan(df, ["k", "part"], "at", sums={"s": F.col("v")}, maxima={"m": F.col("v")}, previous={"p": F.col("v"), "p_at": F.col("at")}, totals={"t": F.lit(1)})
    want = set()
    for key, part in {x[:2] for x in rows}:
        group = sorted(x for x in rows if x[:2] == (key, part))
        for i, (_, _, at, v) in enumerate(group):
            before = [x[3] for x in group[:i] if x[3] is not None]
            want.add((key, part, at, v, sum(before), max(before, default=None), group[i - 1][3] if i else None, group[i - 1][2] if i else None, len(group)))
    assert got.columns == ["k", "part", "at", "v", "s", "m", "p", "p_at", "t"]
    assert {tuple(x) for x in got.collect()} == want


def as_folded(lines):
    """Blocks of body lines by the rule taken line by line: (type, text, items)."""
    out, mode = [], ""
    for x in lines:
        if x["is_table_row"]:
            goes_on, new = mode == "table", "table"
        elif x["is_list_item"]:
            goes_on, new = mode == "list" and x["list_follows"], "list"
        else:
            goes_on = x["list_wraps"] if mode == "list" else mode == "paragraph" and (x["wraps"] or x["crosses"])
            new = "list" if mode == "list" and goes_on else "paragraph"
        if not goes_on:
            out.append((new, []))
        mode = new
        if x["is_list_item"] or not out[-1][1] or mode != "list":
            out[-1][1].append(x["text"])
        else:
            out[-1][1][-1] += " " + x["text"]
    found = [(kind, " ".join(xs) if kind == "paragraph" else None, xs if kind == "list" else None) for kind, xs in out]
    return [x for i, x in enumerate(found) if not (i and x[0] == "paragraph" and found[i - 1] == x)]


@pytest.mark.parametrize("segment", [2, 50])
def test_a_section_of_a_third_of_all_lines(spark, monkeypatch, segment):
    monkeypatch.setattr(scans, "SEGMENT", segment)
    r = random.Random(segment)
    rows = []
    for project, n in (("hot", 400), ("bare", 150), ("p", 200), ("q", 250), ("r", 200)):
        for i in range(n):
            kind = "head" if project != "bare" and (i == 3 or project not in ("hot",) and r.random() < 0.1) else r.choice(["plain", "plain", "plain", "item", "table"])
            text = {"head": r.choice(["Chapter 3", "CHAPTER 4: Named", "Bonus", "Introduction", "Conclusion"]), "plain": r.choice(["some words", "and more.", "Same.", "Same."]), "item": f"{i}. item", "table": "a b"}[kind]
            rows.append((project, i, 1 + i // 7, 700.0 - r.choice([20, 20, 32, 60]) * (i % 7), float(r.choice([12, 12, 12, 18])), text, ["a", "b"] if kind == "table" else [text], kind == "item", kind == "table"))
    df = spark.createDataFrame(rows, "project string, line_no int, page int, y double, font_height double, text string, cells array<string>, is_list_item boolean, is_table_row boolean").repartition(3)
    links = {(x.project, x.line_no): x.asDict() for x in layout.linked(df).collect()}
    for (project, i), x in links.items():  # as the line before has it
        before = links.get((project, i - 1))
        same = bool(before) and before["page"] == x["page"] and abs(before["font_height"] - x["font_height"]) <= 0.5
        assert x["wraps"] == (same and before["y"] - x["y"] <= (before["font_height"] + x["font_height"]) / 2 * layout.WRAP)
    want = {}
    for project in {x[0] for x in rows}:
        lines = [links[project, x[1]] for x in rows if x[0] == project]
        heads = [i for i, x in enumerate(lines) if not x["is_table_row"] and x["text"].split()[0].lower() in ("chapter", "bonus", "introduction", "conclusion")]
        for section, start in enumerate(heads, 1):
            end = heads[section] if section < len(heads) else len(lines)
            body = lines[start + 1 : end]
            if lines[start]["text"] in ("Chapter 3", "Bonus"):
                while body and not body[0]["is_list_item"] and not body[0]["is_table_row"] and (body[0] is lines[start + 1] or body[0]["wraps"]):
                    body = body[1:]
            if body:
                want[project, section] = as_folded(body)
    got = {}
    for x in sorted(layout.section_blocks(df).collect(), key=lambda x: (x.project, x.section, x.block_no)):
        got.setdefault((x.project, x.section), []).append((x.type, x.text, x.items))
    assert got == want
    files = layout.files(df)
    assert files.where("project = 'bare'").count() == 1 and files.where("project = 'hot'").count() == 1


def test_small_projects_are_stored_twice_at_most(spark, monkeypatch):
    """Projects of one segment go through windows by project, larger ones by segments: the same files and warnings, in parts or alone."""
    r, names, store = random.Random(5), [], layout.stored
    monkeypatch.setattr(layout, "stored", lambda df, name: (names.append(name), store(df, name))[1])
    texts = ["Chapter 1: One", "BONUS", "Introduction", "Introduction", "words", "Same.", "Same.", "• a • b", "1. item", "and more"]
    rows = [(p, i, 1 + i // 6, 700.0 - 25 * (i % 6), float(r.choice([12, 12, 18])), t, [t], t == "1. item", False) for p, n in (("long", 60), ("short", 9), ("one", 1)) for i, t in ((i, r.choice(texts if p != "one" else texts[4:])) for i in range(n))]
    df = spark.createDataFrame(rows, "project string, line_no int, page int, y double, font_height double, text string, cells array<string>, is_list_item boolean, is_table_row boolean").repartition(3)
    every = lambda: [sorted(map(repr, found.collect())) for found in (layout.files(df), layout.warnings(df), layout.sections(df), layout.section_blocks(df))]
    whole = every()
    assert names.count("layout-numbered") == 2 and "layout-linked" not in names and "layout-blocks" not in names
    for segment in (2, 20):
        monkeypatch.setattr(scans, "SEGMENT", segment)
        assert every() == whole
