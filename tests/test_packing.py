"""Rows that are shuffled packed: nothing is lost, and little room is taken on disk."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from quireworks import storage
from quireworks.operators import layout, packing
from quireworks.plans import audit
from quireworks.queries import layout as queries

from .oracle import SMALL

ITEMS = "project string, page int, item_no int, str string, x double, y double, width double, height double"


def shuffled(spark) -> int:
    """Bytes that all stages so far have shuffled."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for i in range(files.size()) if (x := files.apply(i).getName()).startswith("shuffle_")}


def test_values_come_through(spark):
    """Numbers to the last bit, nulls, empty and long texts, other types, keys that are null, groups that are dealt out row by row."""
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(3), r.choice([None, -(2**63), 2**63 - 1, i]), r.choice([None, float("inf"), -0.0, 5e-324, r.random()]), r.choice([None, "", "é" * 300, f"w{i}"]), r.choice([None, Decimal("1.50")]), r.choice([None, True, False])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, part int, n long, x double, s string, d decimal(9,2), b boolean").repartition(5)
    got = packing.by_group(df, ["k", "part"], lambda t, group: t.select(["k", "part", "n", "x", "s", "d", "b"]), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    assert packing.by_group(df.where("false"), ["k", "part"], lambda t, group: t, "k string").count() == 0


def test_lines_of_items_as_lines_that_are_shuffled(spark, monkeypatch):
    """Footers, blank lines and pages, negative and missing pages, and projects of many stretches."""
    monkeypatch.setattr(layout, "STRETCH", 2)
    r, rows = random.Random(4), []
    for project, n in (("a", 30), ("b", 3), ("c", 1), (None, 2)):
        for page in [None, -3, *range(n)]:
            for i in range(r.randrange(1, 12)):
                rows.append((project, page, i, r.choice([" ", "word", "12", "1. x", None]), r.choice([0.0, 9.0, 50.0, None]), r.choice([90.0, 88.5, 60.0, 20.0, None]), 10.0, r.choice([8.0, 10.0, None])))
            rows.append((project, page, 99, str((page or 0) % 20000), 0.0, 5.0, 5.0, r.choice([8.0, 20.0])))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, ITEMS).repartition(3)
    got, want = layout.classified_items(df), layout.classified(layout.lines(df))
    assert got.columns == want.columns and got.count() > 50
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_items_take_little_room(spark):
    """A shuffled word with its place takes a few bytes, and none once the lines are stored."""
    items = queries.items(spark, SMALL)
    n, before = items.count(), shuffled(spark)
    assert layout.lines(items).count() > 0
    assert 0 < shuffled(spark) - before < 12 * n
    there = shuffle_files(spark)
    found = layout.classified_items(items)
    assert shuffle_files(spark) <= there and found.count() > 0


def test_pressed(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(1000).repartition(3, F.col("id"))
    assert storage.pressed(df, "pressed").count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_text_of_small_projects_is_stored_twice(spark, monkeypatch):
    """From items to files: as lines and as sections; what is left reads these as they lie, and classified lines that are at hand aren't written again."""
    names, store = [], layout.stored
    monkeypatch.setattr(layout, "stored", lambda df, name: (names.append(name), store(df, name))[1])
    rows = [(p, 1, i, t, 10.0, 700.0 - 20 * i, 50.0, 10.0) for p in ("a", "b") for i, t in enumerate(["Chapter 1: One", "words", "Introduction", "BONUS"] if p == "a" else ["words"])]
    found = audit.ingested(spark.createDataFrame(rows, ITEMS))
    assert names == ["layout-large", "layout-numbered"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.project, r.entry_kind, r.id, r.markdown) for r in found.collect()) == [("a", "bonus", "bonus", "# BONUS\n"), ("a", "chapter", "00-one", "# Chapter 1: One\n\nwords\n"), ("a", "chapter", "01-introduction", "# Introduction\n"), ("b", "chapter", "00-full-text", "words\n")]
