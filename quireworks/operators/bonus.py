"""Checklists and worksheets from bonus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

NUMBERED, EXAMPLE = rf"^[0-9]+\.{P.SPACE}", r"(?i)^example(?![A-Za-z0-9_])"


def parsed(files: DataFrame) -> DataFrame:
    """files: file_id, format (checklist or worksheet), text. One row per part: file_id, role (title, intro, item, outro), nth, text, note. A checklist's items are its bullets, and an example
    is a note of the item before it if that has none; a worksheet's are its numbered lines, and what else their block holds is dropped."""
    rows = files.select("file_id", "format", F.posexplode(T.paragraphs(F.col("text"))).alias("block_no", "block"))
    rows = rows.where(~T.has(F.col("block"), rf"^#{P.SPACE}"))
    is_title = T.has(F.col("block"), rf"^##{P.SPACE}")
    numbered = F.filter(F.transform(F.split("block", "\n"), T.trim), lambda x: T.has(x, NUMBERED))
    found = F.when(is_title, F.array().cast("array<string>")).when(F.col("format") == "worksheet", F.transform(numbered, lambda x: T.sub(x, NUMBERED, ""))).when(F.contains("block", F.lit("•")), T.bullets(F.col("block"))).otherwise(F.array().cast("array<string>"))
    is_run = ~is_title & ((F.size(numbered) > 0) & (F.col("format") == "worksheet") | F.contains("block", F.lit("•")) & (F.col("format") != "worksheet"))
    rows = rows.withColumns({"is_title": is_title, "is_run": is_run, "found": found})
    before = F.coalesce(F.sum(F.size("found")).over(Window.partitionBy("file_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("role", F.when(F.col("is_title"), "title").when(F.col("is_run"), "item").when(before > 0, "outro").otherwise("intro"))
    prose = rows.where("role != 'item'").select("file_id", "role", "block_no", F.when(F.col("is_title"), T.trim(T.sub(F.col("block"), rf"^##{P.SPACE}*", ""))).otherwise(F.col("block")).alias("text"), F.lit(None).cast("string").alias("note"))
    items = rows.where("role = 'item'").select("file_id", "format", "block_no", F.posexplode("found").alias("i", "text"))
    w = Window.partitionBy("file_id").orderBy("block_no", "i")
    items = items.withColumn("is_example", (F.col("format") != "worksheet") & T.has(F.col("text"), EXAMPLE))
    items = items.withColumn("run", F.sum((~F.col("is_example")).cast("int")).over(w))
    nth = F.sum(F.col("is_example").cast("int")).over(Window.partitionBy("file_id", "run").orderBy("block_no", "i"))
    # In a run of examples every other one is a note: the first, where an item leads the run, else the second.
    is_note = F.col("is_example") & (nth % 2 == F.when(F.col("run") > 0, 1).otherwise(0))
    items = items.withColumn("is_note", is_note)
    follows = F.lead(F.when(F.col("is_note"), F.col("text"))).over(w)
    items = items.withColumn("note", follows).where("NOT is_note").select("file_id", F.lit("item").alias("role"), "block_no", "i", "text", "note")
    order = F.row_number().over(Window.partitionBy("file_id", "role").orderBy("block_no", "i"))
    return prose.withColumn("i", F.lit(0)).unionByName(items).select("file_id", "role", order.alias("nth"), "text", "note")


def field_labels(parts: DataFrame) -> DataFrame:
    """Worksheet items: the label before the first bullet, and the guidance after it."""
    found = T.bullets(F.col("text"))
    return parts.where("role = 'item'").select("file_id", "nth", F.coalesce(F.get(found, F.lit(0)), F.col("text")).alias("label"), F.array_join(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), " · ").alias("guidance"))


def sheet_items(parts: DataFrame, files: DataFrame) -> DataFrame:
    """The list entries of each sheet in HTML: file_id, nth, html."""
    rows = parts.where("role = 'item'").join(files.select("file_id", "format"), "file_id")
    note = F.when(F.col("note").isNotNull(), F.concat(F.lit('\n<p class="checklist-example">'), T.escaped(F.col("note")), F.lit("</p>"))).otherwise("")
    check = F.concat(F.lit('<li class="checklist-item"><span class="checklist-box"></span>'), T.escaped(F.col("text")), note, F.lit("</li>"))
    found = T.bullets(F.col("text"))
    label = T.escaped(F.coalesce(F.get(found, F.lit(0)), F.col("text")))
    guide = F.when(F.size(found) > 1, F.concat(F.lit('\n<p class="worksheet-guide">'), T.escaped(F.array_join(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), " · ")), F.lit("</p>"))).otherwise("")
    field = F.concat(F.lit('<li class="worksheet-field">\n<p class="worksheet-label">'), label, F.lit("</p>"), guide, F.lit('\n<span class="worksheet-rule" data-field="f'), F.col("nth").cast("string"), F.lit('" data-field-label="'), label, F.lit('"></span>\n</li>'))
    return rows.select("file_id", "nth", F.when(F.col("format") == "worksheet", field).otherwise(check).alias("html"))


def field_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes in pixels from the top to points from the bottom: boxes have project, page_height, left, top, width, height."""
    pt = lambda c: F.col(c) * 0.75
    return boxes.select("project", pt("left").alias("x"), (pt("page_height") - pt("top") - pt("height")).alias("y"), pt("width").alias("width"), pt("height").alias("height"))


def content_lines(files: DataFrame, least: int = 15) -> DataFrame:
    """files: file_id, text. Lines with a bonus file's own words: headings, list marks and short lines left out."""
    rows = files.select("file_id", F.posexplode(F.transform(F.split("text", "\n"), T.trim)).alias("line_id", "line"))
    bare = T.sub(T.sub(F.col("line"), rf"^[0-9]+[.)]{P.SPACE}+", ""), rf"^[-*]{P.SPACE}+", "")
    return rows.where((F.col("line") != "") & ~F.startswith("line", F.lit("#"))).select("file_id", "line_id", bare.alias("line")).where(F.length("line") >= least)
