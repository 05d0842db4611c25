"""Findings about Markdown files: duplicates, damage, gaps. Each detector gives category, project, file_id, detail; findings() is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

FEW_WORDS, FEW_PER_PAGE = 20, 0.25
LIST_LINE = rf"(?m)^([-*]|[0-9]+[.)]){P.SPACE}"


def duplicate_titles(entries: DataFrame) -> DataFrame:
    """entries: project, pos, id, title. Titles (trimmed, lower case) that a project has twice or more, with their ids in order."""
    same = entries.groupBy("project", F.lower(T.trim(F.col("title"))).alias("title")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("at"))
    return same.where("n > 1").select("project", "title", "n", F.transform("at", lambda x: x["id"]).alias("ids"))


def densities(files: DataFrame) -> DataFrame:
    """files: project, file_id, start_page, end_page, text. Adds words, pages, density, and the project's median density where it has three files or more."""
    pages = F.greatest(F.lit(1), F.col("end_page") - F.col("start_page") + 1)
    rows = files.select("project", "file_id", T.word_count(F.col("text")).alias("words"), pages.alias("pages")).withColumn("density", F.col("words") / F.col("pages"))
    usual = rows.groupBy("project").agg(F.when(F.count(F.lit(1)) >= 3, F.median("density")).alias("usual"))
    return rows.join(usual.withColumnRenamed("project", "of"), F.col("project").eqNullSafe(F.col("of"))).drop("of")


def near_empty(files: DataFrame) -> DataFrame:
    rows = densities(files)
    sparse = F.coalesce(F.col("density") < F.col("usual") * FEW_PER_PAGE, F.lit(False))
    rows = rows.where((F.col("words") < FEW_WORDS) | sparse)
    return rows.select(F.lit("near-empty-section").alias("category"), "project", "file_id", F.concat(F.col("words").cast("string"), F.lit("/"), F.col("pages").cast("string"), F.when(sparse, "/median").otherwise("/floor")).alias("detail"))


def broken_characters(files: DataFrame) -> DataFrame:
    """Replacement characters and (cid:N) by count; control characters U+0080 to U+009F by the context of the first."""
    text = F.col("text")
    n = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    rows = files.select("project", "file_id", n.alias("n"), F.regexp_count(text, F.lit(P.CID)).alias("cids"), T.snippet(text, P.C1).alias("context"))
    counts = F.concat(F.lit("replacement="), F.col("n").cast("string"), F.lit(",cid="), F.col("cids").cast("string"))
    found = F.array_compact(F.array(F.when((F.col("n") > 0) | (F.col("cids") > 0), counts), F.when(F.col("context").isNotNull(), F.concat(F.lit("control="), "context"))))
    return rows.select(F.lit("broken-characters").alias("category"), "project", "file_id", F.explode(found).alias("detail"))


def malformed_lists(files: DataFrame) -> DataFrame:
    """Blocks of numbered lines only that do not run 1, 2, 3; and single items that look cut off, by their end or by what follows."""
    # What follows comes from the same text: files of one name (bonuses with one slug) must not follow each other.
    blocks = files.select("project", "file_id", F.split("text", r"\n\n+").alias("bs"))
    raw = blocks.select("project", "file_id", F.inline(F.arrays_zip(F.col("bs").alias("block"), F.slice("bs", F.lit(2), F.size("bs")).alias("following"))))
    raw = raw.where("block IS NOT NULL").withColumn("following", T.trim(F.coalesce("following", F.lit(""))))
    rows = raw.withColumn("ls", T.parts(F.col("block"), "\n"))
    rows = rows.where((F.size("ls") > 0) & F.forall("ls", lambda x: T.has(x, P.NUMBERED_LINE)))
    numbers = F.transform("ls", lambda x: F.regexp_extract(x, r"^([0-9]+)", 1).try_cast("bigint"))
    ordered = F.forall(F.arrays_zip(numbers.alias("n"), F.sequence(F.lit(1), F.size("ls")).alias("i")), lambda x: F.coalesce(x["n"] == x["i"], F.lit(False)))
    item = T.trim(T.sub(F.col("ls")[0], rf"^[0-9]+[.)]{P.SPACE}+", ""))
    cut = ~T.has(item, P.ENDS_SENTENCE) | T.has(F.col("following"), P.CONTINUES)
    lone = F.size("ls") == 1
    detail = F.when(~lone & ~ordered, F.concat(F.lit("numbers="), F.array_join(numbers.cast("array<string>"), ","))).when(lone & (F.col("following") != "") & cut, F.concat(F.lit("fragment="), F.substring(item, 1, 60)))
    return rows.select(F.lit("malformed-list").alias("category"), "project", "file_id", detail.alias("detail")).where("detail IS NOT NULL")


def truncated_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs that are no heading, quote, table or list, are not shaped like a heading, and end in neither a sentence's nor a soft mark."""
    rows = files.select("project", "file_id", F.explode(T.paragraphs(F.col("text"))).alias("block"))
    block = F.col("block")
    heading_shaped = ~F.contains(block, F.lit("\n")) & (F.size(F.split(block, rf"{P.SPACE}+")) <= 10)
    skipped = T.has(block, rf"^#{{1,6}}{P.SPACE}") | T.has(block, r"^[>|]") | T.has(block, LIST_LINE) | heading_shaped | T.has(block, P.ENDS_SENTENCE) | T.has(block, P.ENDS_SOFTLY)
    return rows.where(~skipped).select(F.lit("truncated-paragraph").alias("category"), "project", "file_id", F.right(block, F.lit(60)).alias("detail"))


def unfulfilled_headings(files: DataFrame) -> DataFrame:
    """Headings that promise a structure over sections without a list, or with a quarter of the file's usual words at most."""
    w = Window.partitionBy("project", "file_id").orderBy("block_no")
    rows = files.select("project", "file_id", F.posexplode(T.paragraphs(F.col("text"))).alias("block_no", "block"))
    block = F.col("block")
    short = ~F.contains(block, F.lit("\n")) & (F.size(F.split(block, rf"{P.SPACE}+")) <= 10) & ~T.has(block, r"[.!?]\z")
    rows = rows.withColumn("is_heading", T.has(block, rf"^#{{1,6}}{P.SPACE}") | short)
    rows = rows.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w)).where("section > 0")
    own = rows.groupBy("project", "file_id", "section").agg(
        F.max(F.when(F.col("is_heading"), T.sub(block, rf"^#+{P.SPACE}*", ""))).alias("heading"),
        F.sum(F.when(F.col("is_heading"), 0).otherwise(T.word_count(block))).alias("words"),
        F.coalesce(F.bool_or(~F.col("is_heading") & T.has(block, LIST_LINE)), F.lit(False)).alias("has_list"),
    )
    usual = F.median(F.when(F.col("words") > 0, F.col("words"))).over(Window.partitionBy("project", "file_id"))
    own = own.withColumn("usual", usual).withColumn("thin", F.coalesce((F.col("usual") > 0) & (F.col("words") < F.col("usual") * FEW_PER_PAGE), F.lit(False)))
    own = own.where(T.has(F.col("heading"), P.PROMISE) & (~F.col("has_list") | F.col("thin")))
    why = F.concat_ws("+", F.when(~F.col("has_list"), "no-list"), F.when(F.col("thin"), "thin"))
    return own.select(F.lit("unfulfilled-heading").alias("category"), "project", "file_id", F.concat(why, F.lit(": "), "heading").alias("detail"))


def title_findings(entries: DataFrame) -> DataFrame:
    found = duplicate_titles(entries)
    return found.select(F.lit("duplicate-title").alias("category"), "project", F.col("ids")[0].alias("file_id"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("detail"))


def findings(entries: DataFrame, files: DataFrame) -> DataFrame:
    """All six detectors. entries: project, pos, id, title; files: project, file_id, start_page, end_page, text."""
    found = [title_findings(entries), *(f(files) for f in (broken_characters, near_empty, malformed_lists, truncated_paragraphs, unfulfilled_headings))]
    return reduce(DataFrame.unionByName, found)
