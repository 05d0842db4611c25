"""Markdown blocks and the component plan of a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

WORDS_PER_PAGE = 275


def _cells(line: Column) -> Column:
    return F.transform(F.split(T.sub(T.sub(line, r"^\|", ""), r"\|\z", ""), r"\|"), T.trim)


def blocks(files: DataFrame) -> DataFrame:
    """files: file_id, text. One row per block: file_id, block_no, kind (heading, table, list, blockquote, paragraph; the first rule that fits),
    level, ordered, items, header, rows, text (what follows up as the block's text)."""
    chunks = F.filter(F.transform(F.split("text", rf"\n{P.SPACE}*\n+"), T.trim), lambda c: c != "")
    rows = files.select("file_id", F.posexplode(chunks).alias("block_no", "chunk"))
    rows = rows.withColumn("ls", F.transform(F.split("chunk", "\n"), T.trim))
    first, every = F.col("ls")[0], lambda pattern: F.forall("ls", lambda x: T.has(x, pattern))
    kind = (
        F.when((F.size("ls") == 1) & T.has(first, P.HEADING), "heading")
        .when(F.forall("ls", lambda x: F.startswith(x, F.lit("|"))), "table")
        .when(every(P.ORDERED_ITEM), "ordered")
        .when(every(P.UNORDERED_ITEM), "unordered")
        .when(F.forall("ls", lambda x: F.startswith(x, F.lit(">"))), "blockquote")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("k", kind)
    item = lambda pattern: F.transform("ls", lambda x: T.trim(F.regexp_extract(x, pattern, 1)))
    items = F.when(F.col("k") == "ordered", item(P.ORDERED_ITEM)).when(F.col("k") == "unordered", item(P.UNORDERED_ITEM))
    header = F.when(F.col("k") == "table", _cells(first))
    body = F.when(F.col("k") == "table", F.transform(F.slice("ls", F.lit(3), F.size("ls")), _cells))
    rows = rows.withColumns({"items": items, "header": header, "rows": body})
    text = (
        F.when(F.col("k") == "heading", T.trim(F.regexp_extract(first, P.HEADING, 2)))
        .when(F.col("k") == "table", F.array_join("header", " "))
        .when(F.col("items").isNotNull(), F.array_join("items", " "))
        .when(F.col("k") == "blockquote", T.trim(F.array_join(F.transform("ls", lambda x: T.sub(x, rf"^>{P.SPACE}?", "")), " ")))
        .otherwise(F.array_join("ls", " "))
    )
    level = F.when(F.col("k") == "heading", F.length(F.regexp_extract(first, P.HEADING, 1)))
    ordered = F.when(F.col("items").isNotNull(), F.col("k") == "ordered")
    name = F.when(F.col("items").isNotNull(), "list").otherwise(F.col("k"))
    return rows.select("file_id", "block_no", name.alias("kind"), level.alias("level"), ordered.alias("ordered"), "items", "header", "rows", text.alias("text"))


def _list_rule(items: Column, ordered: Column, following: Column) -> tuple[Column, Column]:
    n = F.size(items)
    ordinals = F.size(F.filter(items, lambda x: T.has(x, P.ORDINAL)))
    asserts = T.has(F.coalesce(following, F.lit("")), P.ORDER_MATTERS)
    checks = F.size(F.filter(items, lambda x: T.has(x, P.CHECK)))
    steps = ordered & ((ordinals >= 2) | asserts)
    check = checks / F.greatest(n, F.lit(1)) >= 0.6
    component = F.when(n < 3, "editorial-body").when(steps, "process-steps").when(check, "checklist").when(ordered, "process-steps").otherwise("editorial-body")
    rule = (
        F.when(n < 3, "ambiguous-leftover:short-list")
        .when(steps, F.when(asserts, "ordinal:asserted").otherwise("ordinal:named"))
        .when(check, "check-wording")
        .when(ordered, "numbered-list")
        .otherwise("plain-list")
    )
    return component, rule


def plan(files: DataFrame) -> DataFrame:
    """files: file_id, text. One row per content block: file_id, index, component, source_kind, rule, preview. The look-ahead sees headings, the index does not;
    the last list becomes the takeaways; only the first quote of a file stays a quote. In that order."""
    w = Window.partitionBy("file_id").orderBy("block_no")
    rows = blocks(files).withColumn("following", F.lead("text").over(w)).where("kind != 'heading'")
    component, rule = _list_rule(F.col("items"), F.col("ordered"), F.col("following"))
    columns = F.size("header")
    calculation = (F.length("text") <= 200) & T.has(F.col("text"), P.CALCULATION)
    warns = T.has(T.trim(F.col("text")), P.WARNING)
    kind = F.col("kind")
    rows = rows.withColumn(
        "c",
        F.when(kind == "list", component)
        .when(kind == "table", F.when(columns <= 4, "comparison-table").otherwise("editorial-body"))
        .when(kind == "blockquote", "pull-quote")
        .when(warns, "warning-callout")
        .when(calculation, "calculation-card")
        .otherwise("editorial-body"),
    ).withColumn(
        "r",
        F.when(kind == "list", rule)
        .when(kind == "table", F.when(columns <= 4, "narrow-table").otherwise("wide-table"))
        .when(kind == "blockquote", "blockquote")
        .when(warns, "starts-with-warning")
        .when(calculation, "formula")
        .otherwise("default"),
    )
    shown = F.when(kind == "table", F.array_join("header", " | ")).when(kind == "list", F.array_join("items", "; ")).otherwise(F.col("text"))
    rows = rows.withColumns({"index": F.row_number().over(w) - 1, "is_last": F.lead("block_no").over(w).isNull()})
    last = F.col("is_last") & (kind == "list") & F.col("c").isin("process-steps", "checklist")
    rows = rows.withColumns({"r": F.when(last, "last-list").otherwise(F.col("r")), "c": F.when(last, "key-takeaways").otherwise(F.col("c"))})
    quotes = F.sum(F.when(F.col("c") == "pull-quote", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spare = (F.col("c") == "pull-quote") & (quotes > 1)
    rows = rows.withColumn("spare", spare)
    component, rule = F.when(F.col("spare"), "editorial-body").otherwise(F.col("c")), F.when(F.col("spare"), F.concat("r", F.lit("+budget"))).otherwise(F.col("r"))
    return rows.select("file_id", F.col("index").cast("long").alias("index"), component.alias("component"), kind.alias("source_kind"), rule.alias("rule"), T.preview(shown).alias("preview"))


def plan_totals(plans: DataFrame, project: str) -> DataFrame:
    """Blocks and files of each project: plans are rows of plan() with a column that names the project."""
    return plans.groupBy(F.col(project).alias("project")).agg(F.count(F.lit(1)).alias("blocks"), F.count_distinct("file_id").alias("files"))


def plan_report(files: DataFrame) -> DataFrame:
    """files: file_id, type, text. Each file's part of the coverage report in Markdown: file_id, text. A project's report is its files' parts in order."""
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell("index"), cell("component"), cell("source_kind"), cell("rule")), F.lit(" |"))
    lines = plan(files).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("ls"))
    rows = chapter_plans(files).join(lines, "file_id", "left")
    blocks_ = F.coalesce(F.size("ls"), F.lit(0))
    warned = F.when(F.col("warnings") != "", F.concat(F.lit("\n**Warnings:**\n- "), F.replace(F.col("warnings"), F.lit(","), F.lit("\n- ")), F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit("## "), F.col("file_id").cast("string"), F.lit("\n\n- Blocks: "), F.when(F.col("ls").isNull(), 0).otherwise(blocks_).cast("string"), F.lit("\n- Estimated pages: "), F.format_string("%.1f", F.round("estimated_pages", 1)), F.lit("\n- Editorial-body ratio: "), F.round(F.col("editorial_body_ratio") * 100).cast("long").cast("string"),
        F.lit("%\n- Non-body components: "), F.col("actual_non_body").cast("string"), F.lit(" (budget minimum: "), F.col("min_non_body").cast("string"), F.lit(")\n\n| # | Component | Source | Rule |\n|---|---|---|---|\n"), F.coalesce(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("")), F.lit("\n"), warned,
    )
    return rows.select("file_id", text.alias("text"))


def chapter_plans(files: DataFrame) -> DataFrame:
    """files: file_id, type, text. Budget figures of each file: component counts, ratio of body blocks, pages, wanted and actual other components, warnings."""
    per = plan(files).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("component") == "editorial-body").alias("body"),
        F.count_if(F.startswith("rule", F.lit("ambiguous-leftover"))).alias("ambiguous"),
        F.collect_list("component").alias("all"),
    )
    rows = files.select("file_id", "type", T.word_count(F.col("text")).alias("words")).join(per, "file_id", "left")
    n, body = F.coalesce("n", F.lit(0)), F.coalesce("body", F.lit(0))
    ratio = F.when(n > 0, body / n).otherwise(0.0)
    pages = F.col("words") / WORDS_PER_PAGE
    wanted = F.ceil(pages / 4)
    rows = rows.withColumns({"ratio": ratio, "pages": pages, "wanted": wanted, "actual": n - body})
    warnings = F.array_compact(
        F.array(
            F.when(F.col("ratio") > 0.7, "mostly-body"),
            F.when((F.col("actual") < F.col("wanted")) & ~F.col("type").isin("introduction", "conclusion"), "few-components"),
            F.when(F.col("ambiguous") > 0, "ambiguous"),
        )
    )
    every = F.coalesce("all", F.array().cast("array<string>"))
    counts = F.transform(F.array_sort(F.array_distinct(every)), lambda c: F.concat(c, F.lit("="), F.size(F.filter(every, lambda x: x == c)).cast("string")))
    return rows.select("file_id", F.array_join(counts, ",").alias("component_counts"), F.col("ratio").alias("editorial_body_ratio"), F.col("pages").alias("estimated_pages"), F.col("wanted").cast("long").alias("min_non_body"), F.col("actual").cast("long").alias("actual_non_body"), F.array_join(warnings, ",").alias("warnings"))
