"""Writers. Each is safe to run again: results are overwritten as a whole, logs are appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import schemas


def write_files(files: DataFrame, path: str) -> None:
    """files: project, file, text. One folder per project and file, with the text as one part in it; what was there before is cleared."""
    files.select("project", "file", F.col("text").alias("value")).write.partitionBy("project", "file").mode("overwrite").text(path, lineSep="\x00")


def write_valid_json(rows: DataFrame, violations: DataFrame, path: str) -> None:
    """Rows as JSON lines, unless there are violations (rule_id, row_key): then nothing is written and the first of them are named."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("invalid rows: " + ", ".join(f"{v.rule_id} at {v.row_key}" for v in found))
    rows.write.mode("overwrite").json(path)


def write_documents(documents: DataFrame, schema: dict, path: str) -> None:
    """documents: json (one document each) and any columns. Written as lines of JSON, unless one breaks the schema: then nothing is written and the first errors are named with their paths."""
    schemas.checked(documents, "json", schema).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def report(findings: DataFrame) -> DataFrame:
    """findings: category, project, file_id, detail. A Markdown report for each project: project, text. Bars in cells are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell("category"), cell("file_id"), F.regexp_replace(cell("detail"), r"\s+", " ")), F.lit(" |"))
    rows = findings.select("project", "category", "file_id", line.alias("line"))
    order = F.array_sort(F.collect_list(F.struct("category", "file_id", "line")))
    body = F.array_join(F.transform(order, lambda x: x["line"]), "\n")
    head = F.lit("| category | file | detail |\n| --- | --- | --- |\n")
    return rows.groupBy("project").agg(F.concat(F.lit("# Audit of "), F.first("project").cast("string"), F.lit("\n\n"), F.count(F.lit(1)).cast("string"), F.lit(" finding(s)\n\n"), head, body, F.lit("\n")).alias("text"))


def settings_text(rows: DataFrame) -> DataFrame:
    """rows: project, key (group.name), value. A YAML mapping of two levels for each project, values quoted: project, text."""
    group, name = F.substring_index("key", ".", 1), F.regexp_extract("key", r"^[^.]*\.(.*)$", 1)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = rows.groupBy("project", group.alias("group")).agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), quoted.alias("value")))).alias("vs"))
    part = F.concat("group", F.lit(":\n"), F.array_join(F.transform("vs", lambda v: F.concat(F.lit("  "), v["name"], F.lit(": "), v["value"])), "\n"))
    return lines.groupBy("project").agg(F.concat(F.array_join(F.array_sort(F.collect_list(part)), "\n"), F.lit("\n")).alias("text"))


def whole_text(parts: DataFrame) -> DataFrame:
    """parts: project, ordinal, nth, html. The sections of each project that have text, joined in order by blank lines."""
    order = F.array_sort(F.collect_list(F.struct("ordinal", "nth", "html")))
    return parts.where("html IS NOT NULL").groupBy("project").agg(F.array_join(F.transform(order, lambda x: x["html"]), "\n\n").alias("html"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows, the last by `order` for each key."""
    rows = old.unionByName(new).withColumn("nth_from_last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())))
    return rows.where("nth_from_last = 1").drop("nth_from_last")
