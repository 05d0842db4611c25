"""Inputs for the document operators, derived from the plain tables by fixed rules, in Spark and (as SQL prefixes) in DuckDB.

The tables hold prose without Markdown; line i of a document becomes a heading, a numbered item and so on by i modulo 12, with faults put in by
doc_id. Every rule looks at doc_id and the line number alone, so the result is the same however rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, line_no (from 0), line, n_lines."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    out = docs.select("doc_id", "source", "lang", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("line_no", "line"))
    return out.select("doc_id", "source", "lang", "line_no", "line", "n_lines")


LINES = """dl AS (
  SELECT doc_id, source, lang, (i - 1)::INT AS line_no, ls[i] AS line, len(ls)::INT AS n_lines
  FROM (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents))"""


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, line_no, block_at (the first line of its block), md."""
    k, i, d = F.col("line_no") % 12, F.col("line_no"), F.col("doc_id")
    first = F.regexp_extract("line", r"^([^ |]*)", 1)
    item = F.when(d % 5 == 0, F.when(k == 2, "First ").when(k == 3, "Then ").otherwise("")).when(d % 4 == 2, "Check ").otherwise("")
    number = (k - 1 + F.when(d % 3 == 1, 1).otherwise(0)).cast("string")
    fault = F.when((d % 17 == 3) & (k == 1), "� (cid:7)").when((d % 19 == 4) & (k == 1), "\u0091 x").otherwise("")
    md = (
        F.when(k == 0, F.concat(F.when(i == 0, "# ").when(d % 7 == 1, "## 3 ways to ").otherwise("## "), "line"))
        .when(k.isin(2, 3, 4), F.concat(number, F.lit(". "), item, "line"))
        .when(k == 5, F.concat(F.lit("> "), "line"))
        .when(k == 6, F.concat(F.when(d % 2 == 0, "Warning: ").otherwise("Note: "), "line"))
        .when(k.isin(7, 8, 9), F.concat(F.when(d % 6 == 5, "* ").otherwise("- "), item, "line"))
        .when(k == 10, F.concat(F.lit("| a | "), first, F.when(d % 3 == 0, " | c | d | e").otherwise(""), F.lit(" |\n| --- | --- |\n| 1 | 2 |")))
        .when(k == 11, F.concat(F.lit("total = "), i.cast("string"), F.lit(" + "), F.col("line")))
        .otherwise(F.concat("line", fault))
    )
    at = F.when(k.isin(2, 3, 4), i - k + 2).when(k.isin(7, 8, 9), i - k + 7).otherwise(i)
    return doc_lines(spark, sf_dir).select("doc_id", "source", "line_no", at.alias("block_at"), md.alias("md"))


def md_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project (source), file_id (doc_id), type, start_page, end_page, text: a Markdown file for each document."""
    blocks = md_lines(spark, sf_dir).groupBy("doc_id", "source", "block_at").agg(F.sort_array(F.collect_list(F.struct("line_no", "md"))).alias("ls"))
    blocks = blocks.select("doc_id", "source", "block_at", F.array_join(F.transform("ls", lambda x: x["md"]), "\n").alias("md"))
    files = blocks.groupBy("doc_id", "source").agg(F.sort_array(F.collect_list(F.struct("block_at", "md"))).alias("bs"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("doc_id") % 8 == 0, "introduction").when(F.col("doc_id") % 8 == 1, "conclusion").otherwise("chapter")
    text = F.concat(F.array_join(F.transform("bs", lambda x: x["md"]), "\n\n"), F.lit("\n"))
    start = (F.col("doc_id") % 90 + 1).cast("int")
    return files.select(F.col("source").alias("project"), F.col("doc_id").alias("file_id"), kind.alias("type"), start.alias("start_page"), (start + F.col("doc_id") % 4).cast("int").alias("end_page"), text.alias("text"))


MD = (
    LINES
    + """,
mk AS (
  SELECT *, line_no % 12 AS k, regexp_extract(line, '^([^ |]*)', 1) AS w1,
    CASE WHEN doc_id % 5 = 0 THEN CASE line_no % 12 WHEN 2 THEN 'First ' WHEN 3 THEN 'Then ' ELSE '' END WHEN doc_id % 4 = 2 THEN 'Check ' ELSE '' END AS item FROM dl),
ml AS (
  SELECT doc_id, source, line_no,
    CASE WHEN k IN (2, 3, 4) THEN line_no - k + 2 WHEN k IN (7, 8, 9) THEN line_no - k + 7 ELSE line_no END AS block_at,
    CASE WHEN k = 0 THEN CASE WHEN line_no = 0 THEN '# ' WHEN doc_id % 7 = 1 THEN '## 3 ways to ' ELSE '## ' END || line
      WHEN k IN (2, 3, 4) THEN (k - 1 + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END)::VARCHAR || '. ' || item || line
      WHEN k = 5 THEN '> ' || line
      WHEN k = 6 THEN CASE WHEN doc_id % 2 = 0 THEN 'Warning: ' ELSE 'Note: ' END || line
      WHEN k IN (7, 8, 9) THEN CASE WHEN doc_id % 6 = 5 THEN '* ' ELSE '- ' END || item || line
      WHEN k = 10 THEN '| a | ' || w1 || CASE WHEN doc_id % 3 = 0 THEN ' | c | d | e' ELSE '' END || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |'
      WHEN k = 11 THEN 'total = ' || line_no::VARCHAR || ' + ' || line
      ELSE line || CASE WHEN doc_id % 17 = 3 AND k = 1 THEN chr(65533) || ' (cid:7)' WHEN doc_id % 19 = 4 AND k = 1 THEN chr(145) || ' x' ELSE '' END END AS md FROM mk),
mb AS (SELECT doc_id, source, block_at, string_agg(md, chr(10) ORDER BY line_no) AS md FROM ml GROUP BY ALL),
mf AS (
  SELECT source AS project, doc_id AS file_id, CASE WHEN doc_id % 8 = 0 THEN 'introduction' WHEN doc_id % 8 = 1 THEN 'conclusion' ELSE 'chapter' END AS type,
    (doc_id % 90 + 1)::INT AS start_page, (doc_id % 90 + 1 + doc_id % 4)::INT AS end_page, string_agg(md, chr(10) || chr(10) ORDER BY block_at) || chr(10) AS text
  FROM mb GROUP BY source, doc_id)"""
)
