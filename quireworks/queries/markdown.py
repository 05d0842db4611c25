from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markdown
from ..plans import lift
from .sql import BLOCKS, preview, words


def _files(spark, d):
    return lift.md_files(spark, d)


def _blocks(spark, d):
    rows = markdown.blocks(_files(spark, d))
    return rows.select("file_id", "block_no", "kind", "level", "ordered", F.array_join("items", "¦").alias("items"), F.array_join("header", "¦").alias("header"), F.size("rows").cast("long").alias("n_rows"), "text")


PLAN = rf"""n AS (SELECT *, lead(text) OVER (PARTITION BY file_id ORDER BY block_no) AS following FROM b),
c0 AS (
  SELECT *, len(items) AS n, len(list_filter(items, lambda x: regexp_matches(x, '(?i)\b(first|second|third|fourth|fifth|next|then|last|finally|afterwards?|before that|to begin|to start)\b'))) AS ordinals,
    len(list_filter(items, lambda x: regexp_matches(x, '(?i)^(check|verify|confirm|ensure|make sure|double-check|review that|test that)\b'))) AS checks,
    regexp_matches(coalesce(following, ''), '(?i)\b(that|this)\s+(order|sequence)\s+matters?\b|\bin\s+(that|this)\s+order\b|\border\s+matters?\b') AS asserts,
    len(header) AS cols, regexp_matches(text, '(?i)^(warning|caution|never|important)\b') AS warns,
    length(text) <= 200 AND regexp_matches(text, '=.*[-+*/%]|[-+*/%].*=') AS calc FROM n WHERE kind <> 'heading'),
c1 AS (
  SELECT *, CASE WHEN kind = 'list' THEN CASE WHEN n < 3 THEN 'editorial-body' WHEN ordered AND (ordinals >= 2 OR asserts) THEN 'process-steps' WHEN checks / n >= 0.6 THEN 'checklist' WHEN ordered THEN 'process-steps' ELSE 'editorial-body' END
      WHEN kind = 'table' THEN CASE WHEN cols <= 4 THEN 'comparison-table' ELSE 'editorial-body' END WHEN kind = 'blockquote' THEN 'pull-quote' WHEN warns THEN 'warning-callout' WHEN calc THEN 'calculation-card' ELSE 'editorial-body' END AS c,
    CASE WHEN kind = 'list' THEN CASE WHEN n < 3 THEN 'ambiguous-leftover:short-list' WHEN ordered AND asserts THEN 'ordinal:asserted' WHEN ordered AND ordinals >= 2 THEN 'ordinal:named' WHEN checks / n >= 0.6 THEN 'check-wording' WHEN ordered THEN 'numbered-list' ELSE 'plain-list' END
      WHEN kind = 'table' THEN CASE WHEN cols <= 4 THEN 'narrow-table' ELSE 'wide-table' END WHEN kind = 'blockquote' THEN 'blockquote' WHEN warns THEN 'starts-with-warning' WHEN calc THEN 'formula' ELSE 'default' END AS r,
    row_number() OVER (PARTITION BY file_id ORDER BY block_no) - 1 AS index, block_no = max(block_no) OVER (PARTITION BY file_id) AS is_last FROM c0),
c2 AS (
  SELECT *, is_last AND kind = 'list' AND c IN ('process-steps', 'checklist') AS takes,
    c = 'pull-quote' AND sum((c = 'pull-quote')::INT) OVER (PARTITION BY file_id ORDER BY block_no) > 1 AS spare FROM c1),
p AS (
  SELECT file_id, index, CASE WHEN takes THEN 'key-takeaways' WHEN spare THEN 'editorial-body' ELSE c END AS component, kind AS source_kind,
    CASE WHEN takes THEN 'last-list' WHEN spare THEN r || '+budget' ELSE r END AS rule,
    {preview("CASE kind WHEN 'table' THEN array_to_string(header, ' | ') WHEN 'list' THEN array_to_string(items, '; ') ELSE text END")} AS preview FROM c2)"""

QUERIES = {
    "markdown_blocks": _blocks,
    "component_plan": lambda s, d: markdown.plan(_files(s, d)),
    "chapter_plans": lambda s, d: markdown.chapter_plans(_files(s, d)),
}
ORACLES = {
    "markdown_blocks": f"WITH {lift.MD}, {BLOCKS} SELECT file_id, block_no, kind, level, ordered, array_to_string(items, '¦') AS items, array_to_string(header, '¦') AS header, n_rows, text FROM b",
    "component_plan": f"WITH {lift.MD}, {BLOCKS}, {PLAN} SELECT * FROM p",
    "chapter_plans": f"""WITH {lift.MD}, {BLOCKS}, {PLAN},
a AS (SELECT file_id, count(*) AS n, count(*) FILTER (component = 'editorial-body') AS body, count(*) FILTER (starts_with(rule, 'ambiguous-leftover')) AS amb FROM p GROUP BY file_id),
k AS (SELECT file_id, string_agg(component || '=' || n, ',' ORDER BY component) AS component_counts FROM (SELECT file_id, component, count(*) AS n FROM p GROUP BY ALL) GROUP BY file_id),
f AS (SELECT mf.file_id, type, {words("text")} AS words, coalesce(n, 0) AS n, coalesce(body, 0) AS body, amb, coalesce(component_counts, '') AS component_counts FROM mf LEFT JOIN a USING (file_id) LEFT JOIN k USING (file_id)),
g AS (SELECT *, CASE WHEN n > 0 THEN body / n ELSE 0.0 END AS ratio, words / 275 AS pages, ceil(words / 275 / 4)::BIGINT AS wanted, n - body AS actual FROM f)
SELECT file_id, component_counts, ratio AS editorial_body_ratio, pages AS estimated_pages, wanted AS min_non_body, actual AS actual_non_body,
  concat_ws(',', CASE WHEN ratio > 0.7 THEN 'mostly-body' END, CASE WHEN actual < wanted AND type NOT IN ('introduction', 'conclusion') THEN 'few-components' END, CASE WHEN amb > 0 THEN 'ambiguous' END) AS warnings FROM g""",
}
