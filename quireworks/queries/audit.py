from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..plans import lift
from .sql import S, collapse, trim, words


def entries(spark, d):
    """A title for each document: the first line; titles recur as documents do."""
    docs = lift.table(spark, d, "documents")
    return docs.select(F.col("source").alias("project"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"))


def _joined(spark, d):
    found = audit.duplicate_titles(entries(spark, d))
    return found.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array(text, '\n{S}*\n'), lambda x: {trim('x')}), lambda x: x <> '')"
SENTENCE = r"[.!?][\"'')\]]?\z"
PROMISE = (
    r"(?i)\b(do(e?s)?\s+and\s+(don''?ts?|do\s*nots?)|pros\s+and\s+cons|before\s+and\s+after|dos?\s*/\s*don''?ts?)\b|^\s*\d+\s+(ways?|steps?|rules?|reasons?|things?|mistakes?)\b"
    r"|\bthe\s+\d+\s+(ways?|steps?|rules?|reasons?|checks?)\b|\bvs\.?\b|\bversus\b"
)
ENTRIES = "en AS (SELECT source AS project, doc_id AS pos, doc_id AS id, string_split(coalesce(text, ''), chr(10))[1] AS title FROM documents)"
DUPLICATES = f"du AS (SELECT project, lower({trim('title')}) AS title, count(*) AS n, list(id ORDER BY pos) AS ids FROM en GROUP BY 1, 2 HAVING count(*) > 1)"
DENSITY = f"""d0 AS (SELECT project, file_id, {words('text')} AS words, greatest(1, end_page - start_page + 1) AS pages FROM mf),
d1 AS (SELECT *, words / pages AS density FROM d0),
d2 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY project) >= 3 THEN median(density) OVER (PARTITION BY project) END AS usual FROM d1)"""
NEAR = """ne AS (
  SELECT 'near-empty-section' AS category, project, file_id, words || '/' || pages || CASE WHEN coalesce(density < usual * 0.25, false) THEN '/median' ELSE '/floor' END AS detail
  FROM d2 WHERE words < 20 OR coalesce(density < usual * 0.25, false))"""
BROKEN = rf"""br0 AS (
  SELECT project, file_id, length(text) - length(replace(text, chr(65533), '')) AS n, len(regexp_extract_all(text, '\(cid:\d+\)')) AS cids,
    length(regexp_extract(text, '^([^\x{{80}}-\x{{9F}}]*)[\x{{80}}-\x{{9F}}]', 1)) AS before, regexp_matches(text, '[\x{{80}}-\x{{9F}}]') AS has, text FROM mf),
br AS (
  SELECT 'broken-characters' AS category, project, file_id, 'replacement=' || n || ',cid=' || cids AS detail FROM br0 WHERE n > 0 OR cids > 0
  UNION ALL SELECT 'broken-characters', project, file_id, 'control=' || {collapse("text[greatest(before - 29, 1):before + 60]")} FROM br0 WHERE has)"""
LISTS = rf"""l0 AS (SELECT project, file_id, regexp_split_to_array(text, '\n\n+') AS bs FROM mf),
l1 AS (SELECT project, file_id, bs[i] AS block, coalesce(bs[i + 1], '') AS nxt FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM l0)),
l2 AS (SELECT project, file_id, {trim('nxt')} AS following, list_filter(list_transform(string_split(block, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS ls FROM l1),
l3 AS (SELECT *, list_transform(ls, lambda x: TRY_CAST(regexp_extract(x, '^(\d+)', 1) AS BIGINT)) AS nums FROM l2 WHERE len(ls) > 0 AND len(list_filter(ls, lambda x: NOT regexp_matches(x, '^\s*\d+[.)]\s+\S'))) = 0),
l4 AS (SELECT *, {trim("regexp_replace(ls[1], '^[0-9]+[.)]" + S + "+', '')")} AS item FROM l3),
ml2 AS (
  SELECT 'malformed-list' AS category, project, file_id,
    CASE WHEN len(ls) > 1 AND nums <> range(1, len(ls) + 1) THEN 'numbers=' || array_to_string(nums, ',')
      WHEN len(ls) = 1 AND following <> '' AND (NOT regexp_matches(item, '{SENTENCE}') OR regexp_matches(following, '^[•\-*]|^[a-z]')) THEN 'fragment=' || left(item, 60) END AS detail FROM l4),
li AS (SELECT * FROM ml2 WHERE detail IS NOT NULL)"""
TRUNCATED = rf"""tp0 AS (SELECT project, file_id, unnest({PARAGRAPHS}) AS block FROM mf),
tp AS (
  SELECT 'truncated-paragraph' AS category, project, file_id, right(block, 60) AS detail FROM tp0
  WHERE NOT (regexp_matches(block, '^#{{1,6}}{S}') OR regexp_matches(block, '^[>|]') OR regexp_matches(block, '(?m)^([-*]|[0-9]+[.)]){S}')
    OR (NOT contains(block, chr(10)) AND len(regexp_split_to_array(block, '{S}+')) <= 10) OR regexp_matches(block, '{SENTENCE}') OR regexp_matches(block, '[:;,\"''’”)\]]\z')))"""
HEADINGS = rf"""h0 AS (SELECT project, file_id, ps[i] AS block, i AS block_no FROM (SELECT project, file_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT project, file_id, {PARAGRAPHS} AS ps FROM mf))),
h1 AS (
  SELECT *, regexp_matches(block, '^#{{1,6}}{S}') OR (NOT contains(block, chr(10)) AND len(regexp_split_to_array(block, '{S}+')) <= 10 AND NOT regexp_matches(block, '[.!?]\z')) AS is_heading FROM h0),
h2 AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY project, file_id ORDER BY block_no) AS section FROM h1),
h3 AS (
  SELECT project, file_id, section, max(CASE WHEN is_heading THEN regexp_replace(block, '^#+{S}*', '') END) AS heading, sum(CASE WHEN is_heading THEN 0 ELSE {words('block')} END) AS words,
    coalesce(bool_or(NOT is_heading AND regexp_matches(block, '(?m)^([-*]|[0-9]+[.)]){S}')), false) AS has_list FROM h2 WHERE section > 0 GROUP BY ALL),
h4 AS (SELECT *, median(CASE WHEN words > 0 THEN words END) OVER (PARTITION BY project, file_id) AS usual FROM h3),
h5 AS (SELECT *, coalesce(usual > 0 AND words < usual * 0.25, false) AS thin FROM h4),
uh AS (
  SELECT 'unfulfilled-heading' AS category, project, file_id, concat_ws('+', CASE WHEN NOT has_list THEN 'no-list' END, CASE WHEN thin THEN 'thin' END) || ': ' || heading AS detail
  FROM h5 WHERE regexp_matches(heading, '{PROMISE}') AND (NOT has_list OR thin))"""
M = f"WITH {lift.MD}"

QUERIES = {
    "audit_duplicate_titles": _joined,
    "audit_densities": lambda s, d: audit.densities(lift.md_files(s, d)),
    "audit_near_empty": lambda s, d: audit.near_empty(lift.md_files(s, d)),
    "audit_broken_characters": lambda s, d: audit.broken_characters(lift.md_files(s, d)),
    "audit_malformed_lists": lambda s, d: audit.malformed_lists(lift.md_files(s, d)),
    "audit_truncated_paragraphs": lambda s, d: audit.truncated_paragraphs(lift.md_files(s, d)),
    "audit_unfulfilled_headings": lambda s, d: audit.unfulfilled_headings(lift.md_files(s, d)),
    "audit_findings": lambda s, d: audit.findings(entries(s, d), lift.md_files(s, d)),
}
ORACLES = {
    "audit_duplicate_titles": f"WITH {ENTRIES}, {DUPLICATES} SELECT project, title, n, array_to_string(ids, ',') AS ids FROM du",
    "audit_densities": f"{M}, {DENSITY} SELECT * FROM d2",
    "audit_near_empty": f"{M}, {DENSITY}, {NEAR} SELECT * FROM ne",
    "audit_broken_characters": f"{M}, {BROKEN} SELECT * FROM br",
    "audit_malformed_lists": f"{M}, {LISTS} SELECT * FROM li",
    "audit_truncated_paragraphs": f"{M}, {TRUNCATED} SELECT * FROM tp",
    "audit_unfulfilled_headings": f"{M}, {HEADINGS} SELECT * FROM uh",
    "audit_findings": f"""{M}, {ENTRIES}, {DUPLICATES}, {DENSITY}, {NEAR}, {BROKEN}, {LISTS}, {TRUNCATED}, {HEADINGS}
SELECT 'duplicate-title' AS category, project, ids[1] AS file_id, array_to_string(ids, ',') AS detail FROM du
UNION ALL SELECT * FROM ne UNION ALL SELECT * FROM br UNION ALL SELECT * FROM li UNION ALL SELECT * FROM tp UNION ALL SELECT * FROM uh""",
}
