"""Rules of written documents, warnings, lookups, reports and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, config, gates, joins, layout, markdown
from ..plans import lift
from ..sources import sinks
from . import books as book_queries
from . import layout as layout_queries
from . import markdown as markdown_queries
from . import qc as qc_queries
from .sql import BLOCKS


def ingest_warnings(spark, d):
    return layout.warnings(layout_queries.text_lines(spark, d))


def blocked_books(spark, d):
    p = F.col("doc_id")
    rows = lift.table(spark, d, "documents").select(p.alias("project"), (p % 3 == 0).alias("disclaimer_required"), F.when(p % 4 == 0, F.col("text")).when(p % 4 == 1, " \n ").when(p % 4 == 2, "").alias("disclaimer"))
    return assembly.blocked(rows).select("project")


def inlined_fonts(spark, d):
    """Style sheets that name a font twice, one of the web, and now and then one that is not there. Addresses without quotes stay as they are."""
    p = F.col("doc_id")
    name = F.concat(F.lit("fonts/"), (p % 5).cast("string"), F.when(p % 2 == 0, ".ttf").otherwise(".woff2"))
    quote = F.when(p % 3 == 0, "'").when(p % 3 == 1, '"').otherwise("")
    css = F.concat(F.lit("a{src:url("), quote, name, quote, F.lit(')}b{src:url("https://x/y.otf")}c{src:url('), quote, name, quote, F.lit(")}"), F.when(p % 7 == 0, 'd{src:url("lost.OTF")}').otherwise(""))
    styles = lift.table(spark, d, "documents").select(p.alias("project"), css.alias("css"))
    each = F.explode(F.array(*(F.lit(f"fonts/{i}.{x}") for i in range(5) for x in ("ttf", "woff2")))).alias("path")
    fonts = lift.table(spark, d, "documents").select(p.alias("project"), F.coalesce("text", F.lit("")).alias("text"), each).select("project", "path", F.concat("path", "text").cast("binary").alias("content"))
    return assembly.inlined_fonts(styles, fonts).select("project", F.md5(F.col("css").cast("binary")).alias("digest"), F.array_join("missing", ",").alias("missing"))


def relative_paths(spark, d):
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    root = F.concat(F.lit("/w/"), s(i % 3), F.lit("/"), s(i % 5))
    path = F.concat(F.lit("/w/"), s(i % 4), F.lit("/"), s(i % 5), F.when(i % 2 == 0, F.concat(F.lit("/"), F.col("event_type"), F.lit(".md"))).otherwise(""))
    return lift.table(spark, d, "events").select("event_id", T.relative_path(root, path).alias("path"))


def plan_totals(spark, d):
    files = lift.md_files(spark, d)
    return markdown.plan_totals(markdown.plan(files).join(files.select("file_id", "project"), "file_id"), "project")


def plan_report(spark, d):
    return markdown.plan_report(lift.md_files(spark, d)).select("file_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def entry_lookups(spark, d):
    """Orders are projects, their lines the entries."""
    li = lift.table(spark, d, "lineitem")
    id_ = F.concat(F.lit("e"), F.col("l_linenumber").cast("string"))
    entries = li.select(F.col("l_orderkey").alias("project"), id_.alias("id"), F.col("l_returnflag").alias("title"), F.col("l_partkey").cast("string").alias("file")).dropDuplicates(["project", "id"]).withColumns({"title": F.lit("t"), "file": F.concat("id", F.lit(".md"))})
    wanted = lift.table(spark, d, "orders").select(F.col("o_orderkey").alias("project"), F.concat(F.lit("e"), (F.col("o_custkey") % 9).cast("string")).alias("id"))
    return joins.lookups(wanted, entries)


def ink_ranges(spark, d):
    li = lift.table(spark, d, "lineitem")
    rows = li.select((F.col("l_orderkey") % 300).alias("project"), F.col("l_linenumber").alias("page"), (F.col("l_discount") * 7).alias("ink"), (F.col("l_quantity") < 45).alias("exempt"))
    return gates.ink_ranges(rows).withColumn("out", F.array_join(F.col("out").cast("array<string>"), ","))


def book_html(spark, d):
    files = lift.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.when(F.col("l_partkey") % 4 == 0, F.concat(F.col("l_orderkey").cast("string"), F.lit("-book.html"))).otherwise(F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))).alias("name")).distinct()
    return gates.only_file(files, "{project}-book.html")


def settings_files(spark, d):
    rows = config.style_variables(book_queries.resolved(spark, d)).where("value IS NOT NULL")
    return sinks.settings_text(rows.select("project", F.concat(F.when(F.startswith("variable", F.lit("font")), "fonts.").otherwise("palette."), "variable").alias("key"), "value"))


QUERIES = {
    "ingest_warnings": ingest_warnings,
    "blocked_books": blocked_books,
    "inlined_fonts": inlined_fonts,
    "relative_paths": relative_paths,
    "plan_totals": plan_totals,
    "plan_report": plan_report,
    "entry_lookups": entry_lookups,
    "ink_ranges": ink_ranges,
    "book_html": book_html,
    "settings_files": settings_files,
}
_L, _M, _B, _Q = layout_queries, markdown_queries, book_queries, qc_queries
_RUN = f"WITH RECURSIVE {lift.LINES}, {_L.TEXT_LINES}, {_L.SECTIONS}, {_L.BLOCKS}"
_PLAN = f"WITH {lift.MD}, {BLOCKS}, {_M.PLAN}"
ORACLES = {
    "ingest_warnings": f"""{_RUN},
lf AS (SELECT project, count(*) FILTER (section = 0) AS n, max(section) AS last FROM t7 GROUP BY project)
SELECT project, 'lines-before-first-heading' AS rule, NULL::BIGINT AS section, n::VARCHAR AS detail FROM lf WHERE last > 0 AND n > 0 UNION ALL SELECT project, 'no-heading', NULL, n::VARCHAR FROM lf WHERE last = 0
UNION ALL SELECT project, 'untitled-heading', section::BIGINT, heading_text FROM s4 WHERE kind IN ('chapter', 'bonus') AND title = ''
UNION ALL SELECT project, 'empty-divider', section::BIGINT, heading_text FROM s5 WHERE n_body = 0 AND f_kind IS NOT NULL AND f_kind = kind AND f_title = title AND f_number IS NOT DISTINCT FROM number
UNION ALL SELECT project, 'repeated-paragraph', section::BIGINT, left(text, 80) FROM g6 WHERE section > 0 AND type = 'paragraph' AND p_type = 'paragraph' AND p_text = text
UNION ALL SELECT project, 'control-character', section::BIGINT, regexp_extract(text, '[\\x{{80}}-\\x{{9F}}]') FROM g6 WHERE section > 0 AND regexp_matches(text, '[\\x{{80}}-\\x{{9F}}]')""",
    "blocked_books": r"SELECT doc_id AS project FROM documents WHERE doc_id % 3 = 0 AND NOT coalesce(doc_id % 4 = 0 AND regexp_matches(coalesce(text, ''), '\S'), false)",
    "inlined_fonts": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, 'fonts/' || (doc_id % 5) || CASE WHEN doc_id % 2 = 0 THEN '.ttf' ELSE '.woff2' END AS name, CASE doc_id % 3 WHEN 0 THEN '''' WHEN 1 THEN '"' ELSE '' END AS q FROM documents),
u AS (SELECT *, 'url(' || q || CASE WHEN q = '' THEN name ELSE 'data:font/' || CASE WHEN doc_id % 2 = 0 THEN 'ttf' ELSE 'woff2' END || ';base64,' || to_base64(encode(name || text)) END || q || ')' AS u FROM t)
SELECT doc_id AS project, CASE WHEN doc_id % 7 > 0 THEN md5('a{src:' || u || '}b{src:url("https://x/y.otf")}c{src:' || u || '}') END AS digest, CASE WHEN doc_id % 7 = 0 THEN 'lost.OTF' ELSE '' END AS missing FROM u""",
    "relative_paths": """WITH t AS (SELECT event_id, event_id % 3 = event_id % 4 AS same, (event_id % 4) AS a, (event_id % 5) AS b, CASE WHEN event_id % 2 = 0 THEN '/' || event_type || '.md' ELSE '' END AS file FROM events)
SELECT event_id, CASE WHEN same THEN file[2:] ELSE '../../' || a || '/' || b || file END AS path FROM t""",
    "plan_totals": f"{_PLAN} SELECT project, count(*) AS blocks, count(DISTINCT file_id) AS files FROM p JOIN mf USING (file_id) GROUP BY project",
    "plan_report": f"""{_PLAN}, cp AS ({_M.ORACLES['chapter_plans'].replace('WITH ' + lift.MD + ', ' + BLOCKS + ', ' + _M.PLAN + ',', 'WITH', 1)}),
l AS (SELECT file_id, count(*) AS n, string_agg('| ' || index || ' | ' || component || ' | ' || source_kind || ' | ' || rule || ' |', chr(10) ORDER BY index) AS ls FROM p GROUP BY file_id)
SELECT file_id, md5('## ' || file_id || chr(10) || chr(10) || '- Blocks: ' || coalesce(n, 0) || chr(10) || '- Estimated pages: ' || printf('%.1f', round(estimated_pages, 1)) || chr(10) || '- Editorial-body ratio: ' || round(editorial_body_ratio * 100)::BIGINT || '%' || chr(10) || '- Non-body components: ' || actual_non_body || ' (budget minimum: '
  || min_non_body || ')' || chr(10) || chr(10) || '| # | Component | Source | Rule |' || chr(10) || '|---|---|---|---|' || chr(10) || coalesce(ls, '') || chr(10) || CASE WHEN warnings <> '' THEN chr(10) || '**Warnings:**' || chr(10) || '- ' || replace(warnings, ',', chr(10) || '- ') || chr(10) ELSE '' END) AS digest FROM cp LEFT JOIN l USING (file_id)""",
    "entry_lookups": """WITH e AS (SELECT DISTINCT l_orderkey AS project, 'e' || l_linenumber AS id FROM lineitem), k AS (SELECT project, string_agg(id, ', ' ORDER BY id) AS known FROM e GROUP BY project), w AS (SELECT o_orderkey AS project, 'e' || (o_custkey % 9) AS id FROM orders)
SELECT w.project, w.id, CASE WHEN e.id IS NOT NULL THEN 't' END AS title, CASE WHEN e.id IS NOT NULL THEN w.id || '.md' END AS file, CASE WHEN e.id IS NULL THEN 'No entry with id "' || w.id || '". Known ids: ' || coalesce(known, '(none)') || '.' END AS problem FROM w LEFT JOIN e USING (project, id) LEFT JOIN k USING (project)""",
    "ink_ranges": """WITH p AS (SELECT l_orderkey % 300 AS project, l_linenumber AS page, l_discount * 7 AS ink FROM lineitem WHERE NOT l_quantity < 45)
SELECT project, min(ink) AS least, max(ink) AS most, coalesce(string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) FILTER (NOT ink BETWEEN 0.02 AND 0.62), '') AS out FROM p GROUP BY project""",
    "book_html": """WITH f AS (SELECT DISTINCT l_orderkey AS project, CASE WHEN l_partkey % 4 = 0 THEN l_orderkey || '-book.html' ELSE 'x' || l_linenumber END AS name FROM lineitem)
SELECT project, CASE WHEN bool_or(name = project || '-book.html') THEN project || '-book.html' WHEN count(*) = 1 THEN min(name) END AS name FROM f GROUP BY project""",
    "settings_files": f"""WITH v AS ({_B.ORACLES['style_variables']}), g AS (SELECT project, CASE WHEN starts_with(variable, 'font') THEN 'fonts' ELSE 'palette' END AS grp, variable, value FROM v WHERE value IS NOT NULL),
l AS (SELECT project, grp, string_agg('  ' || variable || ': "' || replace(value, '"', '\\"') || '"', chr(10) ORDER BY variable) AS ls FROM g GROUP BY ALL) SELECT project, string_agg(grp || ':' || chr(10) || ls, chr(10) ORDER BY grp) || chr(10) AS text FROM l GROUP BY project""",
}
