"""Whole runs: measurements to verdicts, pages to findings and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates, joins, layout
from ..plans import audit as audit_plan
from ..plans import lift, qc
from . import audit as audit_queries
from . import layout as layout_queries
from . import markdown as markdown_queries
from . import qc as qc_queries
from .sql import BLOCKS, collapse, trim, words

N = 40


def _inputs(spark, d, folios):
    """Measurements of N projects, by the remainder of ids; some projects lack some of them. folios: printed numbers of pages."""
    docs, li, part, conv = (lift.table(spark, d, t) for t in ("documents", "lineitem", "part", "conversations"))
    of = lambda df, c: df.withColumn("project", F.col(c) % N)
    docs, li, part = of(docs, "doc_id"), of(li, "l_orderkey"), of(part, "p_partkey")
    p, id_ = F.col("project"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    first = F.split(text, "\n")[0]
    projects = docs.select("project").distinct()
    words = docs.where("project % 9 > 0").select("project", F.col("doc_id").cast("string").alias("name"), id_.alias("priority"), F.explode(T.words(text)).alias("word"), F.lit(1).cast("long").alias("n"))
    pool = words.groupBy("project", "word").agg((F.sum("n") - F.when((F.length("word") % 5 == 0) & (p % 2 == 0), 1).otherwise(0)).alias("n"))
    items = qc_queries.page_items(spark, d).withColumns({"page": F.col("project") * 1000 + F.col("page"), "project": F.col("project") % N})
    q = F.col("l_quantity")
    return projects, {
        "fonts-embedded": docs.where("project < 35").select("project", F.col("lang").alias("font"), (id_ % 97 > 0).alias("has_file"), (id_ % 193 == 5).alias("substituted")),
        "text-coverage": joins.coverage(joins.drawn(pool, words)),
        "no-broken-chars": docs.select("project", F.concat(text, F.when(id_ % 31 == 3, "(cid:3)").otherwise("")).alias("text")),
        "no-hyphen-page-break": items,
        "ink-coverage": li.where("project % 7 > 0").select("project", F.col("l_linenumber").alias("page"), (F.col("l_discount") * 6 + 0.03).alias("ink"), (q < F.when(p % 2 == 0, 60).otherwise(48)).alias("exempt")),
        "no-overflow": li.where("project % 5 > 0").select("project", F.lit(0.0).alias("left_"), q.alias("top_"), (q + 30).alias("right_"), (q * 2).alias("bottom_"), F.lit(0.0).alias("page_left"), F.lit(0.0).alias("page_top"), F.lit(90.0).alias("page_right"), (F.lit(97.0) + p).alias("page_bottom"), (F.col("l_linenumber") > 1).alias("split")),
        "min-font-size": projects.select("project", F.when(p % 9 > 1, F.concat(F.lit("--font-size-body: "), (p % 7 + 8).cast("string"), F.lit(".5pt;"))).otherwise("none").alias("css")),
        "contrast": projects.select("project", F.concat(F.lit("#"), F.lpad(F.lower(F.hex((p * 300000) % 16777216)), 6, "0")).alias("text"), F.lit("#ffffff").alias("ground")),
        "references": li.where("project % 6 > 0").select("project", F.col("l_partkey").cast("string").alias("path")),
        "existing": li.join(part.where("p_partkey % 100 > 0").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select("project", F.col("l_partkey").cast("string").alias("path")),
        "cover-renders": projects.where("project % 4 > 0").select("project", (p % 3).alias("painted"), F.when(p % 5 > 0, p / N + 0.5).alias("textured")),
        "image-dpi": part.where("project % 3 > 0").select("project", F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("file"), (F.col("p_size") * 20 + 680).alias("width"), F.lit("6in").alias("page_width"), F.lit("0.75in").alias("outer"), F.when(p % 11 == 1, "9mm").otherwise("0.875in").alias("inner")),
        "folio-continuity": folios,
        "titles": docs.select("project", id_.alias("id"), first.alias("title")),
        "outline": docs.where((p % 8 > 0) & (id_ % 211 != 7)).select("project", first.alias("title")),
        "targets": docs.select("project", F.col("lang").alias("target")),
        "ids": docs.where("project != 13 OR lang != 'en'").select("project", F.col("lang").alias("target")),
        "metadata": projects.select("project", F.lit("t").alias("title"), F.lit("t").alias("wanted_title"), F.when(p % 10 == 9, "de").otherwise("en-US").alias("language"), F.lit("a & b").alias("author"), F.lit("a").alias("wanted_author")),
        "file-size": projects.select("project", (p * 450_000).alias("bytes")),
        "lines": lift.table(spark, d, "benchmark").select((F.col("item_id") % 20).alias("project"), F.col("item_id").alias("line_id"), F.col("text").alias("line")),
        "bodies": docs.select("project", id_.alias("text_no"), text.alias("text")),
        "structure": docs.where("project < 38").select("project", F.concat(first, F.when(id_ % 401 == 0, "zz").otherwise("")).alias("title"), text.alias("text")),
    }


def qc_run(spark, d):
    """All events: each user's are a book, and a project's books are those of the users with its remainder."""
    pages = qc_queries.folio_pages(spark, d)
    return qc.checks(*_inputs(spark, d, pages.withColumnsRenamed({"project": "book"}).withColumn("project", F.col("book") % N))).drop("coverage", "evidence")


def qc_run_results(spark, d):
    return qc.results(qc.checks(*_inputs(spark, d, qc_queries.folio_pages(spark, d).where(F.col("project") < 30))))


def qc_report(spark, d):
    """The Markdown report of each project's gates."""
    checks = qc_queries.checks(spark, d)
    checks = checks.withColumn("evidence", F.when(F.col("pos") % 3 > 0, F.concat(F.lit("at "), F.col("pos").cast("string"), F.lit(" | seen"))))
    return qc.report(checks).select("project", F.md5(F.col("text").cast("binary")).alias("digest"))


def run_files(spark, d):
    """Files that positioned words give, from items to Markdown."""
    rows = audit_plan.ingested(layout_queries.items(spark, d))
    return rows.select("project", "id", "file", "start_page", "end_page", "words", F.md5(F.col("markdown").cast("binary")).alias("digest"))


def run_findings(spark, d):
    """Findings in the files that lines with headings give."""
    return audit_plan.audited(layout.files(layout_queries.text_lines(spark, d)))


def run_plans(spark, d):
    """Budget figures of the chapters that lines with headings give."""
    return audit_plan.planned(layout.files(layout_queries.text_lines(spark, d)))


QUERIES = {"run_plans": run_plans, "qc_run": qc_run, "qc_run_results": qc_run_results, "qc_report": qc_report, "run_files": run_files, "run_findings": run_findings}
_Q = qc_queries
_CHECKS = rf"""pr AS (SELECT DISTINCT doc_id % {N} AS project FROM documents),
dd AS (SELECT doc_id % {N} AS project, doc_id, lang, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10))[1] AS first FROM documents),
ll AS (SELECT l_orderkey % {N} AS project, * FROM lineitem),
g AS (SELECT project, doc_id, w AS word, count(*) AS n FROM (SELECT project, doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''-]*')) AS w FROM dd WHERE project % 9 > 0) GROUP BY ALL),
po AS (SELECT project, word, sum(n) - CASE WHEN length(word) % 5 = 0 AND project % 2 = 0 THEN 1 ELSE 0 END AS there FROM g GROUP BY project, word),
dr AS (SELECT g.*, there, sum(n) OVER (PARTITION BY project, word ORDER BY doc_id) AS so_far FROM g JOIN po USING (project, word)),
dt AS (SELECT project, doc_id, sum(least(there, so_far) - least(there, so_far - n)) AS matched, sum(n) AS total FROM dr GROUP BY ALL),
cv AS (SELECT project, sum(matched) / sum(total) AS coverage, bool_and(matched / total >= 0.95) AND sum(matched) / sum(total) >= 0.95 AS passes FROM dt GROUP BY project),
it1 AS (SELECT project % {N} AS project, project * 1000 + page AS page, str, x, y FROM it),
bo1 AS (SELECT *, min(y) OVER (PARTITION BY project, page) AS lowest FROM it1 WHERE trim(str, ' ' || chr(9) || chr(10)) <> '' AND y > 96 AND y < 744),
bl1 AS (SELECT project, page, string_agg(trim(str, ' ' || chr(9) || chr(10)), '' ORDER BY x) AS line FROM bo1 WHERE abs(y - lowest) <= 2 GROUP BY ALL),
la1 AS (SELECT project, max(page) AS last, count(DISTINCT page) AS pages FROM it1 GROUP BY project),
ch AS (SELECT project, lpad(lower(to_hex((project * 300000) % 16777216)), 6, '0') AS c FROM pr),
cl AS (SELECT project, {', '.join(f"('0x' || c[{i}:{i + 1}])::INT / 255.0::DOUBLE AS {n}" for i, n in ((1, 'r'), (3, 'g'), (5, 'b')))} FROM ch),
cr AS (SELECT project, 1.05::DOUBLE / ({' + '.join(f"{k}::DOUBLE * CASE WHEN {n} <= 0.03928 THEN {n} / 12.92::DOUBLE ELSE pow(({n} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END" for k, n in ((0.2126, 'r'), (0.7152, 'g'), (0.0722, 'b')))} + 0.05::DOUBLE) AS ratio FROM cl),
mi AS (SELECT project, count(*) AS n FROM dd WHERE NOT EXISTS (SELECT 1 FROM dd o WHERE o.project = dd.project AND o.project % 8 > 0 AND o.doc_id % 211 <> 7 AND contains(lower({collapse('o.first', '')}), lower({collapse('dd.first', '')}))) GROUP BY project),
lk AS (SELECT DISTINCT project FROM dd JOIN benchmark b ON item_id % 20 = project AND contains(lower({collapse('dd.text')}), lower({collapse('b.text')}))),
st0 AS (
  SELECT project, 'fonts-embedded' AS id, count(*) FILTER (doc_id % 97 = 0 OR doc_id % 193 = 5) = 0 AS ok FROM dd WHERE project < 35 GROUP BY project
  UNION ALL SELECT project, 'text-coverage', passes FROM cv
  UNION ALL SELECT project, 'no-broken-chars', count(*) FILTER (doc_id % 31 = 3 OR contains(text, chr(65533)) OR regexp_matches(text, '\(cid:\d+\)')) = 0 FROM dd GROUP BY project
  UNION ALL SELECT project, 'no-hyphen-page-break', count(*) FILTER (page < last AND right(line, 1) IN ('‐', '‑', chr(173))) = 0 FROM la1 LEFT JOIN bl1 USING (project) WHERE pages >= 2 GROUP BY project
  UNION ALL SELECT project, 'ink-coverage', count(*) FILTER (NOT l_quantity < CASE WHEN project % 2 = 0 THEN 60 ELSE 48 END AND NOT (l_discount * 6 + 0.03::DOUBLE) BETWEEN 0.02 AND 0.62) = 0 FROM ll WHERE project % 7 > 0 GROUP BY project
  UNION ALL SELECT project, 'no-overflow', count(*) FILTER (CASE WHEN l_linenumber > 1 THEN greatest(l_quantity * 2 - 97 - project, 0 - l_quantity) ELSE greatest(l_quantity * 2 - 97 - project, 0 - l_quantity, l_quantity + 30 - 90) END > 2) = 0 FROM ll WHERE project % 5 > 0 GROUP BY project
  UNION ALL SELECT project, 'min-font-size', project % 7 + 8.5 >= 9.5 FROM pr WHERE project % 9 > 1
  UNION ALL SELECT project, 'contrast', ratio >= 4.5 FROM cr
  UNION ALL SELECT project, 'assets-exist', count(*) FILTER (NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 100 > 0)) = 0 FROM ll WHERE project % 6 > 0 GROUP BY project
  UNION ALL SELECT project, 'cover-renders', project % 3 > 0 AND coalesce(CASE WHEN project % 5 > 0 THEN project / {N} + 0.5::DOUBLE END >= 0.85, true) FROM pr WHERE project % 4 > 0
  UNION ALL SELECT p_partkey % {N}, 'image-dpi', count(*) FILTER ((p_size * 20 + 680) / (6.0::DOUBLE - 0.75::DOUBLE - 0.875::DOUBLE) < 150) = 0 FROM part WHERE p_partkey % {N} % 3 > 0 AND p_partkey % {N} % 11 <> 1 GROUP BY 1
  UNION ALL SELECT project, 'folio-continuity', project NOT IN (SELECT project FROM fb WHERE reason IS NOT NULL) FROM f2 WHERE project < 30 GROUP BY project HAVING count(kind) > 0
  UNION ALL SELECT project, 'outline-toc', project % 8 > 0 AND project NOT IN (SELECT project FROM mi) AND NOT (project = 13 AND project IN (SELECT project FROM dd WHERE lang = 'en')) AND project IN (SELECT project FROM dd WHERE doc_id % 211 <> 7) FROM pr
  UNION ALL SELECT project, 'metadata', project % 10 <> 9 FROM pr UNION ALL SELECT project, 'file-size', project * 450000 / 1048576 < 15 FROM pr
  UNION ALL SELECT project, 'no-bonus-in-body', project NOT IN (SELECT project FROM lk) FROM pr WHERE project IN (SELECT item_id % 20 FROM benchmark)
  UNION ALL SELECT project, 'structure', count(*) FILTER (NOT contains(lower({collapse('text', '')}), lower({collapse('first', '')} || CASE WHEN doc_id % 401 = 0 THEN 'zz' ELSE '' END))) = 0 FROM dd WHERE project < 38 GROUP BY project),
cc AS (
  SELECT project, pos, g.id, CASE WHEN ok THEN 'pass' WHEN NOT ok THEN 'fail' ELSE 'skipped' END AS status, CASE WHEN g.id = 'text-coverage' THEN coverage END AS coverage
  FROM pr CROSS JOIN (SELECT unnest([{', '.join(f"'{x}'" for x in gates.GATES)}]) AS id, unnest(range({len(gates.GATES)}))::INT AS pos) g LEFT JOIN st0 USING (project, id) LEFT JOIN cv USING (project))"""
_ALL = f"WITH {_Q._FOLIOS}, {_Q._ITEMS}, {_CHECKS}"
# qc_run looks at the books of all users, by the remainder of their ids.
_SOME_BOOKS = "project NOT IN (SELECT project FROM fb WHERE reason IS NOT NULL) FROM f2 WHERE project < 30 GROUP BY project"
_ALL_BOOKS = f"project % {N} NOT IN (SELECT project % {N} FROM fb WHERE reason IS NOT NULL) FROM f2 GROUP BY project % {N}"
_WHOLE = _ALL.replace(f"SELECT project, 'folio-continuity', {_SOME_BOOKS}", f"SELECT project % {N}, 'folio-continuity', {_ALL_BOOKS}")
_scores = _Q.ORACLES["qc_scores"].partition("p AS (")[2]
_verdicts = _Q.ORACLES["qc_verdicts"].partition("SELECT project, CASE")[2]
_L, _A = layout_queries, audit_queries
_FROM_ITEMS = f"""t4 AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY page, line) - 1 AS line_no, page, y, font_height AS fh, cells, text, is_table_row AS tr, {trim('text')} AS tt, is_list_item AS li FROM kl),
t5 AS ({_L.TEXT_LINES.partition('t5 AS (')[2]}"""
_RUN = f"WITH RECURSIVE {lift.LINES}, {_L.TEXT_LINES}, {_L.SECTIONS}, {_L.BLOCKS}, {_L.FILES}"
_MD = markdown_queries.ORACLES["chapter_plans"].partition(markdown_queries.PLAN)[2]
ORACLES = {
    "run_plans": f"""{_RUN}, mf AS (SELECT {{'project': project, 'file': file}} AS file_id, type, markdown AS text FROM fi WHERE entry_kind = 'chapter'), {BLOCKS}, {markdown_queries.PLAN}{_MD.replace('SELECT file_id, component_counts, ratio', 'SELECT file_id.project, file_id.file, component_counts, ratio')}""",
    "run_files": f"""WITH RECURSIVE {lift.LINES}, {_L.ITEMS}, {_L.LAYOUT}, {_L.CLASSIFIED}, {_FROM_ITEMS}, {_L.SECTIONS}, {_L.BLOCKS}, {_L.FILES}
SELECT project, id, file, start_page, end_page, {words('markdown')} AS words, md5(markdown) AS digest FROM fi""",
    "run_findings": f"""{_RUN}, mf AS (SELECT project, file AS file_id, start_page, end_page, markdown AS text FROM fi), en AS (SELECT project, (entry_kind, pos) AS pos, file AS id, title FROM fi),
{_A.DUPLICATES}, {_A.DENSITY}, {_A.NEAR}, {_A.BROKEN}, {_A.LISTS}, {_A.TRUNCATED}, {_A.HEADINGS}
SELECT 'duplicate-title' AS category, project, ids[1] AS file_id, array_to_string(ids, ',') AS detail FROM du
UNION ALL SELECT * FROM ne UNION ALL SELECT * FROM br UNION ALL SELECT * FROM li UNION ALL SELECT * FROM tp UNION ALL SELECT * FROM uh""",
    "qc_report": f"""WITH {_Q._CHECKS}, v AS ({_Q.ORACLES['qc_verdicts']}), sc AS ({_Q.ORACLES['qc_scores']}),
l AS (SELECT project, string_agg('| ' || id || ' | ' || status || ' | ' || CASE WHEN pos % 3 > 0 THEN 'at ' || pos || ' \\| seen' ELSE '' END || ' |', chr(10) ORDER BY pos) AS ls FROM cc GROUP BY project)
SELECT project, md5('# Quality of ' || project || chr(10) || chr(10) || '## Result: ' || verdict || chr(10) || chr(10) || '| Gate | Status | Evidence |' || chr(10) || '|---|---|---|' || chr(10) || ls || chr(10) || chr(10) || '## Score: ' || total || '/100' || chr(10) || chr(10)
  || '| Dimension | Score |' || chr(10) || '|---|---|' || chr(10) || {" || ".join(f"'| {name} | ' || {c} || '/{most} |' || chr(10)" for name, c, most in (("Content", "content", 25), ("Typography", "typography", 20), ("Layout", "layout", 20), ("Consistency", "consistency", 15), ("Technical", "technical", 10), ("Niche fit", "niche_fit", 10)))}) AS digest
FROM v JOIN sc USING (project) JOIN l USING (project)""",
    "qc_run": f"{_WHOLE} SELECT project, pos, id, status FROM cc",
    "qc_run_results": f"{_ALL}, v AS (SELECT project, CASE{_verdicts}), p AS ({_scores.partition('FROM cc GROUP BY project)')[0]}FROM cc GROUP BY project) SELECT * FROM v JOIN (SELECT *, 7.0::DOUBLE AS niche_fit, round(7.0::DOUBLE + content + typography + layout + consistency + technical, 1) AS total FROM p) USING (project)",
}
