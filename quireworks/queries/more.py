from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, bonus, gates, layout
from ..plans import lift
from ..sources import sinks
from . import audit as audit_queries
from . import books
from . import joins as join_queries
from . import layout as layout_queries
from .sql import S, trim


def page_texts(spark, d):
    items = layout_queries.items(spark, d).withColumn("str", F.when(F.col("item_no") % 11 == 0, "").otherwise(F.col("str")))
    return layout.page_texts(items.withColumn("has_eol", F.col("item_no") % 7 == 0))


def content_lines(spark, d):
    return bonus.content_lines(lift.md_files(spark, d).select("file_id", "text"))


def more_gates(spark, d):
    docs = lift.table(spark, d, "documents")
    p = F.col("doc_id")
    fonts = docs.select(F.col("source").alias("project"), F.col("lang").alias("font"), (p % 211 > 0).alias("has_file"), (p % 307 == 5).alias("substituted"))
    styles = docs.select(p.cast("string").alias("project"), F.when(p % 9 > 0, F.concat(F.lit("--font-size-body: "), (p % 7 + 7).cast("string"), F.lit(".5pt;"))).otherwise("none").alias("css"))
    colours = docs.select(p.cast("string").alias("project"), F.concat(F.lit("#"), F.lpad(F.lower(F.hex((p * 104729) % 16777216)), 6, "0")).alias("text"), F.lit("#ffffff").alias("ground"))
    first = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    titles = docs.select(F.col("source").alias("project"), p.alias("id"), first.alias("title"))
    outline = docs.where("source != 'src1'").select(F.col("source").alias("project"), F.when((F.col("source") == "src2") & (p % 40 == 2), "x").otherwise(first).alias("title"))
    targets = docs.select(F.col("source").alias("project"), (p % 50).cast("string").alias("target"))
    ids = docs.select(F.col("source").alias("project"), F.when((F.col("source") == "src3") & (p % 50 == 43), "none").otherwise((p % 50).cast("string")).alias("target"))
    lines = lift.table(spark, d, "benchmark").select(F.explode(F.array(*map(F.lit, ("en", "de", "fr")))).alias("project"), F.col("item_id").alias("line_id"), F.col("text").alias("line"))
    bodies = docs.select(F.col("lang").alias("project"), p.alias("text_no"), F.coalesce("text", F.lit("")).alias("text"))
    found = [gates.fonts(fonts), gates.min_font_size(styles), gates.contrast(colours), gates.outline_toc(titles, outline, targets, ids), gates.no_bonus(lines, bodies), gates.text_coverage(join_queries.coverages(spark, d))]
    return reduce(DataFrame.unionByName, found)


def front_matter(spark, d):
    events = lift.table(spark, d, "events")
    opens = (F.col("event_type") == "click") & (F.col("user_id") % 3 > 0)
    return gates.front_matter(events.select(F.col("user_id").alias("project"), F.col("event_id").alias("page"), F.when(opens, F.array(F.lit("a"), F.lit("pagedjs_chapter-open_page"))).otherwise(F.array(F.lit("a"))).alias("classes")))


def evidence(spark, d):
    return gates.evidence(lift.table(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_name").alias("item")).distinct())


def report(spark, d):
    return sinks.report(audit_queries.QUERIES["audit_findings"](spark, d))


def whole_books(spark, d):
    return sinks.whole_text(books.book_parts(spark, d)).select("project", F.length("html").cast("long").alias("chars"), F.md5(F.col("html").cast("binary")).alias("digest"))


def paths(spark, d):
    li = lift.table(spark, d, "lineitem")
    wanted = li.select((F.col("l_orderkey") % 100).cast("string").alias("project"), (F.col("l_partkey") % 40).cast("string").alias("path")).distinct()
    own = li.where("l_discount > 0.05 AND l_quantity < 5").select((F.col("l_orderkey") % 100).cast("string").alias("project"), (F.col("l_partkey") % 40).cast("string").alias("path"))
    shared = lift.table(spark, d, "part").where("p_partkey < 30").select(F.col("p_partkey").cast("string").alias("path"))
    return assembly.resolved_paths(wanted, own, shared)


def art(spark, d):
    return assembly.art_sizes(lift.table(spark, d, "part").select(F.col("p_partkey").alias("project"), (F.col("p_size") * 37 + 400).alias("width")))


def upserts(spark, d):
    events = lift.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return sinks.upserted(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def shared_words(spark, d):
    """Words that German and French documents share, as often as both have them."""
    words = lambda lang: lift.table(spark, d, "documents").where(F.col("lang") == lang).select(F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word"))
    return words("de").intersectAll(words("fr"))


QUERIES = {
    "page_texts": page_texts,
    "bonus_content_lines": content_lines,
    "qc_more_gates": more_gates,
    "front_matter": front_matter,
    "evidence": evidence,
    "audit_report": report,
    "whole_books": whole_books,
    "resolved_paths": paths,
    "art_sizes": art,
    "upserted_state": upserts,
    "bag_intersection": shared_words,
}
_ESC = "replace(coalesce({0}, ''), '|', '\\|')"
_PARTS = books.ORACLES["book_parts"]
ORACLES = {
    "page_texts": f"""WITH {lift.LINES}, {layout_queries.ITEMS.split('o AS (')[0].rstrip().rstrip(',')},
e AS (SELECT * REPLACE (CASE WHEN item_no % 11 = 0 THEN '' ELSE str END AS str), item_no % 7 = 0 AS eol FROM it),
r AS (SELECT *, coalesce(sum(eol::INT) OVER (PARTITION BY project, page ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
g AS (SELECT *, lag(x + width) OVER w AS p_end, lag(y) OVER w AS p_y FROM r WHERE str <> '' WINDOW w AS (PARTITION BY project, page, run ORDER BY item_no)),
u AS (SELECT project, page, item_no, CASE WHEN p_end IS NULL THEN '' WHEN abs(p_y - y) < 2 THEN CASE WHEN x - p_end > height * 0.15::DOUBLE THEN ' ' ELSE '' END ELSE chr(10) END || str || CASE WHEN eol THEN chr(10) ELSE '' END AS piece FROM g
  UNION ALL SELECT project, page, item_no, CASE WHEN eol THEN chr(10) ELSE '' END FROM r WHERE str = '')
SELECT project, page, string_agg(piece, '' ORDER BY item_no) AS text FROM u GROUP BY ALL""",
    "bonus_content_lines": rf"""WITH {lift.MD}, l AS (SELECT file_id, i - 1 AS line_id, {trim('ls[i]')} AS line FROM (SELECT file_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM mf))
SELECT * FROM (SELECT file_id, line_id, regexp_replace(regexp_replace(line, '^[0-9]+[.)]{S}+', ''), '^[-*]{S}+', '') AS line FROM l WHERE line <> '' AND NOT starts_with(line, '#')) WHERE length(line) >= 15""",
    "qc_more_gates": f"""WITH cv AS ({join_queries.ORACLES['bag_coverage']}),
co AS (SELECT doc_id, '#' || lpad(lower(to_hex((doc_id * 104729) % 16777216)), 6, '0') AS c FROM documents),
ch AS (SELECT doc_id, ('0x' || c[2:3])::INT / 255.0::DOUBLE AS r, ('0x' || c[4:5])::INT / 255.0::DOUBLE AS g, ('0x' || c[6:7])::INT / 255.0::DOUBLE AS b FROM co),
cl AS (SELECT doc_id, 1.05::DOUBLE / (0.2126::DOUBLE * CASE WHEN r <= 0.03928 THEN r / 12.92::DOUBLE ELSE pow((r + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END + 0.7152::DOUBLE * CASE WHEN g <= 0.03928 THEN g / 12.92::DOUBLE ELSE pow((g + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END
  + 0.0722::DOUBLE * CASE WHEN b <= 0.03928 THEN b / 12.92::DOUBLE ELSE pow((b + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END + 0.05::DOUBLE) AS ratio FROM ch),
f AS (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10))[1] AS t FROM documents),
ol AS (SELECT source, CASE WHEN source = 'src2' AND doc_id % 40 = 2 THEN 'x' ELSE t END AS t FROM f WHERE source <> 'src1'),
sq AS (SELECT DISTINCT source, lower(regexp_replace(t, '{S}+', '', 'g')) AS h FROM ol),
mi AS (SELECT source, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM sq WHERE sq.source = f.source AND contains(h, lower(regexp_replace(f.t, '{S}+', '', 'g')))) GROUP BY source),
br AS (SELECT d.source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND CASE WHEN e.source = 'src3' AND e.doc_id % 50 = 43 THEN 'none' ELSE (e.doc_id % 50)::VARCHAR END = (d.doc_id % 50)::VARCHAR) GROUP BY d.source),
ou AS (SELECT source, coalesce((SELECT n FROM mi WHERE mi.source = s.source), 0) + coalesce((SELECT n FROM br WHERE br.source = s.source), 0) AS bad FROM (SELECT DISTINCT source FROM documents) s),
bo AS (SELECT lang, lower(regexp_replace(coalesce(text, ''), '{S}+', ' ', 'g')) AS hay FROM documents),
lk AS (SELECT lang, count(DISTINCT item_id) AS n FROM bo JOIN benchmark ON lang IN ('en', 'de', 'fr') AND contains(hay, lower(regexp_replace(benchmark.text, '{S}+', ' ', 'g'))) GROUP BY lang)
SELECT source AS project, 'fonts-embedded' AS id, CASE WHEN count(*) FILTER (doc_id % 211 = 0 OR doc_id % 307 = 5) = 0 THEN 'pass' ELSE 'fail' END AS status, (count(*) FILTER (doc_id % 211 = 0 OR doc_id % 307 = 5))::VARCHAR AS evidence FROM documents GROUP BY source
UNION ALL SELECT doc_id::VARCHAR, 'min-font-size', CASE WHEN doc_id % 9 = 0 THEN 'skipped' WHEN doc_id % 7 + 7.5 >= 9.5 THEN 'pass' ELSE 'fail' END, CASE WHEN doc_id % 9 > 0 THEN (doc_id % 7 + 7.5)::DOUBLE::VARCHAR END FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'contrast', CASE WHEN ratio >= 4.5 THEN 'pass' ELSE 'fail' END, round(ratio, 2)::VARCHAR FROM cl
UNION ALL SELECT source, 'outline-toc', CASE WHEN source <> 'src1' AND bad = 0 THEN 'pass' ELSE 'fail' END, bad::VARCHAR FROM ou
UNION ALL SELECT l.lang, 'no-bonus-in-body', CASE WHEN l.lang NOT IN ('en', 'de', 'fr') THEN 'skipped' WHEN n IS NULL THEN 'pass' ELSE 'fail' END, coalesce(n, 0)::VARCHAR FROM (SELECT DISTINCT lang FROM documents) l LEFT JOIN lk USING (lang)
UNION ALL SELECT project, 'text-coverage', CASE WHEN total = 0 THEN 'skipped' WHEN passes THEN 'pass' ELSE 'fail' END, round(coverage, 4)::VARCHAR FROM cv""",
    "front_matter": "SELECT user_id AS project, coalesce(min(event_id) FILTER (event_type = 'click' AND user_id % 3 > 0), 0) AS front_matter FROM events GROUP BY user_id",
    "evidence": "WITH p AS (SELECT p_brand AS project, list(DISTINCT p_name ORDER BY p_name) AS every FROM part GROUP BY 1) SELECT project, array_to_string(every[1:5], ', ') || CASE WHEN len(every) > 5 THEN ', …' ELSE '' END AS evidence FROM p",
    "audit_report": f"""WITH f AS ({audit_queries.ORACLES['audit_findings']}),
r AS (SELECT project, category, file_id, '| ' || category || ' | ' || file_id || ' | ' || regexp_replace({_ESC.format('detail')}, '\\s+', ' ', 'g') || ' |' AS line FROM f)
SELECT project, '# Audit of ' || project || chr(10) || chr(10) || count(*) || ' finding(s)' || chr(10) || chr(10) || '| category | file | detail |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY category, file_id, line) || chr(10) AS text FROM r GROUP BY project""",
    "whole_books": f"WITH p AS ({_PARTS}), w AS (SELECT project, string_agg(html, chr(10) || chr(10) ORDER BY ordinal, nth) AS html FROM p WHERE html IS NOT NULL GROUP BY project) SELECT project, length(html) AS chars, md5(html) AS digest FROM w",
    "resolved_paths": """WITH w AS (SELECT DISTINCT (l_orderkey % 100)::VARCHAR AS project, (l_partkey % 40)::VARCHAR AS path FROM lineitem), o AS (SELECT DISTINCT (l_orderkey % 100)::VARCHAR AS project, (l_partkey % 40)::VARCHAR AS path FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 5)
SELECT w.project, w.path, coalesce(CASE WHEN o.path IS NOT NULL THEN w.project || '/' || w.path END, p_partkey::VARCHAR) AS found FROM w LEFT JOIN o USING (project, path) LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey < 30) ON p_partkey::VARCHAR = w.path""",
    "art_sizes": "SELECT p_partkey AS project, round((p_size * 37 + 400) / 6, 1) AS dpi, round((p_size * 37 + 400) / 1800, 3) AS ratio FROM part",
    "upserted_state": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "bag_intersection": r"WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}][\p{L}\p{N}''-]*')) AS word FROM documents WHERE lang IN ('de', 'fr')) SELECT word FROM w WHERE lang = 'de' INTERSECT ALL SELECT word FROM w WHERE lang = 'fr'",
}
