from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates
from ..plans import lift


def checks(spark, d):
    """A result for each event: 17 in a row are a project's gates."""
    events = lift.table(spark, d, "events")
    pos = (F.col("event_id") % 17).cast("int")
    key = (F.col("event_id") * 7 + F.length("event_type")) % 23
    names = F.array(*map(F.lit, gates.GATES))
    state = F.when(key == 0, "fail").when(key < 5, "skipped").otherwise("pass")
    return events.select(F.floor(F.col("event_id") / 17).alias("project"), pos.alias("pos"), F.get(names, pos).alias("id"), state.alias("status"), F.when((pos == 1) & (state != "skipped"), 1 - F.col("value") / 5000).alias("coverage"))


def folio_pages(spark, d):
    """Printed numbers for each user's events, in order: Roman first, then Arabic, some wrong, some missing."""
    from ..functions import text as T
    from .text import ROMAN_PARTS

    events = lift.table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("page"), F.col("event_type"))
    from pyspark.sql import Window

    rows = events.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("page")))
    n = F.when(F.col("n") <= 4, F.col("n")).otherwise(F.col("n") - 4 + F.when((F.col("page") % 13 == 0), 2).when(F.col("page") % 17 == 0, -1).otherwise(0))
    rows = rows.withColumn("v", n)
    left, roman = F.col("v"), F.lit("")
    for value, sign in ROMAN_PARTS:
        roman = F.concat(roman, F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    kind = F.when(F.col("page") % 19 == 0, None).when((F.col("n") <= 4) | (F.col("page") % 29 == 0), "roman").otherwise("arabic")
    rows = rows.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "roman", roman).when(F.col("kind") == "arabic", F.col("v").cast("string")))
    value = F.when(F.col("kind") == "roman", T.roman(F.col("text")).cast("bigint")).when(F.col("kind") == "arabic", F.col("text").cast("bigint"))
    return rows.select("project", "page", "text", "kind", value.alias("value"))


def page_items(spark, d):
    """Positioned items: each conversation is a project, each turn a page with its words in the body, one of them hyphenated now and then, and a number below."""
    conv = lift.table(spark, d, "conversations").select(F.col("conv_id").alias("project"), F.col("turn").alias("page"), F.split(F.coalesce("text", F.lit("")), " ").alias("w"))
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(" "))
    hyphen = F.when(F.col("project") % 5 == 0, "‐").when(F.col("project") % 5 == 1, "-").otherwise("")
    item = lambda s, x, y: F.struct(s.cast("string").alias("str"), F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    number = F.when(F.col("project") % 7 == 0, F.lit("iv")).when(F.col("project") % 7 == 1, F.lit("x 1")).otherwise((F.col("page") + 1).cast("string"))
    items = F.array(item(word(0), 10, 400), item(F.concat(word(1), hyphen), 90, 200), item(word(2), 10, 201.5), item(F.array_join(F.slice("w", 4, F.greatest(F.size("w") - 3, F.lit(0))), " "), 10, 600), item(number, 100, 30), item(F.lit(" "), 1, 5), item(F.lit("top"), 1, 795))
    return conv.select("project", "page", F.lit(800.0).alias("page_height"), F.inline(items))


def pixels(spark, d):
    """8 by 8 pages of pixels: each order line is a pixel."""
    li = lift.table(spark, d, "lineitem")
    x = F.col("l_partkey") % 8
    y = F.col("l_suppkey") % 8
    c = lambda k: (F.floor(F.col("l_extendedprice") * k).cast("long") % 3 * 100).cast("int")
    rows = li.select((F.col("l_orderkey") % 50).alias("project"), F.col("l_linenumber").alias("page"), x.alias("px"), y.alias("py"), F.lit(8).alias("width"), F.lit(8).alias("height"), c(1).alias("r"), c(2).alias("g"), c(3).alias("b"))
    return rows.groupBy("project", "page", "px", "py", "width", "height").agg(F.min("r").alias("r"), F.max("g").alias("g"), F.min("b").alias("b"))


def pixel_measures(spark, d):
    rows = pixels(spark, d)
    return gates.ink_ratios(rows).join(gates.textured_ratios(rows), ["project", "page"])


def single_gates(spark, d):
    """Gates over measurements taken from the tables, in one table."""
    docs = lift.table(spark, d, "documents")
    li, part, orders = (lift.table(spark, d, t) for t in ("lineitem", "part", "orders"))
    texts = docs.select("source", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("source") == "src3", "�").otherwise("")).alias("text")).withColumnRenamed("source", "project")
    previews = li.select((F.col("l_orderkey") % 300).cast("string").alias("project"), F.col("l_linenumber").alias("page"), (F.col("l_discount") * 7).alias("ink"), (F.col("l_quantity") < 45).alias("exempt"))
    boxes = li.select(
        (F.col("l_orderkey") % 300).cast("string").alias("project"), (F.col("l_tax") * 100).alias("left_"), F.col("l_quantity").alias("top_"), (F.col("l_quantity") + 50).alias("right_"), (F.col("l_quantity") * 2).alias("bottom_"),
        F.lit(0.0).alias("page_left"), F.lit(0.0).alias("page_top"), F.lit(98.5).alias("page_right"), F.lit(97.9).alias("page_bottom"), (F.col("l_linenumber") > 1).alias("split"),
    )
    images = part.select("p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("file"), F.when(F.col("p_partkey") % 97 > 0, F.col("p_size") * 40 + 620).alias("width"), F.lit("6in").alias("page_width"), F.lit("0.75in").alias("outer"), F.when(F.col("p_brand") == "Brand#11", "9mm").otherwise("0.875in").alias("inner")).withColumnRenamed("p_brand", "project")
    files = orders.select(F.col("o_orderkey").cast("string").alias("project"), (F.col("o_totalprice") * 60).cast("long").alias("bytes"))
    refs = li.select((F.col("l_orderkey") % 300).cast("string").alias("project"), F.col("l_partkey").cast("string").alias("path"))
    there = refs.join(part.where("p_partkey % 200 > 0").select(F.col("p_partkey").cast("string").alias("path")), "path", "left_semi").select("project", "path")
    covers = docs.select(F.col("doc_id").cast("string").alias("project"), (F.col("doc_id") % 3).alias("painted"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 100 / 50).alias("textured"))
    titles = docs.select(F.col("doc_id").cast("string").alias("project"), F.concat(F.split(F.coalesce("text", F.lit("")), "\n")[0], F.when(F.col("doc_id") % 4 == 0, "zz").otherwise("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    meta = docs.select(F.col("doc_id").cast("string").alias("project"), F.col("source").alias("title"), F.lit("src1").alias("wanted_title"), F.when(F.col("lang") == "en", "en-US").otherwise(F.col("lang")).alias("language"), F.concat("source", F.lit(" & co")).alias("author"), F.col("source").alias("wanted_author"))
    found = [
        gates.broken_chars(texts), gates.ink(previews), gates.overflow(boxes), gates.image_dpi(images), gates.file_size(files), gates.assets(refs, there), gates.cover(covers), gates.structure(titles), gates.metadata(meta),
        gates.folio_continuity(folio_pages(spark, d).withColumn("project", F.col("project").cast("string"))), gates.hyphen_breaks(page_items(spark, d).withColumn("project", F.col("project").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, [x.withColumn("project", F.col("project").cast("string")) for x in found])


def preferred_files(spark, d):
    files = lift.table(spark, d, "events").select(F.col("user_id").alias("project"), F.when(F.col("event_type") == "click", F.concat(F.col("user_id").cast("string"), F.lit("-book.pdf"))).when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "prototype.pdf").otherwise(F.concat("event_type", (F.col("event_id") % 5).cast("string"))).alias("name"))
    return gates.best_by_rank(files, ["{project}-book.pdf", "ebook-final.pdf", "prototype.pdf"])


def preview_tier(spark, d):
    files = lift.table(spark, d, "events").select(F.col("user_id").alias("project"), F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2).alias("tier"), F.format_string("page-%06d.png", F.col("event_id")).alias("name"))
    return gates.only_tier(files)


QUERIES = {
    "qc_scores": lambda s, d: gates.scores(checks(s, d)),
    "qc_verdicts": lambda s, d: gates.verdicts(checks(s, d)),
    "qc_folio_breaks": lambda s, d: gates.folio_breaks(folio_pages(s, d)),
    "qc_folio_runs": lambda s, d: gates.folio_runs(folio_pages(s, d)),
    "qc_folios": lambda s, d: gates.folios(page_items(s, d)),
    "qc_pixel_measures": pixel_measures,
    "qc_single_gates": single_gates,
    "preferred_files": preferred_files,
    "preview_tier": preview_tier,
}
_G = ", ".join(f"'{g}'" for g in gates.GATES)
_CHECKS = f"""ck AS (
  SELECT event_id // 17 AS project, event_id % 17 AS pos, [{_G}][event_id % 17 + 1] AS id,
    CASE WHEN (event_id * 7 + length(event_type)) % 23 = 0 THEN 'fail' WHEN (event_id * 7 + length(event_type)) % 23 < 5 THEN 'skipped' ELSE 'pass' END AS status, value FROM events),
cc AS (SELECT *, CASE WHEN pos = 1 AND status <> 'skipped' THEN 1 - value / 5000 END AS coverage FROM ck)"""


def _ratio(ids: str) -> str:
    mine = f"status <> 'skipped'{f' AND id IN ({ids})' if ids else ''}"
    return f"coalesce(count(*) FILTER ({mine} AND status = 'pass') / nullif(count(*) FILTER ({mine}), 0), 1.0)"


def _pass(name: str) -> str:
    return f"coalesce(max((status = 'pass')::INT) FILTER (id = '{name}'), 0)::DOUBLE"


_FOLIOS = """f0 AS (SELECT user_id AS project, event_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f1 AS (SELECT *, CASE WHEN n <= 4 THEN n ELSE n - 4 + CASE WHEN page % 13 = 0 THEN 2 WHEN page % 17 = 0 THEN -1 ELSE 0 END END AS v, CASE WHEN page % 19 = 0 THEN NULL WHEN n <= 4 OR page % 29 = 0 THEN 'roman' ELSE 'arabic' END AS kind FROM f0),
f2 AS (
  SELECT project, page, kind, CASE WHEN kind = 'roman' THEN repeat('m', (v // 1000)::INT) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][(v // 100) % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][(v // 10) % 10 + 1]
    || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][v % 10 + 1] WHEN kind = 'arabic' THEN v::VARCHAR END AS text, CASE WHEN kind IS NOT NULL THEN v END AS value FROM f1),
f3 AS (
  SELECT *, lag(kind) OVER w AS p_kind, lag(value) OVER w AS p_value, lag(text) OVER w AS p_text, coalesce(max((kind = 'arabic')::INT) OVER (PARTITION BY project ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen
  FROM f2 WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY project ORDER BY page)),
fb AS (
  SELECT project, page, CASE WHEN kind = 'arabic' AND NOT seen THEN CASE WHEN value <> 1 THEN 'starts at ' || text || ' after ' || coalesce(p_text, 'none') END WHEN kind = 'roman' AND seen THEN 'roman after arabic: ' || text
    WHEN p_kind = kind THEN CASE WHEN value = p_value THEN 'repeats' WHEN value < p_value THEN 'back by ' || (p_value - value) WHEN value > p_value + 1 THEN 'skips ' || (value - p_value - 1) END END AS reason FROM f3)"""
_ITEMS = """c0 AS (SELECT conv_id AS project, turn AS page, string_split(coalesce(text, ''), ' ') AS w FROM conversations),
it AS (SELECT project, page, unnest([
  {'str': coalesce(w[1], ' '), 'x': 10.0, 'y': 400.0}, {'str': coalesce(w[2], ' ') || CASE project % 5 WHEN 0 THEN '‐' WHEN 1 THEN '-' ELSE '' END, 'x': 90.0, 'y': 200.0}, {'str': coalesce(w[3], ' '), 'x': 10.0, 'y': 201.5}, {'str': array_to_string(w[4:], ' '), 'x': 10.0, 'y': 600.0},
  {'str': CASE project % 7 WHEN 0 THEN 'iv' WHEN 1 THEN 'x 1' ELSE (page + 1)::VARCHAR END, 'x': 100.0, 'y': 30.0}, {'str': ' ', 'x': 1.0, 'y': 5.0}, {'str': 'top', 'x': 1.0, 'y': 795.0}], recursive := true) FROM c0),
bo AS (SELECT *, min(y) OVER (PARTITION BY project, page) AS lowest FROM it WHERE trim(str, ' ' || chr(9) || chr(10)) <> '' AND y > 96 AND y < 744),
bl2 AS (SELECT project, page, string_agg(trim(str, ' ' || chr(9) || chr(10)), '' ORDER BY x) AS line FROM bo WHERE abs(y - lowest) <= 2 GROUP BY ALL),
la AS (SELECT project, max(page) AS last, count(DISTINCT page) AS pages FROM it GROUP BY project)"""
_PIX = """px0 AS (
  SELECT l_orderkey % 50 AS project, l_linenumber AS page, l_partkey % 8 AS px, l_suppkey % 8 AS py, min(floor(l_extendedprice * 1)::BIGINT % 3 * 100) AS r, max(floor(l_extendedprice * 2)::BIGINT % 3 * 100) AS g, min(floor(l_extendedprice * 3)::BIGINT % 3 * 100) AS b FROM lineitem GROUP BY ALL),
px1 AS (SELECT *, ((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS bucket FROM px0),
px2 AS (SELECT project, page, bucket, count(*) AS n, min(py * 8 + px) AS first FROM px1 GROUP BY ALL),
px3 AS (SELECT project, page, arg_max(bucket, {'n': n, 'f': -first}) AS ground FROM px2 GROUP BY ALL),
px4 AS (SELECT project, page, avg((sqrt(pow(r - ((ground >> 10) & 31) * 8, 2) + pow(g - ((ground >> 5) & 31) * 8, 2) + pow(b - (ground & 31) * 8, 2)) > 24)::INT) AS ink, any_value(ground) AS ground FROM px1 JOIN px3 USING (project, page) GROUP BY ALL),
px5 AS (SELECT project, page, count(*) FILTER (n > 1) / 64 AS textured FROM (SELECT project, page, px, py, count(DISTINCT bucket) AS n FROM px1 GROUP BY ALL) GROUP BY ALL)"""
_PASS = lambda c, s="false": f"CASE WHEN {s} THEN 'skipped' WHEN {c} THEN 'pass' ELSE 'fail' END AS status"
ORACLES = {
    "qc_scores": f"""WITH {_CHECKS}, p AS (SELECT project, round(25 * ({_pass('structure')} + coalesce(max(coverage) FILTER (id = 'text-coverage'), {_pass('text-coverage')}) + {_pass('no-bonus-in-body')}) / 3, 1) AS content,
  round(20 * {_ratio("'fonts-embedded', 'min-font-size', 'contrast'")}, 1) AS typography, round(20 * {_ratio("'ink-coverage', 'no-overflow', 'outline-toc'")}, 1) AS layout, round(15 * {_ratio("'metadata', 'assets-exist'")}, 1) AS consistency, round(10 * {_ratio('')}, 1) AS technical FROM cc GROUP BY project)
SELECT *, 7.0::DOUBLE AS niche_fit, round(7.0::DOUBLE + content + typography + layout + consistency + technical, 1) AS total FROM p""",
    "qc_verdicts": f"""WITH {_CHECKS} SELECT project, CASE WHEN bool_and(status <> 'fail') THEN 'GO' ELSE 'NO-GO' END AS verdict, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  coalesce(string_agg(id, ',' ORDER BY pos) FILTER (status = 'fail'), '') AS failed_ids, coalesce(string_agg(id, ',' ORDER BY pos) FILTER (status = 'skipped'), '') AS skipped_ids FROM cc GROUP BY project""",
    "qc_folio_breaks": f"WITH {_FOLIOS} SELECT * FROM fb WHERE reason IS NOT NULL",
    "qc_folio_runs": f"WITH {_FOLIOS} SELECT project, kind, arg_min(text, page) AS first, arg_max(text, page) AS last, count(*) AS n FROM f2 WHERE kind IS NOT NULL GROUP BY ALL",
    "qc_folios": f"""WITH {_ITEMS} SELECT DISTINCT project, page, CASE project % 7 WHEN 1 THEN NULL WHEN 0 THEN 'iv' ELSE (page + 1)::VARCHAR END AS text, CASE project % 7 WHEN 1 THEN NULL WHEN 0 THEN 'roman' ELSE 'arabic' END AS kind,
  CASE project % 7 WHEN 1 THEN NULL WHEN 0 THEN 4 ELSE page + 1 END AS value FROM it""",
    "qc_pixel_measures": f"WITH {_PIX} SELECT * FROM px4 JOIN px5 USING (project, page)",
    "qc_single_gates": f"""WITH {_FOLIOS}, {_ITEMS},
t AS (SELECT source AS project, coalesce(text, '') || CASE WHEN source = 'src3' THEN chr(65533) ELSE '' END AS text, doc_id, lang, coalesce(text, '') AS own FROM documents),
bc AS (SELECT project, sum(length(text) - length(replace(text, chr(65533), '')) + len(regexp_extract_all(text, '\\(cid:\\d+\\)'))) AS n FROM t GROUP BY project),
l AS (SELECT (l_orderkey % 300)::VARCHAR AS project, * FROM lineitem),
ik AS (SELECT project, count(*) FILTER (NOT (l_quantity < 45) AND NOT (l_discount * 7 BETWEEN 0.02 AND 0.62)) AS n FROM l GROUP BY project),
ov0 AS (SELECT project, greatest(l_quantity * 2 - 97.9::DOUBLE, 0.0::DOUBLE - l_quantity) AS up, greatest(l_quantity + 50 - 98.5::DOUBLE, 0.0::DOUBLE - l_tax * 100) AS side, l_linenumber > 1 AS split FROM l),
ov AS (SELECT project, count(*) FILTER (CASE WHEN split THEN up ELSE greatest(up, side) END > 2) AS n FROM ov0 GROUP BY project),
im0 AS (SELECT p_brand AS project, CASE WHEN p_partkey % 97 > 0 THEN p_size * 40 + 620 END AS width, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE 6.0::DOUBLE - 0.75::DOUBLE - 0.875::DOUBLE END AS col FROM part),
im AS (SELECT project, count(*) FILTER (width / col < 150) AS low, count(*) FILTER (width IS NULL) AS unread, count(width) AS got, bool_or(col IS NULL) AS odd FROM im0 GROUP BY project),
ae AS (SELECT project, count(DISTINCT l_partkey) FILTER (NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 200 > 0)) AS n FROM l GROUP BY project),
st AS (SELECT doc_id::VARCHAR AS project, NOT contains(lower(regexp_replace(own, '\\s+', '', 'g')), lower(regexp_replace(string_split(own, chr(10))[1] || CASE WHEN doc_id % 4 = 0 THEN 'zz' ELSE '' END, '\\s+', '', 'g'))) AS miss FROM t),
fc AS (SELECT project::VARCHAR AS project, count(*) FILTER (reason IS NOT NULL) AS n FROM fb GROUP BY ALL),
fp AS (SELECT DISTINCT project::VARCHAR AS project, count(kind) OVER (PARTITION BY project) AS printed FROM f2),
hy AS (SELECT project, count(*) FILTER (right(line, 1) IN ('‐', '‑', chr(173))) AS split, count(*) FILTER (right(line, 1) = '-') AS authored FROM bl2 JOIN la USING (project) WHERE page < last GROUP BY project)
SELECT project, 'no-broken-chars' AS id, {_PASS('n = 0')}, n::VARCHAR AS evidence FROM bc
UNION ALL SELECT project, 'ink-coverage', {_PASS('n = 0')}, n::VARCHAR FROM ik
UNION ALL SELECT project, 'no-overflow', {_PASS('n = 0')}, n::VARCHAR FROM ov
UNION ALL SELECT project, 'image-dpi', {_PASS('low = 0 AND unread = 0', 'odd OR got = 0')}, (low + unread)::VARCHAR FROM im
UNION ALL SELECT o_orderkey::VARCHAR, 'file-size', {_PASS('floor(o_totalprice * 60) / 1048576 < 15')}, round(floor(o_totalprice * 60)::DOUBLE / 1048576, 2)::VARCHAR FROM orders
UNION ALL SELECT project, 'assets-exist', {_PASS('n = 0')}, n::VARCHAR FROM ae
UNION ALL SELECT doc_id::VARCHAR, 'cover-renders', {_PASS('doc_id % 3 > 0 AND coalesce(CASE WHEN doc_id % 5 > 0 THEN doc_id % 100 / 50 END >= 0.85, true)')}, (doc_id % 3)::VARCHAR FROM documents
UNION ALL SELECT project, 'structure', {_PASS('NOT miss')}, miss::INT::VARCHAR FROM st
UNION ALL SELECT doc_id::VARCHAR, 'metadata', {_PASS("source = 'src1' AND lang = 'en'")}, source FROM documents
UNION ALL SELECT project, 'folio-continuity', {_PASS('coalesce(n, 0) = 0', 'printed = 0')}, coalesce(n, 0)::VARCHAR FROM fp LEFT JOIN fc USING (project)
UNION ALL SELECT project::VARCHAR, 'no-hyphen-page-break', {_PASS('coalesce(split, 0) = 0', 'pages < 2')}, coalesce(split, 0) || '/' || coalesce(authored, 0) FROM la LEFT JOIN hy USING (project)""",
    "preferred_files": """WITH f AS (SELECT user_id AS project, CASE WHEN event_type = 'click' THEN user_id || '-book.pdf' WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'prototype.pdf' ELSE event_type || (event_id % 5) END AS name FROM events),
r AS (SELECT *, CASE WHEN name = project || '-book.pdf' THEN 0 WHEN name = 'ebook-final.pdf' THEN 1 WHEN name = 'prototype.pdf' THEN 2 ELSE 3 END AS rank FROM f)
SELECT project, arg_min(name, {'r': rank, 'n': name}) AS name, count(*) AS n, min(rank) AS rank FROM r GROUP BY project""",
    "preview_tier": """WITH f AS (SELECT user_id AS project, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS tier, printf('page-%06d.png', event_id) AS name FROM events)
SELECT project, tier, name, row_number() OVER (PARTITION BY project ORDER BY name) AS nth FROM f JOIN (SELECT project, min(tier) AS tier FROM f GROUP BY project) USING (project, tier)""",
}
