from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import layout
from ..plans import lift
from .sql import NS, S, trim, words


def items(spark, d):
    """All words on a grid, six to a line and five lines to a page with a footer number below; the words of some documents sink along the line."""
    docs = lift.table(spark, d, "documents").select(F.col("doc_id").alias("project"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    sixes = lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / 6).cast("int")), lambda j: F.slice(ws, j * 6 + 1, F.lit(6)))
    wrapped = lambda line: F.flatten(F.transform(F.array(F.split(line, " ")), sixes))  # noqa: E731  a line is split once
    rows = docs.select("project", F.posexplode(F.flatten(F.transform("lines", wrapped))).alias("r", "ws"))
    page, k = (F.floor(F.col("r") / 5) + 1).cast("int"), F.col("r") % 5
    item = lambda k, i, w: F.struct(k.cast("int").alias("k"), i.cast("int").alias("i"), w.alias("w"))
    footer = F.when(k == 0, F.array(item(F.lit(5), F.lit(0), page.cast("string")))).otherwise(F.array().cast("array<struct<k:int,i:int,w:string>>"))
    rows = rows.select("project", page.alias("page"), F.inline(F.concat(F.transform("ws", lambda w, i: item(k, i, w)), footer)))
    sink = F.when(F.col("project") % 5 == 0, F.col("i") * 0.9).otherwise(F.col("i") % 2 * 0.5)
    text = F.when((F.col("i") == 3) & (F.col("project") % 3 == 0) & (F.length("w") < 3), " ").otherwise(F.col("w"))
    return rows.select("project", "page", (((F.col("page") - 1) * 6 + F.col("k")) * 10 + F.col("i")).alias("item_no"), text.alias("str"), (F.col("i") * 60 + 50).cast("double").alias("x"), (700 - F.col("k") * 20 - sink).cast("double").alias("y"), (F.length(text) * 5).cast("double").alias("width"), F.when(F.col("k") == 5, 8.0).otherwise(10.0).alias("height"))


ITEMS = """i00 AS (
  SELECT doc_id, flatten(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: list_transform(range(0, (len(string_split(l, ' ')) - 1) // 6 + 1), lambda j: string_split(l, ' ')[j * 6 + 1:j * 6 + 6]))) AS rs FROM documents),
i01 AS (SELECT doc_id, rs[n] AS ws, n - 1 AS r FROM (SELECT doc_id, rs, unnest(range(1, len(rs) + 1)) AS n FROM i00)),
i0 AS (
  SELECT doc_id AS project, r // 5 + 1 AS page, r % 5 AS k, r // 5 * 6 + r % 5 AS line_no, ws FROM i01
  UNION ALL SELECT doc_id, r // 5 + 1, 5, r // 5 * 6 + 5, [(r // 5 + 1)::VARCHAR] FROM i01 WHERE r % 5 = 0),
i1 AS (SELECT * EXCLUDE ws, ws[j] AS w, j - 1 AS i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM i0)),
i2 AS (SELECT *, CASE WHEN i = 3 AND project % 3 = 0 AND length(w) < 3 THEN ' ' ELSE w END AS str FROM i1),
it AS (SELECT project, page, line_no * 10 + i AS item_no, str, (i * 60 + 50)::DOUBLE AS x, 700 - k * 20 - CASE WHEN project % 5 = 0 THEN i * 0.9::DOUBLE ELSE i % 2 * 0.5::DOUBLE END AS y, (length(str) * 5)::DOUBLE AS width, CASE WHEN k = 5 THEN 8.0::DOUBLE ELSE 10.0::DOUBLE END AS height FROM i2),
o AS (SELECT *, row_number() OVER (PARTITION BY project, page ORDER BY y DESC, x, item_no) AS r FROM it),
rc AS (
  SELECT project, page, r, y AS anchor, 0 AS line FROM o WHERE r = 1
  UNION ALL SELECT o.project, o.page, o.r, CASE WHEN abs(anchor - o.y) > 2 THEN o.y ELSE anchor END, line + (abs(anchor - o.y) > 2)::INT FROM rc JOIN o ON o.project = rc.project AND o.page = rc.page AND o.r = rc.r + 1)"""
LAYOUT = f"""q0 AS (SELECT o.*, line FROM o JOIN rc USING (project, page, r)),
q1 AS (SELECT *, max(height) OVER (PARTITION BY project, page, line) AS fh, first_value(y) OVER (PARTITION BY project, page, line ORDER BY x, -y, item_no) AS line_y, {trim('str')} = '' AS blank FROM q0),
q2 AS (SELECT *, x - lag(x + width) OVER (PARTITION BY project, page, line ORDER BY x, -y, item_no) AS gap FROM q1 WHERE NOT blank),
q3 AS (SELECT *, coalesce(gap > greatest(fh * 1.3::DOUBLE, 14), false) AS new_cell FROM q2),
q4 AS (SELECT *, sum(new_cell::INT) OVER (PARTITION BY project, page, line ORDER BY x, -y, item_no) AS cell, CASE WHEN gap IS NULL OR new_cell OR NOT gap > fh * 0.15::DOUBLE THEN '' ELSE ' ' END || str AS piece FROM q3),
q5 AS (SELECT project, page, line, cell, {trim("string_agg(piece, '' ORDER BY x, -y, item_no)")} AS text FROM q4 GROUP BY ALL),
q6 AS (SELECT project, page, line, list(text ORDER BY cell) AS cells FROM q5 GROUP BY ALL),
q7 AS (SELECT DISTINCT project, page, line, line_y AS y, fh AS font_height, coalesce(cells, ['']) AS cells FROM q1 LEFT JOIN q6 USING (project, page, line))"""
CLASSIFIED = rf"""k0 AS (SELECT *, array_to_string(cells, ' ') AS text, len(cells) >= 2 AS is_table_row FROM q7),
k1 AS (SELECT *, NOT is_table_row AND regexp_matches({trim('text')}, '^{S}*[0-9]+[.)]{S}+{NS}') AS is_list_item FROM k0 WHERE {trim('text')} <> ''),
k2 AS (SELECT *, row_number() OVER (PARTITION BY project, page ORDER BY line DESC) = 1 AS is_last, max(font_height) OVER (PARTITION BY project, page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM k1),
kl AS (SELECT * FROM k2 WHERE NOT (is_last AND regexp_matches({trim('text')}, '^[0-9]{{1,4}}$') AND coalesce(font_height < above, false)))"""


def text_lines(spark, d):
    """All lines of documents as lines on pages. By line number some have a heading or a paragraph twice before them, or are numbered items, runs of bullets or table rows."""
    docs = lift.table(spark, d, "documents").select(F.col("doc_id").alias("p"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    p = F.col("p")

    def rows_of(line, i):
        k, n = i % 9, (F.floor(i / 9) + 1).cast("string")
        row = lambda cells, height, down: F.struct(cells.alias("cells"), F.lit(height).cast("double").alias("font_height"), F.lit(down).cast("int").alias("down"))
        one = lambda text: F.array(F.lit(text) if isinstance(text, str) else text)
        left = lambda m: F.substring(line, 1, m)
        head = F.when(p % 6 == 0, F.concat(F.lit("Chapter "), n, F.lit(": "), left(25))).when(p % 6 == 1, F.concat(F.lit("CHAPTER "), n)).when(p % 6 == 2, "Introduction").when(p % 6 == 3, F.concat(F.lit("BONUS - "), left(20))).when(p % 6 == 4, "Conclusion").otherwise("Bonus")
        again = (p % 4 == 2) & k.isin(7, 8)
        mark = F.when((k == 0) & (p % 10 != 9), row(one(head), 18, 0)).when((k == 1) & (p % 12 == 2), row(one("Introduction"), 18, 0)).when(again, row(one("Repeat of the paragraph."), 12, 10))
        twice = F.when(again, row(one("Repeat of the paragraph."), 12, 30))
        body = F.when(k.isin(3, 4), F.concat((k - 2).cast("string"), F.lit(". "), line)).when((k == 7) & (p % 4 == 1), F.concat(F.lit("• "), left(15), F.lit(" • "), F.substring(line, 16, 1 << 30))).otherwise(line)
        w = F.split(line, " ", 2)
        cells = F.when((k == 6) & (p % 3 == 0), F.array(w[0], F.coalesce(F.get(w, F.lit(1)), F.lit("")))).otherwise(one(body))
        height = F.when(k.isin(0, 1) | ((k == 2) & (p % 4 == 0)), 18).otherwise(12)
        return F.array_compact(F.array(mark, twice, row(cells, height, F.when(again, 50).when(k == 8, 40).when(k == 5, 8).otherwise(0))))

    rows = docs.select("p", F.posexplode(F.flatten(F.transform("lines", rows_of))).alias("i", "row")).select("p", "i", "row.*")
    i = F.col("i")
    rows = rows.select(p.alias("project"), i.alias("line_no"), (F.floor(i / 6) + 1).cast("int").alias("page"), (700 - i % 6 * 25 - F.col("down")).cast("double").alias("y"), "font_height", F.array_join("cells", " ").alias("text"), "cells")
    rows = rows.where(T.trim(F.col("text")) != "")
    table_row = F.size("cells") >= 2
    return rows.select("*", (~table_row & T.has(T.trim(F.col("text")), P.NUMBERED_LINE)).alias("is_list_item"), table_row.alias("is_table_row"))


TEXT_LINES = rf"""t0 AS (SELECT doc_id AS project, line_no AS ln, line_no % 9 AS k, (line_no // 9 + 1)::VARCHAR AS n, line, strpos(line, ' ') AS sp, doc_id AS p FROM dl),
t1 AS (
  SELECT project, ln, 0 AS j, [CASE p % 6 WHEN 0 THEN 'Chapter ' || n || ': ' || left(line, 25) WHEN 1 THEN 'CHAPTER ' || n WHEN 2 THEN 'Introduction' WHEN 3 THEN 'BONUS - ' || left(line, 20) WHEN 4 THEN 'Conclusion' ELSE 'Bonus' END] AS cells, 18.0::DOUBLE AS fh, 0 AS down FROM t0 WHERE k = 0 AND p % 10 <> 9
  UNION ALL SELECT project, ln, 0, ['Introduction'], 18.0::DOUBLE, 0 FROM t0 WHERE k = 1 AND p % 12 = 2
  UNION ALL SELECT project, ln, unnest([0, 1]), ['Repeat of the paragraph.'], 12.0::DOUBLE, unnest([10, 30]) FROM t0 WHERE p % 4 = 2 AND k IN (7, 8)
  UNION ALL SELECT project, ln, 2, CASE WHEN k = 6 AND p % 3 = 0 THEN CASE WHEN sp > 0 THEN [left(line, sp - 1), line[sp + 1:]] ELSE [line, ''] END
      ELSE [CASE WHEN k IN (3, 4) THEN (k - 2) || '. ' || line WHEN k = 7 AND p % 4 = 1 THEN '• ' || left(line, 15) || ' • ' || line[16:] ELSE line END] END,
    CASE WHEN k IN (0, 1) OR (k = 2 AND p % 4 = 0) THEN 18.0::DOUBLE ELSE 12.0::DOUBLE END, CASE WHEN p % 4 = 2 AND k IN (7, 8) THEN 50 WHEN k = 8 THEN 40 WHEN k = 5 THEN 8 ELSE 0 END FROM t0),
t2 AS (SELECT project, r AS line_no, r // 6 + 1 AS page, (700 - r % 6 * 25 - down)::DOUBLE AS y, fh, cells FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ln, j) - 1 AS r FROM t1)),
t3 AS (SELECT *, array_to_string(cells, ' ') AS text, len(cells) >= 2 AS tr FROM t2),
t4 AS (SELECT *, {trim('text')} AS tt, NOT tr AND regexp_matches({trim('text')}, '^{S}*[0-9]+[.)]{S}+{NS}') AS li FROM t3 WHERE {trim('text')} <> ''),
t5 AS (SELECT *, lag(page) OVER w AS p_page, lag(fh) OVER w AS p_fh, lag(y) OVER w AS p_y, lag(tt) OVER w AS p_tt FROM t4 WINDOW w AS (PARTITION BY project ORDER BY line_no)),
t6 AS (
  SELECT *, coalesce(page = p_page AND abs(fh - p_fh) <= 0.5 AND p_y - y <= (fh + p_fh) / 2 * 2.46::DOUBLE, false) AS wraps, coalesce(page = p_page AND abs(fh - p_fh) <= 0.5 AND p_y - y <= (fh + p_fh) / 2 * 2.9::DOUBLE, false) AS lwraps,
    coalesce(page <> p_page OR p_y - y <= (fh + p_fh) / 2 * 2.9::DOUBLE, false) AS follows,
    coalesce(page = p_page + 1 AND abs(fh - p_fh) <= 0.5 AND NOT regexp_matches(p_tt, '[.!?:;\"''’”)\]]\z') AND left(tt, 1) = lower(left(tt, 1)) AND left(tt, 1) <> upper(left(tt, 1)), false) AS crosses,
    CASE WHEN tr THEN NULL WHEN lower(tt) IN ('introduction', 'conclusion') THEN lower(tt) WHEN regexp_matches(tt, '(?i)^chapter\s+[0-9]+') THEN 'chapter' WHEN regexp_matches(tt, '(?i)^bonus\b') THEN 'bonus' END AS hk FROM t5),
t7 AS (
  SELECT *, CASE WHEN hk = 'chapter' THEN TRY_CAST(regexp_extract(tt, '(?i)^chapter\s+([0-9]+)', 1) AS INT) END AS hn,
    CASE WHEN hk = 'chapter' THEN {trim(r"regexp_extract(tt, '(?i)^chapter\s+[0-9]+\s*[:.\-–]?\s*(.*)\z', 1)")} WHEN hk = 'bonus' THEN {trim(r"regexp_extract(tt, '(?i)^bonus\b\s*[:.\-–]?\s*(.*)\z', 1)")} ELSE '' END AS ht,
    sum((hk IS NOT NULL)::INT) OVER (PARTITION BY project ORDER BY line_no) AS section FROM t6)"""
SECTIONS = """s0 AS (SELECT *, row_number() OVER w - 1 AS pos, first_value(hk) OVER w AS k0, first_value(ht) OVER w AS n0 FROM t7 WHERE section > 0 WINDOW w AS (PARTITION BY project, section ORDER BY line_no)),
s1 AS (SELECT *, k0 IN ('chapter', 'bonus') AND n0 = '' AS untitled, bool_and(CASE WHEN pos = 0 THEN true WHEN pos = 1 THEN NOT li AND NOT tr ELSE NOT li AND NOT tr AND wraps END) OVER (PARTITION BY project, section ORDER BY line_no) AS in_title FROM s0),
s2 AS (SELECT *, untitled AND in_title AND pos > 0 AS is_title FROM s1),
s3 AS (
  SELECT project, section, max(hk) FILTER (pos = 0) AS kind, max(hn) FILTER (pos = 0) AS number, max(ht) FILTER (pos = 0) AS inline, coalesce(string_agg(tt, ' ' ORDER BY line_no) FILTER (is_title), '') AS next_title, max(text) FILTER (pos = 0) AS heading_text,
    max(page) FILTER (pos = 0) AS start_page, count(*) FILTER (pos > 0 AND NOT is_title) AS n_body, arg_max(page, line_no) FILTER (pos > 0 AND NOT is_title) AS last_page FROM s2 GROUP BY ALL),
s4 AS (SELECT *, CASE kind WHEN 'introduction' THEN 'Introduction' WHEN 'conclusion' THEN 'Conclusion' ELSE CASE WHEN inline <> '' THEN inline ELSE next_title END END AS title, coalesce(last_page, start_page) AS end_page FROM s3),
s5 AS (SELECT *, lead(kind) OVER w AS f_kind, lead(title) OVER w AS f_title, lead(number) OVER w AS f_number FROM s4 WINDOW w AS (PARTITION BY project ORDER BY section)),
se AS (SELECT * FROM s5 WHERE NOT (n_body = 0 AND f_kind IS NOT NULL AND f_kind = kind AND f_title = title AND f_number IS NOT DISTINCT FROM number)),
by0 AS (SELECT project, section, tt, li, tr, cells, wraps, lwraps, follows, crosses, row_number() OVER (PARTITION BY project, section ORDER BY line_no) AS i FROM s2 WHERE pos > 0 AND NOT is_title),
un0 AS (SELECT project, 0 AS section, tt, li, tr, cells, wraps, lwraps, follows, crosses, row_number() OVER (PARTITION BY project ORDER BY line_no) AS i FROM t7 WHERE project NOT IN (SELECT project FROM se)),
bd AS (SELECT b.* FROM by0 b JOIN se USING (project, section) UNION ALL SELECT * FROM un0)"""
BLOCKS = f"""fo AS (
  SELECT project, section, i, CASE WHEN tr THEN 'table' WHEN li THEN 'list' ELSE 'paragraph' END AS mode, true AS starts FROM bd WHERE i = 1
  UNION ALL SELECT b.project, b.section, b.i, CASE WHEN b.tr THEN 'table' WHEN b.li THEN 'list' WHEN mode = 'list' AND lwraps THEN 'list' ELSE 'paragraph' END,
    NOT CASE WHEN b.tr THEN mode = 'table' WHEN b.li THEN mode = 'list' AND follows WHEN mode = 'list' THEN lwraps ELSE mode = 'paragraph' AND (wraps OR crosses) END FROM fo JOIN bd b ON b.project = fo.project AND b.section = fo.section AND b.i = fo.i + 1),
g0 AS (SELECT b.*, sum(starts::INT) OVER (PARTITION BY project, section ORDER BY i) - 1 AS block_no FROM bd b JOIN fo USING (project, section, i)),
g1 AS (SELECT *, sum(li::INT) OVER (PARTITION BY project, section, block_no ORDER BY i) AS item FROM g0),
gi AS (SELECT project, section, block_no, list(t ORDER BY item) AS items FROM (SELECT project, section, block_no, item, string_agg(tt, ' ' ORDER BY i) AS t FROM g1 GROUP BY ALL) WHERE item > 0 GROUP BY ALL),
g2 AS (SELECT project, section, block_no, arg_min(CASE WHEN tr THEN 'table' WHEN li THEN 'list' ELSE 'paragraph' END, i) AS type, string_agg(tt, ' ' ORDER BY i) AS text, list(cells ORDER BY i) AS rows FROM g1 GROUP BY ALL),
g3 AS (SELECT *, list_filter(list_transform(string_split(text, '•'), lambda x: {trim('x')}), lambda x: x <> '') AS run FROM g2 LEFT JOIN gi USING (project, section, block_no)),
g4 AS (SELECT *, type = 'paragraph' AND starts_with({trim('text')}, '•') AND len(run) >= 2 AS prom FROM g3),
g5 AS (SELECT project, section, block_no, CASE WHEN prom THEN 'list' ELSE type END AS type, text, CASE WHEN prom THEN run WHEN type = 'list' THEN items END AS items, CASE WHEN type = 'table' THEN rows END AS rows FROM g4),
g6 AS (SELECT *, lag(type) OVER w AS p_type, lag(text) OVER w AS p_text FROM g5 WINDOW w AS (PARTITION BY project, section ORDER BY block_no)),
gb AS (SELECT * FROM g6 WHERE NOT coalesce(type = 'paragraph' AND p_type = 'paragraph' AND p_text = text, false))"""
_ITEM = f"CASE WHEN regexp_matches(x, '^{S}*[0-9]+[.)]{S}+{NS}') THEN x ELSE '- ' || x END"
FILES = rf"""v0 AS (
  SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM gb),
v1 AS (
  SELECT *, CASE type WHEN 'paragraph' THEN text WHEN 'list' THEN array_to_string(CASE WHEN section = 0 THEN items ELSE list_transform(items, lambda x: {_ITEM}) END, chr(10))
    ELSE array_to_string(list_concat(list_transform(rows[1:1], lambda r: '| ' || array_to_string(list_resize(r, width, ''), ' | ') || ' |'), ['| ' || array_to_string(list_resize(['---'], width, '---'), ' | ') || ' |'], list_transform(rows[2:], lambda r: '| ' || array_to_string(list_resize(r, width, ''), ' | ') || ' |')), chr(10)) END AS md FROM v0),
v2 AS (SELECT project, section, string_agg(md, chr(10) || chr(10) ORDER BY block_no) AS body_md FROM v1 GROUP BY ALL),
v3 AS (
  SELECT se.*, kind = 'bonus' AS bo, concat_ws(chr(10) || chr(10), '# ' || heading_text, CASE WHEN next_title <> '' THEN '## ' || title END, body_md) || chr(10) AS markdown, CASE WHEN title <> '' THEN title ELSE heading_text END AS name,
    row_number() OVER (PARTITION BY project, kind = 'bonus' ORDER BY section) - 1 AS pos FROM se LEFT JOIN v2 USING (project, section)),
v4 AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+\z', '', 'g') AS sl FROM v3),
v5 AS (SELECT *, CASE WHEN bo THEN CASE WHEN sl <> '' THEN sl ELSE 'bonus-' || pos END ELSE CASE WHEN pos < 10 THEN '0' ELSE '' END || pos || '-' || CASE WHEN sl <> '' THEN sl ELSE kind END END AS id FROM v4),
fi AS (
  SELECT project, CASE WHEN bo THEN 'bonus' ELSE 'chapter' END AS entry_kind, pos, id, CASE WHEN NOT bo THEN kind END AS type, number, name AS title, CASE WHEN bo THEN 'bonuses/raw/' ELSE 'chapters/' END || id || '.md' AS file, start_page, end_page, markdown FROM v5
  UNION ALL SELECT v2.project, 'chapter', 0, '00-full-text', 'unclassified', NULL, 'Full text', 'chapters/00-full-text.md', 1, (SELECT max(page) FROM t7 WHERE t7.project = v2.project), body_md || chr(10) FROM v2 WHERE section = 0)"""
PROBLEMS = """pr AS (SELECT *, lag(end_page) OVER (PARTITION BY project ORDER BY pos, id) AS p_end, count(*) OVER (PARTITION BY project) AS alone, count(*) OVER (PARTITION BY project, id) AS same FROM fi),
pq AS (
  SELECT project, pos, id, 'backwards' AS rule FROM pr WHERE end_page < start_page UNION ALL SELECT project, pos, id, 'overlap' FROM pr WHERE start_page <= p_end
  UNION ALL SELECT project, pos, id, 'repeated-id' FROM pr WHERE same > 1 UNION ALL SELECT project, pos, id, 'fallback-not-alone' FROM pr WHERE type = 'unclassified' AND alone > 1)"""


def _joined(df):
    return df.withColumn("cells", F.array_join("cells", "¦"))


def _blocks(spark, d):
    rows = layout.section_blocks(text_lines(spark, d))
    return rows.select("project", "section", "block_no", "type", "text", F.array_join("items", "¦").alias("items"), F.size("rows").cast("long").alias("n_rows"))


QUERIES = {
    "layout_lines": lambda s, d: _joined(layout.lines(items(s, d))),
    "layout_classified": lambda s, d: _joined(layout.classified_items(items(s, d))),
    "section_list": lambda s, d: layout.sections(text_lines(s, d)),
    "section_blocks": _blocks,
    "ingest_files": lambda s, d: layout.files(text_lines(s, d)),
    "inventory_problems": lambda s, d: layout.inventory_problems(layout.files(text_lines(s, d))),
}
_R = f"WITH RECURSIVE {lift.LINES}, "
_I = f"{_R}{TEXT_LINES}, {SECTIONS}, {BLOCKS}, {FILES}"
ORACLES = {
    "layout_lines": f"{_R}{ITEMS}, {LAYOUT} SELECT project, page, line, y, font_height, array_to_string(cells, '¦') AS cells FROM q7",
    "layout_classified": f"{_R}{ITEMS}, {LAYOUT}, {CLASSIFIED} SELECT project, row_number() OVER (PARTITION BY project ORDER BY page, line) - 1 AS line_no, page, y, font_height, text, array_to_string(cells, '¦') AS cells, is_list_item, is_table_row FROM kl",
    "section_list": f"{_R}{TEXT_LINES}, {SECTIONS} SELECT project, section::BIGINT AS section, kind, number, title, next_title <> '' AS from_next, heading_text, start_page, end_page, n_body FROM se",
    "section_blocks": f"{_R}{TEXT_LINES}, {SECTIONS}, {BLOCKS} SELECT project, section::BIGINT AS section, block_no::BIGINT AS block_no, type, CASE WHEN type = 'paragraph' THEN text END AS text, array_to_string(items, '¦') AS items, len(rows) AS n_rows FROM gb WHERE section > 0",
    "ingest_files": f"{_I} SELECT *, {words('markdown')} AS words FROM fi",
    "inventory_problems": f"{_I}, {PROBLEMS} SELECT * FROM pq",
}
