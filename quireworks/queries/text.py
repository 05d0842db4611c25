from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import joins
from ..plans import lift
from .sql import S, collapse, preview, trim, words


def _first_line(spark, d):
    docs = lift.table(spark, d, "documents")
    line = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    return docs.select("doc_id", "source", "lang", line.alias("line"), F.coalesce("text", F.lit("")).alias("text"))


def metrics(spark, d):
    return _first_line(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"), T.preview(F.col("text")).alias("preview"), T.slug(F.col("text")).alias("slug"), F.md5(T.squeezed(F.col("text")).cast("binary")).alias("squeezed"), F.md5(T.trim(T.collapse(F.col("text"))).cast("binary")).alias("flat"))


def word_frequencies(spark, d):
    docs = lift.table(spark, d, "documents").select("lang", F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word"))
    return docs.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def plain_markdown(spark, d):
    return lift.md_files(spark, d).select("file_id", T.plain(F.col("text")).alias("plain"))


def labels(spark, d):
    rows = _first_line(spark, d)
    number = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 130)
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("html/"), (F.col("doc_id") % 130).cast("string"), F.lit(".html"))).otherwise(F.concat(F.lit("html/c-"), F.col("doc_id").cast("string"), F.lit(".html")))
    return rows.select("doc_id", T.toc_label(number, F.col("line")).alias("toc_label"), T.chapter_label(path).alias("chapter_label"))


ROMAN_PARTS = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def roman_numbers(spark, d):
    """Numbers spelt as Roman and read back."""
    rows = lift.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3999 + 1).alias("n"))
    left, text = F.col("n"), F.lit("")
    for value, sign in ROMAN_PARTS:
        text = F.concat(text, F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return rows.withColumn("roman", text).select("doc_id", "roman", T.roman(F.upper("roman")).cast("long").alias("value"))


def colours(spark, d):
    code = lambda k: F.concat(F.when(F.col("doc_id") % 2 == 0, "#").otherwise(""), F.lpad(F.lower(F.hex((F.col("doc_id") * k) % 16777216)), 6, "0"))
    rows = lift.table(spark, d, "documents").select("doc_id", T.hex_colour(code(7919)).alias("text"), T.hex_colour(code(104729)).alias("ground"))
    ratio = T.contrast(F.col("text"), F.col("ground"))
    return rows.select("doc_id", "text", "ground", F.round(ratio, 6).alias("ratio"), (ratio >= 4.5).alias("passes"))


def pages(spark, d):
    return lift.table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))


def page_references(spark, d):
    return pages(spark, d).select("page_id", F.explode(T.references(F.col("html"))).alias("reference"))


def page_escapes(spark, d):
    """Comments taken out, titles escaped, a template filled, a marker put after the first opening section."""
    rows = pages(spark, d)
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    bare = T.without_comments(F.col("html"))
    template = F.lit("<a href='{{HREF}}'>{{TITLE}}</a> {{TITLE}} {{OTHER}}")
    filled = T.filled(template, {"HREF": F.col("page_id").cast("string"), "TITLE": T.escaped(title)})
    return rows.select("page_id", (F.length("html") - F.length(bare)).cast("long").alias("comment_chars"), T.escaped(title).alias("escaped"), filled.alias("filled"), F.md5(T.marked(bare, F.lit("<i></i>")).cast("binary")).alias("marked"))


def lifted_pages(spark, d):
    """Pages with ids, contents entries, raster images and an anchor put in, some of them broken."""
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    top = F.concat(F.lit('<section class="chapter-open" data-n="'), i, F.lit('" id="c'), i, F.lit('">'))
    entry = F.concat(F.lit('<li class="toc-entry">\n <a href="#c'), i, F.when(k == 1, "x").otherwise(""), F.lit('">t</a>\n <span class="toc-pagenum" data-target="#c'), i, F.when(k == 2, "y").otherwise(""), F.lit('"></span></li>'))
    image = F.concat(F.lit('<img src="assets/'), (F.col("page_id") % 40).cast("string"), F.when(k == 3, ".PNG").otherwise(".jpeg"), F.lit('"><img src="a.svg"><i style="background:url(\'bg/'), (F.col("page_id") % 7).cast("string"), F.lit(".png')\"></i>"))
    return pages(spark, d).select("page_id", F.concat(top, entry, image, "html").alias("html"))


def page_anchors(spark, d):
    rows = lifted_pages(spark, d)
    html = F.col("html")
    return rows.select(
        "page_id",
        T.anchor(html).alias("anchor"),
        F.array_join(F.regexp_extract_all(html, F.lit(P.ELEMENT_ID), F.lit(1)), ",").alias("ids"),
        F.array_join(F.regexp_extract_all(html, F.lit(P.RASTER), F.lit(1)), ",").alias("rasters"),
        F.array_join(F.regexp_extract_all(html, F.lit(P.TOC_ENTRY), F.lit(1)), ",").alias("targets"),
        F.array_join(T.references(html), ",").alias("refs"),
    )


def toc_breaks(spark, d):
    """Ids that a page's contents entries point to and no element has."""
    rows = lifted_pages(spark, d)
    targets = rows.select(F.col("page_id").alias("project"), F.explode(T.toc_targets(F.col("html"))).alias("target"))
    ids = rows.select(F.col("page_id").alias("project"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(P.ELEMENT_ID), F.lit(1))).alias("target")).distinct()
    return joins.broken_targets(targets, ids)


def style_tokens(spark, d):
    """A style sheet with variables set, read back."""
    rows = lift.table(spark, d, "documents").select("doc_id", F.col("source"))
    css = F.concat(F.lit(":root {\n  --color-bg:  #fff;\n  --font-body: serif;\n  --font-size-body: "), (F.col("doc_id") % 40 / 4 + 3).cast("string"), F.when(F.col("doc_id") % 11 == 0, "px").otherwise("pt"), F.lit(";\n}"))
    set_ = T.with_variable(T.with_variable(css, "color-bg", T.hex_colour(F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0"))), "font-body", T.font_stack(F.col("source"), "body"))
    points = T.style_points(F.col("css"), "font-size-body")
    return rows.withColumn("css", set_).select("doc_id", "css", points.alias("points"), F.when(points.isNull(), "skipped").when(points >= 9.5, "pass").otherwise("fail").alias("status"), T.with_variable(F.col("css"), "absent", F.lit("x")).isNull().alias("no_absent"))


def title_splits(spark, d):
    rows = _first_line(spark, d).select("doc_id", F.col("line").alias("title"))
    n = F.locate(" ", F.col("title"))
    lead = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" "), F.substring(F.col("title"), F.lit(1), n))).when(F.col("doc_id") % 5 == 2, F.lit("Zzz")).when(F.col("doc_id") % 5 == 3, F.col("title")).otherwise(F.substring("title", 1, 3))
    return rows.withColumn("lead", lead).select("doc_id", T.split_title(F.col("title"), F.col("lead")).alias("s")).select("doc_id", "s.lead", "s.main", "s.problem")


def lists_and_tables(spark, d):
    """Each document's lines as a table of words and as a list, in Markdown; runs of bullets split; leaked callouts repaired."""
    docs = lift.table(spark, d, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = F.transform(lines, lambda x: F.split(x, " "))
    items = F.transform(lines, lambda x, i: F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit(". "), x)).otherwise(x))
    run = F.array_join(lines, " • ")
    leak = F.concat(F.when(F.col("doc_id") % 2 == 0, "\u0091CALLOUT\u0091KIND[ª]TIP, EYEBROW[ª]\"").otherwise("CALL "), F.regexp_replace(lines[0], '["\n]', ""), F.lit('x", BODY[ª]"b '), F.col("doc_id").cast("string"), F.lit('"}]:'))
    md5 = lambda x: F.md5(x.cast("binary"))  # noqa: E731  wide results as digests
    return docs.select("doc_id", md5(T.table_markdown(rows)).alias("table"), md5(T.list_markdown(items)).alias("list"), md5(F.array_join(T.bullets(run), "|")).alias("bullets"), T.repaired_callout(leak).alias("callout"))


CUT = "ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"
QUERIES = {
    "text_metrics": metrics,
    "word_frequencies": word_frequencies,
    "plain_markdown": plain_markdown,
    "chapter_labels": labels,
    "roman_numbers": roman_numbers,
    "colour_contrast": colours,
    "page_references": page_references,
    "page_escapes": page_escapes,
    "page_anchors": page_anchors,
    "toc_breaks": toc_breaks,
    "style_tokens": style_tokens,
    "title_splits": title_splits,
    "lists_and_tables": lists_and_tables,
}


def _plain(x: str) -> str:
    for pattern, to, all_ in ((f"^#{{1,6}}{S}+", "", ""), (f"^{S}*[0-9]+[.)]{S}+", "", ""), (f"^{S}*[-*]{S}+", "", ""), (f"^{S}*>{S}?", "", ""), (r"^\|", "", ""), (r"\|\z", "", ""), (r"\|", " ", ", 'g'")):
        x = f"regexp_replace({x}, '{pattern}', '{to}'{all_})"
    return x


def _lum(c: str) -> str:
    ch = lambda i: f"('0x' || substr({c}, {i}, 2))::INT / 255.0::DOUBLE"
    one = lambda i: f"(CASE WHEN {ch(i)} <= 0.03928 THEN {ch(i)} / 12.92::DOUBLE ELSE pow(({ch(i)} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
    return f"(0.2126::DOUBLE * {one(2)} + 0.7152::DOUBLE * {one(4)} + 0.0722::DOUBLE * {one(6)})"


_REF = r"""(?:src|href)="([^"]+)"|url\(([^)]+)\)"""


def _refs(x: str) -> str:
    a, b = (f"regexp_extract_all({x}, '{_REF}', {i})" for i in (1, 2))
    raw = f"list_transform(list_zip({a}, {b}), lambda p: regexp_replace({trim('CASE WHEN p[1] <> chr(0) AND p[1] <> repeat(chr(32), 0) THEN p[1] ELSE p[2] END')}, '^[''\"]|[''\"]\\z', '', 'g'))"
    return f"list_filter({raw}, lambda r: r <> '' AND NOT regexp_matches(r, '^(data:|#|https?://)'))"


_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_TITLE = r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
ORACLES = {
    "text_metrics": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id AS d FROM documents)
SELECT doc_id, {words('text')} AS words, {preview('text')} AS preview, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+\z', '', 'g') AS slug,
  md5(lower({collapse('text', '')})) AS squeezed, md5({trim(collapse('text'))}) AS flat FROM t""",
    "word_frequencies": r"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}][\p{L}\p{N}''-]*')) AS word FROM documents) GROUP BY ALL",
    "plain_markdown": f"WITH {lift.MD} SELECT file_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: {_plain('l')}), chr(10)) AS plain FROM mf",
    "chapter_labels": r"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title, (doc_id % 130)::VARCHAR AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN title ELSE CASE WHEN length(n) < 2 THEN '0' || n ELSE n END || '. ' || title END AS toc_label,
  CASE WHEN doc_id % 2 = 0 THEN CASE WHEN length(n) < 2 THEN '0' || n ELSE n END ELSE 'c-' || doc_id END AS chapter_label FROM t""",
    "roman_numbers": """WITH t AS (SELECT doc_id, doc_id % 3999 + 1 AS n FROM documents)
SELECT doc_id, repeat('m', (n // 1000)::INT) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][(n // 100) % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][(n // 10) % 10 + 1]
  || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS roman, n AS value FROM t""",
    "colour_contrast": f"""WITH t AS (SELECT doc_id, '#' || lpad(lower(to_hex((doc_id * 7919) % 16777216)), 6, '0') AS text, '#' || lpad(lower(to_hex((doc_id * 104729) % 16777216)), 6, '0') AS ground FROM documents),
l AS (SELECT *, {_lum('text')} AS a, {_lum('ground')} AS b FROM t)
SELECT doc_id, text, ground, round((greatest(a, b) + 0.05::DOUBLE) / (least(a, b) + 0.05::DOUBLE), 6) AS ratio, (greatest(a, b) + 0.05::DOUBLE) / (least(a, b) + 0.05::DOUBLE) >= 4.5 AS passes FROM l""",
    "page_references": f"SELECT DISTINCT page_id, reference FROM (SELECT page_id, unnest({_refs('html')}) AS reference FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))",
    "page_escapes": rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g') AS bare FROM pages),
m AS (SELECT *, length(regexp_extract(bare, '(?s)^(.*?<(?:section|div|main|article)\b[^>]*>)', 1)) AS cut FROM p)
SELECT page_id, length(html) - length(bare) AS comment_chars, {_ESC.format(_TITLE)} AS escaped,
  replace(replace('<a href=''{{{{HREF}}}}''>{{{{TITLE}}}}</a> {{{{TITLE}}}} {{{{OTHER}}}}', '{{{{HREF}}}}', page_id::VARCHAR), '{{{{TITLE}}}}', {_ESC.format(_TITLE)}) AS filled,
  md5(CASE WHEN cut > 0 THEN left(bare, cut) || '<i></i>' || bare[cut + 1:] ELSE '<i></i>' || chr(10) || bare END) AS marked FROM m""",
    "page_anchors": rf"""WITH p AS (
  SELECT page_id, '<section class="chapter-open" data-n="' || page_id || '" id="c' || page_id || '">' || '<li class="toc-entry">' || chr(10) || ' <a href="#c' || page_id || CASE WHEN page_id % 4 = 1 THEN 'x' ELSE '' END || '">t</a>' || chr(10)
    || ' <span class="toc-pagenum" data-target="#c' || page_id || CASE WHEN page_id % 4 = 2 THEN 'y' ELSE '' END || '"></span></li>'
    || '<img src="assets/' || (page_id % 40) || CASE WHEN page_id % 4 = 3 THEN '.PNG' ELSE '.jpeg' END || '"><img src="a.svg"><i style="background:url(''bg/' || (page_id % 7) || '.png'')"></i>' || coalesce(html, '') AS html FROM pages)
SELECT page_id, regexp_extract(html, '<section class="chapter-open"[^>]*\bid="([^"]+)"', 1) AS anchor, array_to_string(regexp_extract_all(html, '\sid="([^"]+)"', 1), ',') AS ids,
  array_to_string(regexp_extract_all(html, '(?i)src="([^"]+\.(?:png|jpe?g))"', 1), ',') AS rasters,
  array_to_string(regexp_extract_all(html, '(?s)<li class="toc-entry">.*?<a href="#([^"]+)".*?<span class="toc-pagenum" data-target="#([^"]+)">', 1), ',') AS targets,
  array_to_string(list_filter({_refs('html')}, lambda r, i: list_position({_refs('html')}, r) = i), ',') AS refs FROM p""",
    "toc_breaks": r"""WITH p AS (SELECT page_id, 'c' || page_id || CASE page_id % 4 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END AS target, list_append(regexp_extract_all(coalesce(html, ''), '\sid="([^"]+)"', 1), 'c' || page_id) AS ids FROM pages)
SELECT page_id AS project, target FROM p WHERE page_id % 4 IN (1, 2) AND NOT list_contains(ids, target)""",
    "style_tokens": r"""WITH t AS (SELECT doc_id, source, (doc_id % 40) / 4 + 3 AS pt, CASE WHEN doc_id % 11 = 0 THEN 'px' ELSE 'pt' END AS unit FROM documents),
c AS (SELECT doc_id, ':root {' || chr(10) || '  --color-bg:  #' || lpad((doc_id % 1000)::VARCHAR, 6, '0') || ';' || chr(10) || '  --font-body: "' || source || '", Georgia, "Times New Roman", serif;' || chr(10)
  || '  --font-size-body: ' || pt::DOUBLE || unit || ';' || chr(10) || '}' AS css, CASE WHEN unit = 'pt' THEN pt::DOUBLE END AS points FROM t)
SELECT doc_id, css, points, CASE WHEN points IS NULL THEN 'skipped' WHEN points >= 9.5 THEN 'pass' ELSE 'fail' END AS status, true AS no_absent FROM c""",
    "title_splits": rf"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title FROM documents),
l AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || left(title, strpos(title, ' ')) WHEN 2 THEN 'Zzz' WHEN 3 THEN title ELSE left(title, 3) END AS given FROM t),
s AS (SELECT *, {trim('given')} AS short FROM l),
m AS (SELECT *, {trim('title[length(short) + 1:]')} AS rest FROM s),
p AS (SELECT *, coalesce(given, '') = '' AS bare, CASE WHEN coalesce(given, '') = '' THEN NULL WHEN NOT starts_with(title, short) THEN 'not a prefix' WHEN rest = '' THEN 'nothing left' WHEN short || ' ' || rest <> title THEN 'not lossless' END AS problem FROM m)
SELECT doc_id, CASE WHEN NOT bare AND problem IS NULL THEN short END AS lead, CASE WHEN bare THEN title WHEN problem IS NULL THEN rest END AS main, problem FROM p""",
    "lists_and_tables": rf"""WITH {CUT}, c AS (SELECT doc_id, l FROM ls),
r AS (SELECT doc_id, l, list_transform(l, lambda x: string_split(x, ' ')) AS rs FROM c),
w AS (SELECT *, list_max(list_transform(rs, lambda r: len(r))) AS n FROM r),
t AS (SELECT *, list_transform(rs, lambda r: '| ' || array_to_string(list_resize(r, n, ''), ' | ') || ' |') AS ts FROM w),
k AS (SELECT *, regexp_replace(l[1], '["\n]', '', 'g') || 'x' AS eye FROM t)
SELECT doc_id, md5(array_to_string(list_concat(ts[1:1], ['| ' || array_to_string(list_resize(['---'], n, '---'), ' | ') || ' |'], ts[2:]), chr(10))) AS "table",
  md5(array_to_string(list_transform(l, lambda x, i: CASE WHEN i % 2 = 1 THEN CASE WHEN regexp_matches(i || '. ' || x, '^\s*\d+[.)]\s+\S') THEN '' ELSE '- ' END || i || '. ' || x
    ELSE CASE WHEN regexp_matches(x, '^\s*\d+[.)]\s+\S') THEN '' ELSE '- ' END || x END), chr(10))) AS list,
  md5(array_to_string(list_filter(list_transform(string_split(array_to_string(l, ' • '), '•'), lambda x: {trim('x')}), lambda x: x <> ''), '|')) AS bullets,
  CASE WHEN doc_id % 2 = 0 THEN '> **' || eye || '**' || chr(10) || '>' || chr(10) || '> b ' || doc_id ELSE 'CALL ' || eye || '", BODY[ª]"b ' || doc_id || '"}}]:' END AS callout FROM k""",
}
