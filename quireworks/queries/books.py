from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly, bonus, config
from ..plans import lift
from .sql import S, trim

THEME = {
    "fonts": {"body": "Georgia", "heading": "Inter", "mono": "Courier"},
    "palette": {"bgAlt": "#eeeeee", "textMuted": "#666666", "heading": "#111111", "border": "#dddddd", "rule": "#cccccc", "link": "#0000ee", "danger": "#aa0000"},
}
TERMS = ["the", "Erin", "zz"]


def _line(i):
    return F.coalesce(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(i)), F.lit(""))


def forms(spark, d):
    """A brand form for each document, with comments, unknown and repeated fields, rules and blank lines."""
    docs = lift.table(spark, d, "documents")
    p = F.col("doc_id")
    text = F.concat(
        F.lit("<!-- note\n**Tone:** hidden -->\n# Brand\n**Niche (required):** "), _line(0), F.lit("\n**Book Title:** "), _line(1), F.lit("\nsecond line\n\n\nthird <&>\n\n**Unknown:** zzz\nlost\n**Author / Brand Name:**\n"), F.col("source"),
        F.lit("\n---\nignored\n**Primary:** "), F.lpad((p % 1000000).cast("string"), 6, "0"), F.lit("\n**Accent:** #abc123\n**Target Reader:** all\n**Tone (optional):** calm\n**Secondary:** 333333\n**Text:** #1c1a17\n"),
        F.when(p % 3 == 0, "**Background:** fbfaf7\n").otherwise("**Background:**\n"), F.lit("**Back Cover Bullets:**\n- one\n\n* two-"), p.cast("string"), F.lit("\n\nthree - x\n**Back Cover Punchline:** P"), F.when(p % 5 == 0, "").otherwise("unch"), F.lit("\n**Accent:** #def456\n"),
        F.when(p % 2 == 0, "**Disclaimer (optional):** not\nadvice\n\nat all\n").otherwise(""), F.when(p % 4 == 1, "**CTA Title:** Go\n**CTA Body:** now\n**CTA Link:** http://x\n").otherwise(""), F.when(p % 8 == 1, "**CTA Link Label:** Click\n").otherwise(""), F.lit("**Body Font:** Lora\n"),
    )
    return docs.select(p.alias("project"), text.alias("text"))


def resolved(spark, d):
    return config.resolved(config.brand_fields(forms(spark, d)), THEME, TERMS)


def _resolved(spark, d):
    return resolved(spark, d).withColumns({"backCoverBullets": F.array_join("backCoverBullets", "¦"), "missing": F.array_join("missing", ",")})


def bonus_files(spark, d):
    docs = lift.table(spark, d, "documents")
    p, a = F.col("doc_id"), _line(0)
    check = F.concat(F.when(p % 3 == 0, "• Example zero • ").otherwise("• check "), a, F.lit(" • Example a • example b • Examples c • Example d\n\nBetween\n\n• last <one> • Example e"))
    sheet = F.concat(F.lit("1. Name • hint\nplain line\n2. Goal "), a, F.lit(" • guide & • more\n\nrule • go • no\n\n3. Third"))
    text = F.concat(F.lit("# BONUS\n\n## "), _line(1), F.lit(" title\n\nIntro "), a, F.lit("\n\n"), F.when(p % 2 == 0, check).otherwise(sheet), F.lit("\n\nOutro"))
    return docs.select(p.alias("file_id"), F.when(p % 2 == 0, "checklist").otherwise("worksheet").alias("format"), text.alias("text"))


def book_parts(spark, d):
    """A book for each source: its documents are the chapters."""
    docs = lift.table(spark, d, "documents")
    books = docs.groupBy(F.col("source").alias("project")).agg(F.min("doc_id").alias("k"), F.count(F.lit(1)).alias("n"))
    k = F.col("k")
    books = books.select(
        "project", F.concat(F.lit("Book & "), "project").alias("title"), F.when(k % 2 == 0, "Sub").alias("subtitle"), F.lit("Me").alias("author"), F.when(k % 3 == 0, F.concat(F.lit("cover/final/"), "project", F.lit(".png"))).alias("cover"), F.when(k % 2 == 1, "One.\n\nTwo <b>.").alias("disclaimer"),
        (k % 2 == 1).alias("disclaimer_required"), (k % 3).alias("n_bonuses"), F.when(k % 4 > 0, "Go").alias("cta_title"), F.lit("now").alias("cta_content"), F.when(k % 4 == 2, "http://x").alias("cta_link"), F.when(k % 5 > 0, "Punch ").alias("punchline"), F.when(k % 2 > 0, F.array(F.lit("One & all"), F.lit("two"))).alias("points"),
    )
    html = F.concat(F.lit('<section class="chapter-open" id="c'), F.col("doc_id").cast("string"), F.lit('"><p>'), T.escaped(F.coalesce("text", F.lit(""))), F.lit("</p></section>"))
    chapters = docs.select(F.col("source").alias("project"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id")).alias("number"), _line(0).alias("title"), html.alias("html"))
    return assembly.book_parts(books, chapters)


def covers(spark, d):
    files = lift.table(spark, d, "events").select(F.col("user_id").alias("project"), F.concat("event_type", (F.col("event_id") % 7).cast("string"), F.when(F.col("event_id") % 3 == 0, ".kindle").when((F.col("event_id") % 11 == 0) & (F.col("user_id") % 2 == 0), ".Print").when(F.col("event_id") % 5 == 0, "-back").otherwise(""), F.when(F.col("event_id") % 2 == 0, ".png").otherwise(".txt")).alias("name"))
    return assembly.print_cover(files)


def stage_results(spark, d):
    events = lift.table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "not_implemented").otherwise("success")
    return assembly.latest(events.select(F.col("user_id").alias("project"), F.concat(F.lit("stage"), (F.col("event_id") % 4).cast("string")).alias("stage"), F.col("event_id").alias("finished_at"), status.alias("status")))


def media(spark, d):
    i = F.col("event_id").cast("string")
    k = F.col("event_id") % 6
    url = F.concat(F.lit("http://m/"), i)
    doc = (
        F.when(k == 0, F.concat(F.lit('{"a": "https://low/'), i, F.lit('", "url": "'), url, F.lit('"}')))
        .when(k == 1, F.concat(F.lit('{"k": [1, {"x": "'), url, F.lit('"}], "s": "ftp://no"}')))
        .when(k == 2, F.concat(F.lit('{"results": [], "output": {"url": "'), url, F.lit('"}}')))
        .when(k == 3, F.col("props"))
        .when(k == 4, F.concat(F.lit('["no", "'), url, F.lit('"]')))
        .otherwise(F.concat(F.lit('{"a": {"b": {"c": {"d": "'), url, F.lit('"}}}}')))
    )
    return lift.table(spark, d, "events").select("event_id", assembly.media_url(doc).alias("url"))


def outline(spark, d):
    """Documents as a forest: each id's parent is a fifth of it within its source's numbering."""
    docs = lift.table(spark, d, "documents")
    from pyspark.sql import Window

    rows = docs.select(F.col("source").alias("project"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("id"), _line(0).alias("title"))
    up = F.floor(F.col("id") / 5).cast("int")
    return assembly.flat_titles(rows.select("project", "id", F.when(up > 0, up).alias("parent"), F.col("id").alias("pos"), "title"))


def boxes(spark, d):
    li = lift.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.lit(800.0).alias("page_height"), F.col("l_quantity").alias("left"), (F.col("l_quantity") * 3).alias("top"), F.col("l_linenumber").cast("double").alias("width"), F.lit(12.0).alias("height"))
    return bonus.field_boxes(li)


QUERIES = {
    "brand_fields": lambda s, d: config.brand_fields(forms(s, d)),
    "resolved_config": _resolved,
    "style_variables": lambda s, d: config.style_variables(resolved(s, d)),
    "config_word_groups": lambda s, d: config.word_groups(resolved(s, d)),
    "bonus_parts": lambda s, d: bonus.parsed(bonus_files(s, d)),
    "bonus_field_labels": lambda s, d: bonus.field_labels(bonus.parsed(bonus_files(s, d).where("format = 'worksheet'"))),
    "bonus_sheet_items": lambda s, d: bonus.sheet_items(bonus.parsed(bonus_files(s, d)), bonus_files(s, d)),
    "field_boxes": boxes,
    "book_parts": book_parts,
    "print_covers": covers,
    "stage_results": stage_results,
    "media_urls": media,
    "outline_titles": outline,
}
_L = "ls AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"
_FIELDS = f"""f0 AS (SELECT doc_id AS p, source, coalesce(l[1], '') AS l0, coalesce(l[2], '') AS l1 FROM ls),
f AS (
  SELECT p, 'niche' AS key, {trim('l0')} AS value FROM f0 UNION ALL SELECT p, 'title', CASE WHEN {trim('l1')} = '' THEN '' ELSE {trim('l1')} || ' ' END || 'second line' || chr(10) || chr(10) || 'third <&>' FROM f0
  UNION ALL SELECT p, 'author', source FROM f0 UNION ALL SELECT p, 'primary', lpad((p % 1000000)::VARCHAR, 6, '0') FROM f0 UNION ALL SELECT p, 'accent', '#def456' FROM f0 UNION ALL SELECT p, 'targetReader', 'all' FROM f0 UNION ALL SELECT p, 'tone', 'calm' FROM f0
  UNION ALL SELECT p, 'secondary', '333333' FROM f0 UNION ALL SELECT p, 'text', '#1c1a17' FROM f0 UNION ALL SELECT p, 'background', CASE WHEN p % 3 = 0 THEN 'fbfaf7' ELSE '' END FROM f0
  UNION ALL SELECT p, 'backCoverBullets', '- one' || chr(10) || chr(10) || '* two-' || p || chr(10) || chr(10) || 'three - x' FROM f0 UNION ALL SELECT p, 'backCoverPunchline', CASE WHEN p % 5 = 0 THEN 'P' ELSE 'Punch' END FROM f0
  UNION ALL SELECT p, 'disclaimer', 'not advice' || chr(10) || chr(10) || 'at all' FROM f0 WHERE p % 2 = 0 UNION ALL SELECT p, unnest(['ctaTitle', 'ctaContent', 'ctaLink']), unnest(['Go', 'now', 'http://x']) FROM f0 WHERE p % 4 = 1
  UNION ALL SELECT p, 'ctaLinkLabel', 'Click' FROM f0 WHERE p % 8 = 1 UNION ALL SELECT p, 'fontBody', 'Lora' FROM f0)"""
_CONFIG = f"""c AS (
  SELECT p, {', '.join(f"max(CASE WHEN key = '{k}' AND value <> '' THEN value END) AS {k}" for k in ('niche', 'title', 'author', 'disclaimer', 'background', 'ctaTitle', 'ctaContent', 'ctaLink', 'ctaLinkLabel', 'backCoverPunchline'))},
    max(CASE WHEN key = 'primary' THEN '#' || value END) AS pal_primary FROM f GROUP BY p),
r AS (
  SELECT p AS project, title, NULL::VARCHAR AS subtitle, author, niche, disclaimer, len(list_filter(['the', 'erin', 'zz'], lambda t: contains(lower(coalesce(niche, '')), t))) > 0 AS disclaimer_required, ctaTitle, ctaContent, ctaLink, ctaLinkLabel, backCoverPunchline,
    ['one', 'two-' || p, 'three - x'] AS backCoverBullets, CASE WHEN background IS NOT NULL THEN '#' || background END AS palette_bg, '#eeeeee' AS palette_bgAlt, '#1c1a17' AS palette_text, '#666666' AS palette_textMuted, '#111111' AS palette_heading,
    pal_primary AS palette_primary, '#333333' AS palette_secondary, '#def456' AS palette_accent, '#dddddd' AS palette_border, '#cccccc' AS palette_rule, '#0000ee' AS palette_link, '#aa0000' AS palette_danger, 'Lora' AS font_body, 'Inter' AS font_heading, 'Courier' AS font_mono FROM c)"""
_MISSING = "concat_ws(',', CASE WHEN niche IS NULL THEN 'niche' END, CASE WHEN palette_bg IS NULL THEN 'background' END, CASE WHEN disclaimer_required AND disclaimer IS NULL THEN 'disclaimer' END)"
_VARS = {"bg": "color-bg", "bgAlt": "color-bg-alt", "text": "color-text", "textMuted": "color-text-muted", "heading": "color-heading", "primary": "color-primary", "secondary": "color-secondary", "accent": "color-accent", "border": "color-border", "rule": "color-rule", "link": "color-link", "danger": "color-danger"}
_E = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
#: The checklist's items, by the rule applied row by row: a fold over the bullets in order.
_ITEMS = f"""bb AS (SELECT doc_id AS p, coalesce(l[1], '') AS a, coalesce(l[2], '') AS t FROM ls),
bu AS (SELECT p, list_filter(list_transform(string_split(CASE WHEN p % 3 = 0 THEN '• Example zero • ' ELSE '• check ' END || a || ' • Example a • example b • Examples c • Example d' || ' • last <one> • Example e', '•'), lambda x: {trim('x')}), lambda x: x <> '') AS bs FROM bb WHERE p % 2 = 0),
st AS (
  SELECT p, 1 AS i, bs, bs[1] AS text, false AS is_note, false AS has_note FROM bu
  UNION ALL SELECT p, i + 1, bs, bs[i + 1], regexp_matches(bs[i + 1], '(?i)^example\\b') AND NOT has_note, regexp_matches(bs[i + 1], '(?i)^example\\b') AND NOT has_note FROM st WHERE i < len(bs)),
nt AS (SELECT *, lead(CASE WHEN is_note THEN text END) OVER (PARTITION BY p ORDER BY i) AS note FROM st),
ci AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY i) AS nth, text, note FROM nt WHERE NOT is_note),
wi AS (SELECT p, unnest([1, 2, 3]) AS nth, unnest(['Name • hint', {trim("'Goal ' || a || ' • guide & • more'")}, 'Third']) AS text, unnest([NULL, NULL, NULL]::VARCHAR[]) AS note FROM bb WHERE p % 2 = 1),
ai AS (SELECT * FROM ci UNION ALL SELECT * FROM wi),
bp AS (
  SELECT p AS file_id, 'title' AS role, 1 AS nth, {trim("t || ' title'")} AS text, NULL::VARCHAR AS note FROM bb UNION ALL SELECT p, 'intro', 1, {trim("'Intro ' || a")}, NULL FROM bb UNION ALL SELECT p, 'item', nth, text, note FROM ai
  UNION ALL SELECT p, 'outro', unnest([1, 2]), unnest([CASE WHEN p % 2 = 0 THEN 'Between' ELSE 'rule • go • no' END, 'Outro']), NULL FROM bb)"""
_CUTS = f"list_filter(list_transform(string_split(text, '•'), lambda x: {trim('x')}), lambda x: x <> '')"
ORACLES = {
    "brand_fields": f"WITH {_L}, {_FIELDS} SELECT p AS project, key, value FROM f",
    "resolved_config": f"WITH {_L}, {_FIELDS}, {_CONFIG} SELECT * EXCLUDE backCoverBullets, array_to_string(backCoverBullets, '¦') AS backCoverBullets, {_MISSING} AS missing FROM r",
    "style_variables": f"WITH {_L}, {_FIELDS}, {_CONFIG} " + " UNION ALL ".join(f"SELECT project, '{v}' AS variable, palette_{k} AS value FROM r" for k, v in _VARS.items())
    + """ UNION ALL SELECT project, 'font-body', '"' || font_body || '", Georgia, "Times New Roman", serif' FROM r UNION ALL SELECT project, 'font-heading', '"' || font_heading || '", "Helvetica Neue", Arial, sans-serif' FROM r UNION ALL SELECT project, 'font-mono', '"' || font_mono || '", "Courier New", monospace' FROM r""",
    "config_word_groups": f"""WITH {_L}, {_FIELDS}, {_CONFIG} SELECT project, 'disclaimer' AS name, 0 AS priority, disclaimer AS text FROM r WHERE disclaimer IS NOT NULL
UNION ALL SELECT project, 'CTA', 1, concat_ws(' ', ctaTitle, ctaContent, CASE WHEN ctaLink IS NOT NULL THEN ctaLinkLabel END) FROM r WHERE ctaTitle IS NOT NULL AND ctaContent IS NOT NULL
UNION ALL SELECT project, 'back cover', 2, backCoverPunchline || ' ' || array_to_string(backCoverBullets, ' ') FROM r WHERE backCoverPunchline IS NOT NULL""",
    "bonus_parts": f"WITH RECURSIVE {_L}, {_ITEMS} SELECT * FROM bp",
    "bonus_field_labels": f"WITH RECURSIVE {_L}, {_ITEMS} SELECT p AS file_id, nth, coalesce({_CUTS}[1], text) AS label, array_to_string({_CUTS}[2:], ' · ') AS guidance FROM wi",
    "bonus_sheet_items": f"""WITH RECURSIVE {_L}, {_ITEMS}, l AS (SELECT *, {_E(f"coalesce({_CUTS}[1], text)")} AS label, array_to_string({_CUTS}[2:], ' · ') AS guide FROM ai)
SELECT p AS file_id, nth, CASE WHEN p % 2 = 0 THEN '<li class="checklist-item"><span class="checklist-box"></span>' || {_E('text')} || CASE WHEN note IS NULL THEN '' ELSE chr(10) || '<p class="checklist-example">' || {_E('note')} || '</p>' END || '</li>'
  ELSE '<li class="worksheet-field">' || chr(10) || '<p class="worksheet-label">' || label || '</p>' || CASE WHEN guide = '' THEN '' ELSE chr(10) || '<p class="worksheet-guide">' || {_E('guide')} || '</p>' END || chr(10) || '<span class="worksheet-rule" data-field="f' || nth || '" data-field-label="' || label || '"></span>' || chr(10) || '</li>' END AS html FROM l""",
    "field_boxes": "SELECT l_orderkey AS project, l_quantity * 0.75::DOUBLE AS x, 800 * 0.75::DOUBLE - l_quantity * 3 * 0.75::DOUBLE - 9.0::DOUBLE AS y, l_linenumber * 0.75::DOUBLE AS width, 9.0::DOUBLE AS height FROM lineitem",
    "book_parts": f"""WITH {_L}, b AS (SELECT source AS project, min(doc_id) AS k FROM ls GROUP BY 1), m AS (SELECT *, '<div class="doc-title-marker">Book &amp; ' || project || '</div>' AS mark FROM b),
h AS (SELECT source AS project, doc_id AS p, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth, {_E("array_to_string(l, chr(10))")} AS body, {_E("CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id || '. ' ELSE '' END || l[1]")} AS label FROM ls)
SELECT project, 0 AS ordinal, 0 AS nth, 'cover' AS section, CASE WHEN k % 3 = 0 THEN '<section class="cover-page">' || mark || '<img src="cover/final/' || project || '.png" alt="Book &amp; ' || project || '"></section>' END AS html, CASE WHEN k % 3 > 0 THEN 'no print cover' END AS reason FROM m
UNION ALL SELECT project, 1, 0, 'title-page', '<section class="title-page">' || CASE WHEN k % 3 > 0 THEN mark ELSE '' END || '<h1>Book &amp; ' || project || '</h1>' || CASE WHEN k % 2 = 0 THEN '<p>Sub</p>' ELSE '' END || '<p>Me</p></section>', NULL FROM m
UNION ALL SELECT project, 2, 0, CASE WHEN k % 2 = 1 THEN 'copyright+disclaimer' ELSE 'copyright' END, '<section><p>Me</p>' || CASE WHEN k % 2 = 1 THEN '<p>One.</p>' || chr(10) || '<p>Two &lt;b&gt;.</p>' ELSE '' END || '</section>', NULL FROM m
UNION ALL SELECT project, 3, 0, 'bonus-teaser', CASE WHEN k % 3 > 0 THEN '<section>' || (k % 3) || ' companion deliverable' || CASE WHEN k % 3 = 1 THEN '' ELSE 's' END || '</section>' END, CASE WHEN k % 3 = 0 THEN 'no bonuses' END FROM m
UNION ALL SELECT project, 6, 0, 'cta', CASE WHEN k % 4 > 0 THEN '<section><h2>Go</h2>now' || CASE WHEN k % 4 = 2 THEN '<a href="http://x"></a>' ELSE '' END || '</section>' END, CASE WHEN k % 4 = 0 THEN 'no title or body' END FROM m
UNION ALL SELECT project, 7, 0, 'back-cover', CASE WHEN k % 5 > 0 AND k % 2 > 0 THEN '<section>Punch<ul><li>One &amp; all</li>' || chr(10) || '<li>two</li></ul></section>' END, CASE WHEN NOT (k % 5 > 0 AND k % 2 > 0) THEN 'no punchline or bullets' END FROM m
UNION ALL SELECT project, 4, nth, 'toc', '<li class="toc-entry"><a href="#c' || p || '">' || label || '</a></li>', NULL FROM h
UNION ALL SELECT project, 5, nth, 'chapter', '<section class="chapter-open' || CASE WHEN nth = 0 THEN ' body-start' ELSE '' END || '" id="c' || p || '"><p>' || body || '</p></section>', NULL FROM h""",
    "print_covers": """WITH f AS (SELECT user_id AS project, event_type || (event_id % 7) || CASE WHEN event_id % 3 = 0 THEN '.kindle' WHEN event_id % 11 = 0 AND user_id % 2 = 0 THEN '.Print' WHEN event_id % 5 = 0 THEN '-back' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN '.png' ELSE '.txt' END AS name FROM events),
r AS (SELECT *, CASE WHEN name ILIKE '%.print.%' THEN 0 WHEN name NOT ILIKE '%.kindle.%' AND name NOT ILIKE '%back%' THEN 1 END AS rank FROM f WHERE name LIKE '%.png')
SELECT project, 'cover/final/' || arg_min(name, {'r': rank, 'n': name}) AS cover FROM r WHERE rank IS NOT NULL GROUP BY project""",
    "stage_results": """WITH r AS (SELECT user_id AS project, 'stage' || (event_id % 4) AS stage, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'not_implemented' ELSE 'success' END AS status FROM events)
SELECT project, stage, arg_max(status, event_id) AS status, max(event_id) AS finished_at, CASE arg_max(status, event_id) WHEN 'success' THEN 0 WHEN 'not_implemented' THEN 2 ELSE 1 END AS exit_code FROM r GROUP BY ALL""",
    "media_urls": "SELECT event_id, CASE WHEN event_id % 6 = 3 THEN NULL ELSE 'http://m/' || event_id END AS url FROM events",
    "outline_titles": """WITH RECURSIVE n AS (SELECT source AS project, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id, string_split(coalesce(text, ''), chr(10))[1] AS title FROM documents),
t AS (SELECT project, id, title, [id] AS path, 0 AS depth FROM n WHERE id < 5 UNION ALL SELECT n.project, n.id, n.title, list_append(path, n.id), depth + 1 FROM t JOIN n ON n.project = t.project AND n.id // 5 = t.id)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY path) AS nth, depth, title FROM t""",
}
