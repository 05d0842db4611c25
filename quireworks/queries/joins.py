from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins
from ..plans import lift
from .sql import S, collapse


def _titles(spark, d):
    docs = lift.table(spark, d, "documents")
    return docs.select(F.col("source").alias("project"), F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"))


def not_in_outline(spark, d):
    """Each document's title against an outline: the second lines of its source's documents, with every other title put in longer."""
    docs = lift.table(spark, d, "documents")
    first, second = (F.coalesce(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(i)), F.lit("")) for i in (0, 1))
    outline = docs.select(F.col("source").alias("project"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("1. "), first)).otherwise(second).alias("title"))
    return joins.not_contained(_titles(spark, d), outline)


def leaked_lines(spark, d):
    """Benchmark lines that a document contains."""
    lines = lift.table(spark, d, "benchmark").select(F.col("item_id").alias("line_id"), F.col("text").alias("line"))
    texts = lift.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    return joins.contained_lines(lines, texts)


def _each_word(df, *keys):
    return df.select(*keys, F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word"), F.lit(1).cast("long").alias("n"))


def _words(df, *keys):
    return _each_word(df, *keys).groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def draws(spark, d):
    """Sources, in the order of their names, draw their documents' words from the pool of the benchmark's words."""
    pool = _words(lift.table(spark, d, "benchmark").select(F.lit("all").alias("project"), "text"), "project")
    docs = lift.table(spark, d, "documents").select(F.lit("all").alias("project"), F.col("source").alias("name"), F.col("source").alias("priority"), "text")
    groups = _words(docs, "project", "name", "priority").join(pool.select("word"), "word", "left_semi")
    return joins.drawn(pool, groups)


def coverages(spark, d):
    """Documents as groups of a language, in the order of ids, draw from the language's own pool of which each fifth word has one occurrence too few."""
    docs = lift.table(spark, d, "documents").select(F.col("lang").alias("project"), F.col("doc_id").cast("string").alias("name"), F.col("doc_id").alias("priority"), F.coalesce("text", F.lit("")).alias("text"))
    words = _each_word(docs, "project", "name", "priority")
    pool = words.groupBy("project", "word").agg((F.sum("n") - F.when(F.length("word") % 5 == 0, 1).otherwise(0)).alias("n"))
    return joins.coverage(joins.drawn(pool, words))


def broken_targets(spark, d):
    """Links of pages (the paths of their references) that no page's own path answers."""
    pages = lift.table(spark, d, "pages")
    host = F.regexp_extract("url", r"//([^/]+)", 1)
    links = pages.select(host.alias("project"), F.explode(T.references(F.coalesce("html", F.lit("")))).alias("target")).distinct()
    ids = pages.select(host.alias("project"), F.concat(F.lit("/"), F.regexp_extract(F.split("html", "</h1>")[0], r"<h1>(\S+)", 1)).alias("target"))
    ids = ids.unionByName(links.where(F.length("target") % 2 == 0))
    return joins.broken_targets(links, ids.distinct())


def by_position(spark, d):
    conv = lift.table(spark, d, "conversations")
    side = lambda who, name: conv.where(F.col("role") == who).select(F.col("conv_id").alias("project"), F.col("turn").alias(f"{name}_turn"), F.col("text").alias(name))
    return joins.by_position(side("user", "asked"), side("assistant", "said"), "asked_turn", "said_turn")


def exemptions(spark, d):
    events = lift.table(spark, d, "events")
    pages = events.select((F.col("event_id") / 10).cast("long").alias("project"), (F.col("event_id") % 10).alias("page"), (F.col("event_type") == "view").alias("exempt"))
    previews = pages.where("NOT (project % 3 = 0 AND page = 7)").select("project", "page", (F.col("page") / 10).alias("ink"))
    return joins.paired_or_unmarked(pages, previews)


def unlabelled(spark, d):
    return lift.table(spark, d, "documents").select("doc_id", "lang").join(lift.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def files_of_entries(spark, d):
    """Labels and documents by id: those that meet, and the labels that do not, in one table."""
    entries = lift.table(spark, d, "labels").select(F.col("doc_id").alias("path"), "quality")
    files = lift.table(spark, d, "documents").where("lang != 'es'").select(F.col("doc_id").alias("path"), T.word_count(F.coalesce("text", F.lit(""))).alias("words"))
    found, missing = joins.with_content(entries, files)
    return found.unionByName(missing.withColumn("words", F.lit(None).cast("long")))


QUERIES = {
    "join_not_in_outline": not_in_outline,
    "join_leaked_lines": leaked_lines,
    "bag_draws": draws,
    "bag_coverage": coverages,
    "join_broken_targets": broken_targets,
    "join_by_position": by_position,
    "join_exemptions": exemptions,
    "join_unlabelled": unlabelled,
    "join_required_files": files_of_entries,
}
_W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}][\p{L}\p{N}''-]*')"
_SQ = lambda x: f"lower({collapse(x, '')})"
_REFS = """list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?:src|href)="([^"]+)"', 1), lambda r: trim(r)), lambda r: r <> '' AND NOT regexp_matches(r, '^(data:|#|https?://)'))"""
ORACLES = {
    "join_not_in_outline": f"""WITH t AS (SELECT source AS project, doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT project, id, l[1] AS title FROM t), o AS (SELECT project, CASE WHEN id % 2 = 0 THEN '1. ' || l[1] ELSE coalesce(l[2], '') END AS title FROM t)
SELECT project, id, title FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.project = w.project AND contains({_SQ('o.title')}, {_SQ('w.title')}))""",
    "join_leaked_lines": f"""WITH n AS (SELECT item_id AS line_id, lower({collapse('text')}) AS needle FROM benchmark), h AS (SELECT doc_id AS text_id, lower({collapse("coalesce(text, '')")}) AS hay FROM documents)
SELECT line_id, text_id FROM n JOIN h ON contains(hay, needle)""",
    "bag_draws": f"""WITH p AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({_W}) AS w FROM benchmark) GROUP BY 1),
g AS (SELECT source, w AS word, count(*) AS n FROM (SELECT source, unnest({_W}) AS w FROM documents) GROUP BY 1, 2),
c AS (SELECT g.*, p.n AS there, sum(g.n) OVER (PARTITION BY word ORDER BY source) AS so_far FROM g JOIN p USING (word))
SELECT 'all' AS project, source AS name, source AS priority, sum(least(there, so_far) - least(there, so_far - n))::BIGINT AS matched, sum(n)::BIGINT AS total FROM c GROUP BY source""",
    "bag_coverage": f"""WITH g AS (SELECT lang, doc_id, w AS word, count(*) AS n FROM (SELECT lang, doc_id, unnest({_W}) AS w FROM documents) GROUP BY ALL),
p AS (SELECT lang, word, sum(n) - CASE WHEN length(word) % 5 = 0 THEN 1 ELSE 0 END AS there FROM g GROUP BY lang, word),
c AS (SELECT g.*, there, sum(n) OVER (PARTITION BY lang, word ORDER BY doc_id) AS so_far FROM g JOIN p USING (lang, word)),
d AS (SELECT lang, doc_id, sum(least(there, so_far) - least(there, so_far - n)) AS matched, sum(n) AS total FROM c GROUP BY ALL)
SELECT lang AS project, sum(matched)::BIGINT AS matched, sum(total)::BIGINT AS total, sum(matched) / sum(total) AS coverage, bool_and(matched / total >= 0.95) AND sum(matched) / sum(total) >= 0.95 AS passes FROM d GROUP BY lang""",
    "join_broken_targets": rf"""WITH l AS (SELECT DISTINCT regexp_extract(url, '//([^/]+)', 1) AS project, unnest({_REFS}) AS target FROM pages),
i AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS project, '/' || regexp_extract(string_split(html, '</h1>')[1], '<h1>(\S+)', 1) AS target FROM pages UNION SELECT * FROM l WHERE length(target) % 2 = 0)
SELECT * FROM l ANTI JOIN i USING (project, target)""",
    "join_by_position": """WITH a AS (SELECT conv_id AS project, turn AS asked_turn, text AS asked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id AS project, turn AS said_turn, text AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE role = 'assistant')
SELECT * FROM a JOIN s USING (project, position)""",
    "join_exemptions": """WITH p AS (SELECT event_id // 10 AS project, event_id % 10 AS page, event_type = 'view' AS exempt FROM events), v AS (SELECT project, page, page / 10 AS ink FROM p WHERE NOT (project % 3 = 0 AND page = 7)),
n AS (SELECT project, (SELECT count(*) FROM p q WHERE q.project = x.project) AS a, count(*) AS b FROM v x GROUP BY project)
SELECT project, page, ink, coalesce(a = b AND exempt, false) AS exempt FROM v LEFT JOIN p USING (project, page) JOIN n USING (project)""",
    "join_unlabelled": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
    "join_required_files": f"""SELECT l.doc_id AS path, quality, CASE WHEN d.doc_id IS NOT NULL THEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '{S}+'), lambda w: w <> ''))::BIGINT END AS words
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'es') d USING (doc_id)""",
}
