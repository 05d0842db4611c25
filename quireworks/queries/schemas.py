"""Written documents against their forms: whole JSON documents, and parts of those that may be too large for a row. Some are broken by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import gates, layout, markdown, rules
from ..operators.schemas import violations
from ..plans import lift
from . import books as book_queries
from . import layout as layout_queries
from . import markdown as markdown_queries
from . import qc as qc_queries
from .sql import BLOCKS

TIME = "2024-05-06T07:08:09"


def _column(x):
    return x if hasattr(x, "alias") else F.lit(x)


def _struct(**fields):
    return F.struct(*(_column(c).alias(k) for k, c in fields.items()))


def _json(**fields):
    return F.to_json(_struct(**fields), {"ignoreNullFields": "false"})


def _head(p, text):
    h = F.sha2(text, 256)
    return {
        "schemaVersion": F.when(p % 9 > 0, 1).otherwise(2), "sourceFile": F.when(p % 8 > 0, F.col("source")), "sourceSha256": F.when(p % 5 == 0, F.upper(h)).otherwise(h), "extractedAt": F.concat(F.lit(TIME), F.when(p % 4 == 0, ".123").otherwise(""), F.when(p % 10 > 0, "Z").otherwise("+01:00")),
        "pageCount": p % 6, "fallbackUsed": F.when(p % 2 == 0, F.lit("true")).otherwise("no"),
    }


def whole_inventories(spark, d):
    """An inventory for each document, its lines the chapters; every rule is broken somewhere. Now and then a text is no JSON, a list, or has a field more."""
    p, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    chapter = lambda line, i: _struct(
        id=F.concat(F.lit("c"), i.cast("string")), type=F.when((i + p) % 11 == 3, "preface").otherwise("chapter"), number=F.when(i % 3 > 0, i + F.when((i + p) % 17 == 4, 0.5).otherwise(0.0)),
        title=F.when(F.length(line) % 19 > 0, line), file="f.md", startPage=(i + p) % 9, endPage=i + 1, wordCount=F.length(line) - 5,
    )
    bonus = F.filter(F.array(F.when(p % 5 == 2, _struct(id="b", title="t", file="f", startPage=1, endPage=p % 2, wordCount=0, extra=p % 3))), lambda b: b.isNotNull())
    json = _json(**_head(p, text), chapters=F.transform(F.split(text, "\n"), chapter), bonuses=bonus, warnings=F.array(F.when(p % 7 > 0, "w"), F.col("lang")))
    odd = F.when(p % 50 == 7, F.concat(F.lit("["), json, F.lit("]"))).when(p % 50 == 8, F.concat(json, F.lit("}"))).when(p % 50 == 9, F.concat(F.lit('{"a/b":1,'), F.substr(json, F.lit(2)))).otherwise(json)
    return violations(lift.table(spark, d, "documents").select(p.cast("string").alias("document"), odd.alias("json")), "json", rules.INVENTORY)


def inventory_heads(spark, d):
    """Inventories without entries."""
    p = F.col("doc_id")
    json = _json(**_head(p, F.coalesce("text", F.lit(""))), chapters=F.array().cast("array<string>"), bonuses=F.array().cast("array<string>"))
    return violations(lift.table(spark, d, "documents").select(p.cast("string").alias("document"), json.alias("json")), "json", rules.INVENTORY)


def inventory_entries(spark, d):
    """The entries of the inventories that lines with headings give, each judged in its place: a project may have any number."""
    p = F.col("project")
    entry = {"id": F.col("id"), "title": F.col("title"), "file": F.col("file"), "startPage": F.when(p % 13 == 5, 0).otherwise(F.col("start_page")), "endPage": F.col("end_page"), "wordCount": F.when(p % 17 == 2, -1).otherwise(0)}
    rows = layout.files(layout_queries.text_lines(spark, d))
    chapters, bonuses = rows.where("entry_kind = 'chapter'"), rows.where("entry_kind = 'bonus'")
    at = lambda name: F.concat(F.lit(f"/{name}/"), F.col("pos").cast("string"))
    found = [
        violations(part.select(p.cast("string").alias("document"), at(name).alias("at"), _json(**entry, **more).alias("json")), "json", schema, F.col("at"))
        for part, name, schema, more in ((chapters, "chapters", rules.CHAPTER, {"type": F.when(p % 7 == 3, "preface").otherwise(F.col("type")), "number": F.col("number")}), (bonuses, "bonuses", rules.BONUS, {}))
    ]
    return found[0].unionByName(found[1]).drop("at")


def page_plans(spark, d):
    """The page plan of each file."""
    files = lift.md_files(spark, d)
    i = F.col("index")
    block = _struct(index=i, component=F.when(i % 9 == 5, "unknown").otherwise(F.col("component")), sourceKind=F.col("source_kind"), rule=F.when(i % 11 > 0, F.col("rule")), preview=F.col("preview"))
    blocks = markdown.plan(files).groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    counts = F.when(F.col("component_counts") == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map("component_counts", F.lit(","), F.lit("=")))
    counts = F.transform_values(counts, lambda k, v: F.when(k != "pull-quote", v.cast("int")))
    chapter = _struct(
        chapterId=F.col("file_id").cast("string"), blocks=F.col("blocks"), componentCounts=counts, editorialBodyRatio=F.col("editorial_body_ratio") * 1.25, estimatedPages=F.col("estimated_pages"), minNonBodyComponents=F.col("min_non_body"), actualNonBodyComponents=F.col("actual_non_body") - 1,
        warnings=F.filter(F.split("warnings", ","), lambda w: w != ""),
    )
    rows = markdown.chapter_plans(files).join(blocks, "file_id")
    return violations(rows.select(F.col("file_id").cast("string").alias("document"), _json(schemaVersion=1, project="p", generatedAt=f"{TIME}Z", chapters=F.array(chapter)).alias("json")), "json", rules.PAGE_PLAN)


def reports(spark, d):
    """The quality report of each project, with notes and a page count that some lack."""
    checks = qc_queries.checks(spark, d)
    passed = F.col("status") == "pass"
    check = _struct(id=F.col("id"), status=F.when(F.col("pos") % 13 == 12, F.upper("status")).otherwise(F.col("status")), evidence=F.when(F.col("status") == "skipped", "").otherwise("seen"), details=F.col("coverage")).withField("pass", passed)
    every = checks.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", check.alias("c")))), lambda x: x["c"]).alias("checks"), F.bool_and(F.col("status") != "fail").alias("go"))
    p = F.col("project")
    parts = {"nicheFit": F.col("niche_fit")} | {k: F.col(k) for k in ("content", "typography", "layout", "consistency")} | {"technical": F.when(p % 3 > 0, F.col("technical"))}
    score = _struct(total=F.col("total") + 10, max=F.when(p % 4 > 0, 100).otherwise(99), breakdown=_struct(**parts), notes=F.array(F.lit("n")))
    rows = every.join(gates.scores(checks), "project")
    return violations(rows.select(p.cast("string").alias("document"), _json(schemaVersion=1, project=p.cast("string"), generatedAt=f"{TIME}Z", outputPdfPath="b.pdf", pageCount=p % 5, checks=F.col("checks"), overallPass=F.col("go"), aesthetic=score).alias("json")), "json", rules.REPORT)


def configurations(spark, d):
    """The resolved configuration of each project."""
    p = F.col("project")
    rows = book_queries.resolved(spark, d)
    slug = F.concat(F.lit("book"), F.when(p % 6 == 1, "_").otherwise("-"), p.cast("string"))
    json = _json(
        schemaVersion=1, project=_struct(slug=slug, title=F.col("title"), subtitle=F.col("subtitle"), author=F.col("author"), niche=F.coalesce("niche", F.lit("")), targetReader="r", tone="t"), language=F.when(p % 7 > 0, rules.LANGUAGE).otherwise("de"),
        format=_struct(pageWidth="6in", pageHeight="9in", marginOuter="1in", marginInner="1in", marginTop="1in", marginBottom="1in"), disclaimer=_struct(required=F.col("disclaimer_required"), text=F.col("disclaimer")), theme=_struct(name="n"),
        fonts=_struct(body=F.col("font_body"), heading=F.col("font_heading"), mono=F.col("font_mono")), palette=_struct(**{k: F.col(f"palette_{k}") for k in P.PALETTE_VARIABLES}),
        backMatter=_struct(**{k: F.col(k) for k in ("ctaTitle", "ctaContent", "ctaLink", "ctaLinkLabel", "backCoverPunchline", "backCoverBullets")}),
    )
    return violations(rows.select(p.cast("string").alias("document"), json.alias("json")), "json", rules.CONFIG)


QUERIES = {
    "schema_violations": whole_inventories,
    "inventory_head_violations": inventory_heads,
    "inventory_violations": inventory_entries,
    "plan_violations": page_plans,
    "score_violations": reports,
    "config_violations": configurations,
}


def _errors(schema: dict, rows: str, at: str = "''") -> tuple[str, str]:
    """DuckDB: tables of the values at each place of the documents in `rows` (document, json, and what `at` needs), and the errors found in these."""
    tables, found = [f"{rows}_0 AS (SELECT document, {at} AS path, json::JSON AS v FROM {rows} WHERE json_valid(json))"], [f"SELECT document, {at} AS path, 'json' AS keyword, 'a JSON text' AS detail FROM {rows} WHERE NOT coalesce(json_valid(json), false)"]
    kind = {"object": "= 'OBJECT'", "array": "= 'ARRAY'", "string": "= 'VARCHAR'", "boolean": "= 'BOOLEAN'", "null": "= 'NULL'", "number": "IN ('BIGINT', 'UBIGINT', 'DOUBLE')"}
    number, text = "CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN v::DOUBLE END", "CASE WHEN json_type(v) = 'VARCHAR' THEN v->>'$' END"
    is_a = lambda k: f"coalesce({number} % 1 = 0, false)" if k == "integer" else f"json_type(v) {kind[k]}"

    def below(select: str, where: str, of: str) -> str:
        tables.append(f"{rows}_{len(tables)} AS (SELECT document, {select} FROM {of} WHERE {where})")
        return f"{rows}_{len(tables) - 1}"

    def look(schema: dict, name: str) -> None:
        ask = lambda keyword, holds, detail: found.append(f"SELECT document, path, '{keyword}', '{detail}' FROM {name} WHERE NOT ({holds})")
        if names := schema.get("type"):
            names = [names] if isinstance(names, str) else names
            ask("type", " OR ".join(map(is_a, names)), ", ".join(names))
        if "enum" in schema:
            ask("enum", f"coalesce({text} IN ({', '.join(f"'{x}'" for x in schema['enum'])}), false)", ", ".join(schema["enum"]))
        if "const" in schema:
            ask("const", f"coalesce({text} = '{schema['const']}', false)" if isinstance(schema["const"], str) else f"coalesce({number} = {schema['const']}, false)", schema["const"])
        if "pattern" in schema:
            ask("pattern", f"regexp_matches({text}, '{schema['pattern']}')", schema["pattern"])
        if "minLength" in schema:
            ask("minLength", f"length({text}) >= {schema['minLength']}", schema["minLength"])
        for keyword, sign in (("minimum", ">="), ("maximum", "<=")):
            if keyword in schema:
                ask(keyword, f"{number} {sign} {schema[keyword]}", schema[keyword])
        for x in schema.get("required", []):
            ask("required", f"json_type(v) <> 'OBJECT' OR json_exists(v, '$.\"{x}\"')", x)
        for x, inner in schema.get("properties", {}).items():
            if inner:
                look(inner, below(f"path || '/{x}' AS path, v->'$.\"{x}\"' AS v", f"json_type(v) = 'OBJECT' AND json_exists(v, '$.\"{x}\"')", name))
        keys = f"(SELECT document, path, v, unnest(json_keys(v)) AS k FROM {name} WHERE json_type(v) = 'OBJECT')"
        if schema.get("additionalProperties") is False:
            found.append(f"SELECT document, path, 'additionalProperties', k FROM {keys} WHERE k NOT IN ({', '.join(f"'{x}'" for x in schema['properties'])})")
        elif more := schema.get("additionalProperties"):
            look(more, below("path || '/' || replace(replace(k, '~', '~0'), '/', '~1') AS path, v->('$.\"' || k || '\"') AS v", "true", keys))
        if items := schema.get("items"):
            lists = f"(SELECT document, path, l, unnest(range(len(l))) AS i FROM (SELECT document, path, v::JSON[] AS l FROM {name} WHERE json_type(v) = 'ARRAY'))"
            look(items, below("path || '/' || i AS path, coalesce(l[i + 1], 'null'::JSON) AS v", "true", lists))

    look(schema, f"{rows}_0")
    return ", ".join(tables), " UNION ALL ".join(found)


def _judged(before: str, schema: dict, json: str, frm: str, key: str) -> str:
    tables, found = _errors(schema, "js")
    return f"{before} js AS (SELECT ({key})::VARCHAR AS document, {json} AS json FROM {frm}), {tables} {found}"


_HEAD = f"""schemaVersion := CASE WHEN p % 9 > 0 THEN 1 ELSE 2 END, sourceFile := CASE WHEN p % 8 > 0 THEN source END, sourceSha256 := CASE WHEN p % 5 = 0 THEN upper(h) ELSE h END, extractedAt := '{TIME}' || CASE WHEN p % 4 = 0 THEN '.123' ELSE '' END || CASE WHEN p % 10 > 0 THEN 'Z' ELSE '+01:00' END,
  pageCount := p % 6, fallbackUsed := CASE WHEN p % 2 = 0 THEN 'true' ELSE 'no' END"""
_DOCS = "WITH dc AS (SELECT doc_id AS p, source, lang, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS h FROM documents),"
_ENTRY = "id := id, title := title, file := file, startPage := CASE WHEN project % 13 = 5 THEN 0 ELSE start_page END, endPage := end_page, wordCount := CASE WHEN project % 17 = 2 THEN -1 ELSE 0 END"
_L, _M, _B, _Q = layout_queries, markdown_queries, book_queries, qc_queries
_CHAPTERS, _BONUSES = _errors(rules.CHAPTER, "ch_js", "place"), _errors(rules.BONUS, "bo_js", "place")
ORACLES = {
    "schema_violations": _judged(
        f"""{_DOCS} ck AS (SELECT p, list(struct_pack(id := 'c' || i, type := CASE WHEN (i + p) % 11 = 3 THEN 'preface' ELSE 'chapter' END, number := CASE WHEN i % 3 > 0 THEN i + CASE WHEN (i + p) % 17 = 4 THEN 0.5::DOUBLE ELSE 0 END END, title := CASE WHEN length(line) % 19 > 0 THEN line END, file := 'f.md',
  startPage := (i + p) % 9, endPage := i + 1, wordCount := length(line) - 5) ORDER BY i) AS chapters FROM (SELECT p, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT p, string_split(text, chr(10)) AS l FROM dc)) GROUP BY p),
j0 AS (SELECT p, to_json(struct_pack({_HEAD}, chapters := chapters, bonuses := CASE WHEN p % 5 = 2 THEN [struct_pack(id := 'b', title := 't', file := 'f', startPage := 1, endPage := p % 2, wordCount := 0, extra := p % 3)] ELSE [] END, warnings := [CASE WHEN p % 7 > 0 THEN 'w' END, lang]))::VARCHAR AS j FROM dc JOIN ck USING (p)),""",
        rules.INVENTORY, "CASE p % 50 WHEN 7 THEN '[' || j || ']' WHEN 8 THEN j || '}' WHEN 9 THEN '{\"a/b\":1,' || j[2:] ELSE j END", "j0", "p",
    ),
    "inventory_head_violations": _judged(_DOCS, rules.INVENTORY, f"to_json(struct_pack({_HEAD}, chapters := [], bonuses := []))::VARCHAR", "dc", "p"),
    "inventory_violations": f"""WITH RECURSIVE {lift.LINES}, {_L.TEXT_LINES}, {_L.SECTIONS}, {_L.BLOCKS}, {_L.FILES},
ch_js AS (SELECT project::VARCHAR AS document, '/chapters/' || pos AS place, to_json(struct_pack({_ENTRY}, type := CASE WHEN project % 7 = 3 THEN 'preface' ELSE type END, number := number))::VARCHAR AS json FROM fi WHERE entry_kind = 'chapter'),
bo_js AS (SELECT project::VARCHAR AS document, '/bonuses/' || pos AS place, to_json(struct_pack({_ENTRY}))::VARCHAR AS json FROM fi WHERE entry_kind = 'bonus'), {_CHAPTERS[0]}, {_BONUSES[0]} {_CHAPTERS[1]} UNION ALL {_BONUSES[1]}""",
    "plan_violations": _judged(
        f"""WITH {lift.MD}, {BLOCKS}, {_M.PLAN}, cp AS ({_M.ORACLES['chapter_plans'].replace('WITH ' + lift.MD + ', ' + BLOCKS + ', ' + _M.PLAN + ',', 'WITH', 1)}),
pb AS (SELECT file_id, list(struct_pack(index := index, component := CASE WHEN index % 9 = 5 THEN 'unknown' ELSE component END, sourceKind := source_kind, rule := CASE WHEN index % 11 > 0 THEN rule END, preview := preview) ORDER BY index) AS blocks FROM p GROUP BY file_id),
pc AS (SELECT file_id, json_group_object(component, CASE WHEN component <> 'pull-quote' THEN n END) AS counts FROM (SELECT file_id, component, count(*) AS n FROM p GROUP BY ALL) GROUP BY file_id),""",
        rules.PAGE_PLAN,
        f"to_json(struct_pack(schemaVersion := 1, project := 'p', generatedAt := '{TIME}Z', chapters := [struct_pack(chapterId := file_id::VARCHAR, blocks := blocks, componentCounts := counts, editorialBodyRatio := editorial_body_ratio * 1.25::DOUBLE, estimatedPages := estimated_pages, minNonBodyComponents := min_non_body, actualNonBodyComponents := actual_non_body - 1, warnings := list_filter(string_split(warnings, ','), lambda w: w <> ''))]))::VARCHAR",
        "cp JOIN pb USING (file_id) JOIN pc USING (file_id)", "file_id",
    ),
    "score_violations": _judged(
        f"""WITH {_Q._CHECKS}, sc AS ({_Q.ORACLES['qc_scores']}),
ev AS (SELECT project, list(struct_pack(id := id, status := CASE WHEN pos % 13 = 12 THEN upper(status) ELSE status END, evidence := CASE WHEN status = 'skipped' THEN '' ELSE 'seen' END, details := coverage, "pass" := status = 'pass') ORDER BY pos) AS checks, bool_and(status <> 'fail') AS go FROM cc GROUP BY project),""",
        rules.REPORT,
        f"to_json(struct_pack(schemaVersion := 1, project := project::VARCHAR, generatedAt := '{TIME}Z', outputPdfPath := 'b.pdf', pageCount := project % 5, checks := checks, overallPass := go, aesthetic := struct_pack(total := total + 10, max := CASE WHEN project % 4 > 0 THEN 100 ELSE 99 END, breakdown := struct_pack(nicheFit := niche_fit, content := content, typography := typography, layout := layout, consistency := consistency, technical := CASE WHEN project % 3 > 0 THEN technical END), notes := ['n'])))::VARCHAR",
        "ev JOIN sc USING (project)", "project",
    ),
    "config_violations": _judged(
        f"WITH {_B._L}, {_B._FIELDS}, {_B._CONFIG},", rules.CONFIG,
        f"""to_json(struct_pack(schemaVersion := 1, project := struct_pack(slug := 'book' || CASE WHEN project % 6 = 1 THEN '_' ELSE '-' END || project, title := title, subtitle := subtitle, author := author, niche := coalesce(niche, ''), targetReader := 'r', tone := 't'), language := CASE WHEN project % 7 > 0 THEN '{rules.LANGUAGE}' ELSE 'de' END,
  format := struct_pack(pageWidth := '6in', pageHeight := '9in', marginOuter := '1in', marginInner := '1in', marginTop := '1in', marginBottom := '1in'), disclaimer := struct_pack(required := disclaimer_required, text := disclaimer), theme := struct_pack(name := 'n'), fonts := struct_pack(body := font_body, heading := font_heading, mono := font_mono),
  palette := struct_pack({', '.join(f'"{k}" := palette_{k}' for k in P.PALETTE_VARIABLES)}), backMatter := struct_pack({', '.join(f'{k} := {k}' for k in ('ctaTitle', 'ctaContent', 'ctaLink', 'ctaLinkLabel', 'backCoverPunchline', 'backCoverBullets'))})))::VARCHAR""",
        "r", "project",
    ),
}
