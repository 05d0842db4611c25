"""The schema compiler: every keyword with values on both sides of it, paths, refusals, and the four forms."""

from __future__ import annotations

import json

import pytest

from quireworks.operators import rules
from quireworks.operators.schemas import violations
from quireworks.sources import sinks


def found(spark, schema, *texts):
    """The errors of each text."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    out = [[] for _ in texts]
    for r in violations(rows, "json", schema).collect():
        out[r.i].append((r.path, r.keyword, r.detail))
    return [sorted(x) for x in out]


def test_types(spark):
    values = {"null": "null", "boolean": "true", "integer": "3", "number": "3.5", "string": '"x"', "array": "[]", "object": "{}"}
    for name in values:
        got = found(spark, {"type": name}, *values.values(), "2.0", "-1e3", "12345678901234567890")
        right = {name} | ({"integer"} if name == "number" else set())
        assert [not e for e in got[:7]] == [v in right for v in values], name
        assert [not e for e in got[7:]] == [name in ("integer", "number")] * 3, name
    assert found(spark, {"type": ["string", "null"]}, "null", '"x"', "1") == [[], [], [("", "type", "string, null")]]


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"enum": ["a", 1, None, True]}, ['"a"', "1", "1.0", "null", "true"], ['"b"', "2", "false", '"1"', "[]"]),
        ({"const": 1}, ["1", "1.0"], ["2", '"1"', "true", "null"]),
        ({"const": "é"}, ['"é"', '"\\u00e9"'], ['"e"']),
        ({"pattern": "^a+$"}, ['"aa"', "5", "null"], ['"ab"', '"a\\n"', '""']),
        ({"pattern": r"\$$"}, ['"x$"'], ['"x"']),
        ({"pattern": "b"}, ['"abc"'], ['"ac"']),
        ({"minLength": 2, "maxLength": 3}, ['"ab"', '"éé"', '"\\ud83d\\ude00x"', "1"], ['"a"', '"abcd"']),
        ({"minimum": 0, "maximum": 1}, ["0", "1", "0.5", '"7"', "1e-3"], ["-0.1", "2"]),
        ({"exclusiveMinimum": 0, "exclusiveMaximum": 1}, ["0.5", "[]"], ["0", "1"]),
        ({"minItems": 1, "maxItems": 2}, ["[1]", "[1, null]", "{}"], ["[]", "[1, 2, 3]"]),
        ({"items": {"type": "integer"}}, ["[]", "[1, 2]", '{"a": "b"}'], ["[null]", '[1, "a"]']),
        ({"required": ["a"]}, ['{"a": null}', "[]", "1"], ["{}", '{"A": 1}']),
        ({"properties": {"a": {"type": "string"}}}, ["{}", '{"a": "x", "b": 1}', "[1]"], ['{"a": null}']),
        ({"properties": {"a": {}}, "additionalProperties": False}, ["{}", '{"a": 1}', "3"], ['{"b": null}']),
        ({"properties": {"a": {}}, "additionalProperties": {"type": "integer"}}, ['{"a": "x"}', '{"z": 1}'], ['{"z": "x"}', '{"z": null}']),
        ({}, ["1", "null", "{}"], []),
    ],
)
def test_keywords(spark, schema, good, bad):
    got = found(spark, schema, *good, *bad)
    assert [bool(e) for e in got] == [False] * len(good) + [True] * len(bad)


def test_texts(spark):
    broken = [("", "json", "a JSON text")]
    assert found(spark, {}, None, "", " ", "{", "1 2", "1] [2", '1}{"":2', "{}}", "[1],", "nul", '{"a":1,"a":2}', " 1 ", "[] \n") == [broken] * 11 + [[], []]


def test_paths(spark):
    schema = {
        "type": "object", "properties": {"a/b": {"properties": {"~": {"type": "string"}}}, "list": {"type": "array", "items": {"$ref": "#/definitions/item"}}, "counts": {"additionalProperties": {"minimum": 0}}},
        "definitions": {"item": {"required": ["id", "of"], "additionalProperties": False, "properties": {"id": {"type": "string"}, "of": {"type": "array", "items": {"$ref": "#/definitions/leaf"}}}}, "leaf": {"maximum": 5}},
    }
    text = '{"a/b": {"~": 1}, "list": [{"id": "x", "of": [1, 9, 2, 8]}, {"of": "no", "more": 1}, 7], "counts": {"x/y": -1, "z": 1}, "own": 1}'
    assert found(spark, schema, text) == [
        [("/a~1b/~0", "type", "string"), ("/counts/x~1y", "minimum", "0"), ("/list/0/of/1", "maximum", "5"), ("/list/0/of/3", "maximum", "5"), ("/list/1", "additionalProperties", "more"), ("/list/1", "required", "id"), ("/list/1/of", "type", "array")]
    ]


def test_refusals(spark):
    for schema in ({"oneOf": []}, {"properties": {"a": {"format": "date"}}}, {"$ref": "#/definitions/x", "definitions": {"x": {"items": {"$ref": "#/definitions/x"}}}}, {"const": [1]}, {"required": ["it's"]}):
        with pytest.raises(ValueError, match="support|itself"):
            found(spark, schema, "1")


@pytest.mark.parametrize("schema", [rules.INVENTORY, rules.PAGE_PLAN, rules.CONFIG, rules.REPORT])
def test_work_for_a_document(spark, schema):
    """A document is parsed twice, however many places its form has, and the type of a value is looked up once."""
    places = lambda s: 1 + sum(map(places, s.get("properties", {}).values())) + (places(s["items"]) if "items" in s else 0) + (places(more) if isinstance(more := s.get("additionalProperties"), dict) else 0)
    rows = spark.createDataFrame([("{}",), ("[]",)], "json string").repartition(2)
    plan = violations(rows, "json", schema)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2 and plan.count("schemaOfVariant") <= places(schema)


def test_forms(spark, tmp_path):
    chapter = {"id": "01-a", "type": "chapter", "number": None, "title": "A", "file": "chapters/01-a.md", "startPage": 1, "endPage": 2, "wordCount": 0}
    bonus = {k: v for k, v in chapter.items() if k not in ("type", "number")}
    inventory = {"schemaVersion": 1, "sourceFile": "s", "sourceSha256": "0" * 64, "extractedAt": "2024-05-06T07:08:09.5Z", "pageCount": 1, "fallbackUsed": False, "chapters": [chapter] * 3, "bonuses": [bonus], "warnings": []}
    block = {"index": 0, "component": "checklist", "sourceKind": "list", "rule": "r", "preview": "p"}
    of_chapter = {"chapterId": "c", "blocks": [block], "componentCounts": {"checklist": 1}, "editorialBodyRatio": 0, "estimatedPages": 0.4, "minNonBodyComponents": 0, "actualNonBodyComponents": 1, "warnings": ["w"]}
    plan = {"schemaVersion": 1, "project": "p", "generatedAt": "2024-05-06T07:08:09Z", "chapters": [of_chapter]}
    report = {
        "schemaVersion": 1, "project": "p", "generatedAt": "2024-05-06T07:08:09Z", "outputPdfPath": "b.pdf", "pageCount": 3, "checks": [{"id": "structure", "status": "pass", "pass": True, "evidence": "seen", "details": [1, {}]}], "overallPass": True,
        "aesthetic": {"total": 97, "max": 100, "breakdown": {"content": 25, "typography": 20, "layout": 20, "consistency": 15, "technical": 10, "nicheFit": 7}, "notes": []},
    }
    filled = dict.fromkeys(("bg", "bgAlt", "text", "textMuted", "heading", "primary", "secondary", "accent", "border", "rule", "link", "danger"), "#aBc123")
    config = {
        "schemaVersion": 1, "project": {"slug": "a-1", "title": "t", "subtitle": None, "author": "a", "niche": "n", "targetReader": "r", "tone": "t"}, "language": "en-US", "format": dict.fromkeys(("pageWidth", "pageHeight", "marginOuter", "marginInner", "marginTop", "marginBottom"), "1in"),
        "disclaimer": {"required": True, "text": None}, "theme": {"name": "n"}, "fonts": {"body": "b", "heading": "h", "mono": "m"}, "palette": filled, "backMatter": {"ctaTitle": None, "ctaContent": "c", "ctaLink": None, "ctaLinkLabel": None, "backCoverPunchline": None, "backCoverBullets": ["x"]},
    }
    for schema, document, changes in [
        (rules.INVENTORY, inventory, [(("schemaVersion",), 2, "const"), (("chapters", 2, "type"), "preface", "enum"), (("chapters", 0, "startPage"), 0, "minimum"), (("bonuses", 0, "type"), "chapter", "additionalProperties"), (("sourceSha256",), "A" * 64, "pattern"), (("fallbackUsed",), "no", "type"), (("warnings",), [None], "type")]),
        (rules.PAGE_PLAN, plan, [(("chapters", 0, "blocks", 0, "component"), "x", "enum"), (("chapters", 0, "componentCounts", "y"), -1, "minimum"), (("chapters", 0, "editorialBodyRatio"), 1.1, "maximum"), (("generatedAt",), "2024-05-06 07:08:09Z", "pattern")]),
        (rules.REPORT, report, [(("checks", 0, "evidence"), "", "minLength"), (("checks", 0, "status"), "ok", "enum"), (("aesthetic", "breakdown", "nicheFit"), 11, "maximum"), (("aesthetic", "max"), 99, "const"), (("pageCount",), 1.5, "type")]),
        (rules.CONFIG, config, [(("project", "slug"), "A", "pattern"), (("palette", "bg"), "#ggg000", "pattern"), (("language",), "de", "const"), (("project", "tone"), "", "minLength"), (("backMatter", "backCoverBullets"), None, "type"), (("fonts", "mono"), 1, "type")]),
    ]:
        texts = [json.dumps(document)]
        for path, value, _ in changes:
            changed = json.loads(texts[0])
            at = changed
            for step in path[:-1]:
                at = at[step]
            at[path[-1]] = value
            texts.append(json.dumps(changed))
        for name in document:
            texts.append(json.dumps({k: v for k, v in document.items() if k != name}))
        got = found(spark, schema, *texts)
        assert got[0] == []
        for (path, value, keyword), errors in zip(changes, got[1:], strict=False):
            at = "".join(f"/{s}" for s in path)
            assert keyword in {e[1] for e in errors} and any(at.startswith(e[0]) or e[0].startswith(at) for e in errors), (path, value, errors)
        assert [e for e in got[1 + len(changes) :]] == [[("", "required", name)] for name in document]
    rows = spark.createDataFrame([("p", json.dumps(plan))], "project string, json string")
    sinks.write_documents(rows, rules.PAGE_PLAN, str(tmp_path / "plan"))
    assert json.loads(spark.read.text(str(tmp_path / "plan")).first()[0]) == plan
    with pytest.raises(ValueError, match="/: required generatedAt"):
        sinks.write_documents(spark.createDataFrame([("p", json.dumps(plan).replace("generatedAt", "x"))], "project string, json string"), rules.PAGE_PLAN, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
