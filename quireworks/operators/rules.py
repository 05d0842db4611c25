"""The forms of the documents that a project writes, as JSON Schemas for operators.schemas: inventory, page plan, resolved configuration, quality report."""

from __future__ import annotations

from ..functions import patterns as P

TEXT, FILLED, MAYBE_TEXT = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": ["string", "null"]}
COUNT, FROM_ONE, YES_NO = {"type": "integer", "minimum": 0}, {"type": "integer", "minimum": 1}, {"type": "boolean"}
# The version, the patterns, the allowed words and the bounds of these documents.
VERSION = {"type": "integer", "const": 1}
TIME = {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"}
SHA256 = {"type": "string", "pattern": "^[a-f0-9]{64}$"}
COLOUR = {"type": "string", "pattern": "^#[0-9a-fA-F]{6}$"}
SLUG = {"type": "string", "pattern": "^[a-z0-9]+(-[a-z0-9]+)*$"}
TYPES = ("introduction", "chapter", "conclusion", "unclassified")
COMPONENTS = ("editorial-body", "process-steps", "checklist", "comparison-table", "calculation-card", "warning-callout", "tip-callout", "key-takeaways", "pull-quote")
SOURCE_KINDS = ("heading", "paragraph", "list", "table", "blockquote")
STATUSES = ("pass", "fail", "skipped")
SCORES = {"content": 25, "typography": 20, "layout": 20, "consistency": 15, "technical": 10, "nicheFit": 10}
LANGUAGE = "en-US"


def one_of(words) -> dict:
    return {"type": "string", "enum": list(words)}


def between(least: float, most: float | None = None) -> dict:
    return {"type": "number", "minimum": least} | ({} if most is None else {"maximum": most})


def each(of: dict) -> dict:
    return {"type": "array", "items": of}


def record(optional: dict | None = None, **fields: dict) -> dict:
    """An object of these fields, all of them there, and of optional ones, and no others."""
    return {"type": "object", "required": list(fields), "properties": fields | (optional or {}), "additionalProperties": False}


_ENTRY = {"id": TEXT, "title": TEXT, "file": TEXT, "startPage": FROM_ONE, "endPage": FROM_ONE, "wordCount": COUNT}
CHAPTER = record(**_ENTRY, type=one_of(TYPES), number={"type": ["integer", "null"]})
BONUS = record(**_ENTRY)
INVENTORY = record(schemaVersion=VERSION, sourceFile=TEXT, sourceSha256=SHA256, extractedAt=TIME, pageCount=FROM_ONE, fallbackUsed=YES_NO, chapters=each(CHAPTER), bonuses=each(BONUS), warnings=each(TEXT))

PLAN_BLOCK = record(index=COUNT, component=one_of(COMPONENTS), sourceKind=one_of(SOURCE_KINDS), rule=TEXT, preview=TEXT)
CHAPTER_PLAN = record(
    chapterId=TEXT, blocks=each(PLAN_BLOCK), componentCounts={"type": "object", "additionalProperties": COUNT}, editorialBodyRatio=between(0, 1), estimatedPages=between(0), minNonBodyComponents=COUNT, actualNonBodyComponents=COUNT, warnings=each(TEXT),
)
PAGE_PLAN = record(schemaVersion=VERSION, project=TEXT, generatedAt=TIME, chapters=each(CHAPTER_PLAN))

CONFIG = record(
    schemaVersion=VERSION,
    project=record({"subtitle": MAYBE_TEXT}, slug=SLUG, title=FILLED, author=FILLED, niche=FILLED, targetReader=FILLED, tone=FILLED),
    language={"type": "string", "const": LANGUAGE},
    format=record(pageWidth=TEXT, pageHeight=TEXT, marginOuter=TEXT, marginInner=TEXT, marginTop=TEXT, marginBottom=TEXT),
    disclaimer=record(required=YES_NO, text=MAYBE_TEXT),
    theme=record(name=TEXT),
    fonts=record(body=FILLED, heading=FILLED, mono=FILLED),
    palette=record(**dict.fromkeys(P.PALETTE_VARIABLES, COLOUR)),
    backMatter=record(ctaTitle=MAYBE_TEXT, ctaContent=MAYBE_TEXT, ctaLink=MAYBE_TEXT, ctaLinkLabel=MAYBE_TEXT, backCoverPunchline=MAYBE_TEXT, backCoverBullets=each(TEXT)),
)

CHECK = record({"details": {}}, id=TEXT, status=one_of(STATUSES), **{"pass": YES_NO}, evidence=FILLED)
SCORE = record(total=between(0, 100), max={"type": "integer", "const": 100}, breakdown=record(**{k: between(0, most) for k, most in SCORES.items()}), notes=each(TEXT))
REPORT = record(schemaVersion=VERSION, project=TEXT, generatedAt=TIME, outputPdfPath=TEXT, pageCount=FROM_ONE, checks=each(CHECK), overallPass=YES_NO, aesthetic=SCORE)
