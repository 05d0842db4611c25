"""Text functions on columns. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def lit(value) -> Column:
    return F.lit(value)


def has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


#: The characters of patterns.SPACE.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column, to: str = " ") -> Column:
    """Every run of white space becomes `to`."""
    return sub(c, rf"{P.SPACE}+", to)


def squeezed(c: Column) -> Column:
    """Without white space, lower-cased: for comparing titles."""
    return F.lower(collapse(c, ""))


def parts(c: Column, pattern: str) -> Column:
    """Split, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(c, pattern), trim), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return parts(c, rf"\n{P.SPACE}*\n")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"{P.SPACE}+"), lambda x: x != "")).cast("long")


def words(c: Column) -> Column:
    """Lower-cased words: a letter or digit, then letters, digits, apostrophes, hyphens."""
    return F.regexp_extract_all(F.lower(c), F.lit(P.WORD), F.lit(0))


def slug(c: Column) -> Column:
    return sub(sub(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def escaped(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def filled(template: Column, values: dict[str, Column]) -> Column:
    """{{KEY}} marks replaced, in the order given."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


def without_comments(c: Column) -> Column:
    return sub(c, r"(?s)<!--.*?-->", "")


def plain(markdown: Column) -> Column:
    """Markdown marks taken off each line."""

    def line(x: Column) -> Column:
        for pattern, to in ((rf"^#{{1,6}}{P.SPACE}+", ""), (rf"^{P.SPACE}*[0-9]+[.)]{P.SPACE}+", ""), (rf"^{P.SPACE}*[-*]{P.SPACE}+", ""), (rf"^{P.SPACE}*>{P.SPACE}?", ""), (r"^\|", ""), (r"\|\z", ""), (r"\|", " ")):
            x = sub(x, pattern, to)
        return x

    return F.array_join(F.transform(F.split(markdown, "\n"), line), "\n")


def preview(c: Column, most: int = 80) -> Column:
    flat = trim(collapse(c))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def snippet(c: Column, pattern: str) -> Column:
    """The context of the first match: 30 characters before it, 60 from it on; null without a match."""
    at = F.regexp_instr(c, F.lit(pattern))
    start = F.greatest(at - 30, F.lit(1))
    return F.when(at > 0, collapse(F.substring(c, start, at + 60 - start)))


def padded(number: Column) -> Column:
    """Two digits at least; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def chapter_label(path: Column) -> Column:
    """A file's stem; a number gets two digits."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?\z", 1)
    return F.when(has(stem, r"^[0-9]+\z"), padded(stem)).otherwise(stem)


def toc_label(number: Column, title: Column) -> Column:
    return F.when(number.isNull(), title).otherwise(F.concat(padded(number), F.lit(". "), title))


def roman(c: Column) -> Column:
    """Value of a roman number, by subtraction of a smaller digit before a larger one."""
    digit = lambda x: F.when(x == "i", 1).when(x == "v", 5).when(x == "x", 10).when(x == "l", 50).when(x == "c", 100).when(x == "d", 500).when(x == "m", 1000).otherwise(0)
    values = F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), digit)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("right"))
    back = lambda s, v: F.struct((s["total"] + F.when(v < s["right"], -v).otherwise(v)).alias("total"), v.alias("right"))
    return F.aggregate(F.reverse(values), zero, back, lambda s: s["total"])


def luminance(colour: Column) -> Column:
    """Relative luminance of #rrggbb."""

    def channel(at: int) -> Column:
        v = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def hex_colour(c: Column) -> Column:
    return F.when(F.startswith(trim(c), F.lit("#")), trim(c)).otherwise(F.concat(F.lit("#"), trim(c)))


def font_stack(family: Column, role: str) -> Column:
    # The fallback families of each role.
    rest = {"body": 'Georgia, "Times New Roman", serif', "heading": '"Helvetica Neue", Arial, sans-serif', "mono": '"Courier New", monospace'}[role]
    return F.concat(F.lit('"'), family, F.lit(f'", {rest}'))


def inches(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([0-9.]+)in\z", 1), F.lit("")).cast("double")


def style_points(css: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(css, rf"--{name}:{P.SPACE}*([0-9.]+)pt{P.SPACE}*;", 1), F.lit("")).cast("double")


def with_variable(css: Column, name: str, value: Column) -> Column:
    """css with the first declaration of --name set; null where there is none."""
    at = F.regexp_instr(css, F.lit(rf"--{name}:{P.SPACE}*[^;]+;"))
    old = F.regexp_substr(css, F.lit(rf"--{name}:{P.SPACE}*[^;]+;"))
    head = F.regexp_extract(css, rf"(--{name}:{P.SPACE}*)[^;]+;", 1)
    after = F.substring(css, at + F.length(old), F.length(css))
    return F.when(at > 0, F.concat(F.substring(css, F.lit(1), at - 1), head, value, F.lit(";"), after))


def with_known_variable(css: Column, name: str, value: Column) -> Column:
    """with_variable(), where css without a declaration of --name stops the run; null css stays null."""
    return F.when(css.isNotNull(), F.coalesce(with_variable(css, name, value), F.raise_error(F.lit(f"no variable --{name} in the style sheet")).cast("string")))


def toc_targets(html: Column) -> Column:
    """Ids that contents entries point to, by link and by page number."""
    href, number = (F.regexp_extract_all(html, F.lit(P.TOC_ENTRY), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.concat(href, number))


def required(c: Column, message: str) -> Column:
    """The value; a null ends the query with the message."""
    return F.coalesce(c, F.raise_error(F.lit(message)).cast("string"))


def relative_path(root: Column, path: Column) -> Column:
    """A POSIX path as seen from a folder; both are absolute or both are not."""
    names = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    a, b = names(root), names(path)
    most = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(0), most), F.lit(0), lambda n, i: F.when((n == i) & (i < most) & F.get(a, i).eqNullSafe(F.get(b, i)), n + 1).otherwise(n))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b))), "/")


def font_urls(css: Column) -> Column:
    """The local fonts that a style sheet refers to in quotes: array of struct(whole, quote, path), in order."""
    parts_ = [F.regexp_extract_all(css, F.lit(P.FONT_URL), F.lit(i)) for i in range(3)]
    found = F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts_, ("whole", "quote", "path"), strict=True))), lambda x: x)
    return F.filter(found, lambda x: ~has(x["path"], r"^(https?:)?//") & ~F.startswith(x["path"], F.lit("data:")))


def with_fonts(css: Column, data: Column) -> Column:
    """css with each local font put in; data: map of path to base64 content. Null where a font is missing."""

    def put(text: Column, x: Column) -> Column:
        kind = F.lower(F.regexp_extract(x["path"], r"\.([A-Za-z0-9]+)\z", 1))
        quote = F.when(x["quote"] == "", '"').otherwise(x["quote"])
        return F.replace(text, x["whole"], F.concat(F.lit("url("), quote, F.lit("data:font/"), kind, F.lit(";base64,"), F.try_element_at(data, x["path"]), quote, F.lit(")")))

    return F.aggregate(font_urls(css), css, put)


def marked(section: Column, marker: Column) -> Column:
    """The marker right after the first opening section, div, main or article tag; before all where there is none."""
    pattern = r"<(?:section|div|main|article)(?![A-Za-z0-9_])[^>]*>"
    at, tag = F.regexp_instr(section, F.lit(pattern)), F.regexp_substr(section, F.lit(pattern))
    end = at + F.length(tag)
    inside = F.concat(F.substring(section, F.lit(1), end - 1), marker, F.substring(section, end, F.length(section)))
    return F.when(at > 0, inside).otherwise(F.concat(marker, F.lit("\n"), section))


def anchor(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'<section class="chapter-open"[^>]*(?<![A-Za-z0-9_])id="([^"]+)"', 1), F.lit(""))


def split_title(title: Column, lead: Column) -> Column:
    """struct(lead, main, problem): the lead must be a prefix, leave a rest, and join to the title again."""
    short = trim(lead)
    main = trim(F.substring(title, F.length(short) + 1, F.length(title)))
    problem = (
        F.when(F.coalesce(lead, F.lit("")) == "", None)
        .when(~F.startswith(title, short), "not a prefix")
        .when(main == "", "nothing left")
        .when(F.concat(short, F.lit(" "), main) != title, "not lossless")
    )
    bare = F.coalesce(lead, F.lit("")) == ""
    return F.struct(F.when(~bare & problem.isNull(), short).alias("lead"), F.when(bare, title).when(problem.isNull(), main).alias("main"), problem.alias("problem"))


def bullets(c: Column) -> Column:
    """The items of a run of bullet signs."""
    return parts(c, "•")


def table_markdown(rows: Column) -> Column:
    """A table of array<array<string>>, rows padded to the widest."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n")


def list_markdown(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.when(has(x, P.NUMBERED_LINE), x).otherwise(F.concat(F.lit("- "), x))), "\n")


def repaired_callout(c: Column) -> Column:
    """A leaked callout as a quote; other text as it is."""
    part = lambda n: F.regexp_extract(c, P.CALLOUT, n)
    return F.when(has(c, P.CALLOUT), F.concat(F.lit("> **"), part(2), F.lit("**\n>\n> "), part(3))).otherwise(c)


def references(html: Column) -> Column:
    """Local references in src, href and url(), distinct."""
    a, b = (F.regexp_extract_all(html, F.lit(P.REFERENCE), F.lit(i)) for i in (1, 2))
    raw = F.zip_with(a, b, lambda x, y: sub(trim(F.when(x != "", x).otherwise(y)), r"^['\"]|['\"]\z", ""))
    return F.array_distinct(F.filter(raw, lambda x: (x != "") & ~has(x, r"^(data:|#|https?://)")))
