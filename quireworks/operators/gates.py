"""Quality gates: measured conditions, and what is made of their results. A gate's status is pass, fail or skipped; skipped neither passes nor blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .joins import broken_targets, contained_lines, not_contained

# The gates in their order.
GATES = (
    "fonts-embedded text-coverage no-broken-chars no-hyphen-page-break ink-coverage no-overflow min-font-size contrast assets-exist cover-renders image-dpi folio-continuity outline-toc metadata file-size no-bonus-in-body structure".split()
)
#: Conditions that take a DataFrame of a project's measurements; register() adds to them.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    def keep(f):
        REGISTRY[name] = f
        return f

    return keep


def status(passes: Column, skipped: Column | None = None) -> Column:
    out = F.when(passes, "pass").otherwise("fail")
    return out if skipped is None else F.when(skipped, "skipped").otherwise(out)


# --- single gates; each gives project, id, status, evidence -------------------------------------------------------


def _row(df: DataFrame, name: str, state: Column, evidence: Column) -> DataFrame:
    return df.select("project", F.lit(name).alias("id"), state.alias("status"), evidence.cast("string").alias("evidence"))


@register("no-broken-chars")
def broken_chars(texts: DataFrame) -> DataFrame:
    """texts: project, text."""
    n = F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("�"), F.lit(""))) + F.regexp_count("text", F.lit(P.CID)))
    return _row(texts.groupBy("project").agg(n.alias("n")), "no-broken-chars", status(F.col("n") == 0), F.col("n"))


@register("ink-coverage")
def ink(previews: DataFrame, low: float = 0.02, high: float = 0.62) -> DataFrame:
    """previews: project, page, ink, exempt."""
    body = ~F.col("exempt")
    rows = previews.groupBy("project").agg(F.count_if(body & ~F.col("ink").between(low, high)).alias("out"), F.min(F.when(body, F.col("ink"))).alias("least"), F.max(F.when(body, F.col("ink"))).alias("most"))
    return _row(rows, "ink-coverage", status(F.col("out") == 0), F.col("out"))


def ink_ranges(previews: DataFrame, low: float = 0.02, high: float = 0.62) -> DataFrame:
    """previews as for ink(). Least and most ink of the pages that aren't exempt, and those outside the band: project, least, most, out (pages in order)."""
    body = previews.where("NOT exempt")
    out = F.array_sort(F.collect_set(F.when(~F.col("ink").between(low, high), F.col("page"))))
    return body.groupBy("project").agg(F.min("ink").alias("least"), F.max("ink").alias("most"), out.alias("out"))


@register("no-overflow")
def overflow(boxes: DataFrame, slack: float = 2.0) -> DataFrame:
    """boxes: project, left_, top_, right_, bottom_ and the page's own page_left and so on; split fragments count vertically only."""
    up = F.greatest(F.col("bottom_") - F.col("page_bottom"), F.col("page_top") - F.col("top_"))
    over = F.when(F.col("split"), up).otherwise(F.greatest(up, F.col("right_") - F.col("page_right"), F.col("page_left") - F.col("left_")))
    rows = boxes.groupBy("project").agg(F.count_if(over > slack).alias("out"), F.max(over).alias("worst"))
    return _row(rows, "no-overflow", status(F.col("out") == 0), F.col("out"))


@register("image-dpi")
def image_dpi(images: DataFrame, least: float = 150.0) -> DataFrame:
    """images: project, file, width (null: unreadable), page_width, outer, inner (lengths as text, in inches)."""
    column = T.inches(F.col("page_width")) - T.inches(F.col("outer")) - T.inches(F.col("inner"))
    dpi = F.try_divide(F.col("width"), column)
    rows = images.groupBy("project").agg(F.count_if(dpi < least).alias("low"), F.count_if(F.col("width").isNull()).alias("unread"), F.count_if(F.col("width").isNotNull()).alias("read"), F.bool_or(column.isNull()).alias("odd"))
    skipped = F.col("odd") | (F.col("read") == 0)
    return _row(rows, "image-dpi", status((F.col("low") == 0) & (F.col("unread") == 0), skipped), F.col("low") + F.col("unread"))


@register("file-size")
def file_size(files: DataFrame, most: int = 15) -> DataFrame:
    """files: project, bytes. Less than `most` MiB."""
    mib = F.col("bytes") / 1048576
    return _row(files, "file-size", status(mib < most), F.round(mib, 2))


@register("assets-exist")
def assets(references: DataFrame, existing: DataFrame) -> DataFrame:
    """references and existing: project, path."""
    # Both in one aggregation: no sorted sides of a join beside it in a task.
    rows = references.select("project", "path", F.lit(1).alias("n"), F.lit(False).alias("there")).unionByName(existing.select("project", "path", F.lit(0).alias("n"), F.col("path").isNotNull().alias("there")))
    rows = rows.groupBy("project", "path").agg(F.sum("n").alias("n"), F.bool_or("there").alias("there"))
    rows = rows.groupBy("project").agg(F.sum("n").alias("n"), F.count_if((F.col("n") > 0) & ~F.col("there") & F.col("project").isNotNull()).alias("missing")).where("n > 0")
    return _row(rows, "assets-exist", status(F.col("missing") == 0), F.col("missing"))


@register("cover-renders")
def cover(pages: DataFrame, least: float = 0.85) -> DataFrame:
    """pages: project, painted (images on the first page), textured (share, null: not measured)."""
    return _row(pages, "cover-renders", status((F.col("painted") > 0) & F.coalesce(F.col("textured") >= least, F.lit(True))), F.col("painted"))


@register("structure")
def structure(titles: DataFrame) -> DataFrame:
    """titles: project, title, text (the whole document's)."""
    missing = ~F.contains(T.squeezed(F.col("text")), T.squeezed(F.col("title")))
    rows = titles.groupBy("project").agg(F.count_if(missing).alias("missing"))
    return _row(rows, "structure", status(F.col("missing") == 0), F.col("missing"))


@register("metadata")
def metadata(rows: DataFrame) -> DataFrame:
    """rows: project, title, wanted_title, language, author, wanted_author."""
    good = (F.col("title") == F.col("wanted_title")) & (F.col("language") == "en-US") & F.contains("author", F.col("wanted_author"))
    return _row(rows, "metadata", status(F.coalesce(good, F.lit(False))), F.col("title"))


@register("fonts-embedded")
def fonts(rows: DataFrame) -> DataFrame:
    """rows: project, font, has_file, substituted."""
    bad = F.count_if(~F.col("has_file") | F.col("substituted"))
    return _row(rows.groupBy("project").agg(bad.alias("bad"), F.count_distinct("font").alias("n")), "fonts-embedded", status(F.col("bad") == 0, F.col("n") == 0), F.col("bad"))


@register("text-coverage")
def text_coverage(totals: DataFrame) -> DataFrame:
    """totals: joins.coverage()."""
    return _row(totals, "text-coverage", status(F.col("passes"), F.col("total") == 0), F.round("coverage", 4))


@register("min-font-size")
def min_font_size(styles: DataFrame, least: float = 9.5) -> DataFrame:
    """styles: project, css."""
    points = T.style_points(F.col("css"), "font-size-body")
    return _row(styles, "min-font-size", status(points >= least, points.isNull()), points)


@register("contrast")
def contrast(colours: DataFrame, least: float = 4.5) -> DataFrame:
    """colours: project, text, ground (#rrggbb)."""
    ratio = T.contrast(F.col("text"), F.col("ground"))
    return _row(colours, "contrast", status(ratio >= least), F.round(ratio, 2))


@register("outline-toc")
def outline_toc(titles: DataFrame, outline: DataFrame, targets: DataFrame, ids: DataFrame) -> DataFrame:
    """titles: project, id, title; outline: project, title; targets, ids: project, target. A project without an outline fails."""
    n = lambda df, name: df.groupBy("project").agg(F.count(F.lit(1)).alias(name))
    rows = titles.select("project").distinct().join(n(outline, "there"), "project", "left").join(n(not_contained(titles, outline), "missing"), "project", "left").join(n(broken_targets(targets, ids), "broken"), "project", "left")
    bad = F.coalesce("missing", F.lit(0)) + F.coalesce("broken", F.lit(0))
    return _row(rows, "outline-toc", status(F.col("there").isNotNull() & (bad == 0)), bad)


@register("no-bonus-in-body")
def no_bonus(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """lines: project, line_id, line of bonus files; texts: project, text_no, text of the bodies' parts. Projects without bonus lines are skipped."""
    found = contained_lines(lines.select(F.struct("project", "line_id").alias("line_id"), "line"), texts.select(F.struct("project", "text_no").alias("text_id"), "text")).where("line_id.project = text_id.project")
    leaks = found.select("text_id.project", "line_id.line_id").distinct().groupBy("project").agg(F.count(F.lit(1)).alias("leaks"))
    rows = texts.select("project").distinct().join(lines.groupBy("project").agg(F.count(F.lit(1)).alias("n")), "project", "left").join(leaks, "project", "left")
    return _row(rows, "no-bonus-in-body", status(F.col("leaks").isNull(), F.col("n").isNull()), F.coalesce("leaks", F.lit(0)))


def front_matter(pages: DataFrame) -> DataFrame:
    """pages: project, page (from 0), classes. Pages before the first that opens a chapter; 0 where none does."""
    first = F.min(F.when(F.array_contains("classes", "pagedjs_chapter-open_page"), F.col("page")))
    return pages.groupBy("project").agg(F.coalesce(first, F.lit(0)).alias("front_matter"))


def evidence(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows: project, item. The first items of each project, an ellipsis where there are more."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy("item"))).where(F.col("nth") <= most + 1)  # a limit that each task applies by itself first
    every = F.transform(F.array_sort(F.collect_list(F.struct("nth", "item"))), lambda x: x["item"])
    text = F.concat(F.array_join(F.slice(F.col("every"), 1, most), ", "), F.when(F.size("every") > most, ", …").otherwise(""))
    return first.groupBy("project").agg(every.alias("every")).select("project", text.alias("evidence"))


# --- folios ------------------------------------------------------------------------------------------------------


def bottom_lines(items: DataFrame, low: float, high: float, joined_by: str = "") -> DataFrame:
    """items: project, page, page_height, str, x, y. The lowest line of each page whose y lies strictly between low and high shares of the height."""
    rows = items.where(T.trim(F.col("str")) != "").where((F.col("y") > F.col("page_height") * low) & (F.col("y") < F.col("page_height") * high))
    lowest = rows.groupBy("project", "page").agg(F.min("y").alias("floor"))
    rows = rows.join(lowest, ["project", "page"]).where(F.abs(F.col("y") - F.col("floor")) <= 2)
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", T.trim(F.col("str")).alias("s")))), lambda t: t["s"]), joined_by)
    return rows.groupBy("project", "page").agg(line.alias("line"))


def folios(items: DataFrame) -> DataFrame:
    """project, page, text, kind (arabic, roman or null), value of each page's printed number."""
    rows = bottom_lines(items, -1e9, 0.12).withColumn("text", T.collapse(F.col("line"), ""))
    kind = F.when(T.has(F.col("text"), P.ARABIC), "arabic").when(T.has(F.col("text"), P.ROMAN), "roman")
    rows = rows.withColumn("kind", kind)
    value = F.when(F.col("kind") == "arabic", F.col("text").try_cast("bigint")).when(F.col("kind") == "roman", T.roman(F.col("text")).cast("bigint"))
    printed = rows.select("project", "page", F.when(kind.isNotNull(), F.col("text")).alias("text"), "kind", value.alias("value"))
    return items.select("project", "page").distinct().join(printed, ["project", "page"], "left")


def folio_breaks(pages: DataFrame) -> DataFrame:
    """pages: project, page, text, kind, value, and book where projects have several. Breaks of a book's printed numbers, pages without one left out."""
    w = Window.partitionBy("project", *(["book"] if "book" in pages.columns else [])).orderBy("page")
    rows = pages.where("kind IS NOT NULL").withColumns({"p_kind": F.lag("kind").over(w), "p_value": F.lag("value").over(w), "p_text": F.lag("text").over(w), "seen": F.coalesce(F.max(F.col("kind") == "arabic").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    arabic, step = F.col("kind") == "arabic", F.col("value") - F.col("p_value")
    reason = (
        F.when(arabic & ~F.col("seen"), F.when(F.col("value") != 1, F.concat(F.lit("starts at "), "text", F.lit(" after "), F.coalesce("p_text", F.lit("none")))))
        .when(~arabic & F.col("seen"), F.concat(F.lit("roman after arabic: "), "text"))
        .when(F.col("p_kind") == F.col("kind"), F.when(step == 0, "repeats").when(step < 0, F.concat(F.lit("back by "), (-step).cast("string"))).when(step > 1, F.concat(F.lit("skips "), (step - 1).cast("string"))))
    )
    return rows.select("project", "page", reason.alias("reason")).where("reason IS NOT NULL")


def folio_runs(pages: DataFrame) -> DataFrame:
    rows = pages.where("kind IS NOT NULL").groupBy("project", "kind")
    return rows.agg(F.min_by("text", "page").alias("first"), F.max_by("text", "page").alias("last"), F.count(F.lit(1)).alias("n"))


@register("folio-continuity")
def folio_continuity(pages: DataFrame) -> DataFrame:
    n = folio_breaks(pages).groupBy("project").agg(F.count(F.lit(1)).alias("breaks"))
    rows = pages.groupBy("project").agg(F.count("kind").alias("printed")).join(n, "project", "left")
    return _row(rows, "folio-continuity", status(F.col("breaks").isNull(), F.col("printed") == 0), F.coalesce("breaks", F.lit(0)))


@register("no-hyphen-page-break")
def hyphen_breaks(items: DataFrame) -> DataFrame:
    """items as for bottom_lines(). Pages, but for a project's last, whose body ends in a hyphen that the renderer put in; authored hyphens are counted only."""
    last = items.groupBy("project").agg(F.max("page").alias("last"), F.count_distinct("page").alias("pages"))
    ends = bottom_lines(items, 0.12, 0.93).join(last, "project").where("page < last").withColumn("end", F.right("line", F.lit(1)))
    n = ends.groupBy("project").agg(F.count_if(F.col("end").isin(P.RENDERER_HYPHENS)).alias("split"), F.count_if(F.col("end") == P.AUTHORED_HYPHEN).alias("authored"))
    rows = last.join(n, "project", "left")
    evidence = F.concat(F.coalesce("split", F.lit(0)).cast("string"), F.lit("/"), F.coalesce("authored", F.lit(0)).cast("string"))
    return _row(rows, "no-hyphen-page-break", status(F.coalesce("split", F.lit(0)) == 0, F.col("pages") < 2), evidence)


# --- pixels ------------------------------------------------------------------------------------------------------


def _bucket() -> Column:
    q = lambda c: F.shiftright(F.col(c), 3)
    return F.shiftleft(q("r"), 10).bitwiseOR(F.shiftleft(q("g"), 5)).bitwiseOR(q("b"))


def ink_ratios(pixels: DataFrame) -> DataFrame:
    """pixels: project, page, px, py, width, r, g, b. Share of pixels further than 24 from the commonest colour, of equal counts the one seen first."""
    rows = pixels.withColumn("bucket", _bucket())
    seen = rows.groupBy("project", "page", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("py").cast("long") * F.col("width") + F.col("px")).alias("first"))
    ground = seen.groupBy("project", "page").agg(F.max_by("bucket", F.struct("n", -F.col("first"))).alias("ground"))
    base = lambda shift: F.shiftright(F.col("ground"), shift).bitwiseAND(F.lit(31)) * 8
    far = F.sqrt(F.pow(F.col("r") - base(10), 2) + F.pow(F.col("g") - base(5), 2) + F.pow(F.col("b") - base(0), 2)) > 24
    return rows.join(ground, ["project", "page"]).groupBy("project", "page").agg(F.avg(far.cast("double")).alias("ink"), F.max("ground").alias("ground"))


def textured_ratios(pixels: DataFrame, grid: int = 8) -> DataFrame:
    """Share of the grid's cells with more than one colour; cells without pixels count as plain."""
    cell = lambda at, size: F.floor(((F.col(at) + 1) * grid - 1) / F.col(size)).cast("int")
    cells = pixels.groupBy("project", "page", cell("px", "width").alias("cx"), cell("py", "height").alias("cy")).agg((F.min(_bucket()) != F.max(_bucket())).alias("varied"))
    return cells.groupBy("project", "page").agg((F.count_if("varied") / (grid * grid)).alias("textured"))


# --- results -----------------------------------------------------------------------------------------------------


def _share(ids: list[str] | None) -> Column:
    mine = (F.col("id").isin(ids) if ids else F.lit(True)) & (F.col("status") != "skipped")
    return F.coalesce(F.try_divide(F.count_if(mine & (F.col("status") == "pass")), F.count_if(mine)), F.lit(1.0))


def scores(checks: DataFrame) -> DataFrame:
    """checks: project, id, status, coverage. Score out of 100 and its parts; each is rounded to one decimal, half up."""
    passed = lambda name: F.coalesce(F.max(F.when(F.col("id") == name, (F.col("status") == "pass").cast("double"))), F.lit(0.0))
    measured = F.max(F.when(F.col("id") == "text-coverage", F.col("coverage")))
    part = {
        "content": 25 * (passed("structure") + F.coalesce(measured, passed("text-coverage")) + passed("no-bonus-in-body")) / 3,
        "typography": 20 * _share(["fonts-embedded", "min-font-size", "contrast"]),
        "layout": 20 * _share(["ink-coverage", "no-overflow", "outline-toc"]),
        "consistency": 15 * _share(["metadata", "assets-exist"]),
        "technical": 10 * _share(None),
    }
    rows = checks.groupBy("project").agg(*(F.round(v, 1).alias(k) for k, v in part.items()))
    return rows.withColumn("niche_fit", F.lit(7.0)).withColumn("total", F.round(sum((F.col(k) for k in part), F.lit(7.0)), 1))


def verdicts(checks: DataFrame) -> DataFrame:
    """GO unless a check failed; counts, and the failed and the skipped ids in order."""
    count = lambda s: F.count_if(F.col("status") == s)
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("pos", "id"))))  # noqa: E731  as many as there are gates
    rows = checks.groupBy("project").agg(F.bool_and(F.col("status") != "fail").alias("ok"), count("pass").alias("passed"), count("fail").alias("failed"), count("skipped").alias("skipped"), ids("fail").alias("at"), ids("skipped").alias("past"))
    return rows.select("project", F.when(F.col("ok"), "GO").otherwise("NO-GO").alias("verdict"), "passed", "failed", "skipped", F.array_join(F.transform("at", lambda x: x["id"]), ",").alias("failed_ids"), F.array_join(F.transform("past", lambda x: x["id"]), ",").alias("skipped_ids"))


def best_by_rank(files: DataFrame, ranks: list[str]) -> DataFrame:
    """files: project, name. The first of the named files that a project has, else its first by name. `{project}` in a rank stands for the project."""
    rank = F.lit(len(ranks))
    for i, name in reversed(list(enumerate(ranks))):
        rank = F.when(F.col("name") == F.replace(F.lit(name), F.lit("{project}"), F.col("project").cast("string")), i).otherwise(rank)
    return files.groupBy("project").agg(F.min_by("name", F.struct(rank, "name")).alias("name"), F.count(F.lit(1)).alias("n"), F.min(rank).alias("rank"))


def only_file(files: DataFrame, name: str) -> DataFrame:
    """files: project, name. The file of that name (`{project}` as in best_by_rank), else a project's only file, else none."""
    found = best_by_rank(files, [name])
    return found.select("project", F.when((F.col("rank") == 0) | (F.col("n") == 1), F.col("name")).alias("name"))


def only_tier(files: DataFrame) -> DataFrame:
    """files: project, tier, name. The files of each project's lowest tier, numbered by name."""
    low = files.groupBy("project").agg(F.min("tier").alias("tier"))
    return files.join(low, ["project", "tier"]).withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy("name")))


def schema_violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule: rule_id, row_key. A rule is a condition that must not be false; null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.select(F.explode(broken).alias("rule_id"), F.col(key).cast("string").alias("row_key"))
