"""Books put together from parts, and the state of the stages that do it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import marked, stored
from .scans import scan


def print_cover(files: DataFrame) -> DataFrame:
    """files: project, name. The first print cover by name; without one the first raster that is neither a listing image nor a back."""
    rows = files.where(T.has(F.col("name"), r"(?i)\.(png|jpe?g)\z"))
    rank = F.when(T.has(F.col("name"), r"(?i)\.print\."), 0).when(~T.has(F.col("name"), r"(?i)\.kindle\.|back"), 1)
    rows = rows.withColumn("rank", rank).where("rank IS NOT NULL")
    return rows.groupBy("project").agg(F.concat(F.lit("cover/final/"), F.min_by("name", F.struct("rank", "name"))).alias("cover"))


def book_parts(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """books: project, title, subtitle, author, cover, disclaimer, disclaimer_required, n_bonuses, cta_title, cta_content, cta_link, punchline, points. chapters: project, pos, number, title, html.
    The sections in their order, each with its HTML or the reason it is left out: project, ordinal, nth, section, html, reason. The first chapter begins the body; the title marker goes into the book's first section. Books that blocked() names have none."""
    stopped = blocked(books).select("project")
    chapters = chapters.withColumn("anchor", T.anchor(F.col("html")))  # before the shuffle, so the table of contents travels without the chapters
    books, chapters = books.join(stopped, "project", "left_anti"), chapters.join(stopped, "project", "left_anti")
    filled = lambda c: F.coalesce(T.trim(F.col(c)), F.lit("")) != ""
    e = lambda c: T.escaped(F.coalesce(F.col(c), F.lit("")))
    part = lambda n, name, cond, html, why: F.struct(F.lit(n).alias("ordinal"), F.lit(0).alias("nth"), name.alias("section"), F.when(cond, html).alias("html"), F.when(~cond, F.lit(why)).alias("reason"))
    yes = F.lit(True)
    points = F.array_join(F.transform("points", lambda x: F.concat(F.lit("<li>"), T.escaped(x), F.lit("</li>"))), "\n")
    fixed = F.array(
        part(0, F.lit("cover"), F.col("cover").isNotNull(), F.concat(F.lit('<section class="cover-page"><img src="'), F.coalesce("cover", F.lit("")), F.lit('" alt="'), e("title"), F.lit('"></section>')), "no print cover"),
        part(1, F.lit("title-page"), yes, F.concat(F.lit('<section class="title-page"><h1>'), e("title"), F.lit("</h1>"), F.when(filled("subtitle"), F.concat(F.lit("<p>"), e("subtitle"), F.lit("</p>"))).otherwise(""), F.lit("<p>"), e("author"), F.lit("</p></section>")), ""),
        part(2, F.when(F.col("disclaimer_required"), "copyright+disclaimer").otherwise("copyright"), yes, F.concat(F.lit("<section><p>"), e("author"), F.lit("</p>"), F.when(filled("disclaimer"), F.array_join(F.transform(T.paragraphs(F.col("disclaimer")), lambda p: F.concat(F.lit("<p>"), T.escaped(p), F.lit("</p>"))), "\n")).otherwise(""), F.lit("</section>")), ""),
        part(3, F.lit("bonus-teaser"), F.col("n_bonuses") > 0, F.concat(F.lit("<section>"), F.col("n_bonuses").cast("string"), F.lit(" companion deliverable"), F.when(F.col("n_bonuses") == 1, "").otherwise("s"), F.lit("</section>")), "no bonuses"),
        part(6, F.lit("cta"), filled("cta_title") & filled("cta_content"), F.concat(F.lit("<section><h2>"), e("cta_title"), F.lit("</h2>"), e("cta_content"), F.when(filled("cta_link"), F.concat(F.lit('<a href="'), e("cta_link"), F.lit('"></a>'))).otherwise(""), F.lit("</section>")), "no title or body"),
        part(7, F.lit("back-cover"), filled("punchline") & (F.size(F.coalesce("points", F.array().cast("array<string>"))) > 0), F.concat(F.lit("<section>"), T.escaped(T.trim(F.coalesce("punchline", F.lit("")))), F.lit("<ul>"), points, F.lit("</ul></section>")), "no punchline or bullets"),
    )
    marker = F.concat(F.lit('<div class="doc-title-marker">'), e("title"), F.lit("</div>"))
    rows = books.select("project", marker.alias("marker"), F.inline(fixed))
    w = Window.partitionBy("project").orderBy("ordinal")
    first = F.min(F.when(F.col("html").isNotNull(), F.col("ordinal"))).over(Window.partitionBy("project"))
    rows = rows.withColumn("first", first).select("project", "ordinal", "nth", "section", F.when(F.col("ordinal") == F.col("first"), T.marked(F.col("html"), F.col("marker"))).otherwise(F.col("html")).alias("html"), "reason")
    body = chapters.withColumn("nth", F.row_number().over(w.partitionBy("project").orderBy("pos")) - 1)
    opened = F.when(F.col("nth") == 0, F.replace(F.col("html"), F.lit('<section class="chapter-open"'), F.lit('<section class="chapter-open body-start"'))).otherwise(F.col("html"))
    entry = F.concat(F.lit('<li class="toc-entry"><a href="#'), F.col("anchor"), F.lit('">'), T.escaped(T.toc_label(F.col("number"), F.col("title"))), F.lit("</a></li>"))
    no_reason = F.lit(None).cast("string").alias("reason")
    toc = body.select("project", F.lit(4).alias("ordinal"), "nth", F.lit("toc").alias("section"), entry.alias("html"), no_reason)
    text = body.select("project", F.lit(5).alias("ordinal"), "nth", F.lit("chapter").alias("section"), opened.alias("html"), no_reason)
    return reduce(DataFrame.unionByName, [rows, toc, text])


def blocked(books: DataFrame) -> DataFrame:
    """Books that must not be put together: their niche needs a disclaimer, and they have none. project, reason."""
    bare = F.coalesce(T.trim(F.col("disclaimer")), F.lit("")) == ""
    return books.where(F.col("disclaimer_required") & bare).select("project", F.lit("a disclaimer is required, and there is none").alias("reason"))


def inlined_fonts(styles: DataFrame, fonts: DataFrame) -> DataFrame:
    """styles: project, css; fonts: project, path, content (binary). Style sheets with their local fonts as data: project, css (null where one is missing), missing (the paths)."""
    none = F.array().cast("array<string>")
    styles = styles.select("project", "css", F.coalesce(F.array_distinct(F.transform(T.font_urls(F.col("css")), lambda x: x["path"])), none).alias("paths"))
    # Fonts that no style sheet refers to are left out before the shuffle by a bitmap, and those that it lets through after.
    key = F.xxhash64("project", "path")
    asked = styles.select("project", F.explode("paths").alias("path")).select(key.alias("font_key"))
    held = marked(fonts.where("content IS NOT NULL").select("project", "path", "content", key.alias("font_key")), "font_key", asked)[0]
    held = held.groupBy("project").agg(F.array_agg(F.struct("path", "content")).alias("held"))
    used = F.filter("held", lambda x: F.array_contains("paths", x["path"]))
    data = F.map_from_entries(F.transform(used, lambda x: F.struct(x["path"], F.regexp_replace(F.base64(x["content"]), r"\s", ""))))
    rows = styles.join(held, "project", "left").withColumn("data", F.coalesce(data, F.create_map().cast("map<string,string>")))
    css = F.when(F.size("paths") == 0, F.col("css")).otherwise(T.with_fonts(F.col("css"), F.col("data")))
    return rows.select("project", css.alias("css"), F.array_sort(F.array_except("paths", F.map_keys("data"))).alias("missing"))


def resolved_paths(wanted: DataFrame, project_files: DataFrame, shared_files: DataFrame) -> DataFrame:
    """wanted: project, path. Where each path is found: in the project, else among the shared files, else nowhere (null)."""
    own = project_files.select("project", "path").distinct().withColumn("own", F.concat("project", F.lit("/"), "path"))
    shared = shared_files.select("path").distinct().withColumn("shared", F.col("path"))
    return wanted.join(own, ["project", "path"], "left").join(shared, "path", "left").select("project", "path", F.coalesce("own", "shared").alias("found"))


def art_sizes(art: DataFrame, width_inches: float = 6.0, print_width: int = 1800) -> DataFrame:
    """art: project, width in pixels. Dots per inch over the full page, and the share of the print's width."""
    return art.select("project", F.round(F.col("width") / width_inches, 1).alias("dpi"), F.round(F.col("width") / print_width, 3).alias("ratio"))


# --- state ---------------------------------------------------------------------------------------------------------


def latest(results: DataFrame) -> DataFrame:
    """results: project, stage, finished_at, status. The last result of each stage, with its exit code."""
    rows = results.groupBy("project", "stage").agg(F.max_by("status", F.struct("finished_at", "status")).alias("status"), F.max("finished_at").alias("finished_at"))
    return rows.withColumn("exit_code", exit_code(F.col("status")))


def exit_code(status: Column) -> Column:
    return F.when(status == "success", 0).when(status == "not_implemented", 2).otherwise(1)


def run_stage(spark: SparkSession, project: str, stage: str, work: Callable[[], str], state_path: str) -> int:
    """Runs one stage on the driver, times it, appends its result to the state table (Parquet) and gives its exit code."""
    began = datetime.now(timezone.utc)
    try:
        message, status, code = work(), "success", 0
    except NotImplementedError as error:
        message, status, code = str(error), "not_implemented", 2
    except Exception as error:  # noqa: BLE001  the stage's failure is its result
        message, status, code = str(error), "failed", 1
    row = [(project, stage, status, code, message, began, datetime.now(timezone.utc))]
    spark.createDataFrame(row, "project string, stage string, status string, exit_code int, message string, started_at timestamp, finished_at timestamp").write.mode("append").parquet(state_path)
    return code


def run_stages(spark: SparkSession, project: str, stages: dict[str, Callable[[], str]], state_path: str) -> int:
    """Stages in order; the first that fails ends the run."""
    for name, work in stages.items():
        if code := run_stage(spark, project, name, work, state_path):
            return code
    return 0


# --- JSON ----------------------------------------------------------------------------------------------------------

# Keys under which a media address is looked for first.
MEDIA_KEYS = ("result_url", "output_url", "media_url", "image_url", "url", "results", "outputs", "output", "media", "assets", "result")


def media_url(doc: Column, depth: int = 4) -> Column:
    """The first http(s) address in a JSON text, named keys before others, to `depth` levels; null if there is none. The levels are unrolled, so it stays one expression."""
    value = F.trim(doc)
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    here = F.when(F.startswith(value, F.lit('"')) & T.has(quoted, r"(?i)^https?://"), quoted)
    if depth < 0:
        return F.lit(None).cast("string")
    if depth == 0:
        return here
    items = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>", {"allowUnquotedFieldNames": "true"}))
    entries = F.when(F.startswith(value, F.lit("{")), F.from_json(value, "map<string,string>"))
    raw = lambda x: F.when(T.has(x, r"^[\[{]"), x).otherwise(F.to_json(F.struct(x.alias("v"))))
    inner = lambda x: media_url(F.when(T.has(x, r"^[\[{]"), x).otherwise(F.regexp_extract(raw(x), r'(?s)^\{"v":(.*)\}\z', 1)), depth - 1)
    first = lambda xs: F.get(F.filter(F.transform(xs, inner), lambda u: u.isNotNull()), F.lit(0))
    named = F.transform(F.filter(F.array(*map(F.lit, MEDIA_KEYS)), lambda k: F.map_contains_key(entries, k)), lambda k: F.try_element_at(entries, k))
    return F.coalesce(here, first(items), first(named), first(F.map_values(entries)))


# --- trees ---------------------------------------------------------------------------------------------------------


#: Where a walk ends: behind a last root, or at a parent that is not there.
_DONE, _LOST = -1, -2


def flat_titles(nodes: DataFrame) -> DataFrame:
    """nodes: project, id, parent (null for roots), pos, title. Depth-first order of each project's outline: project, nth, depth, title; of siblings with one pos the lesser id first. Nodes that no root leads to are left out.

    The walk around the tree enters and leaves each node once, which makes a linked list of two steps a node. Pointer doubling gives each step what is left of its list, in as many rounds as the longest list's length
    has binary digits, whatever the outline's depth; a round is a stored table of narrow rows, spread by step."""
    is_root, up = F.col("parent").isNull().alias("is_root"), F.coalesce(F.col("parent").cast("string"), F.lit("")).alias("up")
    rows = nodes.select("project", F.col("id").cast("string").alias("id"), is_root, up, "pos", F.col("id").alias("own"), "title").where("project IS NOT NULL AND id IS NOT NULL")
    order = ["project", "is_root", "up", "pos", "own"]
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()), "outline-nodes")
    found = scan(rows.select("project", "id", "is_root", "up", "number"), ["project", "is_root", "up"], "number", sums={"nth": F.lit(1)}, previous={"before": F.col("number")}, totals={"siblings": F.lit(1)})
    parents = rows.select(F.col("project").alias("of"), F.col("id").alias("up_id"), F.col("number").alias("up_number"))
    found = stored(found.join(parents, ~F.col("is_root") & (F.col("project") == F.col("of")) & (F.col("up") == F.col("up_id")), "left").select("project", "number", "is_root", "before", (F.col("nth") + 1 == F.col("siblings")).alias("is_last"), "up_number"), "outline-siblings")
    enter, leave = (lambda n: 2 * F.col(n)), (lambda n: 2 * F.col(n) + 1)
    link = lambda df, step, ahead: df.select(step.alias("step"), ahead.alias("ahead"))
    leaves = found.join(found.select(F.col("up_number").alias("has")).where("has IS NOT NULL").distinct(), F.col("number") == F.col("has"), "left_anti")
    steps = reduce(DataFrame.unionByName, [
        link(found.where("before IS NULL AND up_number IS NOT NULL"), enter("up_number"), enter("number")),
        link(found.where("before IS NOT NULL"), leave("before"), enter("number")),
        link(leaves, enter("number"), leave("number")),
        link(found.where("is_last"), leave("number"), F.when(F.col("is_root"), _DONE).otherwise(F.coalesce(leave("up_number"), F.lit(_LOST)))),
    ])
    entering = F.col("step") % 2 == 0
    steps = stored(steps.select("step", "ahead", F.when(entering, 1).otherwise(0).cast("long").alias("left"), F.when(entering, 1).otherwise(-1).cast("long").alias("rise")), "outline-steps")
    most, reach = steps.count(), 1
    while reach <= most and not steps.where("ahead >= 0").isEmpty():
        then = steps.select(F.col("step").alias("at"), F.col("ahead").alias("then"), F.col("left").alias("more"), F.col("rise").alias("more_rise"))
        on = steps.join(then, F.col("ahead") == F.col("at"), "left")
        on = on.select("step", F.coalesce("then", "ahead").alias("ahead"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), (F.col("rise") + F.coalesce("more_rise", F.lit(0))).alias("rise"))
        steps, reach = stored(on, "outline-steps"), 2 * reach
    walked = steps.where((F.col("ahead") == _DONE) & (F.col("step") % 2 == 0)).select(F.shiftright("step", 1).alias("node"), "left", "rise")
    walked = stored(rows.join(walked, F.col("number") == F.col("node")).select("project", "title", "left", "rise"), "outline-walked")
    sizes = walked.groupBy(F.col("project").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    out = walked.join(sizes, F.col("project") == F.col("of"))
    return out.select("project", (F.col("n") - F.col("left") + 1).cast("int").alias("nth"), (-F.col("rise")).cast("int").alias("depth"), "title")
