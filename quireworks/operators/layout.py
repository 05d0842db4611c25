"""Positioned text to lines, sections, blocks and Markdown files."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..storage import pressed, stored
from . import packing, scans
from .scans import plain_scan, scan

SAME_LINE = 2.0
#: Pages of a project that are put in order and numbered together.
STRETCH = 1024
CELL_GAP, CELL_LEAST, SPACE_GAP = 1.3, 14.0, 0.15
WRAP, LIST_WRAP = 2.46, 2.9


def lines(items: DataFrame) -> DataFrame:
    """items: project, page, item_no, str, x, y, width, height. Lines: project, page, line, y, font_height, cells.
    An item belongs to the open line if its y is within SAME_LINE of that line's first item; this needs the page's order, as the distance to the neighbour would let lines drift. Items are shuffled once, packed, by stretches of pages; one stretch at a time is put in order."""
    return packing.by_group(_dealt(items), ["project", "stretch"], lambda rows, group: _lines_of(rows, group)[0], _schema(items, "page", "line int"))


def _stretch() -> Column:
    return F.greatest(F.floor(F.col("page") / STRETCH), F.lit(0))


def _dealt(items: DataFrame) -> DataFrame:
    return items.select("project", _stretch().alias("stretch"), "page", "item_no", "str", "x", "y", "width", "height")


def _schema(items: DataFrame, *more: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    columns = [x if " " in x else f"{x} {kinds[x]}" for x in ("project", *more)]
    return ", ".join([*columns, f"y {kinds['y']}", f"font_height {kinds['height']}", "cells array<string>"])


def _lines_of(items: pa.Table, group: np.ndarray) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """Items of whole pages, in any order, to lines, their groups and their stretches."""
    number = lambda c: items[c].cast(pa.float64()).to_numpy()
    low = lambda a: np.where(np.isnan(a), -np.inf, a)  # noqa: E731  nulls come first
    page = items["page"].combine_chunks().fill_null(0).to_numpy()
    there = items["page"].is_valid().to_numpy()
    order = np.lexsort((items["item_no"].to_numpy(), low(number("x")), low(-number("y")), page, there, group))
    items = items.take(pa.array(order)).combine_chunks()
    found, starts, _ = _laid_out(items, 0)
    return found, group[order][starts], items["stretch"].take(pa.array(starts))


def _laid_out(items: pa.Table, number: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Sorted items to lines, where each of these starts, and their numbers, of which the first is given. A gap to the item before that is wide begins a cell, a lesser one gives a space. Blank items count for y and height alone."""
    floats = lambda c: items[c].cast(pa.float64()).to_numpy()  # noqa: E731  nulls are NaN
    same = [c.chunk(0).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (items["project"], items["page"])]
    turns = np.concatenate(([True], (same[0][1:] != same[0][:-1]) | (same[1][1:] != same[1][:-1])))
    ys, anchor, starts = floats("y"), None, []
    for i, (turned, y) in enumerate(zip(turns.tolist(), ys.tolist(), strict=True)):
        if turned or abs(anchor - y) > SAME_LINE:
            starts.append(i)
            anchor = y
    starts = np.array(starts)
    nth = np.arange(len(starts))
    opens = np.maximum.accumulate(np.where(turns[starts], nth, 0))
    numbers = nth - opens + np.where(opens == 0, number, 0)
    line = np.zeros(len(ys), dtype=np.int64)
    line[starts[1:]] = 1
    line = np.cumsum(line)
    low = lambda a: np.where(np.isnan(a), -np.inf, a)  # noqa: E731  nulls come first
    order = np.lexsort((items["item_no"].to_numpy(), low(-ys), low(floats("x")), line))
    x, width, height, y = (floats(c)[order] for c in ("x", "width", "height", "y"))
    text = items["str"].chunk(0).take(pa.array(order))
    highest = np.fmax.reduceat(height, starts)
    at = np.flatnonzero(pc.fill_null(pc.not_equal(pc.utf8_trim(text, characters=T.SPACES), ""), False).to_numpy(zero_copy_only=False))
    of, gap = line[at], np.full(len(at), np.nan)
    gap[1:] = x[at[1:]] - (x + width)[at[:-1]]
    opening = np.ones(len(at), dtype=bool)
    opening[1:] = of[1:] != of[:-1]
    gap[opening] = np.nan
    begins = opening | (gap > np.fmax(highest[of] * CELL_GAP, CELL_LEAST))
    spaced = ~begins & ~np.isnan(gap) & ~(gap <= highest[of] * SPACE_GAP)
    pieces = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(spaced.astype(np.int8))), text.take(pa.array(at)), "")
    first = np.flatnonzero(begins)
    cells = pc.utf8_trim(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pieces), ""), characters=T.SPACES)
    counts = np.bincount(of[first], minlength=len(starts))
    bare = np.flatnonzero(counts == 0)  # lines of blank items have one empty cell
    lines_, which = np.concatenate((of[first], bare)), np.concatenate((np.arange(len(first)), np.full(len(bare), len(first))))
    cells = pa.concat_arrays([cells, pa.array([""], cells.type)]).take(pa.array(which[np.argsort(lines_, kind="stable")]))
    counts[bare] = 1
    values = {"project": items["project"].take(pa.array(starts)), "page": items["page"].take(pa.array(starts)), "line": pa.array(numbers, pa.int32()), "y": pa.array(y[starts], from_pandas=True).cast(items.schema.field("y").type), "font_height": pa.array(highest, from_pandas=True).cast(items.schema.field("height").type)}
    return pa.table(values | {"cells": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), cells)}), starts, numbers


def classified(rows: DataFrame) -> DataFrame:
    """Adds text, is_table_row, is_list_item, drops blank lines and each page's footer number, and numbers the lines of a project."""
    # Stretches of pages are dealt out, so a project of any size is spread; lines are shuffled and written once, without what follows from their cells.
    rows = rows.select("project", "page", "line", "y", "font_height", "cells").withColumn("stretch", _stretch()).repartition("project", "stretch")
    text = F.array_join("cells", " ")
    rows = rows.where(T.trim(text) != "")
    page, stretch = Window.partitionBy("project", "stretch", "page").orderBy("line"), Window.partitionBy("project", "stretch").orderBy("page", "line")
    rows = rows.withColumns({"is_last": F.lead("line").over(page).isNull(), "above": F.max("font_height").over(page.rowsBetween(Window.unboundedPreceding, -1))})
    footer = F.col("is_last") & T.has(T.trim(text), r"^[0-9]{1,4}\z") & F.coalesce(F.col("font_height") < F.col("above"), F.lit(False))
    rows = rows.where(~footer).withColumn("nth", F.row_number().over(stretch).cast("long") - 1).drop("is_last", "above", "line")
    return _counted(rows)


def classified_items(items: DataFrame) -> DataFrame:
    """classified(lines(items)), where the lines are never shuffled: footers go and lines are numbered where a stretch's items come together."""
    return _counted(packing.by_group(_dealt(items), ["project", "stretch"], lambda rows, group: _without_footers(*_lines_of(rows, group)), _schema(items, "stretch bigint", "page", "nth bigint")))


def _without_footers(rows: pa.Table, group: np.ndarray, stretch: pa.Array) -> pa.Table:
    """_lines_of() without blank lines and footers, numbered in their stretch."""
    text = pc.utf8_trim(pc.binary_join(rows["cells"], " "), characters=T.SPACES)
    rows = rows.append_column("stretch", stretch).append_column("text", text).append_column("group", pa.array(group))
    rows = rows.filter(pc.not_equal(text, "")).combine_chunks()
    group = rows["group"].to_numpy()
    if len(group):
        page = rows["page"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        opens = np.append(0, np.flatnonzero((group[1:] != group[:-1]) | (page[1:] != page[:-1])) + 1)
        last = np.append(opens[1:], len(group)) - 1
        height = rows["font_height"].cast(pa.float64()).to_numpy()
        before = height.copy()
        before[last] = np.nan  # of the lines above the last, the highest
        above = np.fmax.reduceat(before, opens)
        footer = np.zeros(len(group), dtype=bool)
        footer[last] = (height[last] < above) & pc.match_substring_regex(rows["text"].take(pa.array(last)), r"\A[0-9]{1,4}\z").to_numpy()
        rows, group = rows.filter(pa.array(~footer)), group[~footer]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return rows.append_column("nth", pa.array(nth, pa.int64())).select(["project", "stretch", "page", "nth", "y", "font_height", "cells"])


def _counted(rows: DataFrame) -> DataFrame:
    """rows: project, stretch, page, nth (in the stretch), y, font_height, cells. Stored; numbered in the project, with what follows from the cells."""
    text = F.array_join("cells", " ")
    rows = pressed(rows, "layout-lines")
    before = Window.partitionBy("project").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("project", "stretch").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    later = rows.where("stretch > 0").join(ahead.where("stretch > 0"), ["project", "stretch"])  # nothing is ahead of the others, which most lines are
    rows = rows.where("stretch = 0").withColumn("ahead", F.lit(0).cast("long")).unionByName(later)
    rows = rows.withColumns({"line_no": F.col("ahead") + F.col("nth"), "text": text, "is_table_row": F.size("cells") >= 2})
    rows = rows.withColumn("is_list_item", ~F.col("is_table_row") & T.has(T.trim(F.col("text")), P.NUMBERED_LINE))
    return rows.select("project", "line_no", "page", "y", "font_height", "text", "cells", "is_list_item", "is_table_row")


def heading(text: Column) -> Column:
    """struct(kind, number, inline_title); kind is null where the text is no heading."""
    t = T.trim(text)
    kind = F.when(F.lower(t) == "introduction", "introduction").when(F.lower(t) == "conclusion", "conclusion").when(T.has(t, P.CHAPTER), "chapter").when(T.has(t, P.BONUS), "bonus")
    number = F.when(kind == "chapter", F.regexp_extract(t, P.CHAPTER, 1).try_cast("int"))
    title = F.when(kind == "chapter", T.trim(F.regexp_extract(t, P.CHAPTER, 2))).when(kind == "bonus", T.trim(F.regexp_extract(t, P.BONUS, 1))).otherwise("")
    return F.struct(kind.alias("kind"), number.alias("number"), title.alias("inline_title"))


_BEFORE = ("page", "y", "font_height", "text")


def _links() -> dict[str, Column]:
    """How a line follows the one before, whose fields are was_*: wraps (plain), list_wraps, crosses (a page), list_follows."""
    page, y, height, text = (F.col(f"was_{c}") for c in _BEFORE)
    mean, gap = (F.col("font_height") + height) / 2, y - F.col("y")
    same_page, same_font = F.col("page") == page, F.abs(F.col("font_height") - height) <= 0.5
    prev, own = T.trim(text), T.trim(F.col("text"))
    first = F.substring(own, 1, 1)
    crosses = (F.col("page") == page + 1) & same_font & (prev != "") & (own != "") & ~T.has(prev, P.ENDS_BLOCK) & (first == F.lower(first)) & (first != F.upper(first))
    no = lambda c: F.coalesce(c, F.lit(False))
    return {"wraps": no(same_page & same_font & (gap <= mean * WRAP)), "list_wraps": no(same_page & same_font & (gap <= mean * LIST_WRAP)), "crosses": no(crosses), "list_follows": no(~same_page | (gap <= mean * LIST_WRAP))}


def linked(rows: DataFrame) -> DataFrame:
    """Adds how each line follows the one before: wraps (plain), list_wraps, crosses (a page), list_follows."""
    found = scan(rows, ["project"], "line_no", previous={f"was_{c}": F.col(c) for c in _BEFORE})
    return found.withColumns(_links()).drop(*(f"was_{c}" for c in _BEFORE))


#: How lines of projects are gone through: the scan, and what keeps a table that is read twice.
_Way = namedtuple("_Way", "scan kept")
_WHOLE, _SEGMENTED = _Way(plain_scan, lambda df, name: df), _Way(scan, stored)


def _parted(rows: DataFrame, at_hand: bool = False) -> list[tuple[DataFrame, _Way]]:
    """Classified lines with h (their heading), stored unless they are at hand, in two parts where need be: projects that fit into one segment of a scan, whose lines meet in one place by one shuffle, and larger ones, which go by segments."""
    # Few lines begin like a heading: the others are spared its patterns.
    likely = ~F.col("is_table_row") & T.has(F.col("text"), rf"(?i)^{P.SPACE}*(introduction|conclusion|chapter|bonus)")
    rows = rows.withColumns({"h": F.when(likely, heading(F.col("text"))), "cells": F.when(F.col("is_table_row"), F.col("cells"))})  # the cells of other lines are their text
    rows = rows if at_hand else stored(rows, "layout-classified")
    large = stored(rows.groupBy("project").agg(F.max("line_no").alias("last")).where(F.col("last") >= scans.SEGMENT).select("project"), "layout-large")
    if large.isEmpty():
        return [(rows, _WHOLE)]
    large = F.broadcast(large)  # one project for each SEGMENT lines at most
    return [(rows.join(large, "project", "left_anti"), _WHOLE), (rows.join(large, "project", "left_semi"), _SEGMENTED)]


def _over(rows: DataFrame, make: Callable[[DataFrame, _Way], DataFrame], at_hand: bool = False) -> DataFrame:
    """make() of the numbered lines of each part."""
    return reduce(DataFrame.unionByName, [make(_numbered(part, way), way) for part, way in _parted(rows, at_hand)])


def _numbered(rows: DataFrame, way: _Way) -> DataFrame:
    """Classified lines with what sections and blocks need: the links to the line before, h (its heading), section (0 before the first heading), headings (of the project), role (head, title, body; a project's lines
    before its first heading have none), starts (a block, for body).

    A section's title lines follow its heading without a break. A body line is in a list if its section's last list item comes after the last line that ends lists: a table row or a plain line that does not wrap."""
    is_head = F.col("h.kind").isNotNull()
    flags = {"was_head": is_head, "was_table": F.col("is_table_row"), "was_item": F.col("is_list_item")}
    one = F.when(is_head, 1).otherwise(0)
    rows = way.scan(rows, ["project"], "line_no", sums={"section": one}, previous={f"was_{c}": F.col(c) for c in _BEFORE} | flags, totals={"headings": one})
    rows = rows.withColumns(_links()).withColumn("section", F.col("section") + one).drop(*(f"was_{c}" for c in _BEFORE))
    rows = way.kept(rows, "layout-linked")
    at = F.col("line_no")
    plain = ~F.col("is_list_item") & ~F.col("is_table_row")
    goes_on = is_head | plain & (F.col("was_head") | F.col("wraps"))
    untitled = F.col("h.kind").isin("chapter", "bonus") & (F.col("h.inline_title") == "")
    ends_list = F.col("is_table_row") | plain & ~F.col("list_wraps")
    rows = way.scan(rows, ["project"], "line_no", maxima={
        "head_at": F.when(is_head, at), "untitled_at": F.when(untitled, at), "break_at": F.when(~F.coalesce(goes_on, F.lit(False)), at), "item_at": F.when(F.col("is_list_item"), at), "end_at": F.when(F.coalesce(ends_list, F.lit(False)), at),
    })
    after = lambda a, b: F.coalesce(F.col(a), F.lit(-1)) > F.coalesce(F.col(b), F.lit(-1))
    title_so_far = (F.col("untitled_at") == F.col("head_at")) & after("head_at", "break_at")
    in_title = F.coalesce(~is_head & title_so_far & goes_on, F.lit(False))
    role = F.when(is_head, "head").when(in_title, "title").when((F.col("section") > 0) | (F.col("headings") == 0), "body")
    first = F.coalesce(F.col("was_head"), F.lit(True)) | F.coalesce(title_so_far, F.lit(False))
    listed = after("item_at", "end_at") & after("item_at", "head_at")
    mode = F.when(first, "").when(F.col("was_table"), "table").when(F.col("was_item") | listed, "list").otherwise("paragraph")
    rows = rows.withColumns({"role": role, "mode": mode})
    rows = rows.withColumn("starts", F.when(F.col("role") == "body", ~_goes_on(F.col("mode"))))
    return way.kept(rows.drop("mode", "head_at", "untitled_at", "break_at", "item_at", "end_at", *flags), "layout-numbered")


def _goes_on(mode: Column) -> Column:
    """Whether a line continues a block of that mode ('' is none)."""
    return (
        F.when(F.col("is_table_row"), mode == "table")
        .when(F.col("is_list_item"), (mode == "list") & F.col("list_follows"))
        .when(mode == "list", F.col("list_wraps"))
        .otherwise((mode == "paragraph") & (F.col("wraps") | F.col("crosses")))
    )


def sections(rows: DataFrame) -> DataFrame:
    """Classified lines to sections: project, section, kind, number, title, from_next, heading_text, start_page, end_page, n_body (lines). Lines before the first
    heading belong to none; an empty section just before one of the same kind, title and number is dropped."""
    return _over(rows, lambda lines_, way: _all_sections(lines_, way).where("NOT orphan").drop("orphan"))


def _summary(over: Callable[[Column], Column]) -> list[Column]:
    """What a section's lines tell of it; over() makes a window of an aggregate."""
    is_role = lambda r: F.col("role") == r
    titles = over(F.collect_list(F.when(is_role("title"), F.struct("line_no", T.trim(F.col("text")).alias("t")))))
    title = F.array_join(F.transform(F.array_sort(titles), lambda x: x["t"]), " ")
    last = over(F.max(F.when(is_role("body"), F.struct("line_no", "page"))))
    return [over(F.max(F.when(is_role("head"), F.struct("h", "text", "page")))).alias("top"), title.alias("next_title"), over(F.count_if(is_role("body"))).alias("n_body"), last.alias("last")]


def _described(summary: str = "") -> list[Column]:
    """The fields of a section from _summary(), which may be the fields of a struct."""
    top, next_title, n_body, last = (F.col(f"{summary}{c}") for c in ("top", "next_title", "n_body", "last"))
    kind = top["h"]["kind"]
    named = F.when(kind == "introduction", "Introduction").when(kind == "conclusion", "Conclusion").when(top["h"]["inline_title"] != "", top["h"]["inline_title"]).otherwise(next_title)
    end = F.coalesce(last["page"], top["page"])
    return [kind.alias("kind"), top["h"]["number"].alias("number"), named.alias("title"), (next_title != "").alias("from_next"), top["text"].alias("heading_text"), top["page"].alias("start_page"), end.alias("end_page"), n_body.alias("n_body")]


def _all_sections(lines_: DataFrame, way: _Way) -> DataFrame:
    """lines_: _numbered(). sections() with `orphan` for those that it drops."""
    out = lines_.where("section > 0").groupBy("project", "section").agg(*_summary(lambda c: c))
    out = out.select("project", "section", *_described())
    what = F.struct("kind", "title", "number")
    same = lambda following: F.coalesce((F.col("n_body") == 0) & following.eqNullSafe(what) & following.isNotNull(), F.lit(False))
    if way is _WHOLE:
        return out.withColumn("orphan", same(F.lead(what).over(Window.partitionBy("project").orderBy("section"))))
    out = stored(out, "layout-sections")
    following = out.select(F.col("project").alias("of"), (F.col("section") - 1).alias("before"), what.alias("following"))
    return out.join(following, (F.col("project") == F.col("of")) & (F.col("section") == F.col("before")), "left").withColumn("orphan", same(F.col("following"))).drop("of", "before", "following")


def blocks(found: DataFrame, key: str = "section") -> DataFrame:
    """found: project, key, body (lines as linked() has them, in order). Bodies to blocks: project, key, block_no, type, text, items, rows. A paragraph equal to the one just before it is dropped."""
    rows = found.select("project", key, F.posexplode("body").alias("line_no", "x")).select("project", key, "x.*", F.col("line_no").alias("place")).drop("line_no").withColumnRenamed("place", "line_no")
    at = F.col("line_no")
    plain = ~F.col("is_list_item") & ~F.col("is_table_row")
    rows = scan(stored(rows, "layout-bodies"), ["project", key], "line_no", maxima={"item_at": F.when(F.col("is_list_item"), at), "end_at": F.when(F.col("is_table_row") | plain & ~F.col("list_wraps"), at)}, previous={"was_table": F.col("is_table_row"), "was_item": F.col("is_list_item")})
    listed = F.coalesce(F.col("item_at"), F.lit(-1)) > F.coalesce(F.col("end_at"), F.lit(-1))
    mode = F.when(F.col("was_table").isNull(), "").when(F.col("was_table"), "table").when(F.col("was_item") | listed, "list").otherwise("paragraph")
    rows = rows.withColumn("mode", mode).withColumn("starts", ~_goes_on(F.col("mode")))
    return _kept(_all_blocks(stored(rows, "layout-starts"), _SEGMENTED, key), key)


def _kept(rows: DataFrame, key: str = "section") -> DataFrame:
    return rows.where("NOT again").select("project", key, "block_no", "type", F.when(F.col("type") == "paragraph", F.col("text")).alias("text"), "items", "rows")


def section_blocks(rows: DataFrame) -> DataFrame:
    """Classified lines to the blocks of their sections: blocks() of sections of any size."""
    return _over(rows, lambda lines_, way: _kept(_all_blocks(_body(lines_).where("section > 0"), way)))


def _body(lines_: DataFrame) -> DataFrame:
    return lines_.where("role = 'body'")


def _all_blocks(rows: DataFrame, way: _Way, key: str = "section", along: tuple[str, ...] = ()) -> DataFrame:
    """rows: body lines with starts; read twice by segments. blocks() with `again` for paragraphs that it drops, and `leaked` for callouts that it repairs. along: columns that are the same in all lines of a section."""
    number = lambda c: F.col(c).cast("int")
    rows = way.scan(rows, ["project", key], "line_no", sums={"starts_before": number("starts"), "items_before": number("is_list_item")})
    rows = rows.withColumns({"block_no": F.col("starts_before") + number("starts") - 1, "item": F.col("items_before") + number("is_list_item")})
    # Lines to list items (a paragraph or a table is one), items to blocks: each in one group-by.
    inner = F.array_sort(F.collect_list(F.struct("line_no", T.trim(F.col("text")).alias("t"), "cells")))
    rows = rows.groupBy("project", key, *along, "block_no", "item").agg(inner.alias("ls"), F.min(F.struct("line_no", "is_table_row", "is_list_item")).alias("first"))
    rows = rows.select("project", key, *along, "block_no", F.struct("item", F.array_join(F.transform("ls", lambda x: x["t"]), " ").alias("t"), F.transform("ls", lambda x: x["cells"]).alias("cells")).alias("x"), "first")
    rows = rows.groupBy("project", key, *along, "block_no").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.min("first").alias("first"))
    kind = F.when(F.col("first.is_table_row"), "table").when(F.col("first.is_list_item"), "list").otherwise("paragraph")
    texts = F.transform("xs", lambda x: x["t"])
    raw = F.array_join(texts, " ")
    text = T.repaired_callout(raw)
    rows = rows.select("project", key, *along, "block_no", kind.alias("type"), text.alias("text"), texts.alias("items"), F.flatten(F.transform("xs", lambda x: x["cells"])).alias("rows"), (raw != text).alias("leaked"))
    run = T.bullets(F.col("text"))
    promoted = (F.col("type") == "paragraph") & F.startswith(T.trim(F.col("text")), F.lit("•")) & (F.size(run) >= 2)
    rows = rows.withColumns({"promoted": promoted, "run": run})
    rows = rows.select("project", key, *along, "block_no", F.when(F.col("promoted"), "list").otherwise(F.col("type")).alias("type"), "text", F.when(F.col("promoted"), F.col("run")).when(F.col("type") == "list", F.col("items")).alias("items"), F.when(F.col("type") == "table", F.col("rows")).alias("rows"), "leaked")
    rows = way.scan(way.kept(rows, "layout-blocks"), ["project", key], "block_no", previous={"was_type": F.col("type"), "was_text": F.col("text")})
    again = (F.col("type") == "paragraph") & F.coalesce((F.col("was_type") == F.col("type")) & (F.col("was_text") == F.col("text")), F.lit(False))
    return rows.withColumn("again", again).drop("was_type", "was_text")


def warnings(rows: DataFrame) -> DataFrame:
    """What files() leaves out, repairs or cannot tell: project, rule, section (null: the whole project), detail."""
    return _over(rows, _warnings)


def _warnings(lines_: DataFrame, way: _Way) -> DataFrame:
    lines_ = lines_ if way is _SEGMENTED else stored(lines_, "layout-numbered")  # read several times
    found = stored(_all_sections(lines_, way), "layout-all-sections")
    whole = F.lit(None).cast("bigint").alias("section")
    per = lines_.groupBy("project").agg(F.count_if(F.col("section") == 0).alias("n"), F.max("section").alias("last"))
    row = lambda df, rule, section, detail: df.select("project", F.lit(rule).alias("rule"), section, detail.cast("string").alias("detail"))
    parts = _all_blocks(_body(lines_).where("section > 0"), way).where(F.col("again") | F.col("leaked") | T.has(F.col("text"), P.C1))
    parts = stored(parts.select("project", "section", "text", "again", "leaked"), "layout-all-blocks")
    return reduce(DataFrame.unionByName, [
        row(per.where("last > 0 AND n > 0"), "lines-before-first-heading", whole, F.col("n")),
        row(per.where("last = 0"), "no-heading", whole, F.col("n")),
        row(found.where("kind IN ('chapter', 'bonus') AND title = ''"), "untitled-heading", F.col("section").cast("bigint"), F.col("heading_text")),
        row(found.where("orphan"), "empty-divider", F.col("section").cast("bigint"), F.col("heading_text")),
        row(parts.where("again"), "repeated-paragraph", F.col("section").cast("bigint"), F.substring("text", 1, 80)),
        row(parts.where("leaked"), "leaked-callout", F.col("section").cast("bigint"), F.regexp_extract("text", r"^> \*\*([^*]*)\*\*", 1)),
        row(parts.where(T.has(F.col("text"), P.C1)), "control-character", F.col("section").cast("bigint"), T.snippet(F.col("text"), P.C1)),
    ])


def files(rows: DataFrame, at_hand: bool = False) -> DataFrame:
    """Classified lines to Markdown files and inventory: project, entry_kind, pos, id, type, number, title, file, start_page, end_page, words, markdown.
    A project without a heading gives one unclassified file of its whole text. at_hand: rows are stored already, so reading them three times is cheap."""
    return _over(rows, _files, at_hand)


def _body_md(blocks_: DataFrame, *along: str) -> DataFrame:
    """_all_blocks() to the Markdown of sections. Section 0 is there for projects without a heading alone."""
    md = F.when(F.col("type") == "paragraph", F.col("text")).when(F.col("type") == "list", F.when(F.col("section") > 0, T.list_markdown(F.col("items"))).otherwise(F.array_join("items", "\n"))).otherwise(T.table_markdown(F.col("rows")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", md.alias("md")))), lambda b: b["md"]), "\n\n")
    return blocks_.where("NOT again").groupBy("project", "section", *along).agg(text.alias("body_md"))


def _named(out: DataFrame) -> DataFrame:
    """Sections with pos and body_md to files."""
    parts = F.array_compact(F.array(F.concat(F.lit("# "), "heading_text"), F.when(F.col("from_next"), F.concat(F.lit("## "), "title")), F.col("body_md")))
    is_bonus = F.col("kind") == "bonus"
    out = out.withColumns({"markdown": F.concat(F.array_join(parts, "\n\n"), F.lit("\n")), "name": F.when(F.col("title") != "", F.col("title")).otherwise(F.col("heading_text"))})
    slug = F.when(T.slug(F.col("name")) != "", T.slug(F.col("name"))).otherwise(F.when(is_bonus, F.concat(F.lit("bonus-"), F.col("pos").cast("string"))).otherwise(F.col("kind")))
    out = out.withColumn("id", F.when(is_bonus, slug).otherwise(F.concat(T.padded(F.col("pos")), F.lit("-"), slug)))
    return out.select("project", F.when(is_bonus, "bonus").otherwise("chapter").alias("entry_kind"), "pos", "id", F.when(~is_bonus, F.col("kind")).alias("type"), "number", F.col("name").alias("title"), F.concat(F.when(is_bonus, "bonuses/raw/").otherwise("chapters/"), "id", F.lit(".md")).alias("file"), "start_page", "end_page", "markdown")


def _unnamed(whole: DataFrame) -> DataFrame:
    """project, pages, body_md of projects without a heading to files."""
    return whole.select("project", F.lit("chapter").alias("entry_kind"), F.lit(0).alias("pos"), F.lit("00-full-text").alias("id"), F.lit("unclassified").alias("type"), F.lit(None).cast("int").alias("number"), F.lit("Full text").alias("title"), F.lit("chapters/00-full-text.md").alias("file"), F.lit(1).cast("int").alias("start_page"), F.col("pages").cast("int").alias("end_page"), F.concat("body_md", F.lit("\n")).alias("markdown"))


def _files(lines_: DataFrame, way: _Way) -> DataFrame:
    out, whole = (_sections_at_once if way is _WHOLE else _sections_by_segments)(lines_, way)
    return _named(out).unionByName(_unnamed(whole)).withColumn("words", T.word_count(F.col("markdown")))


def _sections_at_once(lines_: DataFrame, way: _Way) -> tuple[DataFrame, DataFrame]:
    """Sections with pos and body_md, and body_md of projects without a heading. A project's lines lie in one place, where they become blocks and sections: text is shuffled once, and written once."""
    here = Window.partitionBy("project", "section")
    summary = ["top", "next_title", "n_body", "last", "pages"]
    rows = lines_.where("section > 0 OR headings = 0").select("*", *_summary(lambda c: c.over(here)), F.max("page").over(here).alias("pages"))
    bare = F.col("role").eqNullSafe("head") & (F.col("n_body") == 0)  # stands for a section without a body
    rows = rows.where((F.col("role") == "body") | bare).withColumns({"starts": F.coalesce("starts", F.lit(True)), "about": F.struct(*summary)}).drop(*summary)
    rows = _body_md(_all_blocks(rows, way, along=("about",)), "about")
    rows = rows.select("project", "section", *_described("about."), F.col("about.pages").alias("pages"), F.when(F.col("about.n_body") > 0, F.col("body_md")).alias("body_md"))
    what = F.struct("kind", "title", "number")
    following = F.lead(F.when(F.col("section") > 0, what)).over(Window.partitionBy("project").orderBy("section"))
    rows = rows.withColumn("orphan", F.coalesce((F.col("n_body") == 0) & following.eqNullSafe(what) & following.isNotNull(), F.lit(False))).where("NOT orphan")
    rows = rows.withColumn("is_bonus", F.col("kind") == "bonus")
    rows = way.scan(rows, ["project", "is_bonus"], "section", sums={"pos": F.lit(1)}).withColumn("pos", F.col("pos").cast("int"))
    rows = stored(rows.drop("orphan", "n_body", "is_bonus"), "layout-numbered")
    return rows.where("section > 0"), rows.where("section = 0")


def _sections_by_segments(lines_: DataFrame, way: _Way) -> tuple[DataFrame, DataFrame]:
    """_sections_at_once() of projects whose lines are spread."""
    found = _all_sections(lines_, way).where("NOT orphan").drop("orphan")
    texts = lambda some: _body_md(_all_blocks(_body(some), way))
    out = found.drop("n_body").join(texts(lines_.where("section > 0")), ["project", "section"], "left")
    places = way.scan(found.select("project", "section", (F.col("kind") == "bonus").alias("is_bonus")), ["project", "is_bonus"], "section", sums={"pos": F.lit(1)}).select(F.col("project").alias("of"), F.col("section").alias("in"), F.col("pos").cast("int").alias("pos"))
    out = out.join(places, (F.col("project") == F.col("of")) & (F.col("section") == F.col("in")))
    pages = lines_.where("headings = 0").groupBy(F.col("project").alias("of")).agg(F.max("page").alias("pages"))
    return out, texts(lines_.where("headings = 0")).join(pages, F.col("project") == F.col("of")).select("project", "pages", "body_md")


def inventory_problems(entries: DataFrame) -> DataFrame:
    """entries: project, pos, id, type, start_page, end_page. Page ranges that run backwards or overlap the one before, repeated ids, and unclassified entries that are not alone."""
    w = Window.partitionBy("project").orderBy("pos", "id")
    alone = F.count(F.lit(1)).over(Window.partitionBy("project"))
    same = F.count(F.lit(1)).over(Window.partitionBy("project", "id"))
    rules = F.array_compact(F.array(
        F.when(F.col("end_page") < F.col("start_page"), "backwards"),
        F.when(F.col("start_page") <= F.lag("end_page").over(w), "overlap"),
        F.when(same > 1, "repeated-id"),
        F.when((F.col("type") == "unclassified") & (alone > 1), "fallback-not-alone"),
    ))
    return entries.select("project", "pos", "id", rules.alias("rules")).select("project", "pos", "id", F.explode("rules").alias("rule"))


def page_texts(items: DataFrame) -> DataFrame:
    """items: project, page, item_no, str, x, y, width, height, has_eol. Text of each page in the items' own order: a space after a gap on one line, a line feed where the line
    changes and after an end of line, which also forgets what came before it."""
    w = Window.partitionBy("project", "page").orderBy("item_no")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.col("str") != "", F.struct("item_no", (F.col("x") + F.col("width")).alias("end"), "y"))
    items = items.repartition("project", "page")  # before what the windows look at is put together, which would be shuffled with the rest
    rows = items.withColumns({"before": F.last(filled, ignorenulls=True).over(ahead), "last_eol": F.max(F.when(F.col("has_eol"), F.col("item_no"))).over(ahead)})
    rows = rows.withColumns({"filled": F.col("str") != "", "before": F.when(F.col("last_eol").isNull() | (F.col("last_eol") < F.col("before.item_no")), F.col("before"))})
    end, y = F.col("before.end"), F.col("before.y")
    glue = F.when(end.isNull(), "").when(F.abs(y - F.col("y")) < 2, F.when(F.col("x") - end > F.col("height") * SPACE_GAP, " ").otherwise("")).otherwise("\n")
    rows = rows.withColumn("glue", glue)
    piece = F.concat(F.when(F.col("filled"), F.concat("glue", "str")).otherwise(""), F.when(F.col("has_eol"), "\n").otherwise(""))
    text = F.array_join(F.sort_array(F.collect_list(F.struct("item_no", piece.alias("p"))))["p"], "")
    return rows.groupBy("project", "page").agg(text.alias("text"))
