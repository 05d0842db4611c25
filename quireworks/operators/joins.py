"""Joins of document parts: required equi joins, position joins, anti joins, containment joins, bag intersection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import marked, stored

#: Characters of a substring by which titles and words meet, and how many of a title's are looked at.
GRAM, PROBES = 8, 16


def with_content(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries and files share `path`. The inner join, and the entries without a file (which must be none)."""
    return entries.join(files, "path"), entries.join(files, "path", "left_anti")


def with_required_content(entries: DataFrame, files: DataFrame) -> DataFrame:
    """The join of with_content(), in which an entry without a file stops the run and is named."""
    rows = entries.join(files.withColumn("is_there", F.lit(True)), "path", "left")
    missing = F.raise_error(F.concat(F.lit("no file "), F.coalesce(F.col("path").cast("string"), F.lit("without a path")))).cast("boolean")
    return rows.where(F.coalesce("is_there", missing)).drop("is_there")


def by_position(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Rows of each project paired by rank; what one side has more is left out."""
    rank = lambda df, c: df.withColumn("position", F.row_number().over(Window.partitionBy("project").orderBy(c)) - 1)
    return rank(left, order_left).join(rank(right, order_right), ["project", "position"])


def paired_or_unmarked(pages: DataFrame, previews: DataFrame) -> DataFrame:
    """pages: project, page, exempt; previews: project, page, ink. Previews with the page's exemption, which falls away for a project whose counts differ."""
    counts = pages.groupBy("project").agg(F.count(F.lit(1)).alias("n_pages")).join(previews.groupBy("project").agg(F.count(F.lit(1)).alias("n_previews")), "project", "full")
    rows = previews.join(pages, ["project", "page"], "left").join(counts, "project")
    return rows.select("project", "page", "ink", F.coalesce((F.col("n_pages") == F.col("n_previews")) & F.col("exempt"), F.lit(False)).alias("exempt"))


def _grams(text, sizes):
    """All substrings of the given sizes (a column of numbers, 1 to GRAM), once each; of a text that is shorter none. In one pass over the text for each size."""
    of = lambda n: F.when(F.array_contains(sizes, n), F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, range(1, GRAM + 1))))


def not_contained(titles: DataFrame, outline: DataFrame) -> DataFrame:
    """titles: project, id, title; outline: project, title. Titles that, white space and case aside, no outline title of their project contains.
    Titles that are an outline title are known by a join. Each other one looks at up to PROBES of its substrings of GRAM characters (a shorter one at those of three or one) and meets the outline titles that have
    the rarest of these, so beginnings that all titles share cost nothing. Equal titles are sought once."""
    wanted = titles.select("project", "id", "title", T.squeezed(F.col("title")).alias("needle"))
    hay = outline.select("project", T.squeezed(F.col("title")).alias("hay")).distinct()
    outlined = hay.select("project").distinct()
    needles = wanted.select("project", "needle").where("needle IS NOT NULL AND project IS NOT NULL").distinct()
    left = needles.where("needle != ''").join(hay.withColumnRenamed("hay", "needle"), ["project", "needle"], "left_anti").unionByName(needles.where("needle = ''"))
    left = left.join(outlined.withColumn("is_outlined", F.lit(True)), "project", "left").where("needle != '' OR is_outlined IS NULL")  # nothing is contained in any title
    left = stored(left, "titles-left")
    sought = left.where("needle != '' AND is_outlined").select("project", "needle")
    size = F.when(F.length("needle") >= GRAM, GRAM).when(F.length("needle") >= 3, 3).otherwise(1)  # three sizes, so that an outline title has three sets of substrings at most
    last = F.length("needle") - size  # the probes are spread over the needle
    probes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.substring(F.col("needle"), (F.floor(i * last / (PROBES - 1)) + 1).cast("int"), size)))
    sizes = sought.groupBy("project").agg(F.collect_set(size).alias("sizes"))
    # Hashes stand for substrings and outline titles until the texts are compared, so two that share a hash cost a comparison and no more.
    key, hay_id = F.xxhash64("project", "gram").alias("key"), F.xxhash64("project", "hay").alias("hay_id")
    asked = sought.select("project", "needle", F.explode(probes).alias("gram")).select("project", "needle", key)
    held = hay.join(sizes, "project").select(hay_id, "project", F.explode(_grams(F.col("hay"), F.col("sizes"))).alias("gram")).select(key, "hay_id")
    held = stored(marked(held, "key", asked.select("key").distinct())[0], "titles-held")  # most substrings are nobody's probe
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, "key", "left").groupBy("project", "needle").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    rarest = stored(rarest, "titles-rarest")
    held = marked(held, "key", rarest.select("key").distinct())[0]
    met = rarest.join(held, "key").select("project", "needle", "hay_id").join(hay.withColumn("hay_id", hay_id), ["project", "hay_id"])
    met = met.where(F.contains("hay", F.col("needle"))).select("project", "needle").distinct()
    missing = left.select("project", "needle").join(met, ["project", "needle"], "left_anti")
    unknown = wanted.where("needle IS NULL OR project IS NULL")  # is contained in none
    return wanted.join(missing, ["project", "needle"], "left_semi").unionByName(unknown.select("project", "needle", "id", "title")).select("project", "id", "title")


def lookups(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted: project, id; entries: project, id, title, file. Each wanted entry, or a problem that lists the ids that the project has: project, id, title, file, problem."""
    known = entries.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("known"))  # an inventory's ids
    rows = wanted.join(entries, ["project", "id"], "left").join(known, "project", "left")
    problem = F.concat(F.lit('No entry with id "'), "id", F.lit('". Known ids: '), F.coalesce("known", F.lit("(none)")), F.lit("."))
    return rows.select("project", "id", "title", "file", F.when(F.col("file").isNull(), problem).alias("problem"))


def broken_targets(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """targets and ids: project, target. Targets without an element of that id."""
    return targets.join(ids, ["project", "target"], "left_anti")


def contained_lines(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """lines: line_id, line; texts: text_id, text. Pairs where the text contains the line, white space and case aside; a blank line is contained in none. A line meets texts that have
    its rarest inner word as a word. A line without an inner word, which is one or two words long, meets texts with a word that holds its longest one, found by their substrings."""
    flat = lambda c: F.lower(T.collapse(c, " "))
    needles = lines.select("line_id", flat(F.col("line")).alias("needle")).where(F.trim("needle") != "")
    split = F.split("needle", " ")
    needles = needles.withColumn("inner", F.filter(F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0))), lambda w: w != ""))
    hay = texts.select("text_id", flat(F.col("text")).alias("hay"))
    words = hay.select("text_id", F.explode(F.array_distinct(F.split("hay", " "))).alias("word"))
    inner = needles.select("line_id", F.explode(F.array_distinct("inner")).alias("word"))
    often = words.join(inner.select("word").distinct(), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = inner.join(often, "word", "left").groupBy("line_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"), F.max(F.col("n").isNull()).alias("nowhere"))
    rarest = stored(rarest.where("NOT nowhere").select("line_id", "word"), "lines-rarest")  # a word that no text has: no text has the line
    candidates = words.join(rarest, "word").select("line_id", "text_id")
    short = needles.where(F.size("inner") == 0)
    if not short.isEmpty():
        piece = F.array_max(F.transform(split, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        short = short.select("line_id", piece.alias("piece")).withColumn("gram", F.substring("piece", 1, GRAM))
        sizes = short.agg(F.collect_set(F.length("gram")).alias("sizes"))  # one row, GRAM numbers at most
        vocabulary = words.select("word").distinct().join(F.broadcast(sizes)).select("word", F.explode(_grams(F.col("word"), F.col("sizes"))).alias("gram"))
        holds = stored(short.join(vocabulary, "gram").where(F.contains("word", F.col("piece"))).select("line_id", "word"), "lines-short")
        candidates = candidates.unionByName(words.join(holds, "word").select("line_id", "text_id").distinct())
    return candidates.join(needles.select("line_id", "needle"), "line_id").join(hay, "text_id").where(F.contains("hay", F.col("needle"))).select("line_id", "text_id")


def drawn(pool: DataFrame, groups: DataFrame) -> DataFrame:
    """pool: project, word, n; groups: project, name, priority, word, n; a group's rows of one word are added up. Each group draws its words from the project's pool, in order of priority: per group
    matched and total. A group's draw is the pool's part between the running totals before and after it."""
    # A word of which the pool has enough for all is drawn by all in full. Only the others' rows have to be put in order, found by a bitmap before they are shuffled.
    there = pool.select(F.col("project").alias("of"), F.col("word").alias("scarce"), F.col("n").alias("there"))
    needed = groups.groupBy("project", "word").agg(F.sum("n").alias("needed"))
    scarce = needed.join(there, (F.col("project") == F.col("of")) & (F.col("word") == F.col("scarce")), "left").where("needed > coalesce(there, 0)")
    scarce = stored(scarce.select(F.xxhash64("project", "word").alias("word_key"), "project", "word", F.coalesce("there", F.lit(0)).alias("there")), "drawn-scarce")
    rows = marked(groups.withColumn("word_key", F.xxhash64("project", "word")), "word_key", scarce.select("word_key"))[0]
    rows = rows.groupBy("project", "name", "priority", "word").agg(F.sum("n").alias("n")).join(scarce.drop("word_key"), ["project", "word"])
    # Groups are dealt out in ranges of their order. A word's running total is that of the ranges before, and that inside its own range, so a word that all groups have is in no one task.
    rows = stored(rows, "drawn-rows")
    rows = stored(rows.repartitionByRange("project", "priority").withColumn("range", F.spark_partition_id()), "drawn-words")
    before = Window.partitionBy("project", "word").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("project", "word", "range").agg(F.sum("n").alias("of_range")).withColumn("ahead", F.coalesce(F.sum("of_range").over(before), F.lit(0))).drop("of_range")
    inside = Window.partitionBy("project", "word", "range").orderBy("priority", "name").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("so_far", F.sum("n").over(inside)).join(ranges, ["project", "word", "range"]).withColumn("so_far", F.col("so_far") + F.col("ahead"))
    got = F.least("there", F.col("so_far")) - F.least("there", F.col("so_far") - F.col("n"))
    short = rows.select("project", "name", "priority", (F.col("n") - got).alias("short")).where("short != 0").withColumn("n", F.lit(0).cast("long"))
    every = groups.select("project", "name", "priority", F.lit(0).cast("long").alias("short"), F.col("n").cast("long").alias("n")).unionByName(short)
    return every.groupBy("project", "name", "priority").agg((F.sum("n") - F.sum("short")).alias("matched"), F.sum("n").alias("total"))


def coverage(draws: DataFrame, least: float = 0.95) -> DataFrame:
    """Totals of drawn() for each project: coverage, and whether the total and each group reach `least`. A group without words does not fail."""
    share = F.try_divide(F.col("matched"), F.col("total"))
    return draws.groupBy("project").agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"), F.bool_and(F.coalesce(share >= least, F.lit(True))).alias("groups_pass")).select(
        "project", "matched", "total", F.try_divide(F.col("matched"), F.col("total")).alias("coverage"), (F.col("groups_pass") & F.coalesce(F.try_divide(F.col("matched"), F.col("total")) >= least, F.lit(True))).alias("passes")
    )
