"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

1. Each source is a queue of its documents in shuffled order (by the MD5 of id and size), repeated `MAX_COPIES` times.
2. A copy's virtual finish time is the source's words up to its end divided by the source's weight.
3. All copies of all sources are range-sorted by it, and the words of the sorted ranges are added up. The mix is cut where they reach the budget, the sum of all sizes: ranges before that
   are taken whole, and in the one range where it lies each copy of which half or more lies before it. A source's taken copies are the beginning of its queue.

What a source should get follows from the totals alone: with W the weights and C the caps (3 times a source's size), T is where
sum(least(C, W * T)) equals the budget, and least(C, W * T) is the target. The cut does not look at it; a source misses it by about one document.

Scale: texts are read once, for their word counts. Rows that agree in id, source and size are one entry a partition, so repeated and null ids are bounded. Running totals are taken inside (source,
first digits of the MD5) and inside the range of the cut, with the totals of those parts added up before, so no task holds a whole source. One task sorts the list of sources, one
the list of ranges.

Edge cases: null text has size 0 and is taken 0 times; null is a source of its own and comes last; a null id is shuffled as
empty text; repeated rows are separate documents; all sizes 0 give targets 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, growing, packed, stored, text_of, unpacked

MAX_COPIES = 3
#: Hexadecimal digits of the MD5 that split a source's queue: 3 make 4096 parts.
PART_DIGITS = 3
#: Numbers that one row is exploded to at once.
STEP = 65_536


def _size() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """source, doc_id, size, n: the rows of docs that agree in these, of each partition. Written once: all steps use it."""
    rows = docs.select("source", "doc_id", _size().alias("size"), F.spark_partition_id().alias("at"))
    return stored(rows.groupBy("source", "doc_id", "size", "at").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target. Each window here runs over the sources, one row each."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    w = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    w = w.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MAX_COPIES)
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    w = w.withColumn("budget", F.sum("source_size").over(all_rows)).withColumn("nth", F.row_number().over(by_ratio))
    w = w.withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("left", (F.col("budget") - F.coalesce("capped", F.lit(0))).cast("double"))
    w = w.withColumn("level", F.col("left") / F.col("weights"))
    w = w.withColumn("first", F.min(F.when(F.col("level") < F.col("ratio"), F.col("nth"))).over(all_rows))
    at_first = lambda c: F.max(F.when(F.col("nth") == F.col("first"), F.col(c))).over(all_rows)
    share = F.col("weight") * at_first("left") / at_first("weights")
    target = F.when(F.col("nth") >= F.col("first"), share).otherwise(F.col("cap").cast("double"))
    return w.select("source", "source_size", "weight", target.alias("target"))


def _each(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row n times, numbered from 0."""
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / STEP))))
    left = F.least(n - F.col("step") * STEP, F.lit(STEP)) - 1
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), left))).withColumn(name, F.col("step") * STEP + F.col(name)).drop("step")


def queues(sizes: DataFrame) -> DataFrame:
    """The entries of sizes with start, the source's words before the entry in its queue."""
    name = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    rows = sizes.withColumn("h", F.md5(name.cast("binary"))).withColumn("part", F.substring("h", 1, PART_DIGITS))
    words = F.col("size") * F.col("n")
    parts = rows.groupBy("source", "part").agg(F.sum(words).alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("aim_source"), F.col("part").alias("aim_part"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.join(growing(parts), F.col("source").eqNullSafe(F.col("aim_source")) & (F.col("part") == F.col("aim_part")))
    return stored(rows.select("source", "doc_id", "size", "n", (F.col("before") + F.col("within")).alias("start")), "mix-queues")


def schedule(queued: DataFrame, aim: DataFrame) -> DataFrame:
    """Every copy of every document that has words, range-sorted by virtual finish time: source, start (the source's words before the copy, those of earlier rounds included), size, finish, range (its number)."""
    aim = aim.select(F.col("source").alias("aim_source"), "source_size", "weight")
    rows = _each(queued.where("size > 0"), F.col("n"), "nth").join(aim, F.col("source").eqNullSafe(F.col("aim_source")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MAX_COPIES - 1))))
    rows = rows.withColumn("start", F.col("copy") * F.col("source_size") + F.col("start") + F.col("nth") * F.col("size"))
    rows = rows.select("source", "start", "size", ((F.col("start") + F.col("size")) / F.col("weight")).alias("finish"))
    order = _order()
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "mix-schedule")


def _order() -> list[Column]:
    return [F.col("finish").asc(), F.col("source").asc_nulls_last(), F.col("start").asc()]


def cut(copies: DataFrame, budget: int) -> DataFrame:
    """aim_source, taken_to: where in each source's queue the last copy begins that lies before the budget in the order of schedule(). Sources without one are not there."""
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    ranges = stored(ranges, "mix-ranges")
    # Ranges are as many as the shuffle has partitions, three numbers each.
    whole = copies.join(F.broadcast(ranges.where(F.col("ahead") + F.col("words") <= budget).select("range")), "range").select("source", "start")
    last = copies.join(F.broadcast(ranges.where((F.col("ahead") < budget) & (F.col("ahead") + F.col("words") > budget)).select("range", "ahead")), "range")
    running = F.coalesce(F.sum("size").over(Window.partitionBy("range").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = last.withColumn("before", F.col("ahead") + running).where(2 * F.col("before") + F.col("size") <= F.lit(2 * budget)).select("source", "start")
    return whole.unionByName(some).groupBy(F.col("source").alias("aim_source")).agg(F.max("start").alias("taken_to"))


def _mixed(docs: DataFrame) -> DataFrame:
    """The entries of docs with source_size, target and taken_to (-1 where nothing is taken)."""
    sizes = sized(docs)
    aim, queued = stored(targets(sizes), "mix-targets"), queues(sizes)
    budget = aim.agg(F.sum("source_size")).first()[0] or 0
    ends = aim.withColumnRenamed("source", "of").join(cut(schedule(queued, aim), budget), F.col("of").eqNullSafe(F.col("aim_source")), "left")
    ends = stored(ends.select("of", "source_size", "target", F.coalesce("taken_to", F.lit(-1)).alias("taken_to")), "mix-ends")
    return queued.join(ends, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _copies(start: Column) -> Column:
    """How many of the copies of a document that begins at start are taken."""
    taken = [(F.lit(i) * F.col("source_size") + start <= F.col("taken_to")).cast("long") for i in range(MAX_COPIES)]
    return F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(0)


def mixture(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken (words, repeats counted)."""
    each = _each(_mixed(docs), F.col("n"), "nth")
    taken = _copies(F.col("start") + F.col("nth") * F.col("size")) * F.col("size")
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, none to MAX_COPIES times, all columns kept. Of rows that share id, source and size, it is left open which
    are taken once more than the others."""
    used = ("doc_id", "text", "source")
    return unpacked(_taken(packed(docs, *used)), docs, *used)


def _taken(docs: DataFrame) -> DataFrame:
    each = _each(_mixed(docs).where("size > 0"), F.col("n"), "nth")
    each = each.select("source", "doc_id", "size", _copies(F.col("start") + F.col("nth") * F.col("size")).alias("copies"))
    counts = each.groupBy(F.col("source").alias("mix_source"), F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size")).agg(F.count(F.lit(1)).alias("mix_n"), F.sum("copies").alias("mix_total"))
    counts = stored(counts, "mix-counts")
    same = docs["doc_id"].eqNullSafe(F.col("mix_id")) & docs["source"].eqNullSafe(F.col("mix_source"))
    repeated = counts.groupBy("mix_id", "mix_source").agg(F.count(F.lit(1)).alias("sizes"), F.max("mix_n").alias("n")).where("sizes > 1 OR n > 1")
    if repeated.isEmpty():  # an id and its source tell a row: its words need no second count
        rows = docs.join(growing(counts.where("mix_total > 0")), same).withColumn("mix_copies", F.col("mix_total"))
    else:
        rows = stored(docs.join(growing(counts), same & (F.regexp_count(docs["text"], F.lit(WORD)) == F.col("mix_size"))).withColumn("mix_at", F.spark_partition_id()), "mix-rows")
        key = ["mix_source", "mix_id", "mix_size"]
        before = Window.partitionBy(*key).orderBy("mix_at").rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.where("mix_n > 1").groupBy(*key, "mix_at").agg(F.count(F.lit(1)).alias("k")).withColumn("mix_before", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
        parts = parts.toDF(*(f"of_{c}" if c != "mix_before" else c for c in parts.columns))
        many = rows.where("mix_n > 1").withColumn("mix_nth", F.row_number().over(Window.partitionBy(*key, "mix_at").orderBy("mix_at")))
        many = many.join(parts, F.col("mix_source").eqNullSafe(F.col("of_mix_source")) & F.col("mix_id").eqNullSafe(F.col("of_mix_id")) & (F.col("mix_size") == F.col("of_mix_size")) & (F.col("mix_at") == F.col("of_mix_at")))
        share = F.floor(F.col("mix_total") / F.col("mix_n"))
        extra = (F.col("mix_before") + F.col("mix_nth") <= F.col("mix_total") - share * F.col("mix_n")).cast("long")
        rows = rows.where("mix_n = 1").withColumn("mix_copies", F.col("mix_total")).select(*docs.columns, "mix_copies").unionByName(many.withColumn("mix_copies", share + extra).select(*docs.columns, "mix_copies"))
        return rows.where("mix_copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_nth")).drop("mix_nth")
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("mix_nth")).drop("mix_nth")


MIX_SQL = r"""
WITH s AS (
  SELECT row_number() OVER () AS id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
w AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::BIGINT AS budget FROM w),
o AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS nth,
    (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
    (sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights FROM r),
f AS (SELECT nth AS first, rest AS f_rest, weights AS f_weights FROM o WHERE rest / weights < ratio ORDER BY nth LIMIT 1),
a AS (
  SELECT source, source_size, weight, budget, CASE WHEN nth >= first THEN weight * f_rest / f_weights ELSE cap::DOUBLE END AS target FROM o LEFT JOIN f ON true),
q AS (
  SELECT s.*, source_size, weight, budget, target,
    (sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ' ' || size), doc_id, size, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM s JOIN a ON s.source IS NOT DISTINCT FROM a.source),
c AS (SELECT id, source, size, budget, copy * source_size + start AS begins, (copy * source_size + start + size)::DOUBLE / weight AS finish FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
t AS (SELECT id, size, 2 * sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, begins) - size <= 2 * budget AS taken FROM c),
k AS (SELECT id, sum(size) AS words FROM t WHERE taken GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(words, 0)::BIGINT AS taken
FROM q LEFT JOIN k USING (id)
"""
