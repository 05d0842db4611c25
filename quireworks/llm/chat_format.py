"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that participant as the assistant and all others as named users; system turns stay system
turns. The loss mask covers what the assistant says, with the end mark of each of its turns. Turns come in the order of turn, speaker, text.

A rendering is cut into chunks of `CHUNK` turn numbers, and a chunk into parts of `CHUNK` turns (more than one where turns share a number), one row each. Joined in the order of chunk and
part they are the whole rendering, which whole_dialogues() gives for conversations that fit one row; spans and `start` say where a part's trained pieces lie in it, and where it begins in the whole.

Scale: turns of chunks that are one part are grouped by it. Those of other chunks are first dealt out in ranges of their order, where a turn's place in its chunk is the count of those in the ranges before
and its place inside its own. So whatever is repeated or null,
no row holds more than `CHUNK` turns, and no task a conversation; one task sorts the sizes of a conversation's parts, a few numbers each.

Edge cases: null text counts as empty; a null role is a speaker named `unknown`; null turns come first and form a chunk of their own, -1; null conv_id is a conversation of
its own; repeated rows and turns with equal numbers are all rendered; a conversation with system turns alone has no participant and gives no row; the marks' strings in a text are
broken up by a space, and line feeds in names become spaces. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import marked, stored, text_of

CHUNK = 64
SYSTEM = "system"
# The marks of the chat format.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    for mark in (BEGIN, END):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    return text


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows: conv_id, chunk and the columns of the order. Adds part: each CHUNK rows of a chunk in order are one."""
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "nth").drop("nth")
    rows = stored(rows.withColumn("range", F.spark_partition_id()), "chat-turns")
    ahead = Window.partitionBy("conv_id", "chunk").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("conv_id", "chunk", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    ranges = ranges.select(F.col("conv_id").alias("of"), F.col("chunk").alias("of_chunk"), F.col("range").alias("of_range"), "ahead")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "chunk", "range").orderBy(*order)) - 1)
    rows = rows.join(ranges, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk")) & (F.col("range") == F.col("of_range")))
    return rows.select("conv_id", "chunk", *order, F.floor((F.col("ahead") + F.col("at")) / CHUNK).alias("part"))


def perspectives(turns: DataFrame, speaker: str = "role") -> DataFrame:
    """turns: conv_id, turn, text and the speaker's column. conv_id, participant, chunk, part, text, spans (begin and end of trained parts
    in text), n_turns, n_chars, start (the rendering's characters before the part)."""
    name = F.replace(F.coalesce(F.col(speaker), F.lit("unknown")), F.lit("\n"), F.lit(" "))
    rows = turns.select("conv_id", "turn", name.alias("speaker"), _plain(text_of()).alias("text"))
    people = stored(rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("participant")).distinct(), "chat-people")
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-1)).cast("long"))
    order = ["turn", "speaker", "text"]
    crowded = stored(rows.groupBy(F.col("conv_id").alias("of"), F.col("chunk").alias("of_chunk")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK), "chat-crowded")
    parts = rows.withColumn("part", F.lit(0).cast("long"))
    if not crowded.isEmpty():
        same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk"))
        touched, rest = marked(rows, "conv_id", crowded.select("of"))  # turns of other conversations are not moved for this
        alone = rest.unionByName(touched.join(crowded, same, "left_anti")).withColumn("part", F.lit(0).cast("long"))
        parts = alone.unionByName(_numbered(touched.join(crowded, same, "left_semi"), order))
    chunks = parts.groupBy("conv_id", "chunk", "part").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("turns"))
    chunks = stored(chunks, "chat-chunks")

    def head(t: Column) -> Column:
        other = F.concat(F.lit("user name="), t["speaker"])
        role = F.when(t["speaker"] == SYSTEM, F.lit(SYSTEM)).when(t["speaker"] == F.col("participant"), F.lit("assistant")).otherwise(other)
        return F.concat(F.lit(BEGIN), role, F.lit("\n"))

    # Where the parts begin follows from the lengths of their turns alone; texts meet the result once.
    lengths = chunks.select("conv_id", "chunk", "part", F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), F.length(t["text"]).alias("n"))).alias("ts"))
    chars = F.aggregate("ts", F.lit(0).cast("long"), lambda n, t: n + F.length(head(t)) + t["n"] + len(END) + 1)
    before = Window.partitionBy("conv_id", "participant").orderBy("chunk", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "participant", "chunk", "part", chars.alias("chars"))
    starts = starts.select(F.col("conv_id").alias("of"), "participant", F.col("chunk").alias("of_chunk"), F.col("part").alias("of_part"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"))
    views = chunks.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk")) & (F.col("part") == F.col("of_part")))
    part = lambda t: F.struct((t["speaker"] == F.col("participant")).alias("trained"), head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"))
    views = views.withColumn("parts", F.transform("turns", part))
    size = lambda p: (F.length(p["head"]) + F.length(p["body"]) + 1).cast("long")
    span = lambda at, p: F.struct((at + F.length(p["head"])).cast("long").alias("begin"), (at + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    step = lambda s, p: F.struct((s["at"] + size(p)).alias("at"), F.when(p["trained"], F.concat(s["spans"], F.array(span(s["at"], p)))).otherwise(s["spans"]).alias("spans"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    views = views.select("conv_id", "participant", "chunk", "part", "start", text.alias("text"), F.aggregate("parts", zero, step).alias("s"), F.size("parts").cast("long").alias("n_turns"))
    return views.select("conv_id", "participant", "chunk", "part", "text", F.col("s.spans").alias("spans"), "n_turns", F.col("s.at").alias("n_chars"), "start")


def whole_dialogues(views: DataFrame) -> DataFrame:
    """views: perspectives(). One row for each conversation and participant, for conversations that fit a row: conv_id, participant, text, spans (in that text), n_turns."""
    moved = F.transform("spans", lambda s: F.struct((s["begin"] + F.col("start")).alias("begin"), (s["end"] + F.col("start")).alias("end")))
    rows = views.groupBy("conv_id", "participant").agg(F.sort_array(F.collect_list(F.struct("chunk", "part", "text", moved.alias("spans")))).alias("ps"), F.sum("n_turns").alias("n_turns"))
    return rows.select("conv_id", "participant", F.array_join(F.transform("ps", lambda p: p["text"]), "").alias("text"), F.flatten(F.transform("ps", lambda p: p["spans"])).alias("spans"), "n_turns")


def perspective_rows(turns: DataFrame) -> DataFrame:
    """perspectives() with the spans as text."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return perspectives(turns).withColumn("spans", spans)


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), chr(10), ' ') AS speaker, coalesce(floor(turn / 64), -1)::BIGINT AS chunk,
    replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id AS owner, speaker AS participant FROM t WHERE speaker <> 'system'),
k AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn NULLS FIRST, speaker, text) - 1) // 64 AS part FROM t),
v AS (
  SELECT conv_id, participant, chunk, part, turn, speaker, text, speaker = participant AS trained,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head,
    text || '<|im_end|>' AS body, row_number() OVER (PARTITION BY conv_id, participant, chunk, part ORDER BY turn NULLS FIRST, speaker, text) AS nth
  FROM k JOIN p ON conv_id IS NOT DISTINCT FROM owner),
o AS (
  SELECT *, (sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, chunk, part ORDER BY nth) - length(head) - length(body) - 1)::BIGINT AS pos FROM v),
c AS (
  SELECT conv_id, participant, chunk, part, string_agg(head || body || chr(10), '' ORDER BY nth) AS text,
    coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body)), ',' ORDER BY nth) FILTER (trained), '') AS spans,
    count(*) AS n_turns, sum(length(head) + length(body) + 1)::BIGINT AS n_chars FROM o GROUP BY ALL)
SELECT *, (coalesce(sum(n_chars) OVER (PARTITION BY conv_id, participant ORDER BY chunk, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM c
"""
