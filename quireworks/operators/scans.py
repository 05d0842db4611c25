"""Segmented scans: what comes before a row in its group, for groups of any size.

A group's rows are cut into segments by their place in it. Each segment is reduced to one row, its totals, maxima and last row; these are composed over the segments of a group, and each segment then runs once
with what it enters with. Segments are the unit of work, so a group that holds a third of all rows is spread like any other, and the cost is linear in the rows.

An automaton whose states are set, reset or kept by each row needs no table: it is in the state if the last row that set it comes after the last row that reset it, which two maxima tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a group in a segment.
SEGMENT = 4096


def scan(rows: DataFrame, keys: list[str], at: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, totals: dict[str, Column] | None = None) -> DataFrame:
    """rows with, by name: the sum and the maximum of an expression over the rows before (0 and null where there are none), its value in the row just before (null in a group's first row), and its sum over the whole
    group. at: the row's place in its group, a whole number from 0 on, not twice the same in a group; gaps are allowed. keys are not null. rows are read twice."""
    sums, maxima, previous, totals = sums or {}, maxima or {}, previous or {}, totals or {}
    segment = "segment_of_scan"
    rows = rows.withColumn(segment, F.floor(F.col(at) / SEGMENT))
    inside = Window.partitionBy(*keys, segment).orderBy(at)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, segment).agg(
        *(F.sum(c).alias(f"sum_{n}") for n, c in (sums | totals).items()), *(F.max(c).alias(f"max_{n}") for n, c in maxima.items()), *([F.max_by(F.struct(*(c.alias(n) for n, c in previous.items())), at).alias("last_row")] if previous else []),
    )
    every, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(segment)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    entering = parts.select(
        *(F.col(k).alias(f"entering_{i}") for i, k in enumerate(keys)), F.col(segment).alias("entering_segment"), *(F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"in_{n}") for n in sums), *(F.max(f"max_{n}").over(before).alias(f"in_{n}") for n in maxima),
        *([F.lag("last_row").over(earlier).alias("in_row")] if previous else []), *(F.sum(f"sum_{n}").over(every).alias(f"in_{n}") for n in totals),
    )
    own = rows.withColumns(
        {f"own_{n}": F.coalesce(F.sum(c).over(ahead), F.lit(0)) for n, c in sums.items()} | {f"own_{n}": F.max(c).over(ahead) for n, c in maxima.items()} | ({"own_row": F.lag(F.struct(*(c.alias(n) for n, c in previous.items()))).over(inside)} if previous else {})
    )
    same = F.col(segment) == F.col("entering_segment")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"entering_{i}"))
    out = own.join(entering, same)
    before_row = F.coalesce("own_row", "in_row") if previous else None
    return out.select(
        *[c for c in rows.columns if c != segment], *((F.col(f"in_{n}") + F.col(f"own_{n}")).alias(n) for n in sums), *(F.greatest(f"in_{n}", f"own_{n}").alias(n) for n in maxima),
        *(before_row[n].alias(n) for n in previous), *(F.col(f"in_{n}").alias(n) for n in totals),
    )


def plain_scan(rows: DataFrame, keys: list[str], at: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, totals: dict[str, Column] | None = None) -> DataFrame:
    """scan() for groups of bounded size: a group is one window, and rows that lie together by some of the keys are not shuffled again."""
    group, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(at)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.coalesce(F.sum(c).over(ahead), F.lit(0)) for n, c in (sums or {}).items()} | {n: F.max(c).over(ahead) for n, c in (maxima or {}).items()}
    return rows.withColumns(found | {n: F.lag(c).over(order) for n, c in (previous or {}).items()} | {n: F.sum(c).over(group) for n, c in (totals or {}).items()})
