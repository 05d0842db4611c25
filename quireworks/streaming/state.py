"""Stage results as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assembly import exit_code


def running_state(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """results: a stream of project, stage, status, finished_at (timestamp). The last result of each project's stage in each day; rows later than `late` are left out, which bounds the state."""
    rows = results.withWatermark("finished_at", late).groupBy(F.window("finished_at", "1 day").alias("day"), "project", "stage")
    out = rows.agg(F.max_by("status", "finished_at").alias("status"), F.max("finished_at").alias("finished_at"))
    return out.select(F.col("day.start").alias("day"), "project", "stage", "status", exit_code(F.col("status")).alias("exit_code"), "finished_at")
