"""From lines on pages to findings, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, layout, markdown
from ..storage import stored


def ingested(items: DataFrame) -> DataFrame:
    """items: project, page, item_no, str, x, y, width, height. Files with their inventory fields (layout.files)."""
    return layout.files(layout.classified_items(items), at_hand=True)


def audited(files: DataFrame) -> DataFrame:
    """files: layout.files(). All findings. The files are stored, as each detector reads them."""
    named = stored(files, "audited-files").withColumn("file_id", F.col("file"))
    entries = named.select("project", F.struct("entry_kind", "pos").alias("pos"), F.col("file").alias("id"), "title")
    return audit.findings(entries, named.select("project", "file_id", "start_page", "end_page", F.col("markdown").alias("text")))


def planned(files: DataFrame) -> DataFrame:
    """files: layout.files(). The chapters' budget figures, by project and file."""
    chapters = stored(files.where("entry_kind = 'chapter'"), "planned-files")
    keyed = chapters.select(F.struct("project", "file").alias("file_id"), "type", F.col("markdown").alias("text"))
    return markdown.chapter_plans(keyed).select("file_id.*", "component_counts", "editorial_body_ratio", "estimated_pages", "min_non_body", "actual_non_body", "warnings")
