"""Readers of whole documents. Paths can be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# The inventory's form.
CHAPTER = "id string, type string, number int, title string, file string, startPage int, endPage int, wordCount int"
BONUS = "id string, title string, file string, startPage int, endPage int, wordCount int"
INVENTORY = f"schemaVersion int, project string, chapters array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in CHAPTER.split(', ')))}>>, bonuses array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in BONUS.split(', ')))}>>, warnings array<string>"


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One row per JSON file, with its path."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.input_file_name())


def inventories(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark, path, INVENTORY)


def inventory_entries(found: DataFrame) -> DataFrame:
    """Chapters and bonuses of inventories as rows: project, entry_kind, pos, then the entry's fields."""
    chapters = found.select("project", F.lit("chapter").alias("entry_kind"), F.posexplode("chapters").alias("pos", "e")).select("project", "entry_kind", "pos", "e.*")
    bonuses = found.select("project", F.lit("bonus").alias("entry_kind"), F.posexplode("bonuses").alias("pos", "e")).select("project", "entry_kind", "pos", "e.*")
    return chapters.unionByName(bonuses, allowMissingColumns=True)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each template, comments taken out."""
    return markdown_files(spark, path).withColumn("text", X.without_comments(F.col("text")))


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def template(spark: SparkSession, path: str) -> str:
    """One template, comments taken out. A missing one is an error."""
    if not _there(spark, path):
        raise FileNotFoundError(f"no template at {path}")
    return templates(spark, path).first().text


def theme(spark: SparkSession, folder: str, name: str) -> dict:
    """One theme's name, fonts and palette. A missing one is an error."""
    path = f"{folder}/{name}/tokens.json"
    if not _there(spark, path):
        raise FileNotFoundError(f"no theme {name} in {folder}")
    row = theme_presets(spark, path).first()
    return {"name": row.name, "fonts": row.fonts, "palette": row.palette}


def build_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of stage results (assembly.run_stage), or None where no stage has run yet."""
    return spark.read.parquet(path) if _there(spark, path) else None


def project_folder(spark: SparkSession, root: str, project: str) -> str:
    """A project's folder. A missing one, or a name that leaves the root, is an error."""
    if not project or "/" in project or project in (".", ".."):
        raise ValueError(f"no project name: {project!r}")
    if not _there(spark, f"{root}/{project}"):
        raise FileNotFoundError(f"no project {project} in {root}")
    return f"{root}/{project}"


def ensured_form(spark: SparkSession, path: str, blank: str) -> str:
    """The text of a filled form. Where there is none a blank one is put there, and the error says to fill it."""
    if not _there(spark, path):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        a, b = jvm.org.apache.hadoop.fs.Path(blank), jvm.org.apache.hadoop.fs.Path(path)
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
        raise FileNotFoundError(f"{path} was missing; fill the blank form that is there now")
    return markdown_files(spark, path).first().text


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, content of each file."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def theme_presets(spark: SparkSession, path: str) -> DataFrame:
    """Theme files: name, fonts and palette as maps."""
    return json_documents(spark, path, "name string, fonts map<string,string>, palette map<string,string>")


def flat_settings(files: DataFrame) -> DataFrame:
    """files: path, text of YAML mappings, two levels, with plain or quoted scalars and lists of scalars: path, key (a.b), pos (null but for list items), value."""
    rows = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("i", "raw"))
    rows = rows.withColumn("line", F.regexp_replace("raw", r"(^|\s)#.*$", "")).where(F.trim("line") != "")
    key = F.regexp_extract("line", r"^(\s*)([A-Za-z0-9_-]+):\s*(.*)$", 2)
    value = F.regexp_extract("line", r"^(\s*)([A-Za-z0-9_-]+):\s*(.*)$", 3)
    item = F.regexp_extract("line", r"^\s*-\s+(.*)$", 1)
    is_item = F.regexp_like("line", F.lit(r"^\s*-\s"))
    rows = rows.withColumns({"is_item": is_item, "key": F.when(~is_item, key), "value": F.when(is_item, item).otherwise(value), "top": ~is_item & ~F.startswith("line", F.lit(" "))})
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("i")
    rows = rows.withColumns({"group": F.last(F.when(F.col("top"), F.col("key")), True).over(w), "owner": F.last(F.when(~F.col("is_item"), F.when(F.col("top"), F.col("key")).otherwise(F.concat(F.last(F.when(F.col("top"), F.col("key")), True).over(w), F.lit("."), "key"))), True).over(w)})
    bare = F.regexp_replace(F.trim("value"), r"""^(["'])(.*)\1$""", "$2")
    rows = rows.withColumn("text", bare).where("text != ''")
    pos = F.when(F.col("is_item"), F.row_number().over(Window.partitionBy("path", "owner", "is_item").orderBy("i")) - 1)
    return rows.select("path", F.col("owner").alias("key"), pos.alias("pos"), F.col("text").alias("value"))
