"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session in one process (tests) gets a temporary one; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quireworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quireworks-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, is computed once, and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pressed(df: DataFrame, name: str) -> DataFrame:
    """stored() in little room: compressed harder, and what its plan shuffled is deleted once it is written, as nothing reads that again."""
    spark, path, setting = df.sparkSession, scratch(df.sparkSession, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of marked(): 2 ** 25 take 4 MB, whatever the input.
MARKS, MARKS_EACH = 1 << 25, 1 << 15


def marked(rows: DataFrame, key: str, among: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the first column of `among`, and those whose key certainly is not. A bitmap of hashes, broadcast at a fixed size, parts them without
    a shuffle of the rows; the more keys are marked, the more rows of others come along, so the first part still has to be joined."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    bits = among.select(place(F.col(among.columns[0])).alias("at")).groupBy(F.floor(F.col("at") / MARKS_EACH).alias("mark_bucket")).agg(F.bitmap_construct_agg(F.col("at") % MARKS_EACH).alias("mark_bits"))
    bits = F.broadcast(stored(bits, "marks"))
    at = place(rows[key])
    joined = rows.join(bits, F.floor(at / MARKS_EACH) == F.col("mark_bucket"), "left")
    byte = F.conv(F.hex(F.substring("mark_bits", (F.floor(at % MARKS_EACH / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    on = F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1
    return joined.where(on).select(*[rows[c] for c in rows.columns]), joined.where(~on).select(*[rows[c] for c in rows.columns])


def clear(spark: SparkSession) -> None:
    """Deletes what stored() and scratch() left for this application; call it once no result is read any more."""
    jvm, path = spark.sparkContext._jvm, shared_folder(spark)
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
