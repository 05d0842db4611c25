"""The corpus pipeline: quality rules, exact deduplication, near deduplication, mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet to the shared folder and reads again as the next stage's docs.
The last stage gives the token digests of the mixed documents; a document that the mix takes twice has two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireworks.llm.bpe import round_trip
from quireworks.llm.common import scratch, ship
from quireworks.llm.exact_dedup import drop_copies
from quireworks.llm.mixing import mixed_documents
from quireworks.llm.near_dedup import drop_near_copies
from quireworks.llm.quality_rules import good_documents
from quireworks.llm.queries import TOKENIZER

#: Pieces that a worker remembers while it encodes: fewer than by default, as executors hold what other stages left.
MEMO = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    ship(spark)
    return good_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(spark)
    return round_trip(docs, TOKENIZER, MEMO)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mix), ("bpe round trip", tokens)]

#: Similarity components and byte-level merges have no SQL form of bearable cost; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
