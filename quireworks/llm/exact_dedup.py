"""Exact deduplication, with DataFrame functions only.

Texts are equal when identical after deleting white space. Rows are grouped by the first 128 bits of
the SHA-256 of that normal form; of each group the row with the most code points in its
original text stays, then the smallest id. Bytes are compared inside each group, so a collision of the 128 bits
cannot merge different texts.

Scale: texts are hashed where they are scanned, and only (hash, id, length) is shuffled. Groups are pre-aggregated by
(hash, salt), so a group that holds a third of all rows is spread over `SALTS` keys in every shuffle, whatever the ids. For the comparison members of groups of two or more
are marked in a bitmap of ids (4 MB): other rows are neither hashed again nor shuffled, as long as the marked ids are few against its 2 ** 25 bits; beyond that more rows take part, never fewer.
Each task hands on two texts of a group at most.

Edge cases: null text counts as empty; all empty texts form one group; a null id sorts before all others; rows
repeated with the same id and text are all marked as kept (`drop_copies` keeps one of them); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, growing, marked, packed, stored, text_of, unpacked

#: Parts that the rows of one hash are spread over.
SALTS = 64


def normal_form(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, norm, digest (32 bytes), k (its first 16)."""
    rows = docs.select("doc_id", text_of().alias("raw")).select("doc_id", F.char_length("raw").cast("long").alias("n_chars"), normal_form(F.col("raw")).alias("norm"))
    return rows.withColumn("digest", F.unhex(F.sha2("norm", 256))).withColumn("k", F.substring("digest", 1, 16))


def _groups(rows: DataFrame, *key: str) -> DataFrame:
    """rows: key, salt, doc_id, n_chars. For each key and salt the size of the key's whole group and the row that stays."""
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").alias("keep_id"))
    parts = rows.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
    whole = parts.groupBy(*key).agg(F.sum("n").alias("group_size"), F.min("best").alias("keep"))
    return parts.select(*key, "salt").join(whole, list(key))


def _salted(rows: DataFrame) -> DataFrame:
    """rows, each with a part of its group by its place in the table: null and repeated ids are spread as well. The result has to be stored."""
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs).drop("n_chars", "k")


def _decided(docs: DataFrame) -> DataFrame:
    """exact_groups() with n_chars, the row's own length, and k."""
    narrow = stored(_salted(_keyed(docs).drop("norm")), "exact-rows")
    decided = stored(_result(narrow.join(_groups(narrow, "k"), ["k", "salt"])), "exact-groups")
    collided = _collisions(docs, decided)
    if collided.isEmpty():
        return decided
    # Different texts share 128 bits: their rows are grouped by the text itself.
    apart = stored(_salted(_keyed(docs).join(collided, "k", "left_semi")), "exact-apart")
    fine = apart.join(_groups(apart, "k", "norm"), ["k", "norm", "salt"])
    return stored(decided.join(collided, "k", "left_anti").unionByName(_result(fine)), "exact-groups")


def _collisions(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The k of groups whose texts are not all the same bytes: their least and their greatest text differ. Only rows that share their k with
    others are compared, found by their ids; each task hands on two texts of a group at most."""
    members, _ = marked(docs.select("doc_id", "text"), "doc_id", decided.where("group_size > 1").select("doc_id"))
    ends = _keyed(members).groupBy("k").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return stored(ends.where("low != high").select("k"), "exact-collisions")


def _result(rows: DataFrame) -> DataFrame:
    stays = F.col("doc_id").eqNullSafe(F.col("keep.keep_id")) & (F.col("n_chars") == -F.col("keep.less"))
    return rows.select("doc_id", F.col("keep.keep_id").alias("keep_id"), "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars", "k")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups() does not keep, all columns kept. Of rows repeated with one id in a group, one stays."""
    found = _decided(docs).select("kept", "group_size", F.col("doc_id").alias("exact_id"), F.col("text_sha256").alias("exact_sha256"), F.col("n_chars").alias("exact_chars"))
    same = ["exact_id", "exact_sha256"]
    gone = found.where("NOT kept").drop("kept", "group_size")
    twice = stored(found.where("kept AND group_size > 1").groupBy(*same).count().where("count > 1").select(*same), "exact-twice")
    # Rows whose id no dropped or repeated row has stay where they are.
    touched, rest = marked(packed(docs, "doc_id", "text"), "doc_id", gone.select("exact_id").unionByName(twice.select("exact_id")))
    rows = touched.withColumns({"own_sha256": F.sha2(normal_form(text_of()), 256), "own_chars": F.char_length(text_of()).cast("long")})
    own = F.col("doc_id").eqNullSafe(F.col("exact_id")) & (F.col("own_sha256") == F.col("exact_sha256"))
    gone, twice = growing(gone), growing(twice)
    out = rows.join(gone, own & (F.col("own_chars") == F.col("exact_chars")), "left_anti")
    if not twice.isEmpty():
        one = out.join(twice, own, "left_semi").dropDuplicates(["doc_id", "own_sha256"])
        out = out.join(twice, own, "left_anti").unionByName(one)
    return unpacked(out.select("doc_id", "text", "rest").unionByName(rest), docs, "doc_id", "text")


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id, max(n) AS longest FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
