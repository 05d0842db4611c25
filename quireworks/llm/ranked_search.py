"""Ranked lexical search: three-phase uniform threshold (TPUT) over term-partitioned postings, for all queries at once.

1. Lists. Documents are numbered, and each BLOCK of them is inverted where it is read; only terms of some query go on, found by a bitmap of fixed size and then by a join. A list is a term's documents with their
   parts of a score before the term's weight, best first, in one row for each block.
2. Heads. The `HEAD` best documents of each list are the lower bound: a query adds up what they give to it, and its k-th best sum is a score that k documents reach.
3. Threshold. A document that has less than t from each list of a query cannot get more than the sum of what each list can give below t: the least of t and the list's best. The query's threshold is the
   largest t for which that sum is below its lower bound, the same for all its lists. Only postings that reach a threshold of some query of a group leave their list; they meet the group's queries
   by blocks of documents. There a document's known parts are added up; it stays while these, and what the other lists can give below the threshold, reach the query's bound and the block's own k-th best sum.
4. Lookups. The k-th best known sum over all blocks is the second bound. Documents that can still reach it are looked up in all lists of their query, and ranked by their exact scores.

Every bound holds for ties too: what can equal the k-th best stays to the end.

Scale: texts are read once. A posting takes some bytes, and lists are shuffled once by term, once with the queries' groups. A list has a row for each block, so a term that is in all documents is as
spread as the documents; rows of a block are at most BLOCK documents times a group's terms. Queries go in groups of `QUERIES`, so their number is bounded nowhere. Two numbers reach the
driver (documents and terms in all), and the bitmap, 4 MB.

Edge cases: null text and text without terms match nothing; repeated documents and documents that share an id rank one by one; equal scores go by id, a null id first, then by place in the table; repeated queries rank each;
a query without terms gives no rows; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import growing, stored, text_of

#: Documents in a block (a power of 2), and queries in a group.
BLOCK_BITS, QUERIES = 11, 256
BLOCK = 1 << BLOCK_BITS
#: Documents of a list's head: at least the results that a query asks for.
HEAD = 128
#: Bits of the bitmap of queried terms, whatever their number.
MARKS, MARKS_EACH = 1 << 25, 1 << 15
#: Postings of one output batch.
POSTINGS = 1 << 20
#: Parts in which a query's sums are ranked first.
PARTS = 64

# Fixed values of the contract: what a term is, and the numbers of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_LOWER = {c: c + 32 for c in range(65, 91)}
UNIT, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE = 1_000_000_000, 1000, 8, 90


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))


def asked(queries: DataFrame) -> DataFrame:
    """queries: item_id, text. q (a number), item_id, term: the distinct terms of each row."""
    rows = queries.select("item_id", F.array_distinct(_terms(text_of())).alias("terms"))
    return stored(rows.withColumn("q", F.monotonically_increasing_id()).select("q", "item_id", F.explode("terms").alias("term")), "search-asked")


def _bitmap(vocabulary: DataFrame) -> np.ndarray:
    """The places of all terms as bits, in 4 MB whatever their number: more terms let more postings through, never fewer."""
    place = F.crc32(F.col("term").cast("binary")) % MARKS
    rows = vocabulary.select(place.alias("at")).groupBy(F.floor(F.col("at") / MARKS_EACH).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % MARKS_EACH).alias("bits"))
    out = np.zeros(MARKS // 8, np.uint8)
    for row in rows.toLocalIterator():
        out[row["part"] * MARKS_EACH // 8 :][: MARKS_EACH // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def inverted(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """docs: doc_id, text. For each block and term: term, block, docs (places in the block), tfs, ns (the documents' terms in all). A row without term has all documents of its block that
    have terms, with ids."""
    marks = docs.sparkSession.sparkContext.broadcast(_bitmap(vocabulary))
    schema = T.StructType().add("term", T.StringType()).add("block", T.LongType()).add("docs", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.IntegerType())).add("ns", T.ArrayType(T.LongType()))
    schema = schema.add("ids", T.ArrayType(docs.schema["doc_id"].dataType))

    def run(batches):
        bits = marks.value
        known: dict[str, bool] = {}

        def is_asked(term: str) -> bool:
            at = zlib.crc32(term.encode()) % MARKS
            return bool(bits[at >> 3] >> (at & 7) & 1)

        def flush():
            rows = [(None, [at for at, _, _ in members], None, [n for _, n, _ in members], [x for *_, x in members])] if members else []
            rows += [(term, at, tf, n, None) for term, (at, tf, n) in lists.items()]
            size = 0
            first = 0
            for i, row in enumerate(rows):
                size += len(row[1])
                if size >= POSTINGS or i + 1 == len(rows):
                    part = rows[first : i + 1]
                    column = lambda k, kind: pa.array([x[k] for x in part], kind)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [column(0, pa.string()), pa.array([block] * len(part), pa.int64()), column(1, pa.list_(pa.int32())), column(2, pa.list_(pa.int32())), column(3, pa.list_(pa.int64())), column(4, pa.list_(id_type))],
                        ["term", "block", "docs", "tfs", "ns", "ids"],
                    )
                    size, first = 0, i + 1

        block, members, lists, id_type = None, [], defaultdict(lambda: ([], [], [])), pa.null()
        for batch in batches:
            id_type = batch.column(1).type
            for at, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if at >> BLOCK_BITS != block:
                    yield from flush()
                    block, members = at >> BLOCK_BITS, []
                    lists.clear()
                found = terms_of(text.as_py())
                if not found:
                    continue
                members.append((at & (BLOCK - 1), len(found), doc_id))
                for term, tf in Counter(found).items():
                    keep = known.get(term)
                    if keep is None:
                        if len(known) > 200_000:
                            known.clear()
                        keep = known[term] = is_asked(term)
                    if keep:
                        x = lists[term]
                        x[0].append(at & (BLOCK - 1))
                        x[1].append(tf)
                        x[2].append(len(found))
        yield from flush()

    numbered = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", text_of().alias("text"))
    return stored(numbered.mapInArrow(run, schema), "search-inverted")


def lists_of(found: DataFrame, vocabulary: DataFrame, documents: int, words: int) -> DataFrame:
    """found: inverted(). For each queried term and block: term, block, docs and gains (the score's part before the weight), best first."""
    div = lambda a, b: F.call_function("div", a, b)
    length = lambda n: F.lit(100 - LENGTH_SHARE).cast("long") + div(n * F.lit(LENGTH_SHARE * documents).cast("long"), F.lit(words).cast("long"))
    gain = lambda x: div(x["tfs"].cast("long") * UNIT, x["tfs"].cast("long") * TF_UNIT + length(x["ns"]) * LENGTH_UNIT)
    rows = found.where("term IS NOT NULL").join(growing(vocabulary), "term")
    pairs = F.array_sort(F.transform(F.arrays_zip("docs", "tfs", "ns"), lambda x: F.struct((-gain(x)).alias("less"), x["docs"].alias("doc"))))
    rows = rows.select("term", "block", pairs.alias("x"))
    return stored(rows.select("term", "block", F.transform("x", lambda x: x["doc"]).alias("docs"), F.transform("x", lambda x: -x["less"]).alias("gains")), "search-lists")


def weighted(lists: DataFrame, documents: int) -> DataFrame:
    """lists: lists_of(). term, weight and most (the best score that the list gives), for terms of some weight."""
    rows = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.col("gains")[0]).alias("best"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2) * F.lit(documents) + 2).cast("double") / (F.lit(2) * F.col("df") + 1).cast("double"))).cast("long")
    return stored(rows.select("term", weight.alias("weight"), "best").where("weight > 0 AND best > 0").select("term", "weight", (F.col("weight") * F.col("best")).alias("most")), "search-weights")


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """sums: q, at, total. q, bound: each query's k-th best sum, for queries that have k; ranked in parts first."""
    part = F.pmod(F.xxhash64("at"), F.lit(PARTS))
    rows = sums.select("q", "total", F.row_number().over(Window.partitionBy("q", part).orderBy(F.desc("total"))).alias("nth")).where(F.col("nth") <= k)
    rows = rows.select("q", "total", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"))).alias("nth"))
    return rows.where(F.col("nth") == k).select("q", F.col("total").alias("bound"))


def threshold(most: list[int], bound: int) -> int:
    """The largest t for which lists that can give `most` give less than bound in all, where each gives less than t; 1 if there is none."""
    spare, left = bound - 1, sorted(most)
    for i, x in enumerate(left):
        if x * (len(left) - i) > spare:
            return max(1, spare // (len(left) - i) + 1)
        spare -= x
    return left[-1] + 1 if left else 1


def _prepared(terms: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """terms: q, term, weight, most. One row per query: q, terms, weights, most, bound (of the heads), threshold, group (about QUERIES of them share one)."""
    top = lists.select("term", "block", F.explode(F.slice(F.arrays_zip("docs", "gains"), 1, HEAD)).alias("x")).select("term", "block", "x.docs", "x.gains")
    nth = F.row_number().over(Window.partitionBy("term", F.pmod("block", F.lit(PARTS))).orderBy(F.desc("gains")))
    top = top.withColumn("nth", nth).where(F.col("nth") <= HEAD)
    top = top.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("gains")))).where(F.col("nth") <= HEAD)
    sums = terms.join(growing(top), "term").groupBy("q", (F.col("block") * BLOCK + F.col("docs")).alias("at")).agg(F.sum(F.col("weight") * F.col("gains")).alias("total"))
    bounds = _kth(sums, k).withColumnRenamed("q", "of")
    rows = terms.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("term", "weight", "most"))).alias("x"))
    rows = rows.join(growing(bounds), F.col("q") == F.col("of"), "left").select("q", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"), F.col("x.most").alias("most"), F.coalesce("bound", F.lit(0)).cast("long").alias("bound"))

    @F.pandas_udf("long")
    def least(most: pd.Series, bound: pd.Series) -> pd.Series:
        return pd.Series([threshold(list(map(int, x)), int(b)) for x, b in zip(most, bound, strict=True)])

    rows = stored(rows.withColumn("threshold", least("most", "bound")), "search-queries")
    return rows.withColumn("group", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-rows.count() // QUERIES)))).cast("int"))


def candidates(lists: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """lists: term, block, docs, gains. queries: q, terms, weights, most, bound, threshold, group. q, at, known, reach: for the documents that can be among a query's k best, what is known of their
    scores, and the most that they can be."""
    least = F.call_function("div", F.col("threshold") + F.col("x.weights") - 1, F.col("x.weights"))
    wanted = queries.select("group", "threshold", F.explode(F.arrays_zip("terms", "weights", "most")).alias("x")).where("x.most >= threshold")
    wanted = wanted.groupBy(F.col("x.terms").alias("of"), "group").agg(F.min(least).alias("least"))
    fetched = lists.join(growing(wanted), (F.col("term") == F.col("of")) & (F.col("gains")[0] >= F.col("least")))
    n = F.size(F.filter("gains", lambda x: x >= F.col("least")))
    fetched = stored(fetched.select("group", "block", "term", F.slice("docs", F.lit(1), n).alias("docs"), F.slice("gains", F.lit(1), n).alias("gains")), "search-fetched")
    blocks = fetched.select(F.col("group").alias("batch"), F.col("block").alias("in")).distinct()
    at_blocks = queries.join(growing(blocks), F.col("group") == F.col("batch")).select("batch", "in", "q", "terms", "weights", "most", "bound", "threshold")

    def meet(found: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        of = {t: (np.asarray(d), np.asarray(g)) for t, d, g in zip(found["term"], found["docs"], found["gains"], strict=True)}
        out = []
        for q, terms, weights, most, bound, least_ in zip(*(sought[c] for c in ("q", "terms", "weights", "most", "bound", "threshold")), strict=True):
            known, rest = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            unseen = 0  # what all lists can give below the threshold
            for term, weight, top in zip(terms, weights, most, strict=True):
                below = min(top, least_ - 1)
                unseen += below
                if top >= least_ and term in of:
                    docs, gains = of[term]
                    n = np.searchsorted(-gains, -(-(-least_ // weight)), "right")  # gains fall
                    known[docs[:n]] += weight * gains[:n]
                    rest[docs[:n]] += below
            seen = np.flatnonzero(known)
            if not len(seen):
                continue
            reach = known[seen] + unseen - rest[seen]
            if len(seen) >= k:
                bound = max(bound, int(np.partition(known[seen], len(seen) - k)[len(seen) - k]))
            keep = reach >= bound
            out.append(pd.DataFrame({"q": q, "at": found["block"].iloc[0] * BLOCK + seen[keep], "known": known[seen][keep], "reach": reach[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "at": [], "known": [], "reach": []}, dtype="int64")

    def met(found: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        return meet(found, sought) if len(found) and len(sought) else pd.DataFrame({"q": [], "at": [], "known": [], "reach": []}, dtype="int64")

    return fetched.groupBy("group", "block").cogroup(at_blocks.groupBy("batch", "in")).applyInPandas(met, "q long, at long, known long, reach long")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k documents (doc_id, text) of highest score above 0 for each row of queries (item_id, text): item_id, rank, doc_id, score."""
    if k > HEAD:
        raise ValueError(f"at most {HEAD} results")
    sought = asked(queries)
    vocabulary = stored(sought.select("term").distinct(), "search-vocabulary")
    found = inverted(docs, vocabulary)
    members = found.where("term IS NULL")
    documents, words = members.agg(F.sum(F.size("docs")), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    documents, words = documents or 0, words or 1
    lists = lists_of(found, vocabulary, documents, words)
    weights = weighted(lists, documents)
    terms = stored(sought.join(growing(weights), "term").select("q", "term", "weight", "most"), "search-terms")
    prepared = _prepared(terms, lists, k)
    some = stored(candidates(lists, prepared, k), "search-candidates")
    bounds = _kth(some.select("q", "at", F.col("known").alias("total")), k).withColumnRenamed("q", "of")
    left = some.join(growing(bounds), F.col("q") == F.col("of"), "left").where(F.col("reach") >= F.coalesce("bound", F.lit(0))).select("q", "at")
    left = stored(left, "search-left")
    # Lookups: each term of a query in the block of each of its documents.
    wanted = left.join(growing(terms), "q").select("q", "at", "weight", F.col("term").alias("of"), F.shiftright("at", BLOCK_BITS).alias("in"), F.pmod("at", F.lit(BLOCK)).cast("int").alias("doc"))
    gain = F.element_at("gains", F.array_position("docs", F.col("doc")).cast("int"))
    known = wanted.join(growing(lists), (F.col("of") == F.col("term")) & (F.col("in") == F.col("block"))).where(F.array_contains("docs", F.col("doc"))).select("q", "at", (F.col("weight") * gain).alias("part"))
    scores = known.groupBy("q", "at").agg(F.sum("part").alias("score")).where("score > 0")
    ids = members.select(F.col("block").alias("in"), F.explode(F.arrays_zip("docs", "ids")).alias("x")).select((F.col("in") * BLOCK + F.col("x.docs")).alias("place"), F.col("x.ids").alias("doc_id"))
    scores = scores.join(growing(ids), F.col("at") == F.col("place"))
    order = (F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("at"))
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy("q", F.pmod(F.xxhash64("at"), F.lit(PARTS))).orderBy(*order))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    names = sought.select(F.col("q").alias("of"), "item_id").distinct()
    return best.join(growing(names), F.col("q") == F.col("of")).select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS words FROM t),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM b JOIN f USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
