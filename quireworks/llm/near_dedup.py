"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

1. Each text becomes the set of its word shingles, hashed to 64 bits. Rows with equal sets (compared by a 128-bit digest) form one class; only one
   document of each class goes on, so copies are never compared with each other.
2. One-permutation hashing: a set's sorted hashes fall into bins by their high bits, and a bin's value is its least hash. An empty bin takes the value of
   the first filled bin in a fixed random sequence of its own (optimal densification).
3. Bands of `rows` bins give bucket keys. All members of a bucket are joined to one center by a star, so a bucket of n gives n - 1
   candidate edges, not n * n / 2. The center is the member with the most bucket mates over all bands, which for edited copies is what they were copied
   from. A center with its candidates is a cell; any two documents of a bucket share a cell.
4. Cells are checked on full sets, in blocks of `BLOCK` members, each with the center. Members whose set is similar enough to the
   center's are done. The rest of a block is compared with all of the block, and, where a cell has several blocks, with the cell's
   other blocks: so the star bounds the work but loses no link between documents that share a bucket. Pairs are counted inside a block and only
   links that join two parts come out.
5. Components of the links, by least label and pointer jumping, each round a stored table.

The bands are chosen so that two sets just at the threshold miss each other in all buckets with a chance below `MISS`.

Scale: texts are read twice and shuffled once, next to the narrow band rows; sets are shuffled once for each cell of a document that has a candidate.
No key is unbounded in a task: classes are pre-aggregated by (digest, salt), cells are dealt out in blocks, and the joins on
bucket keys and centers are plain sort-merge joins, which adaptive execution splits. Nothing but counters reaches the driver.

Edge cases: a text with fewer words than a shingle is one shingle, its whole word sequence; without words, or null, its set is empty and it is linked with nothing. Rows that share an id and
not a text are linked each by its own text. A null id is linked with nothing and gets a null component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, growing, marked, packed, stored, text_of, unpacked, worker_cache

#: Shingle length and similarity in percent, where a contract does not say otherwise.
WORDS, PERCENT = 5, 80
BANDS = 32
MISS = 1e-5
#: Members of a cell that one task compares at once.
BLOCK = 512
SALTS = 64
#: Blocks of a cell for which a center's set is made in one row.
RUN = 64
#: Parts that a center's edges are spread over when they meet the size of its cell.
PARTS = 16
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MEMO = 200_000


def rows_of(percent: int) -> int:
    """Bins in a band: as many as keep the chance of a miss at the threshold below MISS."""
    share = percent / 100
    return max([r for r in range(1, 33) if (1 - share**r) ** BANDS <= MISS], default=1)


# --- sets and signatures ----------------------------------------------------------------------------------------


def _hashes() -> Memo:
    return worker_cache("words", lambda: Memo(xxhash.xxh3_64_intdigest, MEMO))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles; A-Z lower-cased, words split at the six ASCII spaces."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        total += h[i : len(h) - size + 1 + i] * _ODD[i % len(_ODD)] * np.uint64(2 * (i // len(_ODD)) + 1)
    return np.unique(_mixed(total))


def _fillers(bins: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, bins, (256, bins))


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Densified one-permutation signatures, a row for each set; empty sets have EMPTY throughout."""
    out = np.full((len(sets), bins), EMPTY)
    edges = np.array([(b << 64) // bins + (1 if (b << 64) % bins else 0) for b in range(bins)], np.uint64)
    for row, s in zip(out, sets, strict=True):
        at = np.searchsorted(s, edges)
        filled = np.flatnonzero(np.append(at[1:], len(s)) > at)
        row[filled] = s[at[filled]]
    first = out.copy()
    for step in _fillers(bins):
        rows, cols = np.nonzero(out == EMPTY)
        if not len(rows):
            return out
        out[rows, cols] = first[rows, step[cols]]
    for row, whole in zip(out, first, strict=True):  # sets of a few shingles: the next filled bin
        filled = np.flatnonzero(whole != EMPTY)
        if len(filled):
            gaps = np.flatnonzero(row == EMPTY)
            row[gaps] = whole[filled[np.searchsorted(filled, gaps) % len(filled)]]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, rows)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[7], parts.shape[:2]).copy()
    for i in range(rows):
        total = _mixed(total + parts[:, :, i] * _ODD[i % 7])
    return total.view(np.int64)


def _signed(docs: DataFrame, words: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest, bands."""
    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("digest", "binary").add("bands", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                keys = band_keys(signatures(sets, BANDS * rows), rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), flat], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


# --- candidates -------------------------------------------------------------------------------------------------


def _stars(reps: DataFrame) -> DataFrame:
    """reps: rep, bands. The distinct candidate edges (center, rep) of all buckets."""
    rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(rows.join(growing(shared), "key"), "near-buckets")
    mates = members.groupBy("rep").agg(F.sum("n").alias("mates"))
    scored = members.select("key", "rep").join(growing(mates), "rep")
    best = scored.groupBy("key").agg(F.max(F.struct("mates", (-F.col("rep")).alias("id"))).alias("best"))
    centers = best.select("key", (-F.col("best.id")).alias("center"))
    return members.select("key", "rep").join(growing(centers), "key").where("center != rep").select("center", "rep").distinct()


def _cells(edges: DataFrame) -> DataFrame:
    """edges: center, rep. One row for each place of a document in a block of a cell: rep, center, block, blocks. A center is in all blocks of its cell."""
    sizes = edges.groupBy("center").agg(F.count(F.lit(1)).alias("n")).select("center", (F.floor((F.col("n") - 1) / BLOCK) + 1).cast("int").alias("blocks"))
    salted = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    members = edges.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(PARTS)).cast("int")).join(growing(salted), ["center", "part"]).select("rep", "center", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), "blocks")
    return members.unionByName(sizes.select(F.col("center").alias("rep"), "center", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks"))


def _with_sets(docs: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """places: rep, block and any columns. The same rows with `shingles`, the document's set as bytes. A set is made once for all places of its document, or, for a
    center of many blocks, once for each RUN of them, so that no row's list grows with a cell."""
    columns = [c for c in places.columns if c != "rep"]
    of_rep = places.groupBy("rep", F.floor(F.col("block") / RUN).alias("run")).agg(F.collect_list(F.struct(*columns)).alias("places"))
    joined = docs.select("doc_id", text_of().alias("text")).join(growing(of_rep), F.col("doc_id") == F.col("rep")).select("rep", "places", "text")
    schema = places.select("rep", *columns).schema.add("shingles", "binary")
    kinds = [places.schema[c].dataType.simpleString() for c in columns]
    of_kind = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    to = pa.schema([("rep", pa.int64()), *((c, of_kind[k]) for c, k in zip(columns, kinds, strict=True)), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for rep, at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = shingle_set(text.as_py(), words).tobytes()
                for place in at:
                    rows.append({"rep": rep, **place, "shingles": data})
                    size += len(data)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, to)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, to)

    return joined.mapInArrow(run, schema)


def _grouped(batches, n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of sorted batches, by their first n_keys columns: only one group is in memory."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


# --- comparison -------------------------------------------------------------------------------------------------


class Comparison:
    """Members (id, set) of which some are queries: finds all links of the queries, and gives those that join two parts."""

    def __init__(self, percent: int):
        self.percent = percent
        self.parent: dict = {}

    def root(self, x):
        while self.parent.get(x, x) != x:
            x = self.parent[x] = self.parent.get(self.parent[x], self.parent[x])
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def linked(self, shared, n, m):
        """Whether sets of n and m elements that share some are similar enough: 100 * shared >= percent * (n + m - shared)."""
        return (100 + self.percent) * shared >= self.percent * (n + m)

    def star(self, center, members) -> list[tuple]:
        """Links of the center with each member."""
        c_id, c = center
        out = []
        for m_id, m in members:
            small, large = (m, c) if len(m) < len(c) else (c, m)
            if len(small) and self.linked(len(small), len(small), len(large)):
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                if self.linked(int((large[at] == small).sum()), len(c), len(m)) and self.join(c_id, m_id):
                    out.append((c_id, m_id))
        return out

    def against(self, queries, members) -> list[tuple]:
        """Links of each query with each member, by one index of the members' elements."""
        if not queries or not members:
            return []
        sizes = np.array([len(s) for _, s in members])
        owner = np.repeat(np.arange(len(members)), sizes)
        every = np.concatenate([s for _, s in members])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        out = []
        for q_id, q in queries:
            low = np.searchsorted(every, q, "left")
            count = np.searchsorted(every, q, "right") - low
            places = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared = np.bincount(owner[places], minlength=len(members))
            for i in np.flatnonzero((shared > 0) & self.linked(shared, len(q), sizes)):
                if members[i][0] != q_id and self.join(q_id, members[i][0]):
                    out.append((q_id, members[i][0]))
        return out


def _links(docs: DataFrame, edges: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) that the cells of the edges hold, as far as needed to join what is linked."""
    placed = _with_sets(docs, _cells(edges), words).select("center", "block", "blocks", "rep", "shingles")

    def inside(batches):
        for (center, block, blocks), rows in _grouped(batches, 3):
            sets = [(rep, np.frombuffer(data, np.uint64)) for rep, data in rows]
            comparison, members = Comparison(percent), [x for x in sets if x[0] != center]
            found = [link for x in sets if x[0] == center for link in comparison.star(x, members)]
            rest = [x for x in members if comparison.root(x[0]) != comparison.root(center)]
            found += comparison.against(rest, members) if len(members) > 1 else []
            n, here = len(found), members if blocks > 1 else []
            open_ = {x[0] for x in rest if comparison.root(x[0]) != comparison.root(center)}
            yield pa.RecordBatch.from_pydict(
                {
                    "center": pa.array([center] * (n + len(here)), pa.int64()), "block": pa.array([block] * (n + len(here)), pa.int32()), "blocks": pa.array([blocks] * (n + len(here)), pa.int32()),
                    "a": pa.array([a for a, _ in found] + [x[0] for x in here], pa.int64()), "b": pa.array([b for _, b in found] + [None] * len(here), pa.int64()),
                    "open": pa.array([None] * n + [x[0] in open_ for x in here], pa.bool_()), "shingles": pa.array([None] * n + [x[1].tobytes() for x in here], pa.binary()),
                }
            )

    dealt = placed.repartition("center", "block").sortWithinPartitions("center", "block", "blocks")
    first = stored(dealt.mapInArrow(inside, "center long, block int, blocks int, a long, b long, open boolean, shingles binary"), "near-links")
    links, members = first.where("b IS NOT NULL").select("a", "b"), first.where("b IS NULL").select("center", "block", "blocks", F.col("a").alias("rep"), "open", "shingles")
    if members.where("open").isEmpty():
        return links
    return links.unionByName(stored(_across(members, percent), "near-links-across"))


def _across(members: DataFrame, percent: int) -> DataFrame:
    """members: those of cells of several blocks. Links of the open ones, which no link of their block joins to the center, with the cell's other blocks.
    Queries and members meet in pairs of blocks."""
    asked = members.where("open").groupBy("center").agg(F.count(F.lit(1)).alias("n")).select("center", (F.floor((F.col("n") - 1) / BLOCK) + 1).cast("int").alias("q_blocks"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = members.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(PARTS)).cast("int")).join(growing(asked), ["center", "part"])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sought = rows.select("center", "block", each("q_blocks").alias("q_block"), F.lit(False).alias("query"), "rep", "shingles")
    queries = rows.where("open").select("center", each("blocks").alias("block"), F.pmod(F.xxhash64("rep", F.lit(2)), "q_blocks").cast("int").alias("q_block"), F.lit(True).alias("query"), "rep", "shingles")

    def between(batches):
        for _, found in _grouped(batches, 3):
            sets = [(query, (rep, np.frombuffer(data, np.uint64))) for query, rep, data in found]
            links = Comparison(percent).against([x for q, x in sets if q], [x for q, x in sets if not q])
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    placed = sought.unionByName(queries)
    return placed.repartition("center", "block", "q_block").sortWithinPartitions("center", "block", "q_block").mapInArrow(between, "a long, b long")


# --- components -------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Each linked id with the least id of its component: id, component."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = stored(both.where("u != v").distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("component")).withColumnRenamed("u", "id"), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("near"))
        seen = labels.join(near, F.col("id") == F.col("u")).select("id", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        seen = stored(seen, "labels-seen")
        jump = seen.select(F.col("id").alias("to"), F.col("label").alias("beyond"))
        after = seen.join(jump, F.col("label") == F.col("to"), "left").select("id", "was", F.coalesce("beyond", "label").alias("component"))
        after = stored(after, "labels")
        if after.where("component != was").isEmpty():
            return after.select("id", "component")
        labels = after.select("id", "component")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the least doc_id reachable over links), kept. Ids that are no whole numbers get numbers in their order for the work, at the cost
    of a shuffle of all texts."""
    rows = docs.select("doc_id", "text")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _near_groups(rows, words, percent)
    ids = rows.where("doc_id IS NOT NULL").select("doc_id").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = stored(ids.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("number")), "near-ids")
    found = _near_groups(rows.join(growing(ids), F.col("doc_id") == F.col("id"), "left").select(F.col("number").alias("doc_id"), "text"), words, percent)
    found = found.join(growing(ids), F.col("doc_id") == F.col("number"), "left").select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
    least = ids.select(F.col("id").alias("least"), F.col("number").alias("of"))
    return found.join(growing(least), F.col("component_id") == F.col("of"), "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"), "kept")


def _near_groups(docs: DataFrame, words: int, percent: int) -> DataFrame:
    rows = rows_of(percent)
    signed = stored(_signed(docs.withColumn("doc_id", F.col("doc_id").cast("long")), words, rows), "near-signatures")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    parts = some.groupBy("digest", salt).agg(F.min("doc_id").alias("least"))
    whole = parts.groupBy("digest").agg(F.min("least").alias("rep"))
    classes = stored(parts.select("digest", "salt").join(whole, "digest"), "near-classes")
    reps = some.join(growing(classes.select("digest", "rep").distinct().withColumnRenamed("digest", "of")), (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("rep"))).select("rep", "bands")
    edges = stored(_stars(reps), "near-edges")
    found = components(_links(docs.withColumn("doc_id", F.col("doc_id").cast("long")), edges, words, percent))
    labelled = classes.join(found, F.col("rep") == F.col("id"), "left").select("digest", F.col("salt").alias("in"), F.coalesce("component", "rep").alias("component"))
    linked = F.col("n_shingles") > 0
    out = signed.where(linked & F.col("doc_id").isNotNull()).select("doc_id", "n_shingles", "digest", salt)
    out = out.join(growing(labelled.withColumnRenamed("digest", "of")), (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("in")))
    alone = signed.where(~linked | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, all columns kept. Rows that share an id with a kept row stay with it."""
    found = stored(near_groups(docs, words, percent).select("doc_id", "kept"), "near-found")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = stored(gone.join(found.where("kept").select(F.col("doc_id").alias("gone_id")), "gone_id", "left_anti"), "near-gone")
    touched, rest = marked(packed(docs, "doc_id"), "doc_id", gone)
    return unpacked(touched.join(growing(gone), F.col("doc_id") == F.col("gone_id"), "left_anti").unionByName(rest), docs, "doc_id")


NEAR_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 185 * shared >= 85 * (na.n + nb.n)),
r AS (SELECT doc_id, doc_id AS seen FROM t UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
