"""Token-id files of patched frame-of-reference blocks.

A file is a Parquet table of segments, in ascending document order; each segment holds whole documents and packs all their ids into
one binary value:

    magic "PFOR1", then little-endian u32: number of ids n, number of blocks, number of exceptions
    block starts    u32 for each block: where its packed values begin, in bytes from the payload
    block minima    u32 for each block
    block widths    u8 for each block, bits of a packed value
    exceptions      u32 positions in the segment, ascending, then u32 values over the block's width
    payload         for each block: (id - minimum) modulo 2 ** width, `width` bits each, least bit first

A block has `BLOCK` ids, the last one fewer. Its width is the least that holds `PERCENTILE` of its differences; ids that need more are its exceptions.

Parquet carries the segments so that Spark's own writers and readers, and so any store that Spark reaches, serve for the
files, and lost tasks are written again without traces of the first attempt.

Null text counts as empty: such a document has the end id alone. Null ids come first; repeated rows are separate
documents; an empty table gives no segments and no rows; other columns are ignored. A document of any length is one segment at most, a
segment is closed once it has `SEGMENT` ids.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import Memo, cut_at_spaces, give_back, scratch, single_spaces, text_of, windows, without_gc, worker_cache

BLOCK = 256
PERCENTILE = 0.95
SEGMENT = 1 << 18
MAGIC = b"PFOR1"
#: Bytes of a worker's memo of pieces, as counted: its objects and ENTRY for an entry's headers and place. When full, it starts anew.
MEMO, ENTRY = 128 << 20, 190
#: Pieces that the library encodes in one string; bytes of text that are encoded at once.
PART, SLICE = 8192, 12 << 20


# --- the format -------------------------------------------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each of the values (below 2 ** 32) needs; 0 for 0."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _squeezed(values: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of rows of BLOCK values as rows of BLOCK * w / 8 bytes. 64 values fill w words of 64 bits; each step handles one place of all."""
    v = np.ascontiguousarray(values.reshape(-1, 64).T, np.uint64) & np.uint64((1 << w) - 1)
    out = np.zeros((w, v.shape[1]), np.uint64)
    for i in range(64):
        word, at = divmod(i * w, 64)
        out[word] |= v[i] << np.uint64(at)
        if at + w > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - at)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(len(values), -1)


def _spread(data: np.ndarray, w: int) -> np.ndarray:
    """The values of _squeezed()."""
    words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u8").reshape(-1, w).T).astype(np.uint64)
    out, mask = np.empty((64, words.shape[1]), np.uint32), np.uint64((1 << w) - 1)
    for i in range(64):
        word, at = divmod(i * w, 64)
        v = words[word] >> np.uint64(at)
        if at + w > 64:
            v |= words[word + 1] << np.uint64(64 - at)
        out[i] = v & mask
    return out.T.reshape(len(data), BLOCK)


def pack(ids: np.ndarray) -> bytes:
    """The bytes of one segment."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return MAGIC + struct.pack("<III", 0, 0, 0)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n], full[n:] = ids, ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(1)
    rest = full - low[:, None]
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - (blocks - 1) * BLOCK
    at = np.ceil(PERCENTILE * sizes).astype(np.int64) - 1
    wide = np.partition(rest, at[0], 1)[:, at[0]]
    wide[-1] = np.sort(rest[-1, : sizes[-1]])[at[-1]]
    width = _bits(wide)
    over = np.flatnonzero((rest >= np.left_shift(np.uint64(1), width.astype(np.uint64))[:, None]).ravel()[:n])
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            for r, p in zip(rows, _squeezed(rest[rows], int(w)), strict=True):
                parts[r] = p.tobytes()
    if sizes[-1] < BLOCK:
        parts[-1] = parts[-1][: -(-int(sizes[-1]) * int(width[-1]) // 8)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype("<u4")
    head = MAGIC + struct.pack("<III", n, blocks, len(over))
    return b"".join([head, starts.tobytes(), low.astype("<u4").tobytes(), width.tobytes(), over.astype("<u4").tobytes(), rest.ravel()[over].astype("<u4").tobytes(), *parts])


def _header(data: bytes):
    n, blocks, over = struct.unpack_from("<III", data, len(MAGIC))
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a segment")
    at = len(MAGIC) + 12
    starts = np.frombuffer(data, "<u4", blocks, at)
    low = np.frombuffer(data, "<u4", blocks, at + 4 * blocks)
    width = np.frombuffer(data, np.uint8, blocks, at + 8 * blocks)
    at += 9 * blocks
    places, values = np.frombuffer(data, "<u4", over, at), np.frombuffer(data, "<u4", over, at + 4 * over)
    return n, starts, low, width, places, values, at + 8 * over


def _blocks(data: bytes, which: np.ndarray) -> np.ndarray:
    """The ids of some blocks of a segment, `BLOCK` a row; behind the segment's end a row holds anything."""
    n, starts, low, width, places, values, body = _header(data)
    out = np.zeros((len(which), BLOCK), np.uint32)
    raw = np.frombuffer(data + bytes(4 * BLOCK), np.uint8)
    for w in np.unique(width[which]):
        if not w:
            continue
        rows = np.flatnonzero(width[which] == w)
        take = body + starts[which[rows]].astype(np.int64)[:, None] + np.arange(BLOCK * int(w) // 8)
        out[rows] = _spread(raw[take], int(w))
    if len(places):
        row_of = np.full(len(starts), -1)
        row_of[which] = np.arange(len(which))
        mine = row_of[places // BLOCK] >= 0
        out[row_of[places[mine] // BLOCK], places[mine] % BLOCK] = values[mine]
    return out + low[which][:, None]


def unpack(data: bytes) -> np.ndarray:
    """All ids of a segment."""
    n, starts = _header(data)[:2]
    return _unpack_range(data, 0, n) if n else np.zeros(0, np.uint32)


def _unpack_range(data: bytes, begin: int, end: int) -> np.ndarray:
    """Ids begin to end of a segment; only their blocks are read, found by the index of block starts."""
    if begin >= end:
        return np.zeros(0, np.uint32)
    first, last = begin // BLOCK, (end - 1) // BLOCK
    step, out = 1024, []  # the unpacked bits of so many blocks are in memory at once
    for at in range(first, last + 1, step):
        out.append(_blocks(data, np.arange(at, min(at + step, last + 1))).ravel())
    return np.concatenate(out)[begin - first * BLOCK : end - first * BLOCK]


read_range = _unpack_range


# --- encoding with the tokenizers library -----------------------------------------------------------------------


class Pieces:
    """Texts -> ids, by the tokenizers library, a slice of texts at a time. Texts are cut at single spaces between characters that are no
    white space, where the byte-level pattern always ends a pre-token; a slice's distinct pieces are encoded once, and numbers stand for them until the ids are gathered.
    New words of letters go to the library's model, other new pieces to the whole library in one string, whose ids are dealt out by the tokens' lengths in bytes. A
    memo keeps pieces that a slice has more than once."""

    def __init__(self, file: bytes):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.points = Memo(lambda x: self._library([x])[0].tobytes(), 10_000)
        data = json.loads(file)
        sizes = {i: len(w) for w, i in data["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in data["added_tokens"]}
        #: Bytes of each token: the vocabulary spells a byte as one character.
        self.length = np.zeros(max(sizes) + 1, np.int64)
        self.length[list(sizes)] = list(sizes.values())
        self.memo: dict[str, bytes] = {}
        self.held = 0  # bytes of the memo

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # without offsets

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of new pieces, each with the space before it."""
        out = []
        for start in range(0, len(pieces), PART):
            part = pieces[start : start + PART]
            ids = self._library([" " + " ".join(part)])[0]
            ends = np.cumsum([len(p.encode()) + 1 for p in part])
            at = np.searchsorted(np.cumsum(self.length[ids]), ends, "left") + 1
            raw, begin = ids.tobytes(), 0
            for end in (4 * at).tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def _letters(self, word: str) -> bytes:
        """The ids of letters, with or without a space before them: one pre-token, which the library's model takes as it is, spelt in the byte alphabet."""
        spelt = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _simple(self, text: str, space: str, words: dict[str, bytes]) -> bytes | None:
        """The ids of letters and ASCII points after them, which are a pre-token of their own; None if text is anything else."""
        word = text.rstrip(string.punctuation)
        if not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
            return None
        ids = words.get(space + word)
        if ids is None:
            ids = words[space + word] = (self.memo.get(word) if space else None) or self._letters(space + word)
        return ids + self.points[text[len(word) :]] if len(word) < len(text) else ids

    def _known(self, pieces: list[str], often: np.ndarray) -> list[bytes]:
        """The ids of distinct pieces; `often` marks those that the memo is to keep."""
        found = list(map(self.memo.get, pieces))
        gone = [i for i, x in enumerate(found) if x is None]
        words: dict[str, bytes] = {}
        rest = []
        for i in gone:
            line, feed, after = pieces[i].partition("\n")
            ids = self._simple(line, " ", words)
            if feed and ids:  # a line feed between other characters is a pre-token of its own
                more = self._simple(after, "", words)
                ids = more and ids + self.points[feed] + more
            if ids:
                found[i] = ids
            else:
                rest.append(i)
        for i, ids in zip(rest, self._learn([pieces[i] for i in rest]), strict=True):
            found[i] = ids
        if self.held > MEMO:
            self.memo.clear()
            self.held = 0
        for i in gone:
            if often[i] and len(pieces[i]) < 64:
                self.held += ENTRY + 2 * len(pieces[i]) + len(found[i])
                self.memo[pieces[i]] = found[i]
        return found

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice of texts, `end` after each, and how many each has."""
        lists, counts = _cut(texts)
        ends = np.cumsum(counts)
        heads = ends - counts
        coded = lists.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).copy()
        pieces = coded.dictionary.to_pylist()
        # A text's first piece has no space before it.
        first = lists.take(pa.array(heads)).dictionary_encode()
        n = np.bincount(which, minlength=len(pieces))
        n -= np.bincount(which[heads], minlength=len(pieces))
        used = np.flatnonzero(n)
        ids: list[bytes] = [b""] * len(pieces)
        for i, x in zip(used.tolist(), self._known([pieces[i] for i in used.tolist()], n[used] > 1), strict=True):
            ids[i] = x
        which[heads] = len(ids) + first.indices.to_numpy(zero_copy_only=False)
        ids += [x.tobytes() for x in self._library(first.dictionary.to_pylist())]
        ids.append(struct.pack("<I", end))
        which = np.insert(which, ends, len(ids) - 1)
        raw = pa.array(ids, pa.large_binary()).take(pa.array(which))
        offsets = np.frombuffer(raw.buffers()[1], np.int64, len(which) + 1) // 4
        return np.frombuffer(raw.buffers()[2], "<u4", offsets[-1]), np.diff(offsets[ends + np.arange(1, len(ends) + 1)], prepend=0)


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a slice of texts, and how many each has: at least one, which may be empty."""
    simple, other = [], {}
    for i, text in enumerate(texts.to_pylist()):
        if text and not single_spaces(text):
            other[i], text = cut_at_spaces(text), ""
        simple.append(text)
    lists = pc.split_pattern(pa.array(simple, pa.large_string()), " ")
    if other:
        parts, last = [], 0
        for i, cut in other.items():
            parts += [lists.slice(last, i - last), pa.array([cut], lists.type)]
            last = i + 1
        lists = pa.concat_arrays([*parts, lists.slice(last)])
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(pieces: Pieces, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids and sizes of a column of texts, in slices of about SLICE bytes. A longer text is a slice of its own, encoded in windows."""
    bytes_ = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = bytes_[at - 1] if at else 0
        stop = int(np.searchsorted(bytes_, before + SLICE, "right"))
        if stop > at:
            yield pieces.encode(texts.slice(at, stop - at), end)
            at = stop
        else:
            parts = [pieces.encode(pa.array([x]), end)[0][:-1] for x in windows(texts[at].as_py(), SLICE)]
            ids = np.concatenate([*parts, np.array([end], "<u4")])
            yield ids, np.array([len(ids)])
            at += 1


def _pieces(file: bytes) -> Pieces:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return worker_cache(("pieces", hash(file)), lambda: Pieces(file))


# --- files ------------------------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encodes docs (doc_id, text), appends end_id to each, and writes the segments to path in ascending doc_id order."""
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # about 2 MB, whatever the input
    key = docs.schema["doc_id"].dataType.simpleString()
    def run(batches) -> Iterator[pa.RecordBatch]:
        pieces, part, before = _pieces(file.value), TaskContext.get().partitionId(), 0
        names, sizes, parts, total = [], [], [], 0
        for batch in without_gc(batches):
            column, row = batch.column(0), 0
            for ids, counts in _slices(pieces, batch.column(1), end_id):
                ends, at, done = np.cumsum(counts), 0, 0
                while at < len(counts):  # up to the document that fills the segment
                    stop = min(int(np.searchsorted(ends, done + SEGMENT - total)) + 1, len(counts))
                    names.append(column.slice(row + at, stop - at))
                    sizes.append(counts[at:stop])
                    parts.append(ids[done : ends[stop - 1]])
                    total += int(ends[stop - 1]) - done
                    at, done = stop, int(ends[stop - 1])
                    if total >= SEGMENT:
                        yield _segment(part, before, names, sizes, parts)
                        before += total
                        names, sizes, parts, total = [], [], [], 0
                row += len(counts)
                give_back()
        if names:
            yield _segment(part, before, names, sizes, parts)

    # Equal ids are told apart by their texts' hashes, and equal rows by numbers, so that none of them has to be in one task.
    rows = docs.select("doc_id", text_of().alias("text")).withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(run, f"part int, within bigint, doc_ids array<{key}>, n_ids array<bigint>, segment binary").write.parquet(path)


def _segment(part: int, before: int, names: list[pa.Array], sizes: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
    one = lambda flat: pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
    row = {"part": pa.array([part], pa.int32()), "within": pa.array([before], pa.int64()), "doc_ids": one(pa.concat_arrays(names)), "n_ids": one(pa.array(np.concatenate(sizes), pa.int64())), "segment": pa.array([pack(np.concatenate(parts))], pa.binary())}
    return pa.RecordBatch.from_pydict(row)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a file: doc_id, start (ids of all documents before it), ids (array of bigint)."""
    rows = _segments(spark, path)
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = 0
                for name, size in zip(row["doc_ids"], row["n_ids"], strict=True):
                    ids = read_range(row["segment"], at, at + size).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([name], batch.schema.field("doc_ids").type.value_type), "start": pa.array([row["before"] + at], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64()))})
                    at += size

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, ids array<bigint>")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """doc_ids, n_ids, segment, before: the ids of all segments before it. A segment carries the ids before it in its part; those before the part are
    summed over the parts. Their table, two numbers for each task that wrote, is broadcast."""
    rows = spark.read.parquet(path)
    ends = rows.select("part", (F.col("within") + F.aggregate("n_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = ends.groupBy("part").agg(F.max("n").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return rows.join(F.broadcast(parts), "part").select("doc_ids", "n_ids", "segment", (F.col("ahead") + F.col("within")).alias("before"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a file."""
    rows = _segments(spark, path)
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["segment"]).astype("<u4")
                ends = np.cumsum(row["n_ids"], dtype=np.int64)
                starts = ends - np.array(row["n_ids"], np.int64)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), "start": pa.array(starts + row["before"], pa.int64()), "n_tokens": pa.array(row["n_ids"], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                )

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the ids of docs (doc_id, text) to a file in the shared folder and reads it again: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, end_id, path)
    return file_digests(docs.sparkSession, path)
