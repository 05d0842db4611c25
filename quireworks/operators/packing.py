"""Groups of rows through a shuffle in little room.

A shuffled row takes its fixed fields, most of whose bytes are zero, once for each row, and those of neighbours are not compressed against one another by columns. Here each task packs its rows of a group, column by
column, into one compressed value; the values are shuffled and unpacked where the group comes together. Nothing is left out or rounded: numbers travel as their bytes, nulls as bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are unpacked at once, and whole groups beyond that.
CHUNK = 1 << 17


def by_group(rows: DataFrame, keys: list[str], make: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """make(table, group) over some whole groups at a time: all columns of their rows, in no order within a group, and the number of each row's group, not falling. A group has to fit into a worker's memory."""
    values = [c for c in rows.columns if c not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    packed = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n int, size int, body binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            batch, starts = _runs(batch, keys)
            ends, parts = np.append(starts[1:], batch.num_rows), [_packer(batch.column(batch.schema.get_field_index(c))) for c in values]
            bodies = [b"".join([part(a, b) for part in parts]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            heads = [batch.column(batch.schema.get_field_index(k)).take(pa.array(starts)) for k in keys]
            yield pa.RecordBatch.from_arrays([*heads, pa.array(ends - starts, pa.int32()), pa.array(list(map(len, bodies)), pa.int32()), pa.array([codec.compress(x, asbytes=True) for x in bodies], pa.binary())], names=[*keys, "n", "size", "body"])

    types = _arrow_types(rows, values)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, total, last = pa.Codec("zstd"), [], 0, None

        def made() -> list[pa.RecordBatch]:
            ns = np.array([x[1] for x in held])
            turns = np.cumsum([i > 0 and x[0] != held[i - 1][0] for i, x in enumerate(held)])
            at = pa.array(np.repeat(np.arange(len(held)), ns))
            columns = {k: pa.array([x[0][i] for x in held], key_types[i]).take(at) for i, k in enumerate(keys)}
            columns |= dict(zip(values, _unpacked([(x[1], codec.decompress(x[3], x[2])) for x in held], [types[c] for c in values]), strict=True))
            return make(pa.table(columns), np.repeat(turns, ns)).combine_chunks().to_batches(max_chunksize=10_000)

        for batch in batches:
            key_types = [batch.column(i).type for i in range(len(keys))]
            for row in zip(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True), *(batch.column(len(keys) + i).to_pylist() for i in range(3)), strict=True):
                if total >= CHUNK and row[0] != last:
                    yield from made()
                    held, total = [], 0
                held.append(row)
                total, last = total + row[1], row[0]
        if held:
            yield from made()

    return rows.mapInArrow(pack, packed).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(together, schema)


def _arrow_types(rows: DataFrame, columns: list[str]) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {c: to_arrow_type(rows.schema[c].dataType) for c in columns}


def _runs(batch: pa.RecordBatch, keys: list[str]) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch with the rows of a group in one run, and where the runs start."""
    group = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        found = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode")
        group = group * len(found.dictionary) + found.indices.to_numpy()
    changes = lambda: np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)
    starts = changes()
    if len(np.unique(group[starts])) < len(starts):
        order = np.argsort(group, kind="stable")
        batch, group = batch.take(pa.array(order)), group[order]
        starts = changes()
    return batch, starts


def _planes(numbers: np.ndarray) -> bytes:
    """First bytes, second bytes and so on: those that hardly differ lie together."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _numeric(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_float32(kind) or pa.types.is_float64(kind)


def _packer(column: pa.Array) -> Callable[[int, int], bytes]:
    """The bytes of the column's values from a to b: whether some are null, which, and the values; whole numbers as steps."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)

    def nulls(a, b):
        return b"\0" if valid[a:b].all() else b"\1" + np.packbits(valid[a:b]).tobytes()

    if _numeric(column.type):
        numbers = column.fill_null(0).to_numpy(zero_copy_only=False)
        whole = pa.types.is_integer(column.type)
        return lambda a, b: nulls(a, b) + _planes(np.diff(numbers[a:b], prepend=numbers.dtype.type(0)) if whole else numbers[a:b])
    if pa.types.is_string(column.type):
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
        data = memoryview(data or b"")
        return lambda a, b: nulls(a, b) + _planes(np.diff(at[a : b + 1])) + bytes(data[at[a] : at[b]])

    def other(a, b):
        body = pa.record_batch([column.slice(a, b - a)], ["c"]).serialize().to_pybytes()
        return len(body).to_bytes(8, "little") + body

    return other


def _unpacked(bodies: list[tuple[int, pa.Buffer]], kinds: list[pa.DataType]) -> list[pa.Array]:
    """bodies: how many rows, and their columns' bytes one after the other."""
    raw, places = [np.frombuffer(x, np.uint8) for _, x in bodies], [0] * len(bodies)

    def take(i, n):
        places[i] += n
        return raw[i][places[i] - n : places[i]]

    def present(i, n):
        return np.ones(n, dtype=bool) if take(i, 1)[0] == 0 else np.unpackbits(take(i, (n + 7) // 8), count=n).astype(bool)

    def numbers(i, n, dtype):
        return np.ascontiguousarray(take(i, n * dtype.itemsize).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)

    columns = []
    for kind in kinds:
        if _numeric(kind):
            dtype, whole, valid, found = np.dtype(kind.to_pandas_dtype()), pa.types.is_integer(kind), [], []
            for i, (n, _) in enumerate(bodies):
                valid.append(present(i, n))
                x = numbers(i, n, dtype)
                found.append(np.cumsum(x, dtype=dtype) if whole else x)
            columns.append(pa.array(np.concatenate(found), kind, mask=~np.concatenate(valid)))
        elif pa.types.is_string(kind):
            valid, lengths, texts = [], [], []
            for i, (n, _) in enumerate(bodies):
                valid.append(present(i, n))
                lengths.append(numbers(i, n, np.dtype(np.int32)))
                texts.append(take(i, int(lengths[-1].sum())).tobytes())
            at = np.append(0, np.cumsum(np.concatenate(lengths), dtype=np.int64))
            bits = pa.array(np.concatenate(valid)).buffers()[1]
            columns.append(pa.Array.from_buffers(pa.large_string(), len(at) - 1, [bits, pa.py_buffer(at), pa.py_buffer(b"".join(texts))]).cast(kind))
        else:
            parts = []
            for i in range(len(bodies)):
                body = take(i, int.from_bytes(take(i, 8).tobytes(), "little"))
                parts.append(pa.ipc.read_record_batch(pa.py_buffer(body.tobytes()), pa.schema([("c", kind)])).column(0))
            columns.append(pa.concat_arrays(parts))
    return columns
