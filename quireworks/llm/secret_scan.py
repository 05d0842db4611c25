"""Secrets in texts, also inside nested encodings, by a recursive decoding worklist.

1. The text itself is the first layer. Three patterns are looked for in every layer: assignments of a secret to a name, access keys, long hexadecimal numbers.
2. Each layer is unwrapped in every way that it allows: percent escapes and Unicode escapes give the whole layer once more with these replaced; a run of base64 characters gives the readable parts of
   what it decodes to, at each of its four alignments; compressed data (gzip, zlib, bz2, xz) inside percent escapes or base64 gives its content. New layers go on the worklist, until none is left.
3. A layer that was there before (equal text over the same part of the original) is not taken again, so layers that decode to each other end.
4. Each layer carries, for each of its characters, the part of the original text that it comes from. A match is reported as the span of the original that holds all of its characters;
   compressed content maps to the whole of its data. A span that is there already with its kind is not reported twice.

Rules: an escape that is no character (a lone surrogate, a number beyond U+10FFFF) stays as it is; bytes of percent escapes that are no UTF-8 become U+FFFD. An escape character that is itself escaped more than
eight times is unwrapped at once. Compressed content is unpacked and scanned in pieces of `PIECE` bytes, each with the last `TAIL` characters of the one before, so memory is bounded whatever
it unpacks to; a match longer than `TAIL` across such a border is reported for the part in each piece, and damaged data is scanned as far as it unpacks.

Scale: no shuffle; texts are read once, each scanned in the task that reads it. A text without escapes and long runs costs three scans.

Edge cases: null text counts as empty and has no spans; a null id is passed on; repeated rows are separate; other columns are ignored; an empty table gives no rows; offsets are code points.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

# Kinds in the order of reports, their patterns, and the least length of a value, a key and a number.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Bytes of compressed content that are unpacked at once, and characters of a piece that the next one repeats.
PIECE, TAIL = 1 << 23, 4096
#: Texts of one output batch.
ROWS = 256

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_PERCENT_CHAIN = re.compile(r"%(?:25){8,}")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_UNICODE_CHAIN = re.compile(r"\\(?:u005[cC]){8,}|&(?:#38;){8,}")
_PACKED_PERCENT = re.compile(r"(?:%1[fF]%8[bB]|(?:%78|x)%(?:01|5[eE]|9[cC]|[dD][aA]))(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~+-])+")
# The shortest secret has 12 characters, 16 in base64.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48,}(?:\r?\n[A-Za-z0-9+/_-]+)+")
_READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|^x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_URL_SAFE = str.maketrans("-_", "+/")


def matches(text: str) -> list[tuple[int, int, int]]:
    """The secrets that stand in a text as they are: (start, kind, end), kinds as numbers."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(name in low for name in NAMES):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the part of the original that each of its characters comes from. path: how it was unwrapped."""

    __slots__ = ("ends", "path", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, path: tuple[str, ...]):
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    def key(self) -> tuple:
        return xxhash.xxh3_128_intdigest(self.text.encode("utf-8", "surrogatepass")), int(self.starts[0]), int(self.ends[-1])


def original(text: str) -> Layer:
    starts = np.arange(len(text), dtype=np.int32)
    return Layer(text, starts, starts + 1, ())


def _replaced(layer: Layer, found: list[tuple[int, int, str, list[tuple[int, int]]]], how: str) -> Layer:
    """The layer with parts replaced: (start, end, characters, the part of the layer that each comes from)."""
    texts, starts, ends, at = [], [], [], 0
    for a, b, chars, parts in found:
        texts += (layer.text[at:a], chars)
        starts += (layer.starts[at:a], layer.starts[[p for p, _ in parts]])
        ends += (layer.ends[at:a], layer.ends[[q - 1 for _, q in parts]])
        at = b
    texts.append(layer.text[at:])
    return Layer("".join(texts), np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]]), (*layer.path, how))


def _chars(data: bytes) -> list[tuple[str, int, int]]:
    """The characters of bytes with their places; what is no UTF-8 becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            out.append((data[at : at + n].decode(), at, at + n))
            at += n
        except UnicodeDecodeError:
            out.append(("�", at, at + 1))
            at += 1
    return out


def percent(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    found = [(m.start(), m.end(), "%", [m.span()]) for m in _PERCENT_CHAIN.finditer(layer.text)]
    if not found:
        for m in _PERCENT.finditer(layer.text):
            chars = _chars(binascii.unhexlify(m[0].replace("%", "")))
            found.append((m.start(), m.end(), "".join(c for c, _, _ in chars), [(m.start() + 3 * a, m.start() + 3 * b) for _, a, b in chars]))
    if found:
        yield _replaced(layer, found, "url")
    for m in _PACKED_PERCENT.finditer(layer.text):
        data = re.sub(rb"%(..)", lambda x: binascii.unhexlify(x[1]), m[0].encode(), flags=re.S)
        yield from _unpacked(layer, data, m.start(), m.end(), "url")


def unicode(layer: Layer) -> Iterator[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    found = [(m.start(), m.end(), m[0][0], [m.span()]) for m in _UNICODE_CHAIN.finditer(layer.text)]
    if not found:
        high = None  # a high surrogate and where it begins and ends
        for m in _UNICODE.finditer(layer.text):
            code, before, high = int(m[6]) if m[6] else int(next(x for x in m.groups() if x), 16), high, None
            if 0xDC00 <= code < 0xE000 and before and before[2] == m.start():
                code = 0x10000 + (before[0] - 0xD800) * 0x400 + code - 0xDC00
                found.append((before[1], m.end(), chr(code), [(before[1], m.end())]))
            elif 0xD800 <= code < 0xDC00:
                high = (code, *m.span())
            elif code < 0x110000 and not 0xDC00 <= code < 0xE000:
                found.append((m.start(), m.end(), chr(code), [m.span()]))
    if found:
        yield _replaced(layer, found, "unicode")


def base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        yield from _decoded(layer, m[0], np.arange(m.start(), m.end()))
    if "\n" in layer.text:
        for m in _BASE64_LINES.finditer(layer.text):
            places = np.array([i for i, c in enumerate(m[0], m.start()) if c not in "\r\n"])
            yield from _decoded(layer, m[0].replace("\r", "").replace("\n", ""), places)


def _decoded(layer: Layer, run: str, places: np.ndarray) -> Iterator[Layer]:
    """The readable parts, and the contents of packed parts, of a base64 run at each alignment. places: where in the layer the run's characters are."""
    run = run.translate(_URL_SAFE)
    for shift in range(4):
        chars = run[shift : len(run) - ((len(run) - shift) % 4 == 1)]
        if len(chars) < 16:
            continue
        data = binascii.a2b_base64(chars + "=" * (-len(chars) % 4))
        at = places[shift:]
        for m in _READABLE.finditer(data):
            chars_ = _chars(m[0])
            first = np.array([a for _, a, _ in chars_]) + m.start()
            last = np.array([b for _, _, b in chars_]) + m.start()
            yield Layer("".join(c for c, _, _ in chars_), layer.starts[at[first * 4 // 3]], layer.ends[at[(last * 4 + 2) // 3 - 1]], (*layer.path, "base64"))
        for m in _PACKED.finditer(data):
            yield from _unpacked(layer, data[m.start() :], int(at[m.start() * 4 // 3]), int(at[-1]) + 1, "base64")


def _unpacked(layer: Layer, data: bytes, start: int, end: int, how: str) -> Iterator[Layer]:
    """The content of compressed data, which lies between two places of the layer, in pieces."""
    kind, tool = ("gzip", zlib.decompressobj(31)) if data[:2] == b"\x1f\x8b" else ("bz2", bz2.BZ2Decompressor()) if data[:3] == b"BZh" else ("xz", lzma.LZMADecompressor()) if data[:1] == b"\xfd" else ("zlib", zlib.decompressobj())
    tail, first, last = "", layer.starts[start], layer.ends[end - 1]
    try:
        while True:
            piece = tool.decompress(data, PIECE)
            data = tool.unconsumed_tail if kind in ("gzip", "zlib") else b""
            if not piece:
                return
            text = tail + piece.decode("utf-8", "replace")
            yield Layer(text, np.broadcast_to(first, len(text)), np.broadcast_to(last, len(text)), (*layer.path, how, kind))
            tail = text[-TAIL:]
            if tool.eof:
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return


def layers(text: str) -> Iterator[Layer]:
    """The text and every layer below it, each once."""
    if not text:
        return
    first = original(text)
    work, seen = [iter([first])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer is not first:
            key = layer.key()
            if key in seen:
                continue
            seen.add(key)
        yield layer
        work += [base64(layer), unicode(layer), percent(layer)]


def secrets(text: str) -> list[tuple[int, int, int, str]]:
    """All secrets of a text and its layers: (start, kind, end, path of the layer), by start, kind and end; of equal spans the first layer's."""
    found: dict[tuple[int, int, int], str] = {}
    for layer in layers(text):
        for start, kind, end in matches(layer.text):
            # What an unwrapping moves stays in order, so the ends of a match hold all of it.
            found.setdefault((int(layer.starts[start]), kind, int(layer.ends[end - 1])), "/".join(layer.path))
    return [(*span, path) for span, path in sorted(found.items())]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, spans (array of kind, start, end, layers: how the text was unwrapped, empty for the text as it is)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("layers", T.StringType())])
    schema = docs.select("doc_id").schema.add("spans", T.ArrayType(span))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found = [[{"kind": KINDS[k], "start": a, "end": b, "layers": path} for a, k, b, path in secrets(t.as_py())] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256 (those that stand in the text as it is), spans (all), n_added (spans that only a layer shows)."""
    base = F.filter("spans", lambda x: x["layers"] == "")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = secret_spans(docs).withColumn("base", base)
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), added)
