"""Image headers and pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Signature and channels by colour type of 8-bit PNG files; JPEG markers without a length, and those of frames.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
NO_LENGTH = {0x01, *range(0xD0, 0xDA)}
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


#: Pixels that are handed on at once.
ROWS = 1 << 16


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG file; None for others and for broken ones."""
    if data[:8] == SIGNATURE:
        return struct.unpack(">II", data[16:24]) if len(data) >= 24 else None
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in NO_LENGTH:
            at += 2
            continue
        if marker in FRAMES and at + 9 <= len(data):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit, non-interlaced PNG as height x width x 3."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        raise ValueError("bit depth, interlacing or colour type not supported")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8)[: height * (width * n + 1)].reshape(height, width * n + 1)
    pixels = _unfiltered(rows[:, 0], rows[:, 1:].reshape(height, width, n))
    return np.repeat(pixels[:, :, :1], 3, 2) if n < 3 else pixels[:, :, :3]


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Rows of pixels without their filters. A pixel needs those to its left and above, so the pixels of a diagonal are all done at once."""
    height, width, n = lines.shape
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown row filter")
    out = np.zeros((height + 1, width + 1, n), np.int16)  # with a row above and a column to the left
    if not np.isin(kinds, (1, 3, 4)).any():  # rows of their own, or on the one above
        for y in range(height):
            out[y + 1, 1:] = (lines[y] + (out[y, 1:] if kinds[y] else 0)) & 255
        return out[1:, 1:].astype(np.uint8)
    for d in range(width + height - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        near_left, near_up, near_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((near_left <= near_up) & (near_left <= near_corner), left, np.where(near_up <= near_corner, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) // 2, paeth])
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def sizes(files: DataFrame) -> DataFrame:
    """files: path, content. path, width, height (null where unreadable)."""

    def run(batches):
        for batch in batches:
            found = [image_size(x.as_py() or b"") or (None, None) for x in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "width": pa.array([f[0] for f in found], pa.int32()), "height": pa.array([f[1] for f in found], pa.int32())})

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int")


def pixels(files: DataFrame) -> DataFrame:
    """files: path, content (PNG). A row per pixel: path, px, py, width, height, r, g, b; unreadable files give none."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    image = decode_png(content.as_py() or b"")
                except (ValueError, zlib.error, struct.error):
                    continue
                height, width = image.shape[:2]
                step = max(1, ROWS // max(width, 1))
                for top in range(0, height, step):
                    part = image[top : top + step].astype(np.int32).reshape(-1, 3)
                    py, px = np.divmod(np.arange(len(part), dtype=np.int32), width)
                    n = len(part)
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path] * n), "px": px, "py": py + np.int32(top), "width": np.full(n, width, np.int32), "height": np.full(n, height, np.int32), "r": part[:, 0].copy(), "g": part[:, 1].copy(), "b": part[:, 2].copy()})

    return files.select("path", "content").mapInArrow(run, "path string, px int, py int, width int, height int, r int, g int, b int")
