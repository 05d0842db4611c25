"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clear, marked, scratch, shared_folder, stored  # noqa: F401  used by the operators

#: The white space of all text contracts here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


class Memo(dict):
    """key -> make(key), of bounded size: when `size` keys are new, they become the old generation, and the former old one is dropped."""

    def __init__(self, make, size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


_KEPT: dict = {}


def give_back() -> None:
    """Returns free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_cache(key, make):
    """What a worker process keeps from task to task: one thing at a time, so that operators that follow each other do not add up in its memory."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def without_gc(batches):
    """The batches, without searches for reference cycles in between: these would walk a large memo again and again, and nothing here makes cycles."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()


_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def single_spaces(text: str) -> bool:
    """Whether no space in a text (one character at least) is at its ends or beside other white space; False where a rare white space makes that costly to tell."""
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
        return False
    for c in _RARE_SPACES:
        if c in text:
            return False
    return True


def cut_at_spaces(text: str) -> list[str]:
    """The pieces of text between single spaces that have no white space beside them: there, byte-level patterns always end a pre-token."""
    return text.split(" ") if single_spaces(text) else _CUT.split(text)


def windows(text: str, size: int):
    """A long text in parts of about `size` characters, cut before such spaces; a part has no bound where the text has none."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package (some 100 KB) to the executors, once for each application: their Python may not have it on its path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="quireworks-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def growing(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is merged by sort at every size, never broadcast."""
    return side.hint("merge")


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator uses, and all others as one, `rest`, so that no name of theirs meets one of the operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None).cast("boolean")).alias("rest"))


def unpacked(rows: DataFrame, like: DataFrame, *used: str) -> DataFrame:
    """rows that come from packed(like, *used), with the columns of like."""
    return rows.select(*(F.col(c) if c in used else F.col("rest").getField(c).alias(c) for c in like.columns))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
