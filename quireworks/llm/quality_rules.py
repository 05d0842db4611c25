"""Quality rules as a short-circuit cascade.

Every rule is a predicate that rejects a document. `plan()` runs all rules on a sample of rows, and measures which documents each rejects and what each feature costs that the rules
look at. Then it orders the rules greedily by rejection per cost, both conditional: what a rule rejects of the documents that the rules before it left, for the seconds of the
features that those rules have not computed already. `judged()` and `good_documents()` evaluate each document's rules in that order and stop at the
first that rejects. A document is kept if no rule rejects it, so the order changes the cost and the named rule, never the verdict. Features that
several rules share are computed once for a document. The rules look at words, lines and marks of any language; none knows the words of one.

Scale: one pass over the texts without a shuffle, next to the pass that draws the sample (`SAMPLE_ROWS` expected rows, for the order only). `judged()` gives the base counts of all
documents, so it computes these whatever the order; `good_documents()` saves what the order saves.

Edge cases: null text counts as empty: 0 in all counts, rejected as too short. Ids, repeated rows and other columns pass through; `good_documents` keeps
all columns. An empty table gives no rows, with the rules in the order they are listed.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Expected rows of the sample that orders the rules.
SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
SPACE_BYTES = b" \t\n\x0b\f\r"
LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search
BULLETS, ELLIPSES = tuple(x.encode() for x in ("•", "‣", "◦", "- ", "* ")), ("…".encode(), b"...")
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
LETTER_BYTES = UPPER + LOWER + bytes(range(128, 256)) + SPACE_BYTES


class Document:
    """The features of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(type(self), f"_{name}")(self)
        setattr(self, name, value)
        return value

    def _data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def _words(self) -> list[bytes]:
        return self.data.split()  # bytes.split() knows just the six ASCII spaces

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.data.count, (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r")))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x and not x.isspace()]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, UPPER))

    def _n_lower(self) -> int:
        return len(self.data) - len(self.data.translate(None, LOWER))

    def _n_exclaims(self) -> int:
        return self.data.count(b"!")

    def _n_bullets(self) -> int:
        return sum(x.lstrip(SPACE_BYTES).startswith(BULLETS) for x in self.lines)

    def _n_ellipses(self) -> int:
        return sum(x.rstrip(SPACE_BYTES).endswith(ELLIPSES) for x in self.lines)

    def _n_braces(self) -> int:
        return self.data.count(b"{") + self.data.count(b"}")

    def _n_links(self) -> int:
        return self.data.count(b"http://") + self.data.count(b"https://")

    def _number(self) -> dict[bytes, int]:
        """A number for each distinct word, in the order they come."""
        return {w: i for i, w in enumerate(dict.fromkeys(self.words))}

    def _ids(self) -> np.ndarray:
        """The words as numbers."""
        return np.fromiter(map(self.number.__getitem__, self.words), np.int64, self.n_words)

    def _n_marks(self) -> int:
        """Characters that are neither white space nor what a word with a letter needs: no fewer than the words without one."""
        return len(self.data.translate(None, LETTER_BYTES))

    def _n_letterless(self) -> int:
        """Words that have no ASCII letter and nothing beyond ASCII."""
        bare = [i for w, i in self.number.items() if not LETTER(w)]
        return int(np.isin(self.ids, bare).sum()) if bare else 0

    def _n_top_word(self) -> int:
        return int(np.bincount(self.ids).max()) if self.n_words else 0

    def _n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        ids = self.ids
        if ids.max() < (1 << 21) - 1:
            windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:
            windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice[1:] |= twice[:-1].copy()  # a window covers its two next words as well
        first = np.zeros(n, bool)
        first[order[1:][same]] = True
        first[order[:-1][same]] = True
        twice[2:] |= first[:-2]
        return int(twice.sum())


#: Rules: name -> whether it rejects.
RULES: dict[str, Callable[[Document], bool]] = {
    "too_short": lambda d: d.n_words < 50,
    "repeated_words": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "duplicate_lines": lambda d: 2 * d.n_dup_lines > len(d.lines),
    "shouting": lambda d: d.n_upper > d.n_lower,
    "exclaiming": lambda d: 3 * d.n_exclaims > d.n_words,
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
    "bullet_lines": lambda d: 10 * d.n_bullets > 9 * len(d.lines),
    "ellipsis_lines": lambda d: 10 * d.n_ellipses > 3 * len(d.lines),
    "letterless": lambda d: 10 * d.n_marks > 4 * d.n_words and 10 * d.n_letterless > 4 * d.n_words,
    "braces": lambda d: 20 * d.n_braces > d.n_words,
    "links": lambda d: 10 * d.n_links > d.n_words,
    "one_word": lambda d: 10 * d.n_top_word > 3 * d.n_words,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Timed(Document):
    """A document that records the features asked for and the seconds that each takes by itself."""

    def __init__(self, text: str | None):
        super().__init__(text)
        self.seconds: dict[str, float] = {}
        self.inner = [0.0]  # seconds of the features that the open ones asked for

    def __getattr__(self, name: str):
        self.inner.append(0.0)
        began = time.perf_counter()
        value = super().__getattr__(name)
        took = time.perf_counter() - began
        self.seconds[name] = took - self.inner.pop()
        self.inner[-1] += took
        return value


def plan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' names in the order that cascade() finds on a sample."""
    n = docs.count()
    texts = docs.select("text").sample(False, min(1.0, sample_rows / max(n, 1)), seed=1)

    def run(batches):
        worker_cache("quality", dict)  # lets go what an operator before this one kept
        for batch in batches:
            rows = []
            for text in batch.column(0):
                whole, needs, rejected = Timed(text.as_py()), [], []
                for name, rule in RULES.items():
                    rule(whole)
                    own = Timed(whole.text)
                    rejected.append(bool(rule(own)))
                    needs.append(list(own.seconds))
                rows.append((rejected, needs, list(whole.seconds), list(whole.seconds.values())))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.list_(pa.bool_()), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rejected", "needs", "features", "seconds"])

    found = texts.mapInArrow(run, "rejected array<boolean>, needs array<array<string>>, features array<string>, seconds array<double>").collect()  # the bounded sample
    cost: dict[str, float] = {}
    needs: list[set[str]] = [set() for _ in RULES]
    for row in found:
        for feature, seconds in zip(row.features, row.seconds, strict=True):
            cost[feature] = cost.get(feature, 0.0) + seconds / len(found)
        for all_, mine in zip(needs, row.needs, strict=True):
            all_.update(mine)
    return cascade(np.array([row.rejected for row in found], bool).reshape(-1, len(RULES)), dict(zip(RULES, needs, strict=True)), cost)


def cascade(rejected: np.ndarray, needs: dict[str, set[str]], cost: dict[str, float]) -> list[str]:
    """Rules by rejection per cost, the most first, given the rules before: rejected has a row for each sampled document and a column for each rule, needs a rule's
    features, cost a feature's seconds for a document. Rules that reject nothing more come last, the cheapest first; ties in the order given."""
    names, left, known, order = list(needs), np.ones(len(rejected), bool), set(), []
    while len(order) < len(names):

        def worth(name: str) -> tuple[float, float]:
            price = sum(cost.get(x, 0.0) for x in needs[name] - known) + 1e-9
            return rejected[left, names.index(name)].sum() / price, -price

        best = max((x for x in names if x not in order), key=worth)
        order.append(best)
        left &= ~rejected[:, names.index(best)]
        known |= needs[best]
    return order


def first_rejection(document: Document, order: list[str]) -> str | None:
    return next((name for name in order if RULES[name](document)), None)


def judged(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and rule: the first in the order that rejects (null if kept)."""
    order = order or plan(docs)
    schema = docs.select("doc_id").schema
    for name in BASE:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("rule", "string")

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                d = Document(text.as_py())
                rule = first_rejection(d, order)
                base = [getattr(d, name) for name in BASE]
                failed = RULES["too_short"](d) or RULES["repeated_words"](d)
                rows.append((*base, failed, rule is None, rule))
            columns = list(zip(*rows, strict=True)) or [()] * (len(BASE) + 3)
            kinds = [pa.int64()] * len(BASE) + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *BASE, "base_failed", "kept", "rule"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def good_documents(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, all columns kept."""
    order, at = order or plan(docs), docs.columns.index("text")

    def run(batches):
        worker_cache("quality", dict)
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(Document(t.as_py()), order) is None for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUALITY_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id),
o AS (SELECT doc_id, max(k) AS n_top FROM (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM t) GROUP BY ALL) GROUP BY doc_id),
b AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims, len(list_filter(w, lambda x: NOT regexp_matches(x, '[a-zA-Z]|[^\x00-\x7F]'))) AS n_letterless, length(regexp_replace(text, '[^{}]', '', 'g')) AS n_braces,
    len(regexp_extract_all(text, 'https?://')) AS n_links, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(•|‣|◦|- |\* )'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(…|\.\.\.)[\x20\x09-\x0D]*$'))) AS n_ellipses, coalesce(n_top, 0) AS n_top FROM t LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR n_upper > n_lower OR 3 * n_exclaims > n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines OR 10 * n_letterless > 4 * n_words OR 20 * n_braces > n_words
    OR 10 * n_links > n_words OR 10 * n_top > 3 * n_words) AS kept
FROM f
"""
