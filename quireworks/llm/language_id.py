"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text's letters, lower-cased, form words; a word is scored on its own, from a start mark to an end mark, by models of order `ORDER`.
The language with the lowest cross-entropy per symbol wins. A text is rejected (`rejected`) when that cross-entropy lies more standard errors above the language's own, which follows from the
counts, than in all but `FALSE_REJECTIONS` of that language's held-back rows: one learning row in `HELD_BACK`, by a hash of the id, which a first model does not learn from. The
model in use learns from all learning rows.

The counts cover all learning rows: words are counted in each task, turned into character n-grams there, and summed by Spark; the
continuation counts of the lower orders are group-bys over the n-grams. Only the finished
model is collected: for each order sorted arrays of the packed n-grams themselves, so lookups are exact, and for each the discounted share (for contexts the
weight of the lower order) in each language. What is broadcast takes 8 + 4 * languages bytes for each distinct n-gram and for each distinct context, and grows with them.
Characters beyond the first 65,536 code points share symbols, as a symbol has 16 bits.

Edge cases: null texts and texts without a letter get `und`, score 0. Null languages, and rows with held-out ids, teach nothing. Without learning rows
every text gets `und`. Null ids and repeated rows pass through; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored, text_of

ORDER = 4
#: Share of a language's own texts that may be rejected; one learning row in so many is held back to find the limit for that.
FALSE_REJECTIONS, HELD_BACK = 0.001, 16
#: Standard deviations beyond which a normal distribution has that share.
NORMAL = 3.09
#: Standard errors over a language's own cross-entropy from which a text is rejected, where no row of the language is held back.
REJECT = 12.0
#: Symbols of a text that count for the score: words repeat each other, so a long text is no surer than this.
SURE = 40
MEMO = 500_000
LETTERS = re.compile(r"[^\W\d_]+")
PAD, START, END = 0, 1, 2


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' symbols (16 bits each), each word as PAD, PAD, START, letters, END; and the index of the word each belongs to."""
    joined = np.frombuffer("".join(["\x00\x00\x01" + w + "\x02" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    joined = np.where(joined < 1 << 16, joined, 3 + joined % 65521)
    return joined.astype(np.uint64), np.repeat(np.arange(len(words)), [len(w) + 4 for w in words])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed ORDER-grams that end in a letter or END, and the index of each one's word."""
    s, owner = _symbols(words)
    if not len(s):
        return np.zeros(0, np.int64), owner
    packed = s[3:] | (s[2:-1] << np.uint64(16)) | (s[1:-2] << np.uint64(32)) | (s[:-3] << np.uint64(48))
    real = s[3:] > START
    return packed[real].view(np.int64), owner[3:][real]


def _suffix(packed: np.ndarray, order: int) -> np.ndarray:
    return packed if order == 4 else packed & np.int64((1 << (16 * order)) - 1)


class Model:
    """For each order (the first is at 0) sorted arrays of packed n-grams: `grams` with `shares`, `contexts` with `weights`; a column for each language."""

    def __init__(self, languages, grams, shares, contexts, weights, alphabet: int):
        self.languages, self.grams, self.shares, self.contexts, self.weights = languages, grams, shares, contexts, weights
        self.uniform = 1.0 / max(alphabet, 1)
        self.own = np.zeros((len(languages), 2))
        self.limits = np.full(len(languages), REJECT)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(wanted), values.shape[1]), missing, np.float32)
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        out = values[at]
        out[keys[at] != wanted] = missing
        return out

    def surprise(self, packed: np.ndarray) -> np.ndarray:
        """-log2 P of each ORDER-gram's last symbol after the others, a column for each language."""
        p = np.full((len(packed), len(self.languages)), self.uniform)
        for order in range(1, ORDER + 1):
            gram = _suffix(packed, order)
            share = self._find(self.grams[order - 1], gram, self.shares[order - 1], 0.0)
            context = (gram.view(np.uint64) >> np.uint64(16)).view(np.int64)
            weight = self._find(self.contexts[order - 1], context, self.weights[order - 1], 1.0)
            p = share + weight * p
        return -np.log2(np.maximum(p, 1e-12))

    def words(self, words: list[str]) -> np.ndarray:
        """Rows of summed surprise for each language, then the number of symbols."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        for at in range(0, len(words), 20_000):
            packed, owner = _grams(words[at : at + 20_000])
            surprise = self.surprise(packed)
            n = len(words[at : at + 20_000])
            for i in range(len(self.languages)):
                out[at : at + n, i] = np.bincount(owner, surprise[:, i], n)
            out[at : at + n, -1] = np.bincount(owner, minlength=n)
        return out


def _learn(docs: DataFrame) -> DataFrame:
    """lang, back, g (packed ORDER-gram), n over all learning rows; those held back are counted apart."""
    rows = _learning(docs).select("lang", _back().alias("back"), text_of().alias("text"))

    def run(batches):
        counts: dict[tuple[str, bool], Counter] = defaultdict(Counter)

        def flush():
            for (lang, back), found in counts.items():
                words = list(found)
                packed, owner = _grams(words)
                keys, at = np.unique(packed, return_inverse=True)
                n = np.bincount(at, np.fromiter(found.values(), np.int64, len(words))[owner], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "back": pa.array([back] * len(keys), pa.bool_()), "g": keys, "n": n})
            counts.clear()

        for batch in batches:
            for lang, back, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts[lang, back].update(LETTERS.findall(text.as_py().lower()))
                if sum(map(len, counts.values())) > MEMO:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, back boolean, g long, n long").groupBy("lang", "back", "g").agg(F.sum("n").alias("n"))


def _learning(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & ~held_out())


def _back() -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(HELD_BACK)) == 0


def train(docs: DataFrame) -> Model:
    """The model of docs (doc_id, text, lang), learnt from the rows with a language that aren't held out."""
    grams = stored(_learn(docs), "lang-grams")
    limits = _limits(docs, _finished(grams.where("NOT back").drop("back")))
    model = _finished(grams.groupBy("lang", "g").agg(F.sum("n").alias("n")))
    model.limits = np.array([limits.get(x, REJECT) for x in model.languages])
    return model


def _limits(docs: DataFrame, model: Model) -> dict[str, float]:
    """For each language the standard errors that all but FALSE_REJECTIONS of its held-back rows stay below."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer, number = Scorer(shared.value), {lang: i for i, lang in enumerate(shared.value.languages)}
        for batch in batches:
            found = [(lang, scorer.errors(x, number[lang])) for lang, x in zip(batch.column(0).to_pylist(), scorer.totals(batch.column(1).to_pylist()), strict=True) if lang in number and x is not None]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in found], pa.string()), "errors": pa.array([x for _, x in found], pa.float64())})

    rows = _learning(docs).where(_back()).select("lang", text_of().alias("text")).mapInArrow(run, "lang string, errors double")
    # Of few rows the quantile is too low by chance, so that of a normal distribution counts where it is higher.
    spread = F.coalesce(F.stddev("errors"), F.lit(REJECT / NORMAL))
    found = rows.groupBy("lang").agg(F.greatest(F.percentile_approx("errors", 1 - FALSE_REJECTIONS, 100_000), F.avg("errors") + NORMAL * spread).alias("limit"))
    return {r.lang: r.limit for r in found.collect()}


def _finished(grams: DataFrame) -> Model:
    """The model of the counts lang, g, n of ORDER-grams."""
    orders = {ORDER: stored(grams, "lang-grams-used")}
    for order in range(ORDER - 1, 0, -1):
        suffix: Column = F.col("g").bitwiseAND(F.lit((1 << (16 * order)) - 1))
        orders[order] = orders[order + 1].groupBy("lang", suffix.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    counts = None
    for order, grams in orders.items():
        part = grams.select("lang", F.lit(order).alias("k"), "g", F.shiftrightunsigned("g", 16).alias("context"), "n")
        counts = part if counts is None else counts.unionByName(part)
    counts = stored(counts, "lang-counts")
    few = counts.groupBy("lang", "k").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
    few = few.select("lang", "k", F.when(F.col("ones") > 0, F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5).alias("d"))
    contexts = counts.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(few, ["lang", "k"])
    shares = counts.join(contexts, ["lang", "k", "context"]).select("lang", "k", "g", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("v"))
    weights = contexts.select("lang", "k", F.col("context").alias("g"), (F.col("d") * F.col("kinds") / F.col("total")).alias("v"))

    languages = sorted(r.lang for r in few.select("lang").distinct().collect())
    alphabet = counts.where("k = 1").select("g").distinct().count()
    g, s = _arrays(shares, languages, 0.0)
    c, w = _arrays(weights, languages, 1.0)
    model = Model(languages, g, s, c, w, alphabet)
    model.own = _own(orders[ORDER], model)
    return model


def _arrays(values: DataFrame, languages: list[str], missing: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the sorted keys of values (lang, k, g, v), and their values in each language, `missing` in those that lack a key."""
    found = values.select("k", "g", F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).alias("at"), F.col("v").cast("float").alias("v")).toArrow() if languages else None
    keys, out = [], []
    for order in range(1, ORDER + 1):
        part = found.filter(pc.equal(found["k"], order)) if found else None
        grams, at = np.unique(part["g"].to_numpy() if part else np.zeros(0, np.int64), return_inverse=True)
        row = np.full((len(grams), len(languages)), missing, np.float32)
        if part:
            row[at, part["at"].to_numpy() - 1] = part["v"].to_numpy()
        keys.append(grams)
        out.append(row)
    return keys, out


def _own(grams: DataFrame, model: Model) -> np.ndarray:
    """For each language the mean and the variance of the surprise of its own learning text, a symbol at a time."""
    shared = grams.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            surprise = shared.value.surprise(batch.column(1).to_numpy(zero_copy_only=False).copy())
            number = {lang: i for i, lang in enumerate(shared.value.languages)}
            own = surprise[np.arange(len(surprise)), [number[x] for x in batch.column(0).to_pylist()]] if len(surprise) else np.zeros(0)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n * own), pa.array(n * own**2)], ["lang", "n", "s", "s2"])

    found = grams.mapInArrow(run, "lang string, n long, s double, s2 double").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).collect()
    rows = {r.lang: (r.s / r.n, max(r.s2 / r.n - (r.s / r.n) ** 2, 1e-6)) for r in found}
    return np.array([rows[x] for x in model.languages]).reshape(-1, 2)


class Scorer:
    """Texts -> (language, score, rejected), with a memo of words."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.languages) + 1), np.float32)

    def _know(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > MEMO:
            self.number.clear()
            new = list(words)
        first = len(self.number)
        if first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:first], np.zeros((first + 2 * len(new), self.rows.shape[1]), np.float32)])
        self.rows[first : first + len(new)] = self.model.words(new)
        self.number.update(zip(new, range(first, first + len(new)), strict=True))

    def totals(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each text the surprise in each language and the number of symbols; None without a letter."""
        words = [LETTERS.findall(t.lower()) for t in texts]
        self._know(set().union(*words))
        # The words' pattern lets numerals such as U+00B2 pass; they are no letters.
        return [self.rows[np.fromiter(map(self.number.__getitem__, w), np.int64, len(w))].sum(0, dtype=np.float64) if any(c.isalpha() for x in w for c in x) else None for w in words]

    def errors(self, total: np.ndarray, language: int) -> float:
        """How many standard errors a text's cross-entropy lies above a language's own."""
        mean, variance = self.model.own[language]
        return float((total[language] / total[-1] - mean) / np.sqrt(variance / total[-1]))

    def batch(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        return [self._one(x) for x in self.totals(texts)]

    def _one(self, total: np.ndarray | None) -> tuple[str, float, bool]:
        model = self.model
        if not model.languages or total is None:
            return "und", 0.0, True
        entropy = total[:-1] / total[-1]
        best = int(entropy.argmin())
        odds = np.exp2((entropy[best] - entropy) * min(total[-1], SURE))
        return model.languages[best], float(1 / odds.sum()), bool(self.errors(total, best) > model.limits[best])


def identified(docs: DataFrame, model: Model | None = None, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs (doc_id, text; lang if no model is given).
    With reject, rejected texts get `und`."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                found = scorer.batch(part.column(2).to_pylist())
                lang = ["und" if reject and r else x for x, _, r in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([r for _, _, r in found], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(run, schema)
