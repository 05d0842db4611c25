"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model over their votes, and a linear classifier trained on its posterior labels.

1. Voters: a fixed lexicon, one voter a word; patterns (shouting, exclamation, density of marked words); and up to `MINED` words and word beginnings, each with how often a text
   must have it, that mark labelled rows, mined by the likelihood ratio of their document counts. A voter votes "toxic" or is silent.
2. Label model: expectation maximisation over the unknown true label of each row. A voter's rates of votes in toxic and in clean texts are its accuracy. Correlations are modelled by a
   tree: a voter depends on the one with which it shares most information once the class is known, if that is more than chance, and its rates are then estimated for each vote of that
   one. The given labels are one more voter, whose two rates are estimated as well, from a prior that trusts it (`LABEL_PRIOR`).
3. Classifier: logistic regression with L2 penalty on votes, hits and hits per word, fitted to the posterior labels.

Learning uses a bounded sample of labelled rows that aren't held out: `LABELLED` expected rows, chosen by a hash of the id. All texts are scored in one pass without a
shuffle; what is broadcast is the sample's ids and the voters, both bounded by those parameters.

Edge cases: null and empty texts get the score of a text without votes. Null labels teach nothing; of several labels of one id the largest counts. Without labelled rows or without both classes
among them, the lexicon's voters alone decide. Null ids and repeated rows pass through; other columns, lang and source among them, are never read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored, text_of
from .near_dedup import shingle_set

LABELLED = 40_000
MINED = 64
#: A mined voter marks at least so many labelled toxic texts.
SUPPORT = 6
#: And has at least this log likelihood ratio: among millions of terms, chance alone reaches lower ones.
TELLING = 15.0
#: Texts' worth of belief in the given labels: toxic ones marked and not marked, clean ones marked and not marked.
LABEL_PRIOR = ((18, 2), (1, 49))
#: Ways in which a mined term votes: where it occurs, or where it occurs twice or more and at least once in so many words.
RATES = (0, 150, 75)
#: The same for all terms together, as two pattern voters.
DENSE = (100, 64)
#: Least G statistic (twice the log likelihood ratio) by which two voters count as correlated.
CORRELATED = 15.0
ROUNDS = 25
CUT = 0.3
MEMO = 200_000
#: Terms that a task counts before it hands the counts on.
TERMS = 100_000
LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7, 8)
# Insults and abuse that vote wherever they occur.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "filth", "imbecile", "vermin", "retard", "bastard", "bitch", "asshole", "fuck", "shit")


def terms_of(word: str) -> list[str]:
    """The terms a word counts for: itself (marked by a final space) and its beginnings."""
    return [word + " ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def parted(mined: str) -> tuple[str, int]:
    """A mined term's name: the term, and its place in RATES."""
    return mined[:-1], int(mined[-1])


def often(n: int, words: int, rate: int) -> bool:
    return n >= 1 if not rate else n >= 2 and n * rate >= words


class Voters:
    """Terms and patterns over a text's words. Mined terms are named as mine() does."""

    def __init__(self, mined: list[str]):
        self.terms = [*((w + " ", 0) for w in LEXICON), *map(parted, mined)]
        self.of: dict[str, list[tuple[int, int]]] = {}
        for i, (term, rate) in enumerate(self.terms):
            self.of.setdefault(term, []).append((i, RATES[rate]))
        self.n = len(self.terms) + 2 + len(DENSE)
        self.memo: dict[str, tuple[str, ...]] = {}

    def hit(self, word: str) -> tuple[str, ...]:
        found = self.memo.get(word)
        if found is None:
            found = tuple(term for term in terms_of(word) if term in self.of)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def votes(self, text: str) -> tuple[int, int, int]:
        """Votes as bits, words hit, words."""
        words = LETTERS.findall(text.lower())
        bits = hits = 0
        count: dict[str, int] = {}
        for found in map(self.hit, words):
            if found:
                hits += 1
                for term in found:
                    count[term] = count.get(term, 0) + 1
        for term, n in count.items():
            for i, rate in self.of[term]:
                bits |= often(n, len(words), rate) << i
        for i, rate in enumerate(DENSE, len(self.terms)):
            bits |= often(hits, len(words), rate) << i
        data = text.encode("utf-8", "surrogatepass")
        upper = len(data) - len(data.translate(None, bytes(range(65, 91))))
        bits |= (2 * upper > len(data)) << (self.n - 2)
        bits |= (data.count(b"!!") * 5 > len(words) > 0) << (self.n - 1)
        return bits, hits, len(words)

    def features(self, found: list[tuple[int, int, int]]) -> np.ndarray:
        """Votes, then log of hits, hits per word, and whether any term votes."""
        width = (self.n + 7) // 8
        raw = np.frombuffer(b"".join(b.to_bytes(width, "little") for b, _, _ in found), np.uint8).reshape(len(found), width)
        votes = np.unpackbits(raw, axis=1, bitorder="little")[:, : self.n].astype(float)
        hits = np.array([[h, w] for _, h, w in found], float).reshape(-1, 2)
        return np.column_stack([votes, np.log1p(hits[:, 0]), np.minimum(1, 10 * hits[:, 0] / np.maximum(hits[:, 1], 1)), hits[:, 0] > 0])


# --- learning ---------------------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """text, toxic of the labelled rows to learn from."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < int((1 << 62) * most / n))
    ids = F.broadcast(known.withColumnRenamed("doc_id", "of"))  # about `most` rows of two numbers
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("of")).groupBy("doc_id").agg(F.min(text_of()).alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")
    return stored(_apart(rows), "toxic-sample")


def _apart(rows: DataFrame) -> DataFrame:
    """Rows of the sample without near copies of others, which would pass the chance words of one text off as marks: of rows with one of
    three least shingle hashes in common, one stays."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), 3) for t in batch.column(0)]
            least = [pa.array([int((s * np.uint64(odd)).min()) >> 1 if len(s) else 0 for s in sets], pa.int64()) for odd in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *least], ["text", "toxic", "a", "b", "c"])

    rows = rows.mapInArrow(run, "text string, toxic int, a long, b long, c long")
    for key in ("a", "b", "c"):
        rows = rows.groupBy(F.col(key).alias("key")).agg(F.max(F.struct("toxic", "text", "a", "b", "c")).alias("row")).select("row.*")
    return rows.select("text", "toxic")


def mine(sample: DataFrame, most: int = MINED) -> list[str]:
    """Terms that mark toxic rows, each followed by its place in RATES, the most telling first; none is a beginning of another."""

    def run(batches):
        count: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            terms = list(set(count[0]) | set(count[1]))
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "clean": pa.array([count[0][t] for t in terms], pa.int64()), "toxic": pa.array([count[1][t] for t in terms], pa.int64())})
            count[0].clear()
            count[1].clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                times, words = Counter(), LETTERS.findall(text.as_py().lower())
                for word, n in Counter(words).items():
                    for term in terms_of(word):
                        times[term] += n
                count[toxic > 0].update(f"{t}{k}" for t, n in times.items() for k, rate in enumerate(RATES) if often(n, len(words), rate))
                if len(count[0]) + len(count[1]) > TERMS:
                    yield from flush()
        yield from flush()

    sizes = {r.toxic > 0: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        return []
    found = sample.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    p, p0, p1 = (F.col("a") + F.col("b")) / (n0 + n1), F.col("a") / n0, F.col("b") / n1
    part = lambda x, q: F.when(x > 0, x * F.log(F.when(x > 0, x) / q)).otherwise(0.0)
    ratio = n0 * (part(p0, p) + part(1 - p0, 1 - p)) + n1 * (part(p1, p) + part(1 - p1, 1 - p))
    best = found.where((F.col("b") >= max(SUPPORT, 0.005 * n1)) & (p1 > 4 * p0)).select("term", ratio.alias("ratio"))
    rows = best.where(F.col("ratio") >= TELLING).orderBy(F.col("ratio").desc(), F.length("term"), "term").limit(40 * most).collect()
    out: list[str] = []
    for r in rows:
        term = parted(r.term)[0].rstrip()
        if any(w.startswith(term) for w in LEXICON):
            continue
        if not any(term.startswith(t) or t.startswith(term) for t in (parted(x)[0].rstrip() for x in out)):
            out.append(r.term)
    return out[:most]


def _joint(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts of each pair of voters by their votes: [b of the one, c of the other, one, other]."""
    both = votes.T @ (votes * weight[:, None])
    one, n = votes.T @ weight, weight.sum()
    return np.array([[n - one[:, None] - one[None, :] + both, one[None, :] - both], [one[:, None] - both, both]])


def correlations(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each voter the one that it depends on, or -1: the tree of most shared information, given the class, by edges that pass CORRELATED."""
    g = np.zeros((votes.shape[1],) * 2)
    for weight in (q, 1 - q):
        n = np.maximum(_joint(votes, weight), 0)
        total = max(n.sum((0, 1)).max(), 1e-9)
        expected = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / total
        g += 2 * np.where(n > 1e-9, n * np.log(np.maximum(n, 1e-9) / np.maximum(expected, 1e-9)), 0).sum((0, 1))
    np.fill_diagonal(g, 0)
    parent, inside = np.full(len(g), -1), np.zeros(len(g), bool)
    best, by = np.zeros(len(g)), np.full(len(g), -1)
    for _ in range(len(g)):
        i = int(np.argmax(np.where(inside, -1, best)))
        parent[i], inside[i] = (by[i] if best[i] > CORRELATED else -1), True
        nearer = g[i] > best
        best, by = np.where(nearer, g[i], best), np.where(nearer, i, by)
    return parent


def label_model(votes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Posterior of "toxic" for rows of votes (0 or 1 each) and their given labels."""
    prior = np.clip(given.mean(), 0.01, 0.99)
    q = np.where(given > 0, 0.95, 0.05 * prior)
    alone = np.column_stack([votes, np.zeros(len(votes))])  # a voter without a parent depends on one that never votes
    for _ in range(ROUNDS):
        parent = correlations(votes, q)
        follows = alone[:, parent]
        evidence = np.zeros(len(votes))
        for led in (0, 1):
            mine = follows == led
            rate = []
            for w in (1 - q, q):
                base = (votes.T @ w + 0.5 * votes.mean(0)) / (w.sum() + 1)
                rate.append(np.clip(((votes * mine).T @ w + base) / (mine.T @ w + 1), 1e-5, 1 - 1e-5))
            evidence += (mine * np.where(votes > 0, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0])))).sum(1)
        (hit, missed), (wrong, right) = LABEL_PRIOR
        told = ((given @ q + hit) / (q.sum() + hit + missed), (given @ (1 - q) + wrong) / ((1 - q).sum() + wrong + right))
        sure = np.where(given > 0, np.log(told[0] / told[1]), np.log((1 - told[0]) / (1 - told[1])))
        # Voters that know one language are silent together in the others: the tree keeps that from counting more than once.
        logit = np.log(prior / (1 - prior)) + evidence + sure
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        prior = np.clip(q.mean(), 0.01, 0.99)
    return q


def fit(x: np.ndarray, q: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (q - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """The mined terms and the classifier's weights."""
    sample = labelled_sample(docs, labels)
    terms = mine(sample)
    voters = Voters(terms)

    def run(batches):
        mine_ = Voters(terms)
        width = (mine_.n + 7) // 8
        for batch in batches:
            found = [mine_.votes(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([b.to_bytes(width, "little") for b, _, _ in found], pa.binary()), pa.array([h for _, h, _ in found], pa.int64()), pa.array([w for _, _, w in found], pa.int64()), batch.column(1)], ["bits", "hits", "words", "toxic"])

    rows = sample.mapInArrow(run, "bits binary, hits long, words long, toxic int").toArrow().to_pylist()  # the bounded sample
    given = np.array([r["toxic"] > 0 for r in rows], float)
    if not given.any() or given.all():
        weights = np.zeros(voters.n + 4)
        weights[: len(LEXICON)], weights[-1] = 3.0, -3.0
        return terms, weights
    x = voters.features([(int.from_bytes(r["bits"], "little"), r["hits"], r["words"]) for r in rows])
    return terms, fit(x, label_model(x[:, : voters.n], given))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), learnt from labels (doc_id, toxic)."""
    terms, weights = train(docs, labels)
    schema = docs.select("doc_id").schema.add("held_out", "boolean").add("score", "double").add("predicted", "integer")

    def run(batches):
        voters = Voters(terms)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                x = voters.features([voters.votes(t.as_py()) for t in part.column(2)])
                score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text")).mapInArrow(run, schema)
