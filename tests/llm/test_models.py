"""The models against independent computations."""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from quireworks.llm import language_id, quality_rules, toxicity


def kneser_ney(words, order=4):
    """symbol and its context (the three before it) -> probability, by the definition, on strings."""
    grams = Counter()
    for w in words:
        s = "\x00\x00\x01" + w + "\x02"
        grams.update(s[i - 3 : i + 1] for i in range(3, len(s)))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    alphabet = len(counts[1])

    def p(gram):
        below = p(gram[1:]) if len(gram) > 1 else 1 / alphabet
        mine = counts[len(gram)]
        ones, twos = (sum(n == k for n in mine.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        same = [n for g, n in mine.items() if g[:-1] == gram[:-1]]
        return (max(mine[gram] - d, 0) + d * len(same) * below) / sum(same) if same else below

    return p


def test_kneser_ney(spark):
    texts = {"xx": "the sea the ship the seas went out and the wind", "yy": "das meer das schiff die see und der wind und das"}
    rows = [(i, text, lang) for i in range(0, 40) for lang, text in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id._finished(language_id._learn(docs).groupBy("lang", "g").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"))
    kept = docs.where(~language_id.held_out()).select("doc_id").distinct().count()
    asked = ["the", "see", "schiff", "wind", "qua", "a"]
    got = model.words(asked)
    alphabet = len({c for t in texts.values() for w in t.split() for c in w} | {"\x02"})
    for i, lang in enumerate(model.languages):
        p = kneser_ney(texts[lang].split() * kept)
        own = len({c for w in texts[lang].split() for c in w} | {"\x02"})
        for word, found in zip(asked, got, strict=True):
            s = "\x00\x00\x01" + word + "\x02"
            if all(c in texts[lang] for c in word):  # the uniform part of unseen letters is over all languages' letters
                want = -sum(math.log2(p(s[j - 3 : j + 1])) for j in range(3, len(s)))
                assert found[i] == pytest.approx(want, rel=0.05 if own != alphabet else 1e-4)
    assert model.words(["the"])[0][0] < model.words(["the"])[0][1]


def test_rejection_rate(spark):
    """Of a language's own held-out texts few are rejected, of letters at random most."""
    rng = np.random.default_rng(1)
    words = ["sea", "ship", "wind", "tide", "sand", "old", "far", "going", "storm", "harbour"]
    rows = [(i, " ".join(rng.choice(words, 30)), "xx") for i in range(600)] + [(1000 + i, " ".join("".join(rng.choice(list("qxzjkvwy"), 6)) for _ in range(30)), None) for i in range(50)]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    own = [r.rejected for r in got if r.doc_id < 1000 and r.held_out]
    assert sum(own) <= 0.05 * len(own) and all(r.rejected for r in got if r.doc_id >= 1000)


def test_label_model_knows_copies():
    """A voter and its copies tell as much as the voter alone; wrong labels are outvoted; accuracies are found."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    votes = np.column_stack([np.where(truth, rng.random(4000) < hit, rng.random(4000) < miss) for hit, miss in ((0.7, 0.02), (0.5, 0.05), (0.6, 0.01), (0.3, 0.1))]).astype(float)
    given = np.where(rng.random(4000) < 0.1, ~truth, truth).astype(float)
    q = toxicity.label_model(votes, given)
    assert ((q > 0.5) == truth).mean() > (given == truth).mean() + 0.04
    copies = np.column_stack([votes, *[votes[:, 3]] * 5])
    parent = toxicity.correlations(copies, q)
    assert sum(parent[i] < 3 for i in range(3, 9)) == 1 and set(toxicity.correlations(votes, truth.astype(float))) == {-1}
    with_copies = toxicity.label_model(copies, given)
    assert np.abs(with_copies - q).mean() < 0.02

    naive = lambda v: (v @ np.log(((v.T @ truth + 1) / (truth.sum() + 1)) / ((v.T @ ~truth + 1) / ((~truth).sum() + 1))))
    assert np.abs(naive(copies) - naive(votes)).mean() > 0.3  # what independence would make of them


def test_mined_rates(spark):
    """Beginnings that toxic texts have often are found, though clean texts have them now and then."""
    rng = np.random.default_rng(5)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}a" for i in range(12) for j in range(12)]

    def text(toxic):
        words = list(rng.choice(plain, 120))
        for _ in range(3 if toxic else int(rng.random() < 0.3)):
            words[rng.integers(120)] = f"grrl{rng.choice(['ab', 'cd', 'ef', 'gh', 'ij'])}"
        return " ".join(words)

    docs = [(i, text(i % 8 == 0), int(i % 8 == 0)) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    got = toxicity.scored(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    truth = {d: t for d, _, t in docs}
    held = [r for r in got if r.held_out]
    caught = sum(r.predicted for r in held if truth[r.doc_id])
    assert caught >= 0.9 * sum(truth[r.doc_id] for r in held) and sum(r.predicted for r in held if not truth[r.doc_id]) <= 0.03 * len(held)


def test_cascade_order():
    """Greedy, given what is rejected and computed already; against the definition, and cheaper than the order given."""
    rng = np.random.default_rng(7)
    rejected = rng.random((500, 4)) < (0.02, 0.3, 0.25, 0.1)
    rejected[:, 2] |= rejected[:, 1]  # the third adds little to the second
    needs = {"a": {"x"}, "b": {"x", "y"}, "c": {"x", "y", "z"}, "d": {"v"}}
    cost = {"x": 1.0, "y": 4.0, "z": 1.0, "v": 3.0}
    order = quality_rules.cascade(rejected, needs, cost)

    def spent(names):
        total = 0.0
        for row in rejected:
            known = set()
            for name in names:
                total += sum(cost[f] for f in needs[name] - known)
                known |= needs[name]
                if row[list(needs).index(name)]:
                    break
        return total

    left, known, want = np.ones(500, bool), set(), []
    while len(want) < 4:
        rest = [n for n in needs if n not in want]
        best = max(rest, key=lambda n: rejected[left][:, list(needs).index(n)].sum() / (sum(cost[f] for f in needs[n] - known) + 1e-9))
        want.append(best)
        left &= ~rejected[:, list(needs).index(best)]
        known |= needs[best]
    every = [spent(x) for x in itertools.permutations(needs)]
    assert order == want and spent(order) < sum(every) / len(every)


def test_shared_groups(spark):
    groups = defaultdict(int)
    for row in quality_rules.judged(spark.createDataFrame([(1, "- a b c\n" * 30), (2, "7777 " * 60), (3, "one " * 40 + "two three four five six " * 4), (4, None)], "doc_id long, text string"), list(quality_rules.RULES)[::-1]).collect():
        groups[row.rule] += 1
        assert not row.kept
    assert groups["one_word"] >= 1
