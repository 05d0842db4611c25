"""Each operator over documents: nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quireworks.llm import bpe, exact_dedup, language_id, mixing, near_dedup, quality_rules, token_files, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACES = " \t\n\x0b\f\r"
CLASHES = "n size part k key salt h slot rep block row start copy digest bands norm keep kept text_sha256 target taken of to id score".split()


def words(rng, n):
    return " ".join(rng.choice(["the", "sea", "Ship", "été", "of", "x1", "old", "wind", "and", "über", "go", "far", "tide", "sand"]) + rng.choice(["", "", "s", ".", "ing"]) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [words(rng, n) for n in (1, 2, 3, 4, 60, 80, 120, 200, 300, 20_000)]
    texts = [None, "", "  \n\t", None, "...", " ", *base, base[4], base[4] + "\n", base[4].replace(" ", "\t"), base[0], base[0]]
    for i in (6, 7, 8):
        for k in (0, 3, 6, 9, 30):
            w = base[i].split()
            for _ in range(k):
                w[rng.randrange(len(w))] = "changed%d" % rng.randrange(99)
            texts.append(" ".join(w))
    texts += ["line one here\n" * 30, "x" * 200_000, "a<|endoftext|>b  c", "THE SHIP WENT DOWN!! " * 20, "# $ % & " * 40]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s0", None, "s9"][i % 4]) for i, t in enumerate(texts)]
    rows += [(7, base[1], "fr", "s9"), (None, base[5], "en", "s1"), (None, None, None, None)]
    rows += [rows[10], rows[10]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES))).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(text):
    return (text or "").translate({ord(c): None for c in SPACES})


def key(r):
    return tuple((x is not None, x) for x in r)


def test_exact(docs, rows, empty):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[strip(t)].append((-len(t or ""), d is not None, d))
    want = []
    for d, t, *_ in rows:
        n, _, keep = min(groups[strip(t)])
        want.append((d, keep, len(groups[strip(t)]), d == keep and len(t or "") == -n, hashlib.sha256(strip(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    texts = [strip(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({strip(t) for _, t, *_ in rows})
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_collision(spark, docs, rows, monkeypatch):
    """With a hash of one value, all texts collide; the bytes still tell them apart."""
    good = sorted((tuple(r)[:4] for r in exact_dedup.exact_groups(docs).collect()), key=key)
    real = exact_dedup._keyed
    monkeypatch.setattr(exact_dedup, "_keyed", lambda d: real(d).withColumn("k", F.lit(b"same")))
    assert sorted((tuple(r)[:4] for r in exact_dedup.exact_groups(docs).collect()), key=key) == good


def shingles(text, n):
    found = [w for w in (text or "").encode().lower().split()]
    if not found:
        return frozenset()
    return frozenset(zip(*(found[i:] for i in range(n)), strict=False)) if len(found) >= n else frozenset([tuple(found)])


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near(docs, rows, empty, n, percent):
    sets = [(d, shingles(t, n)) for d, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if a is not None and b is not None and s and 100 * len(s & t) >= percent * len(s | t):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)].append(d)
    want = [(d, len(s), None if d is None else min(least[root(i)]) if s else d) for i, (d, s) in enumerate(sets)]
    want = [(d, m, c, d == c) for d, m, c in want]
    got = [tuple(r) for r in near_dedup.near_groups(docs, n, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.drop_near_copies(docs, n, percent).columns == docs.columns


def test_near_blocks(spark, monkeypatch):
    """Cells of several blocks: edited copies of one text, some of them linked with other copies only."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(3)
    base = words(rng, 150).split()
    made = [base]
    for _ in range(60):
        w = list(rng.choice(made))
        for _ in range(rng.choice([2, 4, 8])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        made.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    sets = [shingles(t, 3) for _, t in rows]
    parent = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert len(set(parent)) > 3
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(parent))


def test_quality(docs, rows, empty):
    def base(t):
        w, t = (t or "").encode().split(), t or ""
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)

    got = quality_rules.judged(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((d, *base(t)) for d, t, *_ in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.rule is None) and not (r.kept and r.base_failed)
    orders = [list(quality_rules.RULES), list(quality_rules.RULES)[::-1]]
    verdicts = [sorted(((r.doc_id, r.n_words, r.kept) for r in quality_rules.judged(docs, o).collect()), key=key) for o in orders]
    assert verdicts[0] == verdicts[1]
    good = quality_rules.good_documents(docs)
    assert good.columns == docs.columns and good.count() == sum(r.kept for r in got) > 0
    assert quality_rules.judged(empty).count() == 0


def test_mixing(docs, rows, empty):
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
            open_.remove(s)
    got = mixing.mixture(docs).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode().split())) for d, t, *_ in rows if d is not None)
    assert len(got) == len(rows)
    taken, largest, of = Counter(), Counter(), {v: s for s, v in sizes.items()}
    for r in got:
        s = of[r.source_size]
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, mixing.mixture(docs.repartition(5)).collect()), key=key)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mixture(empty).count() == 0


def test_mixing_of_many_words(spark):
    """A budget of more than 2 ** 30 words: twice that is no int."""
    size = 100_000_000
    sizes = spark.range(15).selectExpr("'a' AS source", "id AS doc_id", f"{size}L AS size", "1L AS n", f"id * {size} AS start")
    found = mixing.cut(mixing.schedule(sizes, mixing.targets(sizes)), 15 * size).collect()
    assert [tuple(r) for r in found] == [("a", 14 * size)]


def test_round_trip(docs, rows, empty):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=key) == sorted(want, key=key)
    ids = bpe.encoded(docs.where("doc_id < 9"), PATH).collect()
    assert all(r.ids == tokenizer.encode(r.decoded, add_special_tokens=False).ids for r in ids)
    assert bpe.round_trip(empty, PATH).count() == 0


def test_token_files(docs, rows, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 2000)
    tokenizer = Tokenizer.from_file(PATH)
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    got = token_files.token_digests(docs, PATH, 2).collect()
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((d, len(x), crc(x)) for d, xs in ids.items() for x in xs), key=key)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, PATH, 2, path)
    read = token_files.read_ids(docs.sparkSession, path).collect()
    assert sorted(((r.doc_id, list(r.ids)) for r in read), key=key) == sorted(((d, x) for d, xs in ids.items() for x in xs), key=key)
    assert token_files.token_digests(empty, PATH, 2).count() == 0


def test_held_out_never_teaches(spark):
    """Rows that are held out carry wrong labels; neither model follows them."""
    rng = random.Random(9)
    voc = {"aa": ["mara", "nalo", "ossa", "pella"], "bb": ["krish", "thogg", "brunk", "szent"]}
    rows, labels = [], []
    for i in range(400):
        held = zlib.crc32(str(i).encode()) % 4 == 2
        lang, toxic = ("aa", "bb")[i % 2], i % 5 == 0
        text = [rng.choice(voc[lang]) + rng.choice("aeiou") for _ in range(40)] + (["grumsel"] * 2 if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), ("bb" if lang == "aa" else "aa") if held else lang, "s"))
        labels.append((i, 1, int(toxic != held)))
    docs = spark.createDataFrame(rows, SCHEMA)
    truth = {r[0]: ("aa", "bb")[r[0] % 2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in language_id.identified(docs).collect())
    got = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in got)
    assert any(r.held_out for r in got) and any(not r.held_out for r in got)


def test_language_model_keeps_every_ngram(spark):
    """Some 400,000 n-grams of noisy words: each has an entry of its own."""
    rng = random.Random(5)
    texts = [(i, [chr(0x4E00 + rng.randrange(20_000)) + chr(0x4E00 + rng.randrange(20_000)) + chr(0x4E00 + rng.randrange(20_000)) for _ in range(1000)]) for i in range(40)]
    model = language_id.train(spark.createDataFrame([(i, " ".join(words), "zh", "s") for i, words in texts], SCHEMA))
    want = set()
    for i, words in texts:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for w in words:
                marked = f"\0\0\1{w}\2"
                want |= {marked[at - n : at] for at in range(4, len(marked) + 1) for n in range(1, 5)}
    assert sum(np.size(x) for x in model.grams) == len(want)


def test_models_edges(spark, docs, rows, empty):
    found = language_id.identified(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[0].lang_pred == by[1].lang_pred == by[4].lang_pred == "und" and by[0].score == 0
    assert {r.lang_pred for r in found} <= {"en", "fr", "und"}
    odd = spark.createDataFrame([(1, "² ½ 12 _", "en", "s"), (2, "a the ship", "en", "s"), (3, "the", "en", "s"), (4, "² a", "en", "s")], SCHEMA)
    assert [r.lang_pred for r in language_id.identified(odd).orderBy("doc_id").collect()] == ["und", "en", "en", "en"]
    assert language_id.identified(empty).count() == 0
    assert {r.lang_pred for r in language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    labels = spark.createDataFrame([(3, 1, None), (None, 1, 1), (10, 1, 1), (10, 1, 0), (11, 0, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.scored(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.scored(empty, labels).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    good = [" ".join(f"w{rng.randrange(4000)}" for _ in range(120)) for _ in range(12)]
    near = " ".join([*good[0].split()[:-2], "other", "end"])
    texts = [*good, good[3], good[3] + " ", near, "short", None, "# " * 90]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], SCHEMA + ", n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes, columns = [], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path)).cache()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        sizes.append({r.doc_id for r in docs.collect()})
    assert sizes[0] == set(range(15))
    assert sizes[1] == set(range(15)) - {3, 12}  # the longest original text stays
    assert sizes[2] == sizes[1] - {14}
    assert sizes[3] <= sizes[2] and len(sizes[3]) >= 8 and sizes[4] == sizes[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == sizes[4]
