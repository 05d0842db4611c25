"""The corpus pipeline against a version that does each stage by brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quireworks.llm import mixing, near_dedup
from quireworks.llm.exact_dedup import EXACT_SQL
from quireworks.llm.mixing import MIX_SQL
from quireworks.llm.quality_rules import QUALITY_SQL


def corpus():
    """Documents of three sources, with exact copies (white space aside), near copies in chains, short, noisy and empty texts."""
    rng = random.Random(11)
    word = lambda: rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") + rng.choice(["", "en", "ing", "ly", "s"])
    texts = [" ".join(word() for _ in range(rng.randint(60, 220))) for _ in range(60)]
    for base in texts[:12]:
        words = base.split()
        for _ in range(rng.randint(1, 4)):
            words = list(words)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = word()
            texts.append(rng.choice([" ", "\n"]).join(words))
    texts += [t.replace(" ", "  ", 3) for t in texts[20:28]] + ["too short", "", None, "# $ % " * 60, "same " * 80, "A" * 3000, texts[30] + "!" * 200]
    rng.shuffle(texts)
    return [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["web", "books", "web", None]), len(t or "")) for i, t in enumerate(texts)]


def near_kept(rows, words=5, percent=80):
    """The ids of the least member of each component, by comparing all pairs."""
    sets = {}
    for d, text, *_ in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets[d] = {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()
    label = {d: d for d in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d for d in sets if label[d] == d}, linked


def test_pipeline_brute(spark, tmp_path):
    rows, columns = corpus(), ["doc_id", "text", "lang", "source", "n_chars"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    con = duckdb.connect()

    def asked(statement):
        con.register("documents", pd.DataFrame(rows, columns=columns).astype({"doc_id": "int64", "text": "object", "source": "object"}))
        return con.execute(statement).df()

    kept = asked(QUALITY_SQL).query("kept").doc_id
    rows = [r for r in rows if r[0] in set(kept)]
    kept = asked(EXACT_SQL).query("kept").doc_id
    assert len(kept) < len(rows)
    rows = [r for r in rows if r[0] in set(kept)]
    kept, linked = near_kept(rows)
    assert linked and len(kept) < len(rows)
    rows = [r for r in rows if r[0] in kept]
    mixed = asked(MIX_SQL)
    copies = {d: t // s for d, s, t in zip(mixed.doc_id, mixed["size"], mixed.taken, strict=True)}
    assert len(set(copies.values())) > 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, text, *_ in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[d, len(ids), digest(",".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))] += copies[d]
    assert got == +want


def test_stages_on_nothing(spark):
    """Empty tables, clashing columns and nulls in every column pass all stages; all but the last keep the columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    some = [(None, None, None, None, None), (1, "plain words that go on " * 30, None, None, None)]
    for data in ([], some):
        docs = spark.createDataFrame(data, schema).withColumns({c: F.lit(1) for c in ("size", "kept", "copies", "range", "n", "start", "own", "k", "salt", "rep", "taken", "of", "digest", "finish", "part")})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, "")
            assert after.columns == docs.columns
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_stages_with_all_names_of_the_code(spark):
    """Extra columns of every name that the stages' modules write themselves, in texts of the code."""
    folder = Path(mixing.__file__).parent
    files = [folder / f"{x}.py" for x in ("common", "exact_dedup", "near_dedup", "mixing", "quality_rules", "bpe")] + [folder.parent / "storage.py"]
    names = sorted({name.lower() for file in files for name in re.findall(r'["\']([A-Za-z_]\w*)["\']', file.read_text())} - {"doc_id", "text", "source", "lang", "n_chars"})
    assert {"mark_bits", "exact_id", "gone_id", "mix_copies", "rest"} <= set(names)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") + rng.choice(["en", "ing", "ly", "s"]) for _ in range(120)) for _ in range(6)]
    rows = [(i, texts[i % 6] + [".", ". ", " more"][i % 3], "en", "ab"[i % 2], i) for i in range(24)] + [(3, texts[0], "en", "a", 1), (None, texts[1], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain, wide = docs, docs.withColumns({name: F.lit(name) for name in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, plain, ""), stage(spark, wide, "")
        assert wide.columns == docs.columns + names, name
        assert Counter(map(tuple, wide.select(*docs.columns).collect())) == Counter(map(tuple, plain.collect())) != Counter(), name
        assert all(r[x] == x for r in wide.collect() for x in names)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, "").count() == plain.count()


def test_near_copies_with_text_ids(spark):
    """Ids of any ordered type: the same groups as with numbers in their order."""
    words = [f"w{i}" for i in range(60)]
    rows = [(f"id{i:02}", " ".join(words[: 50 + i % 3])) for i in range(9)] + [("x", "something else entirely in here"), (None, " ".join(words)), ("y", None), ("id00", "one text of its own that nothing else has")]
    texts = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id string, text string"))
    order = {x: i for i, x in enumerate(sorted({i for i, _ in rows if i}))}
    numbers = near_dedup.near_groups(spark.createDataFrame([(order.get(i), t) for i, t in rows], "doc_id int, text string"))
    got = Counter((order.get(r.doc_id), r.n_shingles, order.get(r.component_id), r.kept) for r in texts.collect())
    assert got == Counter(map(tuple, numbers.collect())) and texts.schema["component_id"].dataType.simpleString() == "string"
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(r.doc_id or "" for r in left.collect()) == ["", "id00", "id00", "x", "y"]


def test_mix_of_equal_keys(spark):
    """A third of the rows without an id, a third with one id, some rows equal: as SQL has it, and the documents are taken as often as the mix says."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["sea", "ship", "wind"]) for _ in range(n))
    rows = [(None, text(rng.choice([3, 5, 5])), rng.choice("abc")) for _ in range(100)] + [(7, text(4), rng.choice("ab")) for _ in range(100)] + [(i, text(rng.randint(0, 9)), rng.choice(["a", "b", "c", None])) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = Counter(tuple(r) for r in mixing.mixture(docs).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert got == Counter(con.execute(MIX_SQL).fetchall())
    taken, mixed = Counter(), Counter()
    for (_, size, source_size, _, words), n in got.items():
        taken[source_size] += words * n
    sizes = Counter()
    for _, t, source in rows:
        sizes[source] += len(t.split())
    for r in mixing.mixed_documents(docs).collect():
        mixed[sizes[r.source]] += len(r.text.split())
    assert mixed == +taken


def test_mix_follows_finish_times(spark, monkeypatch):
    """The cut decides: with the schedule's order turned round, other documents are taken."""
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 3 == 0]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = sorted(map(tuple, mixing.mixture(docs).collect()))
    monkeypatch.setattr(mixing, "_order", lambda: [F.col("finish").desc(), F.col("source").asc_nulls_last(), F.col("start").asc()])
    assert sorted(map(tuple, mixing.mixture(docs).collect())) != plain
