"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams, with DataFrame functions only.

1. Words are counted over all texts, with partial counts in each task. A word's occurrences in one document are read alike (the one code point that a damaged run loses depends on document and run alone).
2. Bigrams are ordered by how many words' places have them, rare ones first. Each word is known by its three rarest bigrams, equal ones by place.
3. One edit spoils two of a word's bigrams at most, in either word, and leaves the others in the same order; so the rarest unspoilt one is among the three of both words, and stands before or behind the edit.
   Before it, both words are equal up to the bigram's end, and its place is the same; behind it, they are equal from the bigram on, and its place differs by what the lengths differ. The join is on these:
   the part up to or from a rare bigram, and the length, which differs by one at most. What meets is verified: first by which letters the words have, then by edit distance.
4. A word's form is its most frequent near word, if at least `TIMES` as frequent. Forms are at least twice as frequent at each step, so chains are short; roots are found by pointer jumping.

Scale: texts are read once. Only counts are shuffled, then six keys a word. A bucket of words that share a key is dealt out in blocks of `BLOCK` words, each of which meets the whole bucket, so no task holds
all pairs of a bucket, and pairs that fail the verification are never written. The order of bigrams goes to all tasks as a list of 2 ** 16 numbers, whatever the input, as letters
have 8 bits.

Edge cases: null text has no words; a null id counts as empty text in the damage rule; empty and one-letter damaged runs are no words; ties of frequency go to the smallest word in code-point order; repeated rows count each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import growing, stored, text_of

# Fixed values of the contract: runs of letters, one run in DAMAGED loses a code point, a word's least length and count, and how much more frequent a form is.
RUN = r"[A-Za-zÀ-ÿ]+"
DAMAGED, LETTERS, TIMES_SEEN, TIMES = 97, 5, 3, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rare bigrams by which a word is known: one more than an edit spoils.
RAREST = 3
#: Words of a bucket that meet the bucket in one group.
BLOCK = 4096


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of docs (doc_id, text) that are long and frequent enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))).alias("run"))
    # lower() is the quick way where no letter is upper case but A to Z.
    rows = rows.select("id", F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", UPPER, LOWER)).otherwise(F.lower("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return rows.select(F.when(h % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= TIMES_SEEN) & (F.char_length("word") >= LETTERS))


def _bigrams(word: str) -> Column:
    """The places of a word's bigrams, from 1, with the bigram's number: its two code points, 8 bits each."""
    code = lambda i: F.ascii(F.substring(F.col(word), i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.struct((code(i) * 256 + code(i + 1)).alias("gram"), i.alias("at")))


def rare_bigrams(found: DataFrame) -> DataFrame:
    """found: word. For each word its RAREST rarest bigrams: word, at (their places, from 1)."""
    each = found.select(F.explode(_bigrams("word")).alias("x")).groupBy("x.gram").agg(F.count(F.lit(1)).alias("places"))
    every = found.sparkSession.range(1 << 16).withColumnRenamed("id", "number").join(each, F.col("number") == F.col("gram"), "left")
    order = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", F.coalesce("places", F.lit(0)).alias("places")))), lambda x: x["places"]).alias("order"))
    order = stored(order, "bigrams").scalar()  # a list of 2 ** 16 numbers, whatever the input
    ranked = F.transform(_bigrams("word"), lambda x: F.struct(F.element_at(F.col("order"), x["gram"] + 1).alias("places"), x["gram"].alias("gram"), x["at"].alias("at")))
    return found.select("word", order.alias("order")).select("word", F.transform(F.slice(F.array_sort(ranked), 1, RAREST), lambda x: x["at"]).alias("at"))


def _keys(rare: DataFrame) -> DataFrame:
    """rare: word, at. A row for each part of a word up to or from a rare bigram: word, length, letters (which it has, as bits), part (hash of it)."""
    letters = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))))
    sides = F.transform("at", lambda i: F.array(F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), i + 1)), F.concat(F.lit(">"), F.substring(F.col("word"), i, F.char_length("word")))))
    rows = rare.withColumns({"length": F.char_length("word"), "letters": letters})
    return rows.select("word", "length", "letters", F.explode(F.array_distinct(F.transform(F.flatten(sides), lambda x: F.xxhash64(x)))).alias("part"))


def near_words(found: DataFrame) -> DataFrame:
    """found: word. The pairs (a, b) of words that differ by exactly one inserted, deleted or replaced code point, each pair once."""
    keys = stored(_keys(rare_bigrams(found)), "spelling-keys")
    # The shorter word, or the first of two as long, meets words of its length and of one more.
    one = keys.select(F.col("word").alias("a"), F.col("length").alias("n"), F.col("letters").alias("has"), "part", F.explode(F.array(F.col("length"), F.col("length") + 1)).alias("length"))
    sizes = keys.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > BLOCK).select("part", "length", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "spelling-large")
    two = keys.join(growing(large), ["part", "length"], "left").select(F.col("word").alias("b"), "length", F.col("letters").alias("others"), "part", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    two = two.withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).drop("blocks")
    one = one.join(growing(large), ["part", "length"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    met = one.join(growing(two), ["part", "length", "block"])
    met = met.where((F.col("n") < F.col("length")) | (F.col("a") < F.col("b")))
    met = met.where(F.bit_count(F.col("has").bitwiseXOR(F.col("others"))) <= 2).where(F.levenshtein("a", "b", 1) == 1)
    return met.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form. Each word with the last form that its chain of forms comes to: word, root. Chains have no cycles."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("of"), F.col("root").alias("beyond"))
        after = stored(at.join(growing(ahead), F.col("root") == F.col("of"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        at = after.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of docs (doc_id, text): word, form (null if none), root, n, n_near, form_n."""
    found = stored(words(docs), "spelling-words")
    pairs = stored(near_words(found), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = found.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = both.join(growing(known), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word"))).alias("best"))
    rows = found.join(growing(near), F.col("word") == F.col("a"), "left")
    better = -F.col("best.less") >= TIMES * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "spelling-forms")
    ends = roots(rows.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return rows.join(growing(ends), F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY ALL),
h AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM d, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM c GROUP BY word HAVING sum(k) >= 3 AND length(word) >= 5),
x AS (SELECT word, length(word) AS n, i, word[: i - 1] || word[i + 1 :] AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.n = b.n AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word),
f AS (
  SELECT w.word, any_value(w.n) AS n, count(p.b) AS n_near, min(struct_pack(less := -o.n, form := o.word)) AS best FROM w LEFT JOIN p ON p.a = w.word LEFT JOIN w o ON o.word = p.b GROUP BY w.word),
g AS (SELECT word, n, n_near, CASE WHEN n_near > 0 AND -best.less >= 2 * n THEN best.form END AS form, CASE WHEN n_near > 0 AND -best.less >= 2 * n THEN -best.less END AS form_n FROM f),
t AS (SELECT word, word AS root FROM g UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.word = t.root WHERE g.form IS NOT NULL),
e AS (SELECT t.word, t.root FROM t JOIN g ON g.word = t.root WHERE g.form IS NULL GROUP BY ALL) -- the last of each chain
SELECT g.word, form, any_value(e.root) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n FROM g JOIN e ON e.word = g.word GROUP BY g.word, form
"""
