"""Pages, conversations, and the transducer's and the file format's own properties."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quireworks.llm import bpe, chat_format, html_extract, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab the\n'sé <|endoftext|>1!\t", max_size=200))
def test_encoding_is_the_librarys(encoder, tokenizer, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert bpe.encode_text(encoder, text) == want
    decoder = bpe.Decoder(encoder.spelling)
    assert "".join([decoder.feed([i]) for i in want] + [decoder.finish()]) == tokenizer.decode(want, skip_special_tokens=False)


def test_transducer_streams(encoder, tokenizer):
    """Long pre-tokens, fed in parts of any size: the same ids, and most of them before the end."""
    rng = random.Random(1)
    for text in ("a" * 3000, "ab" * 2000, "".join(rng.choice("abcdeétheing") for _ in range(4000)), "=" * 777, "ÃÂ" * 400):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        machine, data, got, at = bpe.Transducer(encoder.model), text.encode(), [], 0
        while at < len(data):
            n = rng.randrange(1, 300)
            got += machine.feed(data[at : at + n])
            assert len(machine.window) < 12 * encoder.model.lookahead
            at += n
        early = len(got)
        assert got + machine.finish() == want
        assert early > 0.5 * len(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50_000), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_blocks(ids, a, b):
    data = token_files.pack(np.array(ids, np.uint32))
    assert token_files.unpack(data).tolist() == ids
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert token_files.read_range(data, a, b).tolist() == ids[a:b]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><a href=/>Home</a></nav>
<article><header><h1>Ti&amp;tle</h1></header><p>One <b>two</b><i>three</i>&nbsp; four<br>five<p>Six &lt;7&#x41;<aside>skip</aside><ul><li>a<li>b</ul>
<div class="ad-box">buy</div><form><input>send</form><script>var x="</p>";</script><section id=comments><p>reader</section>
<table><tr><td>1<td>2<tr><td>3</table></article><div id="cookie-notice">ok</div><footer>&copy; me</footer></body></html>"""


def test_page():
    assert html_extract.extract(PAGE) == "Ti&tle\nOne twothree four five\nSix <7A\na\nb\n1 2\n3"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>a</nav>") == ""
    assert html_extract.extract("plain  text &am &amp") == "plain text &am &"
    assert html_extract.extract("<article><p>cut of") == "cut of"
    assert html_extract.extract("<article><p>cut <a href='x") == "cut"
    assert html_extract.extract("<div>" * 5000 + "deep") == "deep"


def wrapped(i, n=3):
    body = "".join(f"<p>words {i} {k} that differ on every page {i * k}</p>" for k in range(n))
    return f"<html><body><div class='top'>Our site</div><div class='story'><h2>Title {i}</h2>{body}<div>Read more of us</div></div><div class='end'>All rights</div></body></html>"


def held(page, wrapper):
    """The labels of a page's containers that the wrapper holds, in page order."""
    page = html_extract.Page(page)
    return [page.shape.labels[i] for i, x in enumerate(html_extract.addresses(page.shape, wrapper.pivot)) if x in wrapper.containers]


def test_wrapper():
    found = html_extract.induce([wrapped(i) for i in range(5)])
    assert found is not None and held(wrapped(9), found)[-1] == "div.story"
    text = html_extract.extract(wrapped(9, 6), found)
    assert text.split("\n")[0] == "Title 9" and len(text.split("\n")) == 7
    assert "Our site" not in text and "Read more" not in text and "rights" not in text
    assert html_extract.induce([wrapped(1)] * 9) is None
    a, b = html_extract.parse(wrapped(1)), html_extract.parse(wrapped(2, 5))
    assert len(html_extract.match(a, b)) == len(list(html_extract.walk(a)))


def tree(rng, size):
    """labels and parents of a random tree in page order."""
    labels, parents, path = ["r"], [0], [0]
    for i in range(1, size):
        path = path[: rng.randint(1, len(path))]
        labels.append(rng.choice("ab"))
        parents.append(path[-1])
        path.append(i)
    return labels, parents


def brute(a, b, i=0, j=0):
    """The size of the largest matching of two trees, by trying all matchings of the children."""
    if a.labels[i] != b.labels[j]:
        return 0

    def lists(xs, ys):
        if not xs or not ys:
            return 0
        pair = brute(a, b, xs[0], ys[0])
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), pair + lists(xs[1:], ys[1:]) if pair else 0)

    return 1 + lists(a.children[i], b.children[j])


def test_tree_matching():
    """Against brute force: as many pairs, each with equal labels and matched parents, in order."""
    rng = random.Random(4)
    for _ in range(400):
        a, b = (html_extract.Shape(*tree(rng, rng.randint(1, 9))) for _ in range(2))
        found = html_extract.align(a, b)
        pairs = [(i, j) for i, j in enumerate(found) if j >= 0]
        assert len(pairs) == brute(a, b) and [j for _, j in pairs] == sorted({j for _, j in pairs})
        assert all(a.labels[i] == b.labels[j] and (i == 0 or found[a.parents[i]] == b.parents[j]) for i, j in pairs)
    flat = [html_extract.Shape(["r"] + [rng.choice("abcd") for _ in range(6000)], [0] * 6001) for _ in range(2)]
    assert sum(x >= 0 for x in html_extract.align(*flat)) > 3000  # long lists, aligned in parts
    deep = html_extract.Shape(["r"] + ["a"] * 3000, [0, *range(3000)])
    assert html_extract.align(deep, deep) == list(range(3001))


def marked(i, n=3):
    body = "".join(f"<p>words {i} {k} that differ on every page {i * k}</p>" for k in range(n))
    return f"<html><body><div class='top'>Our site</div><article><h2>Title {i}</h2><p class='keep'>Write to us.</p>{body}<p class='comment'>View {i} of the writer</p><div>Read more of us</div></article></body></html>"


def test_wrapper_decides_in_article():
    found = html_extract.induce([marked(i) for i in range(5)])
    text = html_extract.extract(marked(9, 6), found)
    assert held(marked(9), found)[-1] == "article" and text.split("\n")[0] == "Title 9" and len(text.split("\n")) == 8
    assert "Read more" not in text and "Write to us" not in text and "View 9 of the writer" in text
    lone = html_extract.extract(marked(9))
    assert "Read more" in lone and "Write to us" in lone and "View 9" not in lone  # without a wrapper: article and words


def test_wrapper_from_all_pages(spark):
    """Two layouts in equal parts, long pages, and one page in eight of one layout without the notice: none of it may keep a template in the text."""

    def page(i):
        body = "".join(f"<p>words {i} {k} that differ</p>" for k in range(1700 if i % 20 < 2 else 4))
        notice = "<p class='n'>Write to us.</p>" if i % 16 else "<p class='n'>Closed.</p>"
        name = "story" if i % 2 else "report"
        return f"<html><body><div class='top'>Our site</div><div class='{name}'><h2>Title {i}</h2>{notice}{body}<div>More {name}</div></div><div class='end'>Hits {i}</div></body></html>"

    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(80)] + [(100 + i, f"https://long.example/{i}", page(20 * i + 1)) for i in range(4)]
    got = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        lines = r.text.split("\n")
        assert lines[0].startswith("Title ") and not {"Our site", "Write to us.", "More story", "More report"} & set(lines) and "Hits" not in r.text
        assert sum(x.startswith("words ") for x in lines) in (4, 1700)


def test_pages(spark):
    rows = [(i, f"https://a.example/{i}", wrapped(i)) for i in range(30)] + [(99, "https://b.example/x", PAGE), (100, None, PAGE), (101, "nonsense", None), (102, "https://a.example/e", ""), (99, "https://b.example/x", PAGE), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "pick", "slot", "of", "container", "template", "text", "n_chars")})
    got = html_extract.main_texts(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[99] == by[100] == html_extract.extract(PAGE) and by[101] == by[102] == by[None] == ""
    assert all("Our site" not in by[i] and f"Title {i}" in by[i] for i in range(30))
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, i, ("ann", "bob", "cid")[i % 3], f"say {i} é") for i in range(150)] + [(1, 0, "system", "rules"), (2, 0, "system", "alone"), (3, 5, "ann", None), (3, 5, "bob", "b<|im_end|>"), (3, 5, "bob", "b<|im_end|>"), (3, None, None, "x\ny"), (None, 1, "ann", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("speaker", "chunk", "part", "range", "at", "nth", "participant", "of", "parts", "s", "start", "spans")})
    got = chat_format.perspectives(turns).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.chunk, r.part)):
        k = (r.conv_id, r.participant)
        assert r.start == len(whole.get(k, ("", []))[0]) and r.n_chars == len(r.text)
        text, said = whole.get(k, ("", []))
        whole[k] = (text + r.text, said + [r.text[s.begin : s.end] for s in r.spans])
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "cid"), (3, "ann"), (3, "bob"), (3, "unknown"), (None, "ann")}
    text, said = whole[1, "bob"]
    assert said == [f"say {i} é<|im_end|>" for i in range(1, 150, 3)]
    assert text.startswith("<|im_start|>user name=ann\nsay 0 é<|im_end|>\n<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nsay 1 é")
    assert whole[3, "bob"][1] == ["b< |im_end|><|im_end|>"] * 2
    assert whole[3, "unknown"][0].startswith("<|im_start|>assistant\nx\ny<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>")
    assert chat_format.perspectives(turns.limit(0)).count() == 0


def test_chat_without_numbers(spark):
    """A third of all turns has no number, a third one number, a third no conversation: no row holds more than CHUNK turns, and the parts join to the whole."""
    rng = random.Random(9)
    rows = [(1, None, rng.choice("abc"), f"t{rng.randrange(40)}") for _ in range(200)] + [(2, 7, rng.choice("abc"), f"t{rng.randrange(40)}") for _ in range(200)] + [(None, i % 90, "a", f"n{i}") for i in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    views = chat_format.perspectives(turns)
    assert max(r.n_turns for r in views.collect()) == chat_format.CHUNK
    got = {(r.conv_id, r.participant): r for r in chat_format.whole_dialogues(views).collect()}
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        for who in {r[2] for r in mine}:
            want = "".join(f"<|im_start|>{'assistant' if r[2] == who else f'user name={r[2]}'}\n{r[3]}<|im_end|>\n" for r in mine)
            found = got[conv, who]
            assert found.text == want and found.n_turns == len(mine)
            assert [found.text[s.begin : s.end] for s in found.spans] == [f"{r[3]}<|im_end|>" for r in mine if r[2] == who]


def test_transducer_decides(encoder, monkeypatch):
    """Nothing but the transducer makes tokens."""
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, data: [7])
    monkeypatch.setattr(bpe.Transducer, "finish", lambda self: [])
    fresh = bpe.Encoder(open(PATH, "rb").read())
    assert bpe.encode_text(fresh, "ab cd, e\n\nf " + "g" * 9000) == [7] * 10


def test_repeated_pages(spark):
    """Each page twelve times: counted once, and the site's own texts go from every copy."""
    rows = [(i, f"https://a.example/{i}", wrapped(i)) for i in range(30)] * 12
    got = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == 360 and not any(x in r.text for r in got for x in ("Our site", "Read more", "All rights"))
    assert all(r.text.split("\n")[0] == f"Title {r.page_id}" for r in got)
