"""Articles on hosts without article elements: what is written into a page's article has to come out, and nothing else. The pages are made from known articles, so the texts to find do not come from the code."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quireworks.llm import html_extract
from quireworks.llm.html_extract import extract, induce, main_texts

WORDS = "river stone window market letter garden winter candle bridge harbour engine carpet orange silver thunder village pocket summer travel mirror".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(main, r):
    """A page around an article: menu, a notice that all pages have, a list of other pages, a footer."""
    others = "".join(f'<li><a href="/{i}">{prose(r, 4)}</a></li>' for i in range(4))
    return f"<html><head><title>t</title></head><body><div class=top><a href=/>Home</a> <a href=/n>News</a></div><div class=wrap>{main}<div class=box><h3>Most read</h3><ul>{others}</ul></div></div><div class=low>All rights reserved by the paper of the town.</div></body></html>"


def lead_beside_text(r):
    title, lead, body = prose(r, 5), prose(r, 12), [prose(r, 40) for _ in range(3)]
    return f"<div class=post><h1>{title}</h1><p class=lead>{lead}</p><div class=text>{''.join(f'<p>{x}</p>' for x in body)}</div></div>", [title, lead, *body]


def two_sections(r):
    title, one, two = prose(r, 5), [prose(r, 8)], [prose(r, 60) for _ in range(3)]
    return f"<div class=post><h1>{title}</h1><section>{''.join(f'<p>{x}</p>' for x in one)}</section><section>{''.join(f'<p>{x}</p>' for x in two)}</section></div>", [title, *one, *two]


def repeated_subheading(r):
    title, body, end = prose(r, 5), [prose(r, 40) for _ in range(2)], prose(r, 20)
    return f"<div class=post><h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in body)}<h2>Summary</h2><p>{end}</p><p>Read more in our Sunday issue.</p></div>", [title, *body, "Summary", end]


def nested(r):
    title, lead, body = prose(r, 6), prose(r, 15), [prose(r, 50) for _ in range(2)]
    return f"<div class=outer><h1>{title}</h1><div class=inner><p>{lead}</p><div class=text>{''.join(f'<p>{x}</p>' for x in body)}</div><div class=comments><p>{prose(r, 9)}</p></div></div></div>", [title, lead, *body]


def in_body(r):
    title, body = prose(r, 6), [prose(r, 50) for _ in range(2)]
    return f"<div class=text>{''.join(f'<p>{x}</p>' for x in body)}</div>", [title, *body]


@pytest.mark.parametrize("kind", [lead_beside_text, two_sections, repeated_subheading, nested])
@pytest.mark.parametrize("n", [4, 23])
def test_nothing_of_the_article_is_lost(kind, n):
    r = random.Random(n)
    made = [kind(r) for _ in range(n)]
    pages = [page(main, r) for main, _ in made]
    wrapper = induce(pages)
    for text, (_, want) in zip(pages, made, strict=True):
        assert extract(text, wrapper).split("\n") == want


def test_titles_beside_the_text_in_the_body():
    r = random.Random(5)
    made = [in_body(r) for _ in range(12)]
    pages = [f"<html><body><div class=top><a href=/>Home</a></div><h1>{want[0]}</h1>{main}<div class=low>All rights reserved.</div></body></html>" for main, want in made]
    assert [extract(p, induce(pages)).split("\n") for p in pages] == [want for _, want in made]


def test_one_article_under_many_addresses():
    """Its quotation stands in a slot that no other page has."""
    r = random.Random(6)
    made = [lead_beside_text(r) for _ in range(20)]
    pages = [page(main, r) for main, _ in made]
    quoted = "A quotation that only one article has, in an element that only it has."
    main, want = made[0]
    main = main.replace("</div></div>", f"<blockquote>{quoted}</blockquote></div></div>")
    pages += [page(main, r) for _ in range(3)]  # around it, other lists
    wrapper = induce(pages)
    for text in pages[-3:]:
        assert extract(text, wrapper).split("\n") == [*want, quoted]


def test_a_rare_layout():
    """15 of 3,000 pages have a layout of their own, with its own notice."""
    r = random.Random(7)
    most, some = [repeated_subheading(r) for _ in range(2985)], [lead_beside_text(r) for _ in range(15)]
    rare = [f"<html><body><div class=report><div class=note><p>This report is part of our long series.</p></div>{main}</div></body></html>" for main, _ in some]
    pages = [page(main, r) for main, _ in most] + rare
    wrapper = induce(pages)
    for text, (_, want) in [*zip(rare, some, strict=True), *zip(pages[:20], most, strict=False)]:
        assert extract(text, wrapper).split("\n") == want


def test_long_lists_are_aligned_exactly(monkeypatch):
    r = random.Random(8)
    for _ in range(60):
        xs, ys = ([r.randrange(6) for _ in range(r.randrange(1, 25))] for _ in range(2))
        weights = {(x, y): r.choice([0, 0, 1, 2, 5]) for x in range(6) for y in range(6)}
        weight = lambda x, y: weights[x, y]  # noqa: E731, B023
        monkeypatch.setattr(html_extract, "PAIRS", 1 << 22)
        whole = html_extract._chosen(xs, ys, weight)
        monkeypatch.setattr(html_extract, "PAIRS", 4)
        parts = html_extract._chosen(xs, ys, weight)
        total = lambda pairs: sum(weight(xs[i], ys[j]) for i, j in pairs)  # noqa: E731, B023
        assert total(parts) == total(whole) and all(a < b for a, b in zip(np.array(parts), np.array(parts)[1:], strict=False) for a, b in zip(a, b, strict=True))


def test_spark_has_the_same(spark):
    """Hosts of all kinds in one table, as extract() and induce() have them in memory."""
    rows, want = [], {}
    for h, kind in enumerate([lead_beside_text, two_sections, repeated_subheading, nested]):
        r = random.Random(h)
        made = [kind(r) for _ in range(9)]
        for i, (main, texts) in enumerate(made):
            rows.append((100 * h + i, f"http://h{h}.org/{i}", page(main, r)))
            want[100 * h + i] = "\n".join(texts)
    got = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert {x.page_id: x.text for x in got.collect()} == want
