"""Queries and operators over whole inputs: no limit of depth or length."""

from __future__ import annotations

import random

from quireworks.operators import assembly
from quireworks.queries import books

from .oracle import SMALL


def test_outline_of_any_depth(spark):
    rows = [("p", i, i - 1 if i else None, i, f"t{i}") for i in range(14)] + [("q", 0, None, 0, "root"), ("q", 5, 6, 0, "loop"), ("q", 6, 5, 0, "loop")]
    got = assembly.flat_titles(spark.createDataFrame(rows, "project string, id int, parent int, pos int, title string")).collect()
    assert sorted((r.project, r.nth, r.depth, r.title) for r in got) == sorted([("p", i + 1, i, f"t{i}") for i in range(14)] + [("q", 1, 0, "root")])


def test_outlines_by_recursion(spark, monkeypatch):
    """A chain of 5,000, one parent of a third of all nodes, trees with equal places, several roots, a loop, and a parent that is not there."""
    r, rounds = random.Random(2), []
    store = assembly.stored
    monkeypatch.setattr(assembly, "stored", lambda df, name: (rounds.append(name), store(df, name))[1])
    rows = [("chain", i, i - 1 if i else None, 0) for i in range(5000)] + [("wide", i, 0 if i else None, i * 7 % 1500) for i in range(3000)]
    rows += [("tree", i, r.choice([None, *range(i)]) if i else None, r.randrange(3)) for i in range(400)] + [("odd", 1, 99, 0), ("odd", 2, 3, 0), ("odd", 3, 2, 0), ("odd", 4, 2, 0), ("odd", 5, None, 0), ("odd", 6, 1, 0), ("none", 1, 1, 0)]
    r.shuffle(rows)
    got = assembly.flat_titles(spark.createDataFrame([(*x, f"t{x[1]}") for x in rows], "project string, id int, parent int, pos int, title string").repartition(4)).collect()
    below, want = {}, set()
    for project, i, parent, pos in rows:
        below.setdefault((project, parent), []).append((pos, i))
    for project in {x[0] for x in rows}:
        stack, nth = [(i, 0) for _, i in sorted(below.get((project, None), []), reverse=True)], 0
        while stack:
            i, depth = stack.pop()
            nth += 1
            want.add((project, nth, depth, f"t{i}"))
            stack += [(c, depth + 1) for _, c in sorted(below.get((project, i), []), reverse=True)]
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert rounds.count("outline-steps") < 20


def test_addresses_at_depth_four(spark):
    got = books.QUERIES["media_urls"](spark, SMALL).collect()
    assert got and all(r.url == (None if r.event_id % 6 == 3 else f"http://m/{r.event_id}") for r in got)
