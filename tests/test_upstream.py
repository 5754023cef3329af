"""Upstream labels against a search in plain Python."""

import random

import pytest

from tidewater.operators.upstream import extend_index, upstream, upstream_index


def expected(edges, asked):
    into = {}
    for a, b in edges:
        if a != b and a is not None and b is not None:
            into.setdefault(b, set()).add(a)
    pairs = set()
    for x in asked:
        seen, todo = {x}, [x]
        while todo:
            fresh = into.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        pairs |= {(x, n) for n in seen - {x}}
    return pairs


def frame(spark, edges):
    return spark.createDataFrame(edges, "source string, target string")


def answered(spark, index, asked):
    rows = upstream(index, spark.createDataFrame([(x,) for x in asked], "node string")).collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {(r["asked"], r["upstream"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_cycles_and_later_edges(spark, seed):
    rng = random.Random(seed)
    name = lambda: f"n{rng.randrange(40):02}"
    edges = [(name(), name()) for _ in range(45)] + [(f"file{i}", name()) for i in range(60)] + [(None, "n01"), ("n01", None)]
    later = [(name(), name()) for _ in range(8)] + [("new", "n03"), ("n05", "file7"), ("n06", "fresh"), edges[0]]
    asked = [f"n{i:02}" for i in range(0, 40, 3)] + ["file7", "fresh", "unknown", None]
    index = upstream_index(frame(spark, edges))
    assert answered(spark, index, asked) == expected(edges, asked)
    links = {e for e in edges if None not in e and e[0] != e[1]}
    assert index.others.count() + index.landing.count() <= len(links)
    assert index.ways.count() == len({b for _, b in links})
    more = extend_index(index, frame(spark, later))
    assert answered(spark, more, asked) == expected(edges + later, asked)


def test_only_cycles_a_chain_and_nothing(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("a", "r3"), ("b", "a"), ("s", "t"), ("t", "s")]
    index = upstream_index(frame(spark, ring))
    asked = ["r0", "a", "s", "b"]
    assert answered(spark, index, asked) == expected(ring, asked)
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(12)]
    index = upstream_index(frame(spark, chain))
    assert index.others.count() == 0  # one way holds them all: a single round answers
    assert answered(spark, index, ["c12", "c03"]) == expected(chain, ["c12", "c03"])
    empty = upstream_index(frame(spark, []))
    assert answered(spark, empty, ["x"]) == set()
    assert answered(spark, extend_index(empty, frame(spark, chain)), ["c12"]) == expected(chain, ["c12"])
