"""Components against union-find."""

import random

import pytest

from tessera.llm.components import components


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(k, k + 1) for k in range(100, 130)]
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + chain + [(500, k) for k in range(501, 540)] + [(7, 7)]
    rng.shuffle(links)
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute([x for x in links if x[0] != x[1]])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
