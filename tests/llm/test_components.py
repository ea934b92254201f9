"""Connected components against union-find, with broadcast and with shuffled parents."""
import random

import pytest

from surveykit.llm import components


@pytest.mark.parametrize("limit", [0, components.BROADCAST_VERTICES])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BROADCAST_VERTICES", limit)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300, 340)] + [(0, i) for i in range(1, 40)]  # a chain and a star
    edges += [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(7, 7), (250, 250), (1, 0), (1, 0)]
    top = {}

    def root(v):
        while top.setdefault(v, v) != v:
            v = top[v]
        return v

    for a, b in edges:
        if a != b:
            top[root(a)] = root(b)
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {v for a, b in edges if a != b for v in (a, b)}
    of = {}
    for v, c in got.items():
        assert root(v) == root(c) and of.setdefault(root(v), c) == c
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
