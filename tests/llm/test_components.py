"""Components against a plain union-find."""

import numpy as np
import pytest

from quarrylake.llm._components import components


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["empty", "chain", "star", "random"])
def test_components(spark, kind):
    rng = np.random.default_rng(3)
    edges = {"empty": [], "chain": [(k, k + 1) for k in range(40)], "star": [(900, k) for k in range(200)] + [(1000, 1000)], "random": [tuple(map(int, x)) for x in rng.integers(0, 300, (220, 2))]}[kind]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in plain([e for e in edges if e[0] != e[1]]).items()}
