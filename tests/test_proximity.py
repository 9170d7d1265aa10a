"""Ranks summed over seeds equal those solved seed by seed."""

import numpy as np
import pytest
from ledgerloom.operators import graph


@pytest.mark.parametrize("dense", [1000, 0])
def test_proximity_equals_direct_solutions(spark, monkeypatch, dense):
    monkeypatch.setattr(graph, "DENSE", dense)
    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2))} | {(5, 5)})
    data = [(f"n{a}", f"n{b}", float(a + 1)) for a, b in pairs]
    seeds = list(range(0, 40, 2))
    got = {r.node: r.proximity for r in graph.seed_proximity(spark.createDataFrame(data, "src string, dst string, weight double"), spark.createDataFrame([(f"n{s}",) for s in seeds], "node string")).collect()}
    nodes = sorted({x for p in pairs for x in p})
    p = np.zeros((40, 40))
    for a, b in pairs:
        p[a, b] = 1.0
    p /= np.maximum(p.sum(1, keepdims=True), 1)
    visits = np.linalg.inv(np.eye(40) - 0.85 * p)
    ranks = visits / visits.sum(1, keepdims=True)
    want = {f"n{x}": sum(ranks[s, x] for s in seeds if s in nodes and s != x) for x in nodes}
    assert got == pytest.approx(want, abs=1e-7)
