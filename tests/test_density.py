"""Density-based clusters by small cells equal those of all pairs."""

import numpy as np
import pytest
from ledgerloom.operators import learning


@pytest.mark.parametrize("columns", [["x", "y"], ["x"], ["x", "y", "z", "u"]])
def test_clusters_equal_those_of_all_pairs(spark, columns):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, s, (n, 4)) for c, s, n in ((0, 0.3, 150), (3, 0.05, 60), (-2, 1.5, 60))])
    x[200:206] = x[0]
    rows = [(int(k), *map(float, p)) for k, p in zip(rng.permutation(len(x)), x, strict=True)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, u double")
    eps = {1: 0.02, 2: 0.1, 4: 0.5}[len(columns)]
    got = {r.id: r.cluster for r in learning.density_clusters(df, "id", columns, eps, 4).collect()}
    z = {r.id: np.array(r["__x"].toArray()) for r in learning.scaled(df, columns).collect()}
    near = {k: [j for j in z if ((z[k] - z[j]) ** 2).sum() <= eps * eps] for k in z}
    core = {k for k in z if len(near[k]) >= 4}
    name: dict = {}
    for k in sorted(core):
        todo = [k] if k not in name else []
        while todo:
            at = todo.pop()
            if at not in name:
                name[at] = k
                todo += [j for j in near[at] if j in core]
    want = {k: name[k] if k in core else min((name[j] for j in near[k] if j in core), default=None) for k in z}
    assert got == want and len(set(want.values())) > 2


def test_points_of_a_full_cell_do_not_meet_one_by_one(spark, monkeypatch):
    written = []
    monkeypatch.setattr(learning, "cut", lambda df, f=learning.cut: (out := f(df), written.append(out.count()))[0])
    df = spark.range(3000).selectExpr("id", "id % 53 / 53 AS x", "id % 59 / 59 AS y")
    found = learning.density_clusters(df, "id", ["x", "y"], eps=1.0)
    assert found.where("cluster = 0").count() == 3000 and max(written) == 3000
