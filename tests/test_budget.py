"""Compression to a budget against every choice of rules, and its parts against the same steps in one array."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.operators import budget as bu

CELL, GROUP, GATEWAYS = ["rpgt", "currency", "bank"], ["rpgt", "currency"], ["g0", "g1", "g2", "g3"]


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g, n in enumerate((9, 30, 1, 14)):
        kinds = rng.dirichlet(np.ones(4) / 2, 4)
        for b in range(n):
            x = kinds[b % 4] if b % 3 else rng.dirichlet(np.ones(4))
            volume = float(rng.integers(1, 500))
            rows += [(f"r{g % 2}", ("eur", None)[g // 2], f"b{b}", name, float(s), volume) for name, s in zip(GATEWAYS, x, strict=True) if s > 0.02]
    rows += [("r0", "eur", "void", "g0", 0.0, 5.0), ("r0", "eur", "bare", "g0", 1.0, None)]
    return spark.createDataFrame(rows, "rpgt string, currency string, bank string, gateway string, share double, volume double")


def lloyd(x, w, k, rounds=30):
    """The same k-means over one array."""
    centres = x[sorted(range(len(x)), key=lambda i: (-w[i], x[i].tolist()))[:k]].copy()
    for _ in range(rounds):
        at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(x[at == c], axis=0, weights=w[at == c]) if (at == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(new - centres).max() < 1e-12:
            break
        centres = new
    return centres


@pytest.fixture(scope="module")
def points(split):
    return bu.vectors(split, CELL, GROUP, GATEWAYS).groupBy("_g", "x").agg(F.sum("w").alias("w")).cache()


def in_arrays(points):
    out = {}
    for r in points.orderBy("_g", "x").collect():
        out.setdefault(r["_g"], []).append((r["x"], r["w"]))
    return {g: (np.array([x for x, _ in v]), np.array([w for _, w in v])) for g, v in out.items()}


def test_centroids_equal_those_of_one_array(points):
    found = bu.lloyd(points.repartition(7), 5)
    for g, (x, w) in in_arrays(points).items():
        assert np.allclose(found[g], lloyd(x, w, 5)), g


def test_curves_are_those_of_the_nested_clusters(points):
    known = bu.trees(points, 6)
    found = {(r["_g"], r["k"]): r["loss"] for r in bu.curves(points, known).collect()}
    for g, (x, w) in in_arrays(points).items():
        parent, centres = known[g]
        n = bu._leaves(parent)
        leaf = ((x[:, None] - centres[None, :n]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(1, n + 1):
            at = leaf.copy()
            for _ in range(n):
                at = np.where((parent[at] >= 0) & (parent[at] < 2 * n - k), parent[at], at)
            assert len(set(at)) <= k and abs(found[g, k] - (w * np.abs(x - centres[at]).sum(axis=1)).sum() / 2) < 1e-9
        every = centres[parent < 0][0]
        assert np.allclose(every, np.average(x, axis=0, weights=w))


@pytest.mark.parametrize("priced", [False, True])
def test_budgets_are_kept_and_best(spark, points, priced):
    curve = bu.curves(points, bu.trees(points, 6)).cache()
    loss = {}
    for r in curve.collect():
        loss.setdefault(r["_g"], {})[r["k"]] = r["loss"]
    groups = sorted(loss)
    cost = {g: 1 + (i % 3 if priced else 0) for i, g in enumerate(groups)}
    costs = spark.createDataFrame(list(cost.items()), "_g string, cost long") if priced else None
    steps = sorted(((-r["rate"] / cost[r["_g"]], r["_g"], r["start"]), (r["k"] - r["start"]) * cost[r["_g"]]) for r in bu.hull(curve).collect())
    corners = set(itertools.accumulate([s for _, s in steps], initial=sum(cost.values())))
    met = 0
    least = sum(cost.values())
    for total in sorted({*sorted(c for c in corners if c < 30)[:6], least + 1, least + 4}):
        got = {r["_g"]: (r["k"], r["loss"]) for r in bu.allotted(curve, total, costs).collect()}
        assert set(got) == set(groups) and sum(k * cost[g] for g, (k, _) in got.items()) <= total
        assert all(loss[g][k] == v for g, (k, v) in got.items())
        if total in corners:
            best = min(sum(loss[g][k] for g, k in zip(groups, ks, strict=True)) for ks in itertools.product(*[sorted(loss[g]) for g in groups]) if sum(k * cost[g] for g, k in zip(groups, ks, strict=True)) <= total)
            assert abs(sum(v for _, v in got.values()) - best) < 1e-9
            met += 1
    assert met >= 5
    assert {r["k"] for r in bu.allotted(curve, 0).collect()} == {1}


def test_rules_are_no_more_than_the_budget(spark, split):
    rules, allotment = bu.compressed(split, CELL, GROUP, GATEWAYS, budget=12, fine=16, most=0.9)
    found = rules.toPandas()
    assert len(found.drop_duplicates(["rpgt", "currency", "cluster"])) <= 12 and found.share.max() <= 0.9 + 1e-9
    assert np.allclose(found.groupby(["rpgt", "currency", "bank"], dropna=False).share.sum(), 1)
    assert len(found.drop_duplicates(["rpgt", "currency", "bank"])) == split.where("bank <> 'void'").select(*CELL).distinct().count()
    for r in bu.compressed(split, CELL, GROUP, GATEWAYS, target=0.9, fine=16)[1].collect():
        assert r["loss"] <= 0.1 * r["w"] + 1e-6
    empty, none = bu.compressed(split.where("false"), CELL, GROUP, GATEWAYS, budget=5)
    assert empty.count() == 0 and none.count() == 0
