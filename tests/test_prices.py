"""Rate caps by prices against the exact optimum where it is known, and against a bound where it is not."""

import numpy as np
import pytest

from switchyard.operators.prices import answers, price_capped

SPLIT = "cell string, gateway string, mid string, volume double, share double, risk_rate double"


def lagrangian(rows, prices, cap, most):
    """The least of sum |x - ref| + prices times excess, cell by cell and exactly: a lower bound of any capped split's movement."""
    cells = {}
    for c, _, m, v, s, r in rows:
        cells.setdefault(c, []).append((prices[m] * v * (r - cap), s, s if sum(x[0] == c for x in rows) < 2 else most))
    total = 0.0
    for parts in cells.values():
        cost, ref, top = (np.array(x) for x in zip(*parts, strict=True))
        x = ref.copy()
        for i in np.argsort(-cost):  # the dearest gives to the cheapest with room while that pays
            for j in np.argsort(cost):
                gain = cost[i] - cost[j] - 2
                if gain > 0:
                    d = min(x[i], top[j] - x[j])
                    x[i], x[j] = x[i] - d, x[j] + d
        total += np.abs(x - ref).sum() + (cost * x).sum()
    return total


def made(rng, n_cells, n_gateways):
    rows = []
    for c in range(n_cells):
        n = int(rng.integers(1, n_gateways + 1))
        shares = rng.dirichlet(np.ones(n))
        for k in range(n):
            rows.append((f"c{c}", f"g{k}", f"m{k % 4}", float(rng.integers(10, 1000)), float(shares[k]), float(rng.uniform(0.001, 0.004) * (1 + 2 * (k % 4 == 0)))))
    volume = {}
    for c, _, _, v, *_ in rows:
        volume.setdefault(c, v)
    return [(c, g, m, volume[c], s, r) for c, g, m, _, s, r in rows]


@pytest.mark.parametrize(("seed", "cap", "most"), [(1, 0.0042, 1.0), (2, 0.0055, 0.9), (3, 0.0030, 1.0)])
def test_caps_hold_at_the_least_movement(spark, seed, cap, most):
    rows = [r for r in made(np.random.default_rng(seed), 40, 5)]
    single = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    rows = [r for r in rows if r[0] not in single] + [("alone", "g1", "m1", 50.0, 1.0, 0.002)]
    capped = [(c, g, m, v, s if c == "alone" else min(s, most), r) for c, g, m, v, s, r in rows]
    total = {}
    for c, _, _, _, s, _ in capped:
        total[c] = total.get(c, 0) + s
    capped = [(c, g, m, v, s / total[c] if c != "alone" else s, r) for c, g, m, v, s, r in capped]
    capped = [r for r in capped if r[0] == "alone" or max(x[4] for x in capped if x[0] == r[0]) <= most]
    shares, mids = price_capped(spark.createDataFrame(capped, SPLIT), ["cell"], cap, most=most)
    found, held = shares.toPandas(), mids.toPandas()
    assert held.held.all() and (held.rate <= cap + 1e-12).all() and (held.price > 0).any()
    assert np.allclose(found.groupby("cell").share.sum(), 1) and found.share.min() >= -1e-12
    assert (found[found.cell != "alone"].share <= most + 1e-9).all() and found[found.cell == "alone"].share.tolist() == [1.0]
    moved = np.abs(found.share - found.reference).sum()
    bound = lagrangian(capped, dict(zip(held.mid, held.price, strict=True)), cap, most)
    assert 0 < bound <= moved * (1 + 1e-9) and moved <= bound * 1.001


def test_one_price_is_a_fractional_knapsack(spark):
    rows = [(f"c{k}", g, m, 100.0 * (k + 1), s, r) for k in range(6) for g, m, s, r in (("a", "bad", 0.6, 0.010 + 0.002 * k), ("b", "good", 0.4, 0.001))]
    cap = 0.012
    shares, mids = price_capped(spark.createDataFrame(rows, SPLIT), ["cell"], cap)
    excess, moved = sum(v * s * (r - cap) for _, _, m, v, s, r in rows if m == "bad"), 0.0
    for _, _, _, v, s, r in sorted((r for r in rows if r[2] == "bad" and r[5] > cap), key=lambda r: -r[3] * (r[5] - cap)):
        d = min(s, max(excess, 0) / (v * (r - cap)))
        excess, moved = excess - d * v * (r - cap), moved + 2 * d
    found = shares.toPandas()
    assert abs(np.abs(found.share - found.reference).sum() / moved - 1) < 1e-3 and all(r.held for r in mids.collect())


def test_what_cannot_be_held_is_told(spark):
    rows = [("c", "a", "m", 100.0, 0.5, 0.02), ("c", "b", "m", 100.0, 0.5, 0.03), ("d", "a", "n", 10.0, 1.0, 0.001)]
    shares, mids = price_capped(spark.createDataFrame(rows, SPLIT), ["cell"], 0.01)
    assert {(r.mid, r.held) for r in mids.collect()} == {("m", False), ("n", True)} and shares.count() == 3
    shares, mids = price_capped(spark.createDataFrame([], SPLIT), ["cell"], 0.01)
    assert shares.count() == 0 and mids.count() == 0


def test_answers_stay_on_the_simplex():
    rng = np.random.default_rng(0)
    ref = rng.dirichlet(np.ones(6), 500)
    x, _ = answers(rng.normal(0, 3, (500, 6)), ref, np.zeros((500, 6)), np.full((500, 6), 0.7), 0.001)
    assert np.allclose(x.sum(axis=1), 1) and x.min() >= 0 and x.max() <= 0.7
