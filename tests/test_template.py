"""The template row by row in Python, and totals along a global order against a window."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from switchyard.operators import template as te
from switchyard.operators.ordered import running
from switchyard.sources import shared

CELL = ["rpgt", "currency", "bank"]


def brute(shares, country, provider, usa_only, incapable, cap, grid):
    """Units by gateway of one sub-cell."""
    barred = lambda g: (country != "USA" and g in usa_only) or (provider in te.WALLETS and g in incapable)
    w = {g: 0.0 if barred(g) else s for g, s in shares.items()}
    total = sum(w.values())
    if total <= 0:
        return dict.fromkeys(w, 0)
    w = {g: s / total for g, s in w.items()}
    capped = sum(s > 1e-12 for s in w.values()) >= 2
    if capped:
        for _ in range(50):
            excess = sum(max(s - cap, 0) for s in w.values())
            room = {g: cap - s if 1e-12 < s < cap - 1e-12 else 0.0 for g, s in w.items()}
            if excess <= 1e-12 or sum(room.values()) <= 1e-12:
                break
            w = {g: cap if s > cap else s + room[g] / sum(room.values()) * min(excess, sum(room.values())) for g, s in w.items()}
    u = {g: int(s * grid + 0.5) for g, s in w.items()}
    limit, rest = (round(cap * grid) if capped else grid), grid - sum(u.values())
    order = sorted((g for g in u if u[g]), key=lambda g: (u[g] >= limit, -u[g], g))
    for g in order:
        take = max(min(limit - u[g], rest), 0) if rest > 0 else -min(u[g], -rest)
        u[g], rest = u[g] + take, rest - take
    u[order[0]] += rest
    return u


def test_units_sum_to_the_grid_under_the_cap(spark):
    rng = random.Random(5)
    gateways = [f"g{k}" for k in range(7)]
    rows, shares = [], {}
    for k in range(60):
        own = {g: rng.choice([0.0, 0.001, rng.random(), rng.random() ** 6]) for g in rng.sample(gateways, rng.randint(1, 7))}
        own = dict.fromkeys(own, 0.0) if k % 20 == 0 else own
        shares["a", "eur", f"b{k}"] = own
        rows += [("a", "eur", f"b{k}", g, s) for g, s in own.items()]
    split = spark.createDataFrame(rows, "rpgt string, currency string, bank string, gateway string, share double")
    presence = spark.createDataFrame([("eur", f"b{k}", k % 2, k % 3) for k in range(40)], "currency string, bank string, usa long, other long")
    got = {}
    for r in te.template(split, CELL, presence, ["G1", "g2"], ["g3", "g0"], 0.6, 1000).collect():
        got.setdefault((r.rpgt, r.currency, r.bank, r.country, r.provider), {})[r.gateway] = r.units
    for k in range(60):
        usa, other = (k % 2, k % 3) if k < 40 else (1, 1)
        countries = [c for c, n in zip(te.COUNTRIES, (usa, other), strict=True) if n] or ["Non-USA"]
        assert {key[3] for key in got if key[2] == f"b{k}"} == set(countries)
    assert len(got) == sum(3 * max(1, (k % 2 > 0) + (k % 3 > 0)) if k < 40 else 6 for k in range(60))
    capped = 0
    for key, units in got.items():
        assert units == brute(shares[key[:3]], key[3], key[4], {"g1", "g2"}, {"g3", "g0"}, 0.6, 1000), key
        used = [u for u in units.values() if u]
        assert sum(used) == (1000 if used else 0)
        capped += len(used) > 1 and max(used) == 600
    assert capped > 20


def test_a_rest_goes_on_by_rank_where_the_largest_has_no_room(spark):
    rows = [("c", f"g{k}", s) for k, s in enumerate([0.3335, 0.3335, 0.333])]
    split = spark.createDataFrame(rows, "cell string, gateway string, share double")
    found = {r.gateway: r.units for r in te.apportioned(split.withColumn("share", F.col("share") * 0.9985), ["cell"], 0.334, 1000).collect()}
    assert sum(found.values()) == 1000 and max(found.values()) <= 334


def test_sheets_and_conditions(spark):
    rows = spark.createDataFrame([("a", "e", b, "USA", "non_gp_ap", g, u) for b, us in (("1", (40, 60)), ("2", (60, 40)), ("3", (40, 60)), ("4", (0, 0))) for g, u in zip(("x", "y"), us, strict=True)],
                                 "rpgt string, currency string, bank string, country string, provider string, gateway string, units long")
    sub = [*CELL, "country", "provider"]
    assert {(r.bank, r.check, r.condition) for r in te.conditions(rows, ["rpgt"], sub).collect()} == {("1", 100, 1), ("2", 100, 2), ("3", 100, 1), ("4", 0, 3)}
    sheet = te.wide(rows, sub, ["x", "y", "z"], 100)
    assert {(r.bank, r.x, r.y, r.z) for r in sheet.collect()} == {("1", 40.0, 60.0, 0.0), ("2", 60.0, 40.0, 0.0), ("3", 40.0, 60.0, 0.0), ("4", 0.0, 0.0, 0.0)}
    assert {(r.bank, r.gateway): r.share for r in te.shares_of(sheet, sub, ["x", "y", "z"]).collect()}["2", "x"] == 0.6


def test_running_totals_equal_a_window_without_one_task(spark):
    rows = spark.range(5000).selectExpr("id", "(id * 7919) % 613 AS v", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 4 END AS k", "id % 97 AS w")
    order = Window.orderBy(F.desc("v"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = running(rows, ["-v", "id"], {"total": "w"}, part=300)
    want = rows.withColumn("row", F.count(F.lit(1)).over(order)).withColumn("total", F.sum("w").over(order))
    assert got.select("id", "row", "total").exceptAll(want.select("id", "row", "total")).isEmpty() and got.count() == 5000
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    within = Window.partitionBy("k").orderBy(F.desc("v"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = running(rows, ["-v", "id"], {"total": "w"}, ["k"], part=300)
    want = rows.withColumn("row", F.count(F.lit(1)).over(within)).withColumn("total", F.sum("w").over(within))
    assert got.select("id", "row", "total").exceptAll(want.select("id", "row", "total")).isEmpty() and got.count() == 5000
    assert running(rows.where("false"), ["id"], {"total": "w"}).count() == 0


def test_written_tables_go_with_their_handle(spark):
    from pathlib import Path

    with shared.tables(shared.Written()) as made:
        shared.written(spark.range(3), "x")
    path = Path(made.paths[0].removeprefix("file://"))
    assert path.exists()
    made.clear(spark)
    assert not path.exists()


def brute_pools(cells, special):
    """cells: {(rpgt, currency, bank, country, provider): {gateway: units}} -> the pools, by sets in memory."""
    groups = {}
    for (kind, cur, bank, country, provider), units in cells.items():
        sig = tuple(sorted((g, u) for g, u in units.items() if u))
        if sig:
            groups.setdefault((kind, cur, country, provider, sig), set()).add(bank)
    labels = {}
    for (kind, cur, country, provider, sig), banks in groups.items():
        labels.setdefault((kind, cur, sig, frozenset(banks), provider), set()).add(country)
    met = {}
    for (kind, cur, sig, banks, provider), countries in labels.items():
        met.setdefault((kind, cur, sig, banks, "All" if len(countries) > 1 else min(countries)), set()).add(provider)
    out = set()
    for (kind, cur, sig, banks, country), providers in met.items():
        some = [tuple(sorted(providers))] if len(providers) == 3 else [te.WALLETS[::-1]] + [(p,) for p in providers - set(te.WALLETS)] if set(te.WALLETS) <= providers else [(p,) for p in providers]
        for p in some:
            w = {g: round(u / 10) for g, u in sig}
            order, gap = sorted(w, key=lambda g: (-w[g], g)), 1000 - sum(w.values())
            for i in range(abs(gap)):
                w[order[i % len(order)]] += 1 if gap > 0 else -1
            priority = (500_000 if kind in special else 100_000) + 200_000 + (100_000 if len(p) == 2 else 0) + 200_000
            out.add((kind, cur, country, p, tuple(sorted(banks)), tuple(sorted(w.items())), priority))
    return out


def test_pools_combine_countries_and_providers(spark):
    rng = random.Random(6)
    kinds = [{"a": 3335, "b": 6665}, {"a": 3333, "b": 3333, "c": 3334}, {"c": 10_000, "a": 0}, {"a": 1005, "b": 1005, "c": 1015, "d": 6975}, {}]
    cells = {}
    for bank in range(40):
        for rpgt in ("x", "y"):
            base = rng.choice(kinds)
            for country in te.COUNTRIES:
                for provider in te.PROVIDERS:
                    if rng.random() < 0.9 or bank % 2:
                        cells[rpgt, "eur", f"b{bank:02d}", country, provider] = base if bank % 2 or rng.random() < 0.8 else rng.choice(kinds)
    rows = spark.createDataFrame([(*k, g, u) for k, units in cells.items() for g, u in units.items()], "rpgt string, currency string, bank string, country string, provider string, gateway string, units long")
    got = {(r.rpgt, r.currency, r.country, tuple(r.providers), tuple(r.banks), tuple((c.gateway, c.weight) for c in r.connectors), r.priority) for r in te.pools(rows, special=["y"]).collect()}
    assert got == brute_pools(cells, {"y"}) and len(got) > 20
    assert {len(p[3]) for p in got} == {1, 2, 3} and {p[2] for p in got} == {"All", *te.COUNTRIES}
    chunks = te.pools(rows, chunk=2).collect()
    assert max(len(r.banks) for r in chunks) == 2 and sum(len(r.banks) for r in chunks) == sum(len(p[4]) for p in got)
    assert {r.rpgt: r.pools for r in te.pool_count(rows).collect()} == {k: sum(p[0] == k for p in got) for k in ("x", "y")}
    assert te.pools(rows.where("false")).count() == 0
