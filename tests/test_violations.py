import math

import pytest

from switchyard.operators import violations as vi

SPLIT = "cell string, gateway string, mid string, scheme string, volume double, share double, baseline_share double, risk_rate double"


@pytest.fixture(scope="module")
def split(spark):
    rows = [("c1", "a", "m1", "x", 100.0, 0.7, 0.5, 0.02), ("c1", "b", "m2", "x", 100.0, 0.3, 0.5, 0.01), ("c2", "a", "m1", "x", 300.0, 1.0, 1.0, 0.03), ("c3", "b", "m2", "x", 50.0, 0.96, 0.0, None), ("c3", "c", "m3", None, 50.0, 0.04, None, 0.5), ("c4", "d", "m4", "y", None, None, None, None)]
    return spark.createDataFrame(rows, SPLIT)


def test_breaches_by_hand(spark, split):
    caps = spark.createDataFrame([("m1", 300.0), ("m2", 0.0), ("m9", 1.0)], "mid string, cap double")
    bands = spark.createDataFrame([("m1", 10.0, None, 9.0, 2), ("m2", 10.0, 20.0, None, None), ("m4", 7.0, 8.0, None, 1), ("m1", 10.0, 1.0, 100.0, 1)], "mid string, value double, floor double, ceiling double, priority int")
    found = {(r.kind, r.mid, r.priority): r for r in vi.breaches(split, ["cell"], 0.025, caps, bands, 0.95, 0.1, yields=100.0).collect()}
    base = {"m1": 350.0, "m2": 50.0, "m3": 0.0, "m4": 0.0}
    weight = {m: b / 200 if b else 1.0 for m, b in base.items()}
    volume = {"m1": 370.0, "m2": 78.0, "m3": 2.0}
    want = {
        ("rate_cap", "m1", None): ((1.4 + 9) / 370 / 0.025 - 1, weight["m1"]), ("rate_cap", "m3", None): (0.5 / 0.025 - 1, 1.0), ("volume_cap", "m1", None): (370 / 300 - 1, weight["m1"]),
        ("band_ceiling", "m1", 2): (volume["m1"] / 350 * 10 / 9 - 1, weight["m1"] / 100), ("band_floor", "m2", None): (1 - 78 / 50 * 10 / 20, weight["m2"]), ("band_floor", "m4", 1): (1 - 7 / 8, 1.0),
        ("max_share", "m1", None): (0.05 / 0.95, 1.0), ("max_share", "m2", None): (0.01 / 0.95, 1.0), ("floor", "m3", None): (0.6, 1.0),
    }
    assert set(found) == set(want)
    for key, (over, w) in want.items():
        assert found[key].over == pytest.approx(over) and found[key].weight == pytest.approx(w) and found[key].penalty == pytest.approx((1 + 10 * over * over) * w), key
    steep = {(r.kind, r.mid): r for r in vi.breaches(split, ["cell"], 0.025, caps, bands, steep=True).collect()}
    assert steep["rate_cap", "m3"].penalty == pytest.approx(1 + 10 * (math.exp(19.0) - 1)) and not any(k[0] in ("floor", "max_share") for k in steep)

    levels = {}
    for r in vi.report(vi.breaches(split, ["cell"], 0.025, caps, bands, 0.95, 0.1, yields=100.0)).collect():
        levels.setdefault(r.level, {})[r.kind, r.mid, r.scheme, r.priority] = r
    assert set(levels) == set(vi.LEVELS)
    total = levels["all"][None, None, None, None]
    assert total.breaches == 9 and total.worst == pytest.approx(19.0) and total.worst_mid == "m3"
    assert sum(r.breaches for r in levels["mid"].values()) == 9 and levels["mid"][None, "m4", None, None].worst_to_shed is None
    assert levels["kind and priority"]["band_floor", None, None, 0].breaches == 1
    assert vi.report(vi.breaches(split.where("false"), ["cell"], 0.025, caps, bands)).where("level <> 'all'").count() == 0
