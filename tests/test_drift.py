"""Drift against pairing the documents one by one in Python."""

import json
import random
from collections import Counter

from switchyard.operators.drift import drift


def document(rng, kind, banks, weights):
    parts = [{"key": "rpgt", "operator": "IN", "values": [kind]}, {"key": "bank", "operator": "IN", "values": rng.sample(banks, len(banks))}]
    rng.shuffle(parts)
    connectors = [{"gateway": g, "weight": w} for g, w in weights]
    rng.shuffle(connectors)
    body = [("kind", "ConnectorPool"), ("selector", {"priority": rng.randint(1, 99), "expressions": parts}), ("spec", {"connectors": connectors})]
    rng.shuffle(body)
    return json.dumps(dict(body))


def brute(before, after):
    """Rules (type, banks, weights) paired: all the same, then the selector, then all but the type, each in order."""
    a, b, out = list(before), list(after), Counter()
    for status, key in (("same", lambda r: r), ("changed", lambda r: r[:2]), ("moved", lambda r: r[1:])):
        for x in sorted(a):
            y = next((y for y in sorted(b) if key(y) == key(x)), None)
            if y is not None:
                a.remove(x)
                b.remove(y)
                out[status, x[0], y[0]] += 1
    out.update(("dropped", x[0], None) for x in a)
    out.update(("added", None, y[0]) for y in b)
    return out


def test_status_does_not_depend_on_order(spark):
    rng = random.Random(8)
    banks = [("b1",), ("b2",), ("b1", "b2", "b3"), ("b4",)]
    weights = [(("g1", 500), ("g2", 500)), (("g1", 1000),), (("g1", 300), ("g2", 300), ("g3", 400))]
    for _ in range(3):
        some = [tuple((rng.choice("tuv"), rng.choice(banks), rng.choice(weights)) for _ in range(25)) for _ in range(2)]
        frames = [spark.createDataFrame([(document(rng, k, list(b), list(w)),) for k, b, w in rules] + [("{}",), ("no json",), ('{"kind": "Other"}',), (None,)], "json string").repartition(3) for rules in some]
        got = Counter({(r.status, r.was, r.type): r.n for r in drift(*frames).collect()})
        want = brute(*some)
        by = lambda c, side: {s: sum(n for k, n in c.items() if k[0] == s) for s in ("same", "changed", "moved", "dropped", "added")}
        assert by(got, 0) == by(want, 0) and sum(n for k, n in got.items() if k[0] != "added") == 25
        for status in ("same", "changed"):
            assert {k: n for k, n in got.items() if k[0] == status} == {k: n for k, n in want.items() if k[0] == status}
    assert drift(frames[0], frames[0]).select("status").distinct().collect()[0].status == "same"
    assert {r.status for r in drift(frames[0].where("false"), frames[0]).collect()} == {"added"}
