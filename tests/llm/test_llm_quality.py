"""The label model and the discriminant against the same estimates made row by row and in one array."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from switchyard.llm.doc_stats import document_statistics
from switchyard.llm.quality_qda import Discriminant, quality_report, transformed
from switchyard.llm.quality_rules import Supervision, estimated, judged


def expectation_maximisation(rows, s):
    """Of lists of votes (1, 0 or -1), row by row: the log prior odds and each rule's log ratio for a vote."""
    start = {1: dict(zip((0, 1, -1), s.good, strict=True)), 0: dict(zip((0, 1, -1), s.bad, strict=True))}
    n_rules = len(rows[0])
    chance = {c: [dict(start[c]) for _ in range(n_rules)] for c in (0, 1)}
    prior = s.prior
    for _ in range(s.rounds):
        posterior = []
        for votes in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[1][k][v] / chance[0][k][v]) for k, v in enumerate(votes))
            posterior.append(1 / (1 + math.exp(-odds)))
        before = [dict(x) for x in chance[1]]
        for c in (0, 1):
            own = [p if c else 1 - p for p in posterior]
            chance[c] = [{v: (sum(w for w, votes in zip(own, rows, strict=True) if votes[k] == v) + s.trust * start[c][v]) / (sum(own) + s.trust) for v in (0, 1, -1)} for k in range(n_rules)]
        prior = min(max(sum(posterior) / len(rows), s.bounds[0]), s.bounds[1])
        if max(abs(chance[1][k][v] - before[k][v]) for k in range(n_rules) for v in (0, 1, -1)) < 1e-7:
            break
    return math.log(prior / (1 - prior)), [[math.log(chance[1][k][v] / chance[0][k][v]) for v in (0, 1, -1)] for k in range(n_rules)]


def test_rule_weights_equal_estimation_row_by_row():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        good = rng.random() < 0.7
        rows.append(tuple(int(v) for v in (rng.choice([1, 0, -1], p=[0.6, 0.1, 0.3]) if good else rng.choice([1, 0, -1], p=[0.2, 0.5, 0.3]) for _ in range(4))))
    counts = Counter(rows)
    s = Supervision(rounds=30)
    first, weights = estimated(np.array(list(counts)), np.array(list(counts.values()), dtype=float), s)
    want_first, want = expectation_maximisation(rows, s)
    assert abs(first - want_first) < 1e-9 and np.allclose(weights, want)


def test_verdicts_follow_from_votes(spark, odd, none):
    rows = judged(odd).collect()
    votes = [[-1 if c == "-" else int(c) for c in r.votes] for r in rows]
    first, weights = expectation_maximisation(votes, Supervision())
    for r, own in zip(rows, votes, strict=True):
        odds = first + sum(weights[k][{0: 0, 1: 1, -1: 2}[v]] for k, v in enumerate(own))
        assert abs(r.posterior - 1 / (1 + math.exp(-odds))) < 1e-6
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.posterior >= 0.5)
    assert {r.doc_id: r.n_words for r in rows if r.doc_id in (3, 4, 5, 6)} == {3: 0, 4: 0, 5: 0, 6: 2} and judged(none).count() == 0


def test_differences_equal_densities_in_one_array(spark, odd, none):
    rng = np.random.default_rng(5)
    words = ["good", "plain", "text", "und", "the", "of", "||", "###", "AAA", "12", "x."]
    rows = [(k, " ".join(rng.choice(words[:6] if k % 3 else words, int(rng.integers(5, 60)))) + ("\nline ends." if k % 2 else "")) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("doc_id > 1000 OR doc_id IS NULL"))
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(120)], "doc_id long, quality int")
    p = Discriminant()
    got = {r.doc_id: r for r in quality_report(docs, labels, p).collect()}
    stats = document_statistics(docs).toArrow()
    ids = stats["doc_id"].to_pylist()
    x = transformed(pa.RecordBatch.from_arrays([c.combine_chunks() for c in stats.columns], names=stats.column_names))
    place = {i: k for k, i in enumerate(ids)}
    train = [k for k in range(120) if not got[k].held_out]
    some, y = x[[place[k] for k in train]], np.array([int(k % 3 > 0) for k in train])
    means = [some[y == c].mean(axis=0) for c in (0, 1)]
    spread = [np.cov(some[y == c].T, bias=True) for c in (0, 1)]
    n = [int((y == c).sum()) for c in (0, 1)]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / len(y)
    density = []
    for c in (0, 1):
        own = n[c] / (n[c] + 4 * x.shape[1]) * (1 - p.pooled)
        cov = (1 - p.ridge) * (own * spread[c] + (1 - own) * pooled) + p.ridge * np.diag(np.maximum(np.diag(pooled), 1e-4))
        gap = x - means[c]
        density.append(np.log(n[c] / len(y)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    want = np.clip(density[1] - density[0], -200, 200)
    assert np.allclose([got[i].difference for i in ids], want, atol=1e-6)
    order = sorted(got.values(), key=lambda r: r.difference)
    assert all(a.score <= b.score + 1e-12 for a, b in zip(order, order[1:], strict=False)) and all(r.predicted == int(r.score >= 0.5) for r in order)
    assert quality_report(none, labels).count() == 0
