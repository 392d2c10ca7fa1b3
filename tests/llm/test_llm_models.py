import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.llm.doc_stats import statistics
from switchyard.llm.labelled import area
from switchyard.llm.maxent import Codes, MaxEnt, class_logs, features, fitted, scored
from switchyard.llm.quality_qda import quality_report
from switchyard.llm.quality_rules import judged
from switchyard.llm.text import WordHashes
from switchyard.llm.toxicity import toxicity_report


def sentences(rng, n, vocabulary):
    return " ".join(str(w) for w in rng.choice(vocabulary, n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    plain, bad = [f"{a}{b}" for a in ("tion", "ment", "er", "and", "the") for b in ("al", "ist", "en", "or", "ly", "ed")], ["grumbler", "nastyhead", "fouldog"]
    rows, labels = [], []
    for k in range(400):
        toxic, poor = k % 4 == 0, k % 5 == 0
        words = sentences(rng, 60, plain).split()
        if toxic:
            for at in rng.integers(0, 60, 4):
                words[at] = str(rng.choice(bad))
        text = " ".join(words) + "." if not poor else " | ".join(w for w in words for _ in range(3))
        rows.append((k, text))
        labels.append((k, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("report", "column", "folds", "held"), [(toxicity_report, "toxic", 5, 0), (quality_report, "quality", 3, 1)])
def test_held_out_labels_are_found(labelled, odd, none, report, column, folds, held):
    docs, labels = labelled
    got = report(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.itertuples())
    test = got[got.held_out]
    assert area(test.score.to_numpy(), test[column].to_numpy()) > 0.97
    hidden = labels.withColumn(column, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, 1 - F.col(column)).otherwise(F.col(column)))
    flipped = report(docs, hidden).toPandas().set_index("doc_id").score
    assert np.allclose(flipped.loc[got.doc_id].to_numpy(), got.score.to_numpy())
    assert report(odd, labels).count() == odd.count() and report(none, labels).count() == 0
    alone = report(odd, labels.where("false")).toPandas()
    assert len(alone) == odd.count() and alone.score.between(0, 1).all()


def test_base_score_and_counts_equal_brute_force(spark, odd, none):
    rng = np.random.default_rng(9)
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(200 + k, sentences(rng, 40, [f"w{x}" for x in range(60)])) for k in range(80)], "doc_id long, text string"))
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, words in rows if not held(i) for w in words)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for i, w in rows)
    for p in (MaxEnt(hot=50), MaxEnt(flush=10, text=1000)):
        got = scored(docs, p).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert scored(none).count() == 0


def by_hand(p, docs, shared):
    """P(word | history) from counts alone, with the class weights as they were trained: (chance, words)."""
    codes = Codes()
    train = [[codes[w] for w in t.encode().lower().split() + [b""]] for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    n, slots, inside = Counter(c for t in train for c in t), Counter(), Counter()
    for c in n:
        slots[c % 65536] += n[c]
        inside[c % 65536] += 1
    seen = Counter((a, b % 65536) for t in train for a, b in zip([0, *t], t, strict=False))
    several = {k: v for k, v in seen.items() if v > 1}
    unseen = sum(v == 1 for v in seen.values()) / max(len(several), 1)
    group = lambda s: s // 4096
    classes = Counter()
    for s, k in slots.items():
        classes[group(s)] += k
    base = lambda s: (slots[s] + 1) / (classes[group(s)] + 4096)
    fits = {}
    for a, g in {(a, group(s)) for a, s in several}:
        some = sorted(s for x, s in several if x == a and group(s) == g)
        q, k = np.array([base(s) for s in some]), np.array([several[a, s] for s in some], dtype=float)
        total, w = k.sum() + unseen * len(some), np.zeros(len(some))
        for _ in range(4000):  # plain ascent by small steps, to where slopes vanish
            e = q * np.exp(w)
            w += 0.2 / total * (k - total * e / (1 - q.sum() + e.sum()) - w / p.spread)
        fits[a, g] = dict(zip(some, w, strict=True)), math.log(1 - q.sum() + (q * np.exp(w)).sum())

    def chance(history, c):
        back = [np.array([x], dtype=np.uint64) for x in (history[::-1] + [0, 0, 0])[:3]]
        s = c % 65536
        weights, norm = fits.get((history[-1] if history else 0, group(s)), ({}, 0.0))
        of_class = float(class_logs(shared.weights, shared.bias, features(back, p.rows))[0, group(s)])
        return math.exp(of_class + math.log(base(s)) + weights.get(s, 0.0) - norm) * (n[c] + 1) / (slots[s] + inside[s] + 1)

    return chance, codes, n, slots, inside, base, fits


def test_model_equals_brute_force_and_sums_to_one(spark):
    pairs = ["alpha beta", "gamma delta", "omega sigma", "alpha nu", "mu", "mu pi rho"]
    rng = np.random.default_rng(3)
    docs = [(k, " ".join(str(x) for x in rng.choice(pairs, 30, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1]))) for k in range(160)] + [(900, "Never seen words ALPHA beta"), (901, ""), (902, "alpha")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    p = MaxEnt(batch=64, steps=60)
    shared = fitted(frame, p, 1)[2]
    chance, codes, n, slots, inside, base, fits = by_hand(p, docs, shared)
    want = {}
    for i, t in docs:
        row = [codes[w] for w in t.encode().lower().split() + [b""]]
        want[i] = sum(math.log10(chance(row[:k], c)) for k, c in enumerate(row))
    for more in ({}, {"hot": 3}, {"hot": 1, "text": 200, "flush": 100}):
        got = scored(frame, MaxEnt(batch=64, steps=60, **more)).toPandas().set_index("doc_id")
        assert max(abs(got.score[i] - s) for i, s in want.items()) < 1e-2
    for history in ([], [codes[b"alpha"]], [codes[b"mu"], codes[b"pi"]], [codes[b"new"]]):
        words = sum(chance(history, c) for c in n) + sum(chance(history, s) / (n[s] + 1) for s in slots)  # with one unknown word in each slot
        back = [np.array([x], dtype=np.uint64) for x in (history[::-1] + [0, 0, 0])[:3]]
        empty = 0.0  # slots without words, of each class
        for g, log in enumerate(class_logs(shared.weights, shared.bias, features(back, p.rows))[0]):
            held = [s for s in slots if s // 4096 == g]
            norm = fits.get((history[-1] if history else 0, g), ({}, 0.0))[1]
            empty += math.exp(float(log) - norm) * (1 - sum(map(base, held)))
        assert abs(words + empty - 1) < 1e-4
    held = got[got.held_out]
    assert held.score.sum() > 0.6 * held.base_score.sum()


def test_statistics_equal_brute_force():
    rng = np.random.default_rng(8)
    for k in range(60):
        text = "".join(str(x) for x in rng.choice(["ab ", "cd ", "é x ", "\n", "| # ", "same words again and again here now ok "], rng.integers(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)) if words else (0,) * 5
        assert statistics(text.encode(), WordHashes())[:5] == want, k


def test_rules_reject_defects_and_keep_clean_documents(labelled, odd, none):
    docs, labels = labelled
    got = judged(docs).toPandas().merge(labels.toPandas(), on="doc_id")
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.05
    rows = {r.doc_id: r for r in judged(odd).collect()}
    assert not rows[3].kept and rows[3].base_failed and rows[8].base_failed and judged(odd).count() == odd.count() and judged(none).count() == 0
