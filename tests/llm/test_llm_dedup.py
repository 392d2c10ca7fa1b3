import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from switchyard.llm.components import components
from switchyard.llm.dedup import MinHashes, NearDuplicates, deduplicated, near_duplicates


def word_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(texts):
    sets, top = {i: word_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sets.items():
        for j, t in sets.items():
            if i < j and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_same_components_as_all_pairs(spark):
    rng = np.random.default_rng(2)
    texts, n = {}, 0
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 500, 60)]
        for _ in range(rng.integers(1, 12)):
            w = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 5)):
                w[at] = f"x{rng.integers(0, 9)}"
            texts[n], n = " ".join(w), n + 1
    texts |= {n: "Few words", n + 1: "few\twords", n + 2: "", n + 3: " \n"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for p in (NearDuplicates(), NearDuplicates(block=4, wide=0, salts=2)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, p).collect()}
        assert got == brute(texts)


def test_odd_rows(odd, none):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect())
    assert got == [
        (False, 1, 3, 1, True), (False, 2, 3, 1, False), (False, 2, 3, 1, False), (False, 3, 0, 3, True), (False, 4, 0, 4, True), (False, 5, 0, 5, True),
        (False, 6, 1, 6, True), (False, 7, 1, 6, False), (False, 8, 1, 8, True), (False, 9, got[9][2], 9, True), (True, 0, 3, None, True),
    ]
    assert near_duplicates(none).count() == 0


def test_rows_of_one_id_keep_the_links_of_their_own_texts(spark):
    rng = np.random.default_rng(4)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " zz"), (5, b + " zz"), (None, a + " yy"), (None, "some other words without an id"), (6, a), (6, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in near_duplicates(frame).collect()), key=str)
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 1), ("4", 1), ("5", 1), ("6", 1), ("6", 1), ("None", 1), ("None", None)]
    left = sorted((str(r.doc_id), r.text) for r in deduplicated(frame).collect())
    assert left == sorted([("1", a), ("1", b), ("None", rows[7][1])])
    again = spark.createDataFrame([(7, a), (7, a), (8, a), (9, ""), (9, ""), (None, None)], "doc_id long, text string").withColumn("_key", F.lit(1))
    assert sorted((str(r.doc_id), r.text) for r in deduplicated(again).collect()) == [("7", a), ("9", ""), ("9", ""), ("None", None)] and deduplicated(again).columns == again.columns


def test_a_bucket_of_many_unlinked_members_is_split(spark):
    rng = np.random.default_rng(7)
    shared, texts = [f"s{k}" for k in range(120)], {}
    for k in range(90):  # alike at about 0.6, so most share buckets and few are linked
        texts[k] = " ".join(shared + [f"u{k}-{x}" for x in range(40)] if k % 9 else shared + [f"g{k // 30}-{x}" for x in range(40)])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for p in (NearDuplicates(block=16, wide=500),):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame, p).collect()} == brute(texts)


def test_a_wide_bucket_keeps_the_links_of_a_single_shared_bucket(spark):
    """a bucket of many comparisons was split by second shared buckets, so with one band all but the hubs' links went."""
    rng = np.random.default_rng(3)
    shared, texts = [f"s{k}" for k in range(120)], {}
    for k in range(60):  # pairs at 0.9; pairs of one another at 0.5 or so
        own = [f"u{k // 2}-{x}" for x in range(40)]
        own[rng.integers(0, 40)] = f"v{k}"
        texts[k] = " ".join(shared + own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = []
    for wide in (0, 1 << 26):
        p = NearDuplicates(bands=1, rows=1, block=4, wide=wide, wider=2)
        found.append({r.doc_id: r.component_id for r in near_duplicates(frame, p).collect()})
    assert found[0] == found[1]
    every = brute(texts)
    assert sum(found[0][k] == every[k][1] for k in texts) > 45  # the others share no bucket


def test_tasks_need_nothing_of_the_package(tmp_path):
    """What runs in executors is pickled whole, so they need not have this package installed."""
    code = "import sys, pickle, numpy as np\nm, p = pickle.loads(sys.stdin.buffer.read())\nprint(len(m(p)(np.arange(9, dtype=np.uint64))), p.least_matches()[0][0])"
    sent = cloudpickle.dumps((MinHashes, NearDuplicates()))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd=tmp_path, env=env, check=True)
    assert out.stdout.split() == [b"768", b"128"]


def test_a_long_chain_has_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.comp) for r in components(links).collect()} == {(i, 1) for i in range(1, 61)} | {(100, 100), (101, 100)}


def test_bounds_rise_with_the_batches():
    bounds = NearDuplicates().least_matches()
    assert [n for n, _ in bounds] == list(range(128, 769, 128)) and all(0.5 < m / n < 0.75 for n, m in bounds) and pytest.approx(0.69, abs=0.01) == bounds[-1][1] / bounds[-1][0]
