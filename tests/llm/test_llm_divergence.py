"""Source divergence against counting term by term with Python's integers."""

import re
from collections import Counter

import pytest

from switchyard.llm.divergence import Audit, divergence, terms_of

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, least):
    groups, docs, counts = {}, {}, {}
    for text, lang, source in ((t or "", la or "", s or "") for t, la, s in rows):
        words = [x.translate(FOLD) for x in TERM.findall(text)]
        groups.setdefault(lang, set()).add(source)
        docs.setdefault(lang, Counter()).update(set(words))
        counts.setdefault((lang, source), Counter()).update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda p, q: {t: (p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in p}
        each = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            f = far(each[s], whole)
            parts = {"pair": {o: sum(far(each[s], each[o]).values()) for o in sources if o != s}, "term": {t: f[t] for t in kept if counts[lang, s][t] and each[s][t] > whole[t]}}
            for part, items in parts.items():
                order = sorted(items, key=lambda x: (-items[x], x.encode()))  # noqa: B023
                out |= {(lang, s, part, x, items[x], k) for k, x in enumerate(order[: 10 if part == "term" else None], 1)}
    return out


def listed(frame):
    rows = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("least", [1, 3])
def test_values_and_ranks_equal_counting(spark, odd, none, least):
    words = ["alpha", "beta", "gamma", "délta", "épsilon", "zeta", "日本", "x"]
    rows = [(k, " ".join(words[(k * j) % (5 + k % 4)] for j in range(k % 13)) + " 1-2_Tie tie", ("en", "de", None)[k % 3], ("a", "b", "ß", "Z", "", None)[k % 6] if k % 3 else "hot") for k in range(90)]
    docs = odd.select("doc_id", "text", "lang", "source", "score", "n").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    every = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert listed(divergence(docs, Audit(least=least, cells=16, held=20, rows=50, piece=7))) == brute(every, least)
    assert divergence(none).count() == 0


def test_a_term_is_not_cut_between_pieces():
    text = "añb Cd-e " * 50
    assert [w for part in terms_of(text.encode(), 3) for w in part] == [x.translate(FOLD).encode() for x in TERM.findall(text)]
