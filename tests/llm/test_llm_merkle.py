"""The Merkle manifest against a tree built in memory."""

import hashlib
import zlib

import pytest

from switchyard.llm.merkle import Manifest, manifest

LOWER = {c: c + 32 for c in range(65, 91)}


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """(top, for each node the siblings left and right of it on every level)."""
    paths, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for k, below in enumerate(at):
            run, j = runs[k // fanout], k % fanout
            for b in below:
                paths[b].append((run[:j], run[j + 1 :]))
        at = [sum(at[k : k + fanout], []) for k in range(0, len(at), fanout)]
        nodes = [digest(*r) for r in runs]
    return nodes[0], paths


def brute(rows, fanout, every=5):
    """rows (doc_id, source, lang, n_chars, text) -> the rows of the manifest."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: (sorted(by_source[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], fanout)) for s in sources}
    root, above = tree([built[s][1] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        members, subroot, paths = built[s]
        for (_, _, own, r), path in zip(members, paths, strict=True):
            sides = path + above[k]
            node = leaf([*r[:4], r[4] if r[4] is None else r[4].translate(LOWER)]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0 else own
            for left, right in sides:
                node = digest(*left, node, *right)
            out.append((r[0], own, subroot, root, digest(*[x for a, b in sides for x in [*a, *b]]), node, node == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("fanout", "rows"), [(16, 1000), (16, 37), (3, 10), (2, 5)])
def test_manifest_equals_a_tree_in_memory(spark, odd, none, fanout, rows):
    docs = odd.select("doc_id", "source", "lang", "n_chars", "text", "score", "n")
    sizes = {None: 1, "": 2, "hot": 290, "Z": 16, "a": 17, "ß": 33}
    made = [(1000 + 7 * k, s, "en", k, f"Text {k} Ö") for s, size in sizes.items() for k in range(size)]
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars int, text string"), allowMissingColumns=True)
    every = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = manifest(docs, Manifest(fanout=fanout, rows=rows))
    assert got.columns == COLUMNS
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == brute(every, fanout)
    assert 0 < sum(not x[-1] for x in found) < len(found) / 2
    assert manifest(none).count() == 0


def test_one_row_is_its_own_root(spark):
    only = spark.createDataFrame([(4, None, None, None, None)], "doc_id long, source string, lang string, n_chars int, text string")
    assert [tuple(r) for r in manifest(only).collect()] == brute([(4, None, None, None, None)], 16)
