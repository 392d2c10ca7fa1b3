"""MinHash near-duplicate detection with sequential Bayesian verification.

Method: banded MinHash signatures give candidate pairs; signatures are compared in batches, and a pair is dropped as soon
as the posterior probability of a similarity at or above the threshold falls under ``miss``; survivors are verified
exactly on their full shingle sets.

Scale: rows with equal sets collapse to one node first, so copies never form pairs.  In a bucket each member is compared
with the bucket's hub only (linear); a hub meets its members in salted parts, its own data once in each.  What the hub
links leave in different components of one bucket is compared in blocks of bounded size, the minority components against
all, inside tasks that emit surviving pairs alone: first each member's best pair with a component, then, for what those
leave apart, all.  Blocks are as many as a bucket needs, whatever its size; in a large one they hold more members, so that
signatures are copied less often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.llm.bitmap import bitmap, held
from switchyard.llm.components import components
from switchyard.llm.scratch import stored
from switchyard.llm.text import WordHashes, binary_rows, kept, mixed, shingle_set, texts


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters.  ``bands`` of ``rows`` hashes; ``hashes`` in all, compared in steps of ``batch``; ``miss``: posterior
    probability under which a candidate is pruned; ``block``: members of a bucket that meet in one task at a time;
    ``wide``: comparisons in one bucket over which its blocks hold ``wider`` times as many (which changes no result);
    ``salts``: parts of a hub's members at most, one for each ``part`` members of a bucket."""

    percent: int = 75
    width: int = 5
    bands: int = 40
    rows: int = 5
    hashes: int = 768
    batch: int = 128
    miss: float = 1e-4
    block: int = 1024
    wide: int = 1 << 26
    wider: int = 8
    salts: int = 256
    part: int = 64
    seed: int = 11

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, least number of equal ones to go on).  One byte of each hash is kept, so unequal hashes agree
        once in 256; with a uniform prior the posterior is a beta distribution, whose tail is a binomial sum."""
        p = self.percent / 100
        p += (1 - p) / 256
        out = []
        for n in range(self.batch, self.hashes + 1, self.batch):
            total, m = 0.0, -1
            while total < self.miss:
                m += 1
                total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            out.append((n, m))
        return out

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 2**31, self.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, self.hashes, dtype=np.uint32)


class MinHashes:
    """The least value of each hash function over a set, in a buffer that is used again."""

    def __init__(self, p: NearDuplicates, chunk: int = 128):
        (self.a, self.b), self.buffer = p.multipliers(), np.empty((chunk, p.hashes), dtype=np.uint32)

    def __call__(self, shingle: np.ndarray) -> np.ndarray:
        x, chunk = (shingle ^ (shingle >> np.uint64(32))).astype(np.uint32), len(self.buffer)
        out = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), chunk):
            part = x[at : at + chunk, None]
            values = self.buffer[: len(part)]
            np.multiply(part, self.a, out=values)
            np.add(values, self.b, out=values)
            np.minimum(out, values.min(axis=0), out=out)
        return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``key``, a hash of both, by which a row is known again."""
    ids, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(ids.alias("doc_id"), text.alias("text"), F.xxhash64(ids, text).alias("key"))


def signatures(docs: DataFrame, p: NearDuplicates) -> DataFrame:
    """One row per row: r (its number), doc_id, key, n_shingles, set_key (of the full set), bands (bucket of each band), sig (a byte of each hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, least, r = kept("words", WordHashes), MinHashes(p), TaskContext.get().partitionId() << 33
        place = np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for batch in batches:
            n, keys, bands, sigs = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingle_set(text, cache, p.width)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                if not len(s):
                    bands.append([]), sigs.append(b"")
                    continue
                h = least(s)
                key = place.copy()
                for column in h[: p.bands * p.rows].reshape(p.bands, p.rows).T:
                    key = mixed(key + column)
                bands.append(key.view(np.int64))
                sigs.append(((h * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes())
            rows = pa.array(np.arange(r, r + len(n)))
            r += len(n)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["r", "doc_id", "key", "n_shingles", "set_key", "bands", "sig"])

    return keyed(docs).mapInArrow(run, "r long, doc_id long, key long, n_shingles long, set_key binary, bands array<long>, sig binary")


def _alive(x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]], u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows, x[u] with y[v], survive the batches, and their equal hashes."""
    left, before = np.arange(len(u)), 0
    same = np.zeros(len(u), dtype=np.int32)
    for n, least in bounds:
        same = same + (x[u[left], before:n] == y[v[left], before:n]).sum(axis=1, dtype=np.int32)
        keep = same >= least
        left, same, before = left[keep], same[keep], n
    return left, same


def _met(pairs: DataFrame, data: DataFrame, p: NearDuplicates, test: Callable[[bytes, list[bytes]], np.ndarray]) -> DataFrame:
    """Those of ``pairs`` (hub, spoke, parts: in how many the hub's spokes are dealt out) whose ``data`` (id, data) pass ``test``, which takes a hub's data and those of some spokes.

    A hub's spokes come in salted parts, each behind one copy of the hub's data, so no hub is one task's and no data are
    copied for every pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, b""
        for batch in batches:
            hubs, spoke = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            ids, values, parts, found = batch.column(3).to_numpy(), batch.column(4), batch.column(5).to_numpy(), []
            heads = np.flatnonzero(~spoke).tolist()
            for at, end in zip([-1, *heads], [*heads, len(hubs)], strict=True):
                if at >= 0:
                    hub, own = hubs[at], values[at].as_py()
                some = np.arange(at + 1, end)
                some = some[hubs[some] == hub] if len(some) else some
                if len(some):
                    some = some[test(own, values.take(pa.array(some)).to_pylist())]
                    found.append(np.stack([hubs[some], ids[some], parts[some]]))
            both = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[2].astype(np.int32))], names=["hub", "spoke", "parts"])

    salt = F.pmod(F.xxhash64("spoke"), F.col("parts")).cast("int")
    parts = pairs.select("hub", salt.alias("salt"), "spoke", "parts")
    spokes = parts.join(data, parts.spoke == data.id).select("hub", "salt", F.lit(True).alias("role"), "id", "data", "parts")
    hubs = parts.select("hub", "salt").distinct()
    hubs = hubs.join(data, hubs.hub == data.id).select("hub", "salt", F.lit(False).alias("role"), "id", "data", F.lit(0).alias("parts"))
    return spokes.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role").mapInArrow(run, "hub long, spoke long, parts int")


def pruned(pairs: DataFrame, sigs: DataFrame, p: NearDuplicates) -> DataFrame:
    """Pairs (hub, spoke, parts) that the posterior bounds leave."""
    bounds = p.least_matches()

    def test(own: bytes, others: list[bytes]) -> np.ndarray:
        x, y = np.frombuffer(own, "u1")[None], np.frombuffer(b"".join(others), "u1").reshape(-1, p.hashes)
        return _alive(x, y, bounds, np.zeros(len(y), dtype=np.int64), np.arange(len(y)))[0]

    return _met(pairs, sigs.select("id", F.col("sig").alias("data")), p, test)


def shingle_sets(docs: DataFrame, wanted: DataFrame, p: NearDuplicates, bits: int = 23) -> DataFrame:
    """(id, data): full shingle sets of the ``wanted`` (id, key, set_key).  The bitmap keeps other texts out of the shuffle; the join that follows is exact."""
    packed = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "key", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept("words", WordHashes)
        for batch in batches:
            keep = np.flatnonzero(held(packed.value, batch.column(2).to_numpy()))
            if len(keep):
                some = batch.take(pa.array(keep))
                sets = [shingle_set(t, cache, p.width).tobytes() for t in texts(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(2), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["key", "set_key", "data"])

    rows = keyed(docs).mapInArrow(run, "key long, set_key binary, data binary")
    return rows.join(wanted, ["key", "set_key"]).dropDuplicates(["key", "set_key"]).select("id", "data")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, p: NearDuplicates) -> DataFrame:
    """Links (a, b): pairs (hub, spoke, parts) whose full sets have 100 * intersection >= percent * union."""

    def test(own: bytes, others: list[bytes]) -> np.ndarray:
        x, keep = np.frombuffer(own, np.uint64), []
        for k, other in enumerate(others):
            y = np.frombuffer(other, np.uint64)
            if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= p.percent * (len(both) - common):
                keep.append(k)
        return np.array(keep, dtype=np.int64)

    ids = pairs.select(F.col("hub").alias("id")).union(pairs.select(F.col("spoke").alias("id"))).distinct()
    sets = stored(shingle_sets(docs, stored(nodes.join(ids, "id", "left_semi").select("id", "key", "set_key"), "wanted"), p), "sets")
    return _met(pairs, sets, p, test).select(F.col("hub").alias("a"), F.col("spoke").alias("b"))


def _across(rows: DataFrame, p: NearDuplicates, best: bool) -> DataFrame:
    """Surviving pairs (hub, spoke) of different components within each block pair.  A pair is emitted in the first band that it shares.

    ``best``: of a member's pairs with one component in one block, only the most similar by signature.
    """

    kinds, bounds = {"sig": ("u1", p.hashes), "code": ("<u4", p.bands)}, p.least_matches()

    def pairs_of(held: list[pa.RecordBatch]) -> np.ndarray:
        rows = pa.Table.from_batches(held)
        side = rows["side"].to_numpy()
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(left) or not len(right):
            return np.zeros((0, 2), dtype=np.int64)
        ids, comp, main, band = (rows[k].to_numpy() for k in ("id", "comp", "main", "band"))
        sig, code = (binary_rows(rows[k], *kinds[k]) for k in ("sig", "code"))
        out = []
        for some in np.array_split(left, -(-len(left) * len(right) // 20_000)):
            can = (comp[some][:, None] != comp[right]) & (main[right] | (ids[right] > ids[some][:, None]))
            x, y = np.nonzero(can)
            x, y = some[x], right[y]
            for at in range(0, len(x), 20_000):
                u, v = x[at : at + 20_000], y[at : at + 20_000]
                alive, same = _alive(sig, sig, bounds, u, v)
                u, v = u[alive], v[alive]
                if best and len(u):
                    order = np.lexsort((-same, comp[v], u))
                    u, v = u[order], v[order]
                    top = np.append(True, (u[1:] != u[:-1]) | (comp[v[1:]] != comp[v[:-1]]))
                    u, v = u[top], v[top]
                first = (code[u] == code[v]).argmax(axis=1) == band[0]
                out.append(np.stack([np.minimum(ids[u[first]], ids[v[first]]), np.maximum(ids[u[first]], ids[v[first]])], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)

    def emitted(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["hub", "spoke"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            found = []
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                now = tuple(keys[at])
                if now != key and held:
                    found.append(pairs_of(held))
                    held = []
                key = now
                held.append(batch.slice(at, end - at))
            yield emitted(found)
        yield emitted([pairs_of(held)] if held else [])

    rows = rows.select("bucket", "i", "j", "band", "id", "comp", "main", "side", "sig", "code")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "hub long, spoke long")


def _parted(at: DataFrame, p: NearDuplicates) -> DataFrame:
    """Buckets of ``at`` (bucket, id, comp) with more than one component: main_comp, and blocks of all members (nj) and of those outside it (ni)."""
    parts = at.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    few = F.col("size") - F.col("top.n")
    room = F.when(few * F.col("size") > p.wide, p.block * p.wider).otherwise(p.block)
    n_block = lambda c: F.ceil(c / room).cast("int")
    return split.select("bucket", (F.col("size") > F.col("parts")).alias("again"), F.col("top.comp").alias("main_comp"), n_block(F.col("size")).alias("nj"), n_block(few).alias("ni"))


def cross_pairs(members: DataFrame, comps: DataFrame, sigs: DataFrame, p: NearDuplicates, best: bool) -> tuple[DataFrame, DataFrame]:
    """Surviving pairs (hub, spoke) that share a bucket but not a component: in each bucket the members outside its main component against all, by blocks.

    With them the members of those buckets where ``best`` may have left pairs out: where each is a component of its own, it left none.
    """
    at = stored(members.join(comps, "id", "left").select("bucket", "band", "id", F.coalesce("comp", "id").alias("comp")), "members-components")
    split = stored(_parted(at, p), "parted")
    here = at.join(split, "bucket")
    here = here.join(sigs, "id").withColumn("main", F.col("comp") == F.col("main_comp"))
    keep = ["bucket", "band", "id", "comp", "main", "sig", "code"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    right = here.select(*keep, F.lit(False).alias("side"), spread(F.col("ni")).alias("i"), F.pmod(F.xxhash64("id"), F.col("nj")).cast("int").alias("j"))
    left = here.where("not main").select(*keep, F.lit(True).alias("side"), F.pmod(F.xxhash64("id"), F.col("ni")).cast("int").alias("i"), spread(F.col("nj")).alias("j"))
    again = at.join(split.where("again").select("bucket"), "bucket", "left_semi").select("bucket", "band", "id")
    return stored(_across(left.unionByName(right), p, best).distinct().withColumn("parts", F.lit(p.salts)), "cross-survivors"), again


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) after ``links`` between ids; ids new to ``comps`` are added."""
    named = lambda side: comps.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    ends = stored(ends, "links-of-components")
    tops = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    every = comps.unionByName(ends.select(F.col("a").alias("id"), F.col("x").alias("comp"))).unionByName(ends.select(F.col("b").alias("id"), F.col("y").alias("comp"))).distinct()
    return stored(every.join(tops, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")), "components")


def _signed(base: DataFrame, ids: DataFrame, bits: int = 23) -> DataFrame:
    """(id, sig, code: 32 bits of each bucket) of the rows ``ids`` of ``base``, all of which have bands.  A bitmap keeps most others out of the shuffle; the join is exact."""
    packed = base.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("id").alias("k")), "k", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(held(packed.value, batch.column(0).to_numpy())))
            codes = some.column("bands").flatten().to_numpy().astype("<u4").reshape(some.num_rows, -1) if some.num_rows else []
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("sig"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "sig", "code"])

    rows = base.select(F.xxhash64("r").alias("k"), F.col("r").alias("id"), "sig", "bands").mapInArrow(run, "id long, sig binary, code binary")
    return rows.join(ids, "id", "left_semi")


def classed(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (see ``keyed``), n_shingles, component_id, and ``first``, true for one row of each component and for rows without shingles."""
    base = stored(signatures(docs, p), "signatures")
    full = base.where("n_shingles > 0")
    nodes = full.groupBy("set_key").agg(F.min(F.struct("r", "key")).alias("x"), F.min("doc_id").alias("doc"), F.min_by("r", F.struct(F.col("doc_id").isNull(), "doc_id", "r")).alias("lead"))
    nodes = stored(nodes.select("set_key", F.col("x.r").alias("id"), "x.key", "doc", "lead"), "nodes")  # one for each distinct set; ``id`` is a row that has it
    bands = full.select(F.col("r").alias("id"), "bands").join(nodes.select("id"), "id", "left_semi")
    rows = bands.select("id", F.posexplode("bands").alias("band", "bucket")).repartition("bucket")  # before the window, which else has its order shuffled too
    order = F.struct(F.xxhash64("id", F.pmod("bucket", F.lit(4))).alias("o"), F.col("id").alias("hub"))
    whole = Window.partitionBy("bucket")
    rows = rows.select("*", F.min(order).over(whole)["hub"].alias("hub"), F.count(F.lit(1)).over(whole).alias("size"))
    members = stored(rows.where("size > 1"), "members")
    sigs = stored(_signed(full, members.select("id").distinct()), "members-signatures")

    spokes = members.where("id <> hub").groupBy(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).agg(F.min("hub").alias("hub"), F.max("size").alias("n"))
    n_parts = F.least(F.lit(p.salts), F.ceil(F.col("n") / p.part)).cast("int")
    spokes = stored(spokes.select("hub", (F.col("a") + F.col("b") - F.col("hub")).alias("spoke"), n_parts.alias("parts")), "spokes")
    members = members.where("size > 2").select("bucket", "band", "id")  # the pair of two is a hub and its spoke
    links = stored(verified(stored(pruned(spokes, sigs, p), "survivors"), docs, nodes, p), "hub-links")
    comps = components(links)

    for best in (True, False):  # most components merge over their best pairs; what then is left apart is compared in full
        pairs, members = cross_pairs(members, comps, sigs, p, best)
        comps = merged(comps, stored(verified(pairs, docs, nodes, p), "cross-links"))

    named = stored(nodes.join(comps, "id", "left").select("set_key", "doc", "lead", F.coalesce("comp", "id").alias("comp")), "named")
    heads = named.groupBy("comp").agg(F.min("doc").alias("component_id"), F.min_by("lead", F.struct(F.col("doc").isNull(), "doc", "lead")).alias("head"))
    named = named.join(heads, "comp").select("set_key", "component_id", "head")
    some = base.where("n_shingles > 0").join(named, "set_key", "left").select("doc_id", "key", "n_shingles", "component_id", (F.col("r") == F.col("head")).alias("first"))
    none = base.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return some.unionByName(none)


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: one row per input row.

    Rows whose sets of word shingles have a similarity of ``percent`` or more are linked; a component's id is its smallest
    doc_id, and rows that bear it are kept.  Null or empty texts have no shingles and link with nothing.  Rows are linked
    by their own texts, so two rows of one doc_id with different texts may lie in different components.  A row with a null
    doc_id is linked like any other; a component without any doc_id has a null id, and its rows are kept.  Other columns
    are ignored.  Empty input gives an empty result.
    """
    kept_ = F.when(F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return classed(docs, p).select("doc_id", "n_shingles", "component_id", kept_.alias("kept"))


def deduplicated(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest doc_id, and every row without words.  Columns stay as they are."""
    rows = classed(docs, p).groupBy("key").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("n_shingles"))
    rows = stored(rows.where("not first or (n > 1 and n_shingles > 0)").select("key", "first"), "copies")
    mark = "_key"
    while mark in docs.columns:
        mark += "_"
    keyed_ = docs.withColumn(mark, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    dropped, several = rows.select(F.col("key").alias(mark)), rows.where("first").select(F.col("key").alias(mark))
    out = keyed_.join(dropped, mark, "left_anti").select(*docs.columns)
    if several.isEmpty():
        return out
    return out.unionByName(keyed_.join(several, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns))
