"""Benchmark decontamination by size-partitioned MinHash containment search.

Method: items are partitioned by the size of their shingle sets.  An item's signature names the shingles that are least under
each of several hash functions; the share of them found in a document estimates how much of the item the document
contains, whatever the document's length.  Each partition has its own signature size and, from that and a miss
probability, its own bound on matches; candidates are verified on the full sets.

Scale: one scan of the texts, which leaves of each document only the shingles whose bits are set in two bitmaps of fixed
size, one of all signatures and one of all items.  Those few meet signatures and items in joins, so neither side is ever
on the driver or in one task whole, and any number of items gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.bitmap import bitmap, held
from switchyard.llm.scratch import stored
from switchyard.llm.text import WordHashes, kept, mixed, shingles, sliced, texts


@dataclass(frozen=True)
class Containment:
    """An item is found where ``percent`` of its distinct shingles lie in the document.  Items of at most ``whole`` shingles are their own signature; others, of less than 2**k shingles, have ``grade * k`` hashes; ``bits``: size of the bitmaps; ``salts``: copies of a signature among which documents are dealt."""

    percent: int = 75
    width: int = 5
    whole: int = 16
    grade: int = 4
    miss: float = 1e-7
    bits: int = 25
    salts: int = 8
    seed: int = 3

    def least_matches(self, n: int) -> int:
        """Least signature matches at which containment of ``percent`` still has the miss probability."""
        c, total, m = self.percent / 100, 0.0, -1
        while total < self.miss:
            m += 1
            total += comb(n, m) * c**m * (1 - c) ** (n - m)
        return max(1, m)

    def signature(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(shingles, how many hash functions chose each, least matches) of a set, as its size partition has it."""
        if len(s) <= self.whole:
            return s, np.ones(len(s), dtype=np.int64), -(-self.percent * len(s) // 100)
        hashes = self.grade * len(s).bit_length()
        salts = np.random.default_rng(self.seed).integers(0, 2**63, hashes, dtype=np.uint64)
        return *np.unique([s[mixed(s ^ salt).argmin()] for salt in salts], return_counts=True), self.least_matches(hashes)


def _item_rows(benchmark: DataFrame, p: Containment) -> DataFrame:
    """Distinct items (item_id, s) as rows (i, item_id, width, n, s, chosen, weight, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, i = kept("words", WordHashes), TaskContext.get().partitionId() << 33
        for batch in batches:
            words = [min(p.width, len(t.split())) for t in texts(batch.column(1))]
            sets = [np.unique(shingles(t, cache, p.width)) for t in texts(batch.column(1))]
            signed = [p.signature(s) for s in sets]
            longs = lambda some: pa.array([x.view(np.int64) for x in some], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(i, i + len(sets))), batch.column(0), pa.array(words, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), longs(sets), longs([c for c, _, _ in signed]), pa.array([w for _, w, _ in signed], pa.list_(pa.int64())), pa.array([m for _, _, m in signed], pa.int64())],
                names=["i", "item_id", "width", "n", "s", "chosen", "weight", "least"],
            )
            i += len(sets)

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return rows.mapInArrow(run, "i long, item_id long, width int, n long, s array<long>, chosen array<long>, weight array<long>, least long").where("n > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, p: Containment = Containment()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_items, n_hits, item_ids, best_common, contaminated.

    ``item_ids``: the items of which the document holds ``percent`` or more of the distinct word shingles, ascending and
    distinct; ``n_hits`` counts item texts (two texts may share an item_id); ``best_common`` is the largest number of
    common shingles.  An item of fewer words than ``width`` is one shingle, found wherever its words stand in that order.
    Items without words or id are skipped; null or empty texts contain nothing.  Rows are searched by themselves, so rows
    of one doc_id, or of none, each give their own result; with no items nothing is contaminated.
    """
    spark = docs.sparkSession
    items = stored(_item_rows(benchmark, p), "items")
    widths = sorted({r.width for r in items.select("width").distinct().collect()})  # at most ``width`` of them
    signs = items.select("i", "least", F.explode(F.arrays_zip("chosen", "weight")).alias("x")).select("i", "least", F.col("x.chosen").alias("value"), "x.weight")
    by_sign = spark.sparkContext.broadcast(bitmap(signs, "value", p.bits))
    by_item = spark.sparkContext.broadcast(bitmap(items.select(F.explode("s").alias("value")), "value", p.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, r = kept("words", WordHashes), TaskContext.get().partitionId() << 33
        for batch in sliced(batches, 1):
            signs_, own = [], []
            for text in texts(batch.column(1)):
                some = np.concatenate([shingles(text, cache, w) for w in widths]) if widths else np.zeros(0, np.uint64)
                some = some[held(by_item.value, some)]
                some = np.unique(some) if len(some) else some
                first = some[held(by_sign.value, some)]
                signs_.append(first.view(np.int64))
                own.append((some if len(first) else first).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(r, r + len(own))), batch.column(0), pa.array(signs_, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], names=["r", "doc_id", "signs", "own"])
            r += len(own)
        pa.default_memory_pool().release_unused()  # the worker lives on

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = stored(rows.mapInArrow(run, "r long, doc_id long, signs array<long>, own array<long>"), "scan")
    quiet, open_ = scan.where("size(signs) = 0"), scan.where("size(signs) > 0")
    dealt = open_.select("r", F.explode("signs").alias("value")).withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(p.salts)))
    copied = signs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.salts - 1).cast("long"))))
    able = dealt.join(copied, ["value", "salt"]).groupBy("r", "i").agg(F.sum("weight").alias("matched"), F.first("least").alias("least")).where("matched >= least").select("r", "i")
    common = F.size(F.array_intersect("own", "s")).cast("long")
    hits = able.join(open_.select("r", "own"), "r").join(items.select("i", "item_id", "n", "s"), "i").select("r", "item_id", "n", common.alias("common")).where(100 * F.col("common") >= p.percent * F.col("n"))
    found = hits.groupBy("r").agg(F.count(F.lit(1)).alias("n_hits"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("common").alias("best_common"))
    out = open_.select("r", "doc_id").join(found, "r", "left").drop("r").unionByName(quiet.select("doc_id"), allowMissingColumns=True)
    ids, zero = F.coalesce("item_ids", F.expr("cast(array() as array<bigint>)")), F.lit(0).cast("long")
    return out.select("doc_id", F.size(ids).cast("long").alias("n_items"), F.coalesce("n_hits", zero).alias("n_hits"), ids.alias("item_ids"), F.coalesce("best_common", zero).alias("best_common"), F.col("n_hits").isNotNull().alias("contaminated"))
