"""Sharding by sampled splitters, on DataFrame functions alone.

Method: size-weighted samples of the key (a hash of the text) give quantile boundaries; records are range-partitioned by them, and
ranges that come out overfull are subdivided.  Exact sizes of all ranges then place every record on one line of bytes,
which is cut into equal parts.

Scale: equal texts are one group, a row with a count, so a hot text is one row until the end.  Only groups that
exceed a fixed share of a shard are spread over several shards; there are at most ``2 * shards / whole`` of them, a
proven bound for their broadcast.  Texts are read once and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.llm.scratch import stored


@dataclass(frozen=True)
class Splitters:
    """``ranges``: first ranges (a square); ``samples``: expected samples; ``full``: groups in one range at most, over which it is subdivided; ``whole``: share of a shard up to which equal texts stay together; ``salts``: parts in which a large group is numbered."""

    shards: int = 16
    ranges: int = 256
    samples: int = 8192
    full: int = 1_000_000
    whole: float = 0.02
    salts: int = 64


def _literal(values: list) -> Column:
    return F.array(*[_literal(v) if isinstance(v, list) else F.lit(v) for v in values])


def _splitters(groups: DataFrame, total: int, p: Splitters) -> list[int]:
    """Quantile boundaries of the key from samples drawn in proportion to size: a group of size s has s/step copies, rounded up or down by its hash."""
    step = max(1.0, total / p.samples)
    chance = F.pmod(F.xxhash64("h", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = groups.select("h", F.floor(F.col("bytes") / F.lit(step) + chance).cast("long").alias("copies")).where("copies > 0")
    ends = F.sum("copies").over(Window.orderBy("h", "copies").rowsBetween(Window.unboundedPreceding, 0))  # about ``samples`` rows
    last = F.floor(ends * p.ranges / F.sum("copies").over(Window.partitionBy()))
    rows = drawn.select("h", last.alias("q")).groupBy("q").agg(F.min("h").alias("h")).where(f"q > 0 and q < {p.ranges}").orderBy("q").collect()
    found = [r.h for r in rows]
    return (found + [2**63 - 1] * p.ranges)[: p.ranges - 1]


def _range_of(key: Column, splitters: list[int], p: Splitters) -> Column:
    """Number of splitters at or below the key, in two steps of about sqrt(ranges)."""
    side = int(p.ranges**0.5)
    padded = splitters + [2**63 - 1] * (side * side - len(splitters))
    coarse, fine = padded[side - 1 :: side], [padded[k : k + side - 1] for k in range(0, side * side, side)]
    below = lambda values: F.size(F.filter(values, lambda s: s <= key))
    first = below(_literal(coarse[:-1]))
    return first * side + below(F.element_at(_literal(fine), first + 1))


def shard(docs: DataFrame, p: Splitters = Splitters()) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, divided: one row per input row.

    The law is ``bytes``: shards are consecutive stretches of equal bytes along the key, up to the text at a border.
    Equal texts lie together unless they are over ``whole`` of a shard, as equal sizes then ask; ``divided`` marks their
    rows.  Null texts are empty, of size 1; a null doc_id
    sorts first; repeated rows each take a slot; other columns are ignored; empty input gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    base = stored(base, "sizes")
    key = ["h", "text_crc32", "size"]
    groups = base.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    groups = stored(groups, "groups")
    total, n_rows, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()

    splitters = _splitters(groups, total, p)
    ranged = groups.withColumn("r", _range_of(F.col("h"), splitters, p))
    full = min(p.full, max(1, 2 * n_groups // p.ranges))
    spans = ranged.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).select("r", "lo", "hi", F.ceil(F.col("n") / F.lit(full)).cast("int").alias("pieces"))  # one row for each range
    width = (F.col("hi").cast("double") - F.col("lo").cast("double") + 1.0) / F.col("pieces")
    sub = F.least(F.floor((F.col("h").cast("double") - F.col("lo").cast("double")) / width), F.col("pieces") - 1).cast("int")
    ranged = ranged.join(F.broadcast(spans), "r").select(*key, "rows", "bytes", "r", F.when(F.col("pieces") > 1, sub).otherwise(0).alias("s"))
    ranged = stored(ranged, "ranges")
    before = Window.orderBy("r", "s").rowsBetween(Window.unboundedPreceding, -1)  # at most ranges + groups / full rows, doubled
    sums = ranged.groupBy("r", "s").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n"))
    sums = sums.select("r", "s", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("r", "s").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    along = lambda base_, c: F.col(base_) + F.coalesce(F.sum(c).over(inside), F.lit(0))
    placed = ranged.join(sums, ["r", "s"]).select(*key, "rows", "bytes", along("b0", "bytes").alias("start"), along("n0", "rows").alias("first"))
    large = (F.col("rows") > 1) & ((F.col("bytes") > p.whole * total / p.shards) | (F.col("rows") > p.whole * n_rows / p.shards))
    placed = stored(placed.withColumn("large", large), "places")

    part = lambda twice: F.least(F.floor(twice * p.shards / F.lit(2 * max(total, 1))), F.lit(p.shards - 1)).cast("int")
    few = F.broadcast(placed.where("large").select(*key, "start", "first"))
    many = placed.where("not large").select(*key, "first", part(F.col("start") * 2 + F.col("bytes")).alias("shard"))
    copy = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")) - 1
    small = base.join(few.select(*key), key, "left_anti").join(many, key).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + copy).alias("at"), F.lit(False).alias("divided"))

    salted = base.join(few, key).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(p.salts)))
    counts = salted.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # ``salts`` rows
    counts = counts.select(*key, "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    within = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("doc_id")) - 1
    spread = salted.join(counts, [*key, "salt"]).withColumn("k", F.col("n0") + within)
    spread = spread.select("doc_id", "size", "text_crc32", part((F.col("start") + F.col("k") * F.col("size")) * 2 + F.col("size")).alias("shard"), (F.col("first") + F.col("k")).alias("at"), F.lit(True).alias("divided"))

    rows = stored(small.unionByName(spread), "rows")
    firsts = F.broadcast(rows.groupBy("shard").agg(F.min("at").alias("from")))  # one row for each shard
    return rows.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "divided")
