"""Relational helpers with the null, tie and empty-group rules that the domain needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; give a full tie-break for a fixed result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def without_covered(general: DataFrame, specific: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``general`` whose key has no row in ``specific``."""
    return general.join(specific.select(*keys).distinct(), list(keys), "left_anti")


def remainder_after(source: DataFrame, moved: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``source`` with ``value`` less what ``moved`` took from it, never below 0."""
    taken = moved.groupBy(*keys).agg(F.sum(value).alias("_taken"))
    left = F.greatest(F.col(value) - F.coalesce("_taken", F.lit(0.0)), F.lit(0.0))
    return source.join(taken, list(keys), "left").withColumn(value, left).drop("_taken")


def with_fallback(frame: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str]]], value: str, default: Column, out: str) -> DataFrame:
    """Left-join ``value`` from ever coarser tables; the first level that has a key wins, then ``default``."""
    names = []
    for k, (table, keys) in enumerate(levels):
        names.append(f"_level{k}")
        frame = frame.join(table.select(*keys, F.col(value).alias(names[-1])), list(keys), "left")
    return frame.withColumn(out, F.coalesce(*names, default)).drop(*names)


def commonest(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-null ``value`` of each key, the least in order among equals; counts come first, so a hot key is small."""
    return most_used(frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), keys, value, "_n")


def most_used(counts: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """The ``value`` of each key with the greatest count ``n``, the least in order among equals."""
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col(n), F.col(value))).alias(value))


def top_with_other(frame: DataFrame, label: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest by absolute value, the rest added up as ``Other``.  The ranking sees one row for each label."""
    sums = frame.groupBy(label).agg(F.sum(value).alias(value))
    top = sums.orderBy(F.abs(value).desc(), label).limit(n).select(F.col(label).alias("_top"))
    tagged = sums.join(F.broadcast(top), F.col(label) == F.col("_top"), "left")  # n rows
    return tagged.groupBy(F.coalesce("_top", F.lit("Other")).alias(label)).agg(F.sum(value).alias(value))


def with_total(frame: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """Sums by label and a TOTAL row, in one pass."""
    rolled = frame.rollup(label).agg(F.grouping(label).alias("_g"), *[F.sum(v).alias(v) for v in values])
    return rolled.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(label)).alias(label), *values)


def expanded(frame: DataFrame, column: str, choices: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose ``column`` is a collective word become one row for each member; others stay."""
    out = F.array(F.col(column))
    for word, members in choices.items():
        out = F.when(F.lower(column) == word.lower(), F.array(*[F.lit(m) for m in members])).otherwise(out)
    return frame.withColumn(column, F.explode(out))


def long_shares(wide: DataFrame, keys: Sequence[str], gateways: Sequence[str]) -> DataFrame:
    """Wide gateway columns to rows (gateway, share), unreadable and empty cells dropped."""
    from switchyard.functions.columns import percent

    texts = wide.select(*keys, *[F.col(f"`{g}`").cast("string").alias(g) for g in gateways])
    return texts.unpivot(list(keys), list(gateways), "gateway", "_text").select(*keys, "gateway", percent(F.col("_text")).alias("share")).where("share > 0")


def reconciled(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """One row: number of keys, of keys beyond the tolerance, and the worst key with its difference."""
    a = left.groupBy(*keys).agg(F.sum(value).alias("_a"))
    b = right.groupBy(*keys).agg(F.sum(value).alias("_b"))
    both = a.join(b, list(keys), "full_outer").select(F.concat_ws("|", *keys).alias("key"), (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("d"))
    return both.agg(F.count(F.lit(1)).alias("keys"), F.sum((F.abs("d") > tolerance).cast("long")).alias("beyond"), F.max_by("key", F.struct(F.abs("d"), "key")).alias("worst"), F.max(F.abs("d")).alias("difference"))


def with_pool(frame: DataFrame, rates: DataFrame, keys: Sequence[str], value: str, pool: Column) -> DataFrame:
    """``value`` by keys, else ``pool``, with ``pooled`` true where the pool stood in."""
    own = rates.select(*keys, F.col(value).alias("_own"))
    return frame.join(own, list(keys), "left").withColumn(value, F.coalesce("_own", pool)).withColumn("pooled", F.col("_own").isNull()).drop("_own")
