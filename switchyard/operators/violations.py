"""Breaches of a split's limits, their weights and penalties, and one report over MIDs, schemes and priorities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-9
LEVELS = {"all": [], "kind": ["kind"], "mid": ["mid"], "kind and scheme": ["kind", "scheme"], "kind and mid": ["kind", "mid"], "kind and priority": ["kind", "priority"]}


def penalty(over: Column, fixed: float, scale: float, steep: bool = False) -> Column:
    """A fixed hit for any breach, and a square (or exponential) of its relative size."""
    size = scale * (F.exp(F.least(over, F.lit(50.0))) - 1) if steep else scale * over * over
    return F.when(over > TINY, fixed + size).otherwise(0.0)


def mid_sums(split: DataFrame) -> DataFrame:
    """(mid, scheme, volume, risk, base, weight): volumes under the split and the baseline; the weight of a breach is the baseline volume over the MIDs' mean of those that have any, else 1."""
    v = F.coalesce("volume", F.lit(0.0)) * F.coalesce("share", F.lit(0.0))
    base = F.coalesce("volume", F.lit(0.0)) * F.coalesce("baseline_share", F.lit(0.0))
    sums = split.groupBy("mid", "scheme").agg(F.sum(v).alias("volume"), F.sum(v * F.coalesce("risk_rate", F.lit(0.0))).alias("risk"), F.sum(base).alias("base"))
    mean = F.broadcast(sums.agg(F.avg(F.when(F.col("base") > 0, F.col("base"))).alias("_mean")))  # one row
    weight = F.when((F.col("base") > 0) & (F.col("_mean") > 0), F.col("base") / F.col("_mean")).otherwise(1.0)
    return sums.join(mean).withColumn("weight", weight).drop("_mean")


def breaches(split: DataFrame, cell: Sequence[str], rate_cap: float, volume_caps: DataFrame, bands: DataFrame, most: float = 1.0, least: float = 0.0, fixed: float = 1.0, scale: float = 10.0, yields: float = 5000.0, steep: bool = False) -> DataFrame:
    """(kind, mid, scheme, priority, value, limit, over, weight, penalty): one row for each limit that is broken.

    ``split``: cell, gateway, mid, scheme, volume (of the cell), share, baseline_share, risk_rate; ``volume_caps``: mid, cap; ``bands``: mid, value (at the baseline),
    floor, ceiling, priority: the value follows the MID's volume.  ``over`` is relative to the limit.  A band of priority p counts
    ``yields``^(1 - p).  Shares over ``most``, or under ``least`` (at most 1/n in a cell of n gateways, two or more), are breaches
    of weight 1.  Null limits ask nothing.
    """
    sums = mid_sums(split)
    row = lambda kind, value, limit, over, weight, priority=None: F.struct(
        F.lit(kind).alias("kind"), (priority if priority is not None else F.lit(None).cast("int")).alias("priority"), value.alias("value"), limit.alias("limit"), F.greatest(F.coalesce(over, F.lit(0.0)), F.lit(0.0)).alias("over"), weight.alias("weight"))
    held = lambda limit: F.when(limit.isNotNull(), F.greatest(limit, F.lit(TINY)))
    above = lambda value, limit: value / held(limit) - 1
    rate = F.when(F.col("volume") > 1e-12, F.col("risk") / F.col("volume")).otherwise(0.0)
    capped = sums.join(volume_caps.select("mid", "cap"), "mid", "left")
    cap = F.when(F.col("cap") > 0, F.col("cap").cast("double"))
    of_mids = capped.select("mid", "scheme", F.explode(F.array(row("rate_cap", rate, F.lit(float(rate_cap)), above(rate, F.lit(float(rate_cap))), F.col("weight")), row("volume_cap", F.col("volume"), cap, above(F.col("volume"), cap), F.col("weight")))).alias("x"))
    known = bands.select("mid", F.col("value").alias("_at"), F.col("floor").cast("double").alias("floor"), F.col("ceiling").cast("double").alias("ceiling"), F.col("priority").cast("int").alias("priority"))
    moved = F.when(F.col("base") > 1e-12, F.col("volume") / F.col("base")).otherwise(1.0) * F.col("_at")
    weight = F.col("weight") * F.pow(F.lit(float(yields)), 1 - F.coalesce("priority", F.lit(1)))
    floor = F.when(F.col("floor") > 0, F.col("floor"))
    both = F.array(row("band_ceiling", moved, F.col("ceiling"), above(moved, F.col("ceiling")), weight, F.col("priority")), row("band_floor", moved, floor, 1 - moved / held(floor), weight, F.col("priority")))
    of_bands = sums.join(known, "mid").select("mid", "scheme", F.explode(both).alias("x"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*cell))
    at_least = F.when(n >= 2, F.least(F.lit(least), 1 / n))
    x = F.coalesce("share", F.lit(0.0))
    one, none = F.lit(1.0), F.lit(None).cast("double")
    of_cells = split.select("mid", "scheme", x.alias("_x"), at_least.alias("_floor")).select("mid", "scheme", F.explode(F.array(
        row("max_share", F.col("_x"), F.lit(float(most)) if most < 1 else none, (F.col("_x") - most) / max(most, TINY) if most < 1 else none, one),
        row("floor", F.col("_x"), F.col("_floor") if least > 0 else none, (F.col("_floor") - F.col("_x")) / max(least, TINY) if least > 0 else none, one))).alias("x"))
    every = of_mids.unionByName(of_bands).unionByName(of_cells).select("mid", "scheme", "x.*").where(F.col("over") > TINY)
    return every.withColumn("penalty", penalty(F.col("over"), fixed, scale, steep) * F.col("weight"))


def report(found: DataFrame) -> DataFrame:
    """(level, kind, mid, scheme, priority, breaches, penalty, worst, worst_to_shed, worst_mid): sums of the breaches on every level, by one grouping.

    ``worst_to_shed`` leaves out what needs more volume (``band_floor``, ``floor``).  A band without priority stands under 0.
    """
    keys = ["kind", "mid", "scheme", "priority"]
    rows = found.withColumn("priority", F.coalesce("priority", F.lit(0)))
    shed = F.max(F.when(~F.col("kind").isin("band_floor", "floor"), F.col("over")))
    sums = rows.groupingSets([[F.col(c) for c in level] for level in LEVELS.values()], *[F.col(c) for c in keys]).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("breaches"), F.sum("penalty").alias("penalty"), F.max("over").alias("worst"), shed.alias("worst_to_shed"), F.max(F.struct("over", "mid"))["mid"].alias("worst_mid"))
    bits = {sum(0 if c in level else 1 << (3 - i) for i, c in enumerate(keys)): name for name, level in LEVELS.items()}
    name = F.element_at(F.create_map(*[F.lit(v) for pair in bits.items() for v in pair]), F.col("_id").cast("int"))
    return sums.withColumn("level", name).select("level", *keys, "breaches", "penalty", "worst", "worst_to_shed", "worst_mid")
