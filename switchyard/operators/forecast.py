"""Risk forecast in long form: curves by age, extrapolation, tails, shares and origin lock.

Month m runs 0 to ``MONTHS - 1``, age t 0 to ``AGES - 1``; history has period 0 for the latest full month.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import AVERAGE_MONTH, finite, share_of
from switchyard.operators.relational import with_fallback, without_covered

MONTHS, AGES = 6, 10


def mapping_percent(mapping: DataFrame, volume: str = "trx", keys: Sequence[str] = ("rpgt",)) -> DataFrame:
    """Share of each profile in its transaction type's volume; 0 where there is none."""
    return mapping.withColumn("mapping_pct", share_of(volume, keys))


def overridden(mapping: DataFrame, targets: DataFrame, volume: str = "trx") -> DataFrame:
    """Gateways with a target are scaled so that their volume is the target.  ``targets``: gateway, target (a short list)."""
    total = F.sum(volume).over(Window.partitionBy("gateway"))
    out = mapping.join(targets, "gateway", "left")
    return out.withColumn(volume, F.when(F.col("target").isNotNull() & (total > 0), F.col(volume) * F.col("target") / total).otherwise(F.col(volume).cast("double"))).drop("target")


def forecast_volume(mapping: DataFrame, macro: DataFrame) -> DataFrame:
    """(profile, m, trx): the plan's units of each month spread by mapping share; a type without plan has 0."""
    spread = mapping.join(macro, "rpgt", "left")
    return spread.withColumn("trx", F.coalesce(F.col("units") * F.col("mapping_pct"), F.lit(0.0))).drop("units")


def to_target(volume: DataFrame, target: float, mix: DataFrame | None = None) -> DataFrame:
    """All months scaled so that month 0 totals ``target``, then month 0's types by ``mix`` (rpgt, ratio); a type outside the mix gets 0."""
    zero = F.when(F.col("m") == 0, F.col("trx")).otherwise(0.0)
    total = F.sum("z").over(Window.partitionBy())
    sums = volume.groupBy("rpgt").agg(F.sum(zero).alias("z")).select("rpgt", "z", total.alias("all"))  # one row for each type
    if mix is None:
        factor = sums.select("rpgt", F.when(F.col("all") > 0, target / F.col("all")).otherwise(0.0).alias("factor"))
    else:
        factor = sums.join(mix, "rpgt", "left").select("rpgt", F.when(F.col("z") > 0, target * F.coalesce("ratio", F.lit(0.0)) / F.col("z")).otherwise(0.0).alias("factor"))
    return volume.join(factor, "rpgt").withColumn("trx", F.col("trx") * F.col("factor")).drop("factor")


def aligned(history: DataFrame) -> DataFrame:
    """Periods shifted so that the least is 0, where it is above 0."""
    least = history.agg(F.min("period").alias("least"))
    shift = F.greatest(F.coalesce("least", F.lit(0)), F.lit(0))
    return history.join(F.broadcast(least)).withColumn("period", (F.col("period") - shift).cast("int")).drop("least")  # one row


def decay_curve(history: DataFrame, keys: Sequence[str], sample: int = 6) -> DataFrame:
    """(keys, t, pct, seen, total): share of each age in the risk of the periods up to ``sample``, filled with 0 to all ages, and the counts it is made of."""
    used = history.where(F.col("period") <= sample).withColumn("t", F.coalesce("t", F.lit(0)))
    summed = used.groupBy(*keys, "t").agg(F.sum("risk_count").alias("r"))
    by_key = summed.groupBy(*keys).agg(F.sum("r").alias("total"), F.map_from_entries(F.collect_list(F.struct("t", "r"))).alias("by_age"))  # ten entries at most
    ages = by_key.select(*keys, "total", "by_age", F.explode(F.sequence(F.lit(0), F.lit(AGES - 1))).alias("t"))
    seen = F.coalesce(F.try_element_at("by_age", "t"), F.lit(0))
    return ages.select(*keys, "t", finite(F.try_divide(seen.cast("double"), F.col("total"))).alias("pct"), seen.alias("seen"), "total")


def curves_with_base(history: DataFrame, fine: Sequence[str], base: Sequence[str], least: float = 50.0, sample: int = 6) -> DataFrame:
    """Fine curves; where a fine key has less than ``least`` risk and its base key has a curve, the base curve."""
    own = decay_curve(history, fine, sample)
    coarse = decay_curve(history, base, sample).select(*base, "t", F.col("pct").alias("base_pct"))
    weight = history.where(F.col("period") <= sample).groupBy(*fine).agg(F.sum("risk_count").alias("weight"))
    both = own.join(weight, list(fine)).join(coarse, [*base, "t"], "left")
    return both.select(*fine, "t", F.when((F.col("weight") < least) & F.col("base_pct").isNotNull(), F.col("base_pct")).otherwise(F.col("pct")).alias("pct"))


def base_rate(history: DataFrame, volumes: DataFrame, keys: Sequence[str], decay: float = 0.8, lookback: int = 6) -> DataFrame:
    """Risk at age 0 per transaction, recent periods weighing more: sum(risk d^p) / sum(txn d^p)."""
    near = F.col("period") < lookback
    w = F.pow(F.lit(decay), F.col("period"))
    risk = history.where(near & (F.col("t") == 0)).groupBy(*keys).agg(F.sum(F.col("risk_count") * w).alias("r"))
    txn = volumes.where(near).groupBy(*keys).agg(F.sum(F.col("txn_count") * w).alias("v"))
    return txn.join(risk, list(keys), "left").select(*keys, finite(F.try_divide(F.coalesce("r", F.lit(0.0)), "v")).alias("rate0"))


def extrapolation(history: DataFrame, curves: DataFrame, keys: Sequence[str], sample: int = 6) -> DataFrame:
    """(keys, age, factor) for ages 1 to 9: risk already seen of cohorts that will be ``age`` old over what the curve expects of it.

    The cohort of age T had age T-i in period i, for i up to min(T, sample).  Both sums are of counts, divided once, so the result
    does not depend on the order of adding.  ``curves``: as of ``decay_curve``.
    """
    both = history.groupBy(*keys, "period", "t").agg(F.sum("risk_count").alias("r"))
    pairs = curves.select(*keys, F.col("t").alias("u"), F.col("seen").alias("of_age"), "total").withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(sample))))
    pairs = pairs.withColumn("age", F.col("u") + F.col("period")).where(F.col("age").between(1, AGES - 1))
    joined = pairs.join(both.withColumnRenamed("t", "u"), [*keys, "period", "u"], "left")
    sums = joined.groupBy(*keys, "age").agg(F.sum(F.coalesce("r", F.lit(0))).alias("seen"), F.sum("of_age").alias("of_ages"), F.max("total").alias("total"))
    return sums.select(*keys, "age", finite(F.try_divide((F.col("seen") * F.col("total")).cast("double"), F.col("of_ages"))).alias("factor"))


def tails(volume: DataFrame, rates: DataFrame, curves: DataFrame, factors: DataFrame, keys: Sequence[str], days: DataFrame) -> DataFrame:
    """(keys, m, t, risk): risk of new business by age and of the cohorts already sold, each month scaled by its days.

    New business of month o appears at month o+t with vol * rate0 / c0 * curve(t), or vol * rate0 at age 0 where c0 is 0.  A sold
    cohort of age T appears at (m, T+m) with factor * curve.  A month's shortfall against an average month is carried to
    the next month and age.  ``days``: m, days (six rows).
    """
    curves = curves.select(*keys, "t", "pct")
    c = curves.withColumn("c0", F.max(F.when(F.col("t") == 0, F.col("pct"))).over(Window.partitionBy(*keys)))  # ten ages
    new = volume.join(rates, list(keys)).join(c, list(keys)).select(*keys, (F.col("m") + F.col("t")).cast("int").alias("m"), "t", F.when(F.col("c0") > 0, F.col("trx") * F.col("rate0") / F.col("c0") * F.col("pct")).when(F.col("t") == 0, F.col("trx") * F.col("rate0")).otherwise(0.0).alias("raw"))
    old = factors.join(curves, list(keys)).where("t >= age").select(*keys, (F.col("t") - F.col("age")).cast("int").alias("m"), "t", (F.col("factor") * F.col("pct")).alias("raw"))
    raw = new.where(F.col("m") < MONTHS).unionByName(old.where(F.col("m") < MONTHS)).groupBy(*keys, "m", "t").agg(F.sum("raw").alias("raw"))
    flexed = raw.join(F.broadcast(days.select("m", (F.col("days") / AVERAGE_MONTH).alias("flex"))), "m")
    part = lambda step, much: F.struct((F.col("m") + step).alias("m"), (F.col("t") + step).alias("t"), (F.col("raw") * much).alias("risk"))
    both = flexed.select(*keys, F.explode(F.array(part(0, F.col("flex")), part(1, 1 - F.col("flex")))).alias("x")).select(*keys, "x.*")
    return both.where((F.col("m") < MONTHS) & (F.col("t") < AGES)).groupBy(*keys, "m", "t").agg(F.sum("risk").alias("risk"))


def waterfall_shares(future: DataFrame, history: DataFrame, key: str = "prof") -> DataFrame:
    """(key, gateway, share): from future volume where the profile has any, else from history, else 1 for each."""
    both = future.select(key, "gateway", F.col("trx").alias("f"), F.lit(0.0).alias("h")).unionByName(history.select(key, "gateway", F.lit(0.0).alias("f"), F.col("txn_count").cast("double").alias("h")))
    sums = both.groupBy(key, "gateway").agg(F.sum("f").alias("f"), F.sum("h").alias("h"))
    w = Window.partitionBy(key)
    raw = F.when(F.sum("f").over(w) > 0, F.col("f")).when(F.sum("h").over(w) > 0, F.col("h")).otherwise(F.lit(1.0))
    return sums.select(key, "gateway", raw.alias("raw")).select(key, "gateway", share_of("raw", [key]).alias("share"))


def origin_locked(risk: DataFrame, future: DataFrame, past: DataFrame, key: str = "prof") -> DataFrame:
    """(key, gateway, m, t, risk): risk of cohorts sold from month 0 on follows future shares; older cohorts keep the split of the period they were sold in, if known."""
    spread = risk.join(future, key).withColumn("period", F.when(F.col("t") > F.col("m"), F.col("t") - F.col("m") - 1).cast("int"))
    spread = spread.join(past.withColumnRenamed("share", "past_share"), [key, "gateway", "period"], "left")
    share = F.when(F.col("m") >= F.col("t"), F.col("share")).otherwise(F.coalesce("past_share", "share"))
    return spread.select(key, "gateway", "m", "t", (F.col("risk") * share).alias("risk"))


def shifted(risk: DataFrame, last: DataFrame, keys: Sequence[str], month_days: int) -> DataFrame:
    """Months moved on by one; month 0 becomes last month's raw count, no longer normalised to an average month."""
    moved = risk.withColumn("m", F.col("m") + 1).where(F.col("m") < MONTHS)
    first = last.select(*keys, F.lit(0).alias("m"), "t", (F.col("risk_count") * month_days / AVERAGE_MONTH).alias("risk"))
    return moved.unionByName(first).groupBy(*keys, "m", "t").agg(F.sum("risk").alias("risk"))


def rescued(profiles: DataFrame, known: DataFrame, sources: Sequence[tuple[DataFrame, Sequence[str]]], key: Sequence[str]) -> DataFrame:
    """(key, gateway, share) of the profiles that ``known`` lacks: the gateway of the first of ``sources`` (gateway by keys) that has one, else ``unmapped``, with all of the share."""
    lost = without_covered(profiles, known, key)
    return with_fallback(lost, sources, "gateway", F.lit("unmapped"), "gateway").withColumn("share", F.lit(1.0))


def joined_history(past: DataFrame, future: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """History and forecast one under the other, added up where both have a key."""
    return past.unionByName(future).groupBy(*keys).agg(F.sum(value).alias(value))


def inherited(profiles: DataFrame, curves: DataFrame, swaps: Mapping[str, str], rest: Sequence[str]) -> DataFrame:
    """(rpgt, rest, t, pct) for every profile and age: its own curve, else that of the type that ``swaps`` names for its type, else 0."""
    other = F.lit(None).cast("string")
    for kind, stand_in in swaps.items():
        other = F.when(F.col("rpgt") == kind, F.lit(stand_in)).otherwise(other)
    ages = profiles.withColumn("_other", other).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(AGES - 1))))
    own = curves.select("rpgt", *rest, "t", F.col("pct").alias("_own"))
    theirs = curves.select(F.col("rpgt").alias("_other"), *rest, "t", F.col("pct").alias("_theirs"))
    both = ages.join(own, ["rpgt", *rest, "t"], "left").join(theirs, ["_other", *rest, "t"], "left")
    return both.select("rpgt", *rest, "t", F.coalesce("_own", "_theirs", F.lit(0.0)).alias("pct"))


def actual_rules(volume: DataFrame, deaths: DataFrame, profile: Sequence[str], days: int) -> DataFrame:
    """Last month's volume (profile, gateway, n) as rules: gateways dead from the start go, one that died on a day of the month counts as if it had run all ``days``.

    ``deaths``: gateway, end_day (NULL: dead from the start), a short list.
    """
    marked = volume.join(F.broadcast(deaths.withColumn("_dead", F.lit(True))), "gateway", "left").where("_dead is null or end_day is not null")
    scaled = marked.withColumn("_x", F.col("n").cast("double") * F.when(F.col("end_day").isNull(), 1.0).otherwise(F.lit(float(days)) / F.col("end_day")))
    return scaled.select(*profile, "gateway", share_of("_x", profile).alias("share"), F.lit("Actuals").alias("rule_source"))


def period_shares(slots: DataFrame, past: DataFrame, deep: DataFrame, periods: int, key: str = "prof") -> DataFrame:
    """(key, gateway, period, share) for every slot (key, gateway) and period: from the period's own volume where the profile has any, else from all its history, else even."""
    every = slots.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    both = every.join(past.select(key, "gateway", "period", F.col("n").alias("_p")), [key, "gateway", "period"], "left").join(deep.select(key, "gateway", F.col("n").alias("_d")), [key, "gateway"], "left").na.fill(0, ["_p", "_d"])
    w = Window.partitionBy(key, "period")
    raw = F.when(F.sum("_p").over(w) > 0, F.col("_p")).when(F.sum("_d").over(w) > 0, F.col("_d")).otherwise(F.lit(1)).cast("double")
    return both.withColumn("_raw", raw).select(key, "gateway", "period", share_of("_raw", [key, "period"]).alias("share"))
