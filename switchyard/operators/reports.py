"""Reports over a projection (mid, keys, period, t, risk and transactions before and after) and over history."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import any_positive, finite

VALUES = ("risk_pre", "risk_post", "txn_pre", "txn_post")


def rounded(frame: DataFrame, digits: int, names: Sequence[str] = VALUES) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})


def summed(projection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The four values by keys; rows with nothing above 0 go."""
    sums = projection.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in VALUES])
    return sums.where(any_positive(*[F.col(v) for v in VALUES]))


def granular(projection: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """By keys with the differences, in the order of MID, period and the greatest rise of risk."""
    s = summed(projection, keys).withColumn("risk_diff", F.col("risk_post") - F.col("risk_pre")).withColumn("txn_diff", F.col("txn_post") - F.col("txn_pre"))
    return rounded(s, digits, [*VALUES, "risk_diff", "txn_diff"]).orderBy("mid", "period", F.desc("risk_diff"), *[k for k in keys if k not in ("mid", "period")])


def effective_rate(projection: DataFrame, keys: Sequence[str], period: int, least: float = 50.0) -> DataFrame:
    """Sales, risk and rate of one period, before (sim) and after (forecast), of keys with more than ``least`` sales or one risk."""
    s = projection.where(F.col("period") == period).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in VALUES]).where((F.col("txn_post") > least) | (F.col("risk_post") > 1))
    rate = lambda side: finite(F.try_divide(f"risk_{side}", f"txn_{side}"))
    return s.select(
        *keys, F.round("txn_post", 4).alias("forecast_sales"), F.round("risk_post", 4).alias("forecast_risk"), F.round(rate("post"), 6).alias("forecast_rate"),
        F.round("txn_pre", 4).alias("sim_sales"), F.round("risk_pre", 4).alias("sim_risk"), F.round(rate("pre"), 6).alias("sim_rate"),
    )


def mid_level(projection: DataFrame, past: DataFrame, months: Sequence[int] = range(6)) -> DataFrame:
    """One row for each MID: what it did (``past``: mid, attempts_pre, transactions_pre, risk_pre) and its months ahead; MIDs without anything go."""
    wide = projection.groupBy("mid").pivot("period", list(months)).agg(*[F.sum(v).alias(v) for v in VALUES])
    both = wide.join(past, "mid", "full_outer").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    ahead = []
    for m in months:
        value = {v: F.col(f"{m}_{v}") for v in VALUES}
        rate = F.when(value["txn_pre"] > 0, value["risk_pre"] / value["txn_pre"]).otherwise(0.0)
        ahead += [F.round(value["risk_pre"], 4).alias(f"fc_risk_m{m}"), F.round(value["txn_pre"], 4).alias(f"fc_txn_m{m}"), F.round(rate, 6).alias(f"fc_rate_m{m}"), F.round(value["risk_post"], 4).alias(f"fc_risk_post_m{m}"), F.round(value["txn_post"], 4).alias(f"fc_txn_post_m{m}")]
    active = both.where((F.col(f"{months[0]}_risk_post") > 0) | (F.col("transactions_pre") > 0) | (F.col(f"{months[0]}_txn_post") > 0))
    return active.select("mid", "attempts_pre", "transactions_pre", "risk_pre", F.round(ratio("transactions_pre", "attempts_pre"), 6).alias("success_rate_pre"), F.round(ratio("risk_pre", "transactions_pre"), 6).alias("risk_ratio_pre"), *ahead)


def cohorts(rows: DataFrame, keys: Sequence[str], oldest: int = 5) -> DataFrame:
    """(keys, origin, risk, txn): all risk of the customers of a month beside that month's sales; months with either are kept.  ``rows``: keys, period, t, risk, txn."""
    life = rows.where("risk > 0").groupBy(*keys, (F.col("period") + F.col("t")).alias("origin")).agg(F.sum("risk").alias("risk"))
    sold = rows.where("t = 0").groupBy(*keys, F.col("period").alias("origin")).agg(F.sum("txn").alias("txn"))
    return life.join(sold, [*keys, "origin"], "full_outer").where(F.col("origin").between(0, oldest)).na.fill(0, ["risk", "txn"])


def contributors(frame: DataFrame, label: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest of ``frame`` (one row for each label) with their per cent of the whole."""
    whole = F.sum(value).over(Window.partitionBy())
    return frame.select(label, value, (100 * F.col(value) / whole).alias("per_cent")).orderBy(F.desc(value), label).limit(n)


def recent(rows: DataFrame, keys: Sequence[str], periods: Sequence[int] = (0, 1)) -> DataFrame:
    """(keys, success_count, attempt_count): volume of the latest periods, as the baseline of gateways' shares."""
    n = rows.where(F.col("period").isin(*periods)).groupBy(*keys).agg(F.count(F.lit(1)).alias("success_count"))
    return n.withColumn("attempt_count", F.col("success_count"))


def renamed(frame: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns in another scheme's words: every part of a name, between underscores, that ``names`` has is replaced."""
    new = {c: "_".join(names.get(part, part) for part in c.split("_")) for c in frame.columns}
    if len(set(new.values())) < len(new):
        raise ValueError("two columns would have one name")
    return frame.withColumnsRenamed(new)


def base_metrics(rows: DataFrame, latest: datetime.date, days: int = 30, otherwise: float = 25.0) -> DataFrame:
    """(rpgt, currency, bank, gateway, attempts, success, gateway_rate, cell_rate, ticket, type_ticket) of the last ``days`` up to ``latest``.

    ``rows``: day, rpgt, currency, bank, gateway, amount, success.  ``ticket`` is the mean amount of successes of the bank and currency, ``otherwise`` where
    there are none; ``type_ticket`` that of the type there, else ``ticket``.  A null amount counts as ``otherwise``.  One tally
    by gateway carries all levels; sums of money are exact.
    """
    near = (F.col("day") > F.lit(latest - datetime.timedelta(days=days))) & (F.col("day") <= F.lit(latest))
    won = F.when(F.col("success"), F.coalesce("amount", F.lit(otherwise)).cast("decimal(18,2)"))
    sums = rows.where(near).groupBy("rpgt", "currency", "bank", "gateway").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("success"), F.coalesce(F.sum(won), F.lit(0)).alias("_won"))
    cell, both = Window.partitionBy("rpgt", "currency", "bank"), Window.partitionBy("currency", "bank")
    mean = lambda w, other: F.when(F.sum("success").over(w) > 0, F.sum("_won").over(w).cast("double") / F.sum("success").over(w)).otherwise(other)
    rate = F.sum("success").over(cell) / F.sum("attempts").over(cell)
    found = sums.withColumn("gateway_rate", F.col("success") / F.col("attempts")).withColumn("cell_rate", rate).withColumn("ticket", mean(both, F.lit(otherwise)))
    return found.withColumn("type_ticket", mean(cell, F.col("ticket"))).drop("_won")


def month_filled(projected: DataFrame, kinds: Sequence[str], less: Mapping[str, float]) -> DataFrame:
    """(rpgt, units): whole units of each of ``kinds``, 0 where nothing is projected, less what is agreed (``less``), never below 0."""
    spark = projected.sparkSession
    asked = spark.createDataFrame([(k, float(less.get(k, 0.0))) for k in kinds], "rpgt string, _less double")
    units = F.coalesce(F.bround("projected"), F.lit(0.0)) - F.col("_less")
    return asked.join(projected.select("rpgt", "projected"), "rpgt", "left").select("rpgt", F.greatest(units, F.lit(0.0)).cast("long").alias("units"))
