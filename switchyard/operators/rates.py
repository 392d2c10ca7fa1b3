"""Success and risk rates with shrinkage, blocked pairs and sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.operators.ordered import running
from switchyard.sources.shared import written

CELL = ("rpgt", "currency", "bank")


def decay_weight(day: Column, latest: Column, half_life: float) -> Column:
    """``0.5 ** (age / half_life)``; an unreadable date weighs nothing."""
    return F.coalesce(F.pow(F.lit(0.5), F.datediff(latest, day) / F.lit(half_life)), F.lit(0.0))


def tallied(attempts: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(keys, n, s): attempts and successes, plain or weighted."""
    w = F.lit(1.0) if weight is None else weight
    return attempts.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(F.when(F.col("success"), w).otherwise(0.0)).alias("s"))


def moment_kappa(cells: DataFrame, group: Sequence[str], fallback: float, edge: float | None = None, low: float = 1.0, high: float = 5000.0, least: float = 1e-9) -> DataFrame:
    """Method-of-moments strength of the prior for each ``group`` of rows (n, s).

    The variance between rows beyond binomial noise gives mu(1-mu)/variance - 1, kept within [low, high].  Fewer than two
    rows give ``fallback``; a mean of 0 or 1 gives ``edge`` (``fallback`` if None); a variance of about 0 gives ``high``.
    """
    rate = F.col("s") / F.col("n")
    sums = cells.where("n > 0").groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * rate * rate).alias("q"))
    mu = F.col("s") / F.col("n")
    noise = mu * (1 - mu) * F.col("k") / F.col("n")
    excess = F.greatest(F.col("q") / F.col("n") - mu * mu, F.lit(0.0)) - noise
    kappa = F.when(F.col("k") < 2, F.lit(fallback)).when((mu <= 0) | (mu >= 1), F.lit(fallback if edge is None else edge)).when(excess <= least, F.lit(high)).otherwise(F.least(F.greatest(mu * (1 - mu) / excess - 1, F.lit(low)), F.lit(high)))
    return sums.select(*group, mu.alias("mu"), kappa.alias("kappa"))


def within_kappa(cells: DataFrame, scope: Sequence[str], within: Sequence[str] = ("bank",), fallback: float = 50.0, high: float = 5000.0) -> DataFrame:
    """(scope, mu, kappa): ``moment_kappa`` of the spread between the rows of one ``within`` (bank), pooled over the scope by attempts.

    So differences between banks do not count as differences between gateways.  Banks with one row tell nothing; a scope
    without others, or of mean 0 or 1, has ``fallback``; no spread beyond binomial noise gives ``high``.
    """
    rate = F.col("s") / F.col("n")
    banks = cells.where("n > 0").groupBy(*scope, *[c for c in within if c not in scope]).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * rate * rate).alias("q"))
    own = F.col("s") / F.col("n")
    spread = F.greatest(F.col("q") - F.col("n") * own * own, F.lit(0.0)) - own * (1 - own) * F.col("k")  # times the attempts
    able = F.col("k") >= 2
    sums = banks.groupBy(*scope).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.when(able, F.col("n"))).alias("w"), F.sum(F.when(able, spread)).alias("x"))
    mu, excess = F.col("s") / F.col("n"), F.col("x") / F.col("w")
    kappa = F.when(F.col("w").isNull() | (mu <= 0) | (mu >= 1), F.lit(fallback)).when(excess <= 1e-9, F.lit(high)).otherwise(F.least(F.greatest(mu * (1 - mu) / excess - 1, F.lit(1.0)), F.lit(high)))
    return sums.select(*scope, mu.alias("mu"), kappa.alias("kappa"))


def shrunk_success(attempts: DataFrame, keys: Sequence[str] = (*CELL, "gateway"), scope: Sequence[str] = ("rpgt", "gateway"), kappa: float = 50.0) -> DataFrame:
    """Rate of each key drawn towards its scope's rate with ``kappa`` pseudo-attempts.

    The scope's rate is a window over the keys' tallies, so attempts are read and shuffled once.
    """
    return shrunk(tallied(attempts, keys), keys, scope, kappa)


def shrunk(cells: DataFrame, keys: Sequence[str] = (*CELL, "gateway"), scope: Sequence[str] = ("rpgt", "gateway"), kappa: float = 50.0) -> DataFrame:
    """``shrunk_success`` of tallies (keys, n, s)."""
    w = Window.partitionBy(*scope)
    out = cells.withColumn("prior_rate", F.sum("s").over(w) / F.sum("n").over(w))
    return out.select(*keys, F.col("n").cast("long").alias("attempts"), F.col("s").cast("long").alias("success"), F.least(F.col("s") / F.col("n"), F.lit(1.0)).alias("raw_rate"), "prior_rate", ((F.col("s") + kappa * F.col("prior_rate")) / (F.col("n") + kappa)).alias("success_rate"))


def backed_off(cells: DataFrame, levels: Sequence[Sequence[str]], kappa: float) -> DataFrame:
    """Rate shrunk through ever finer ``levels``: each level's rate is drawn towards the one above; ``levels[0]`` may be empty (all rows)."""
    above: DataFrame | None = None
    cells = written(cells, "tallies")  # each level is made of it; its size follows the keys
    for keys in levels:
        sums = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        if above is None:
            above = sums.select(*keys, (F.col("s") / F.col("n")).alias("rate"))
            upper: Sequence[str] = keys
            continue
        joined = sums.join(above, list(upper)) if upper else sums.join(F.broadcast(above))  # one row
        above, upper = joined.select(*keys, ((F.col("s") + kappa * F.col("rate")) / (F.col("n") + kappa)).alias("rate")), keys
    return above


def refitted(cells: DataFrame, levels: Sequence[Sequence[str]], fallback: float = 50.0, high: float = 5000.0) -> DataFrame:
    """``cells`` (keys, n, s) with ``rate``: from the rate of all rows through ``levels``, each drawing its groups' pooled rate towards the cell's estimate so far.

    A level's strength is fitted to the spread of its own groups' rates beyond binomial noise; levels need not be nested.
    """
    cells = written(cells, "tallies")  # each level is made of it; its size follows the keys
    whole = cells.agg((F.sum("s") / F.sum("n")).alias("rate"))  # one row
    out = cells.join(F.broadcast(whole))
    for keys in levels:
        sums = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        kappa = F.broadcast(moment_kappa(sums, [], fallback, edge=high, high=high, least=1e-12).select("kappa"))  # one row
        level = sums.select(*keys, F.col("n").alias("_n"), F.col("s").alias("_s"))
        out = out.join(level, list(keys)).join(kappa).withColumn("rate", (F.col("_s") + F.col("kappa") * F.col("rate")) / (F.col("_n") + F.col("kappa"))).drop("_n", "_s", "kappa")
    return out


def blocked_pairs(daily: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Pairs whose attempts since the last success number ``least`` or more: attempts in that run and the last day with a success."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    seen = daily.withColumn("_any", F.max((F.col("s") > 0).cast("int")).over(newest))
    run = F.sum(F.when(F.col("_any") == 0, F.col("n")).otherwise(0))
    return seen.groupBy(*keys).agg(run.cast("long").alias("run_attempts"), F.max(F.when(F.col("s") > 0, F.col("day"))).alias("last_success")).where(F.col("run_attempts") >= least)


def blocked_capped(split: DataFrame, cell: Sequence[str], cap: float) -> DataFrame:
    """Shares of blocked gateways cut to ``cap``; the excess goes to the cell's other gateways in proportion.  Cells without a recipient stay."""
    w = Window.partitionBy(*cell)
    cut = F.when(F.col("blocked"), F.greatest(F.col("share") - cap, F.lit(0.0))).otherwise(0.0)
    open_ = F.sum(F.when(~F.col("blocked"), F.col("share")).otherwise(0.0)).over(w)
    new = F.when(open_ <= 0, F.col("share")).when(F.col("blocked"), F.col("share") - F.col("_cut")).otherwise(F.col("share") + F.sum("_cut").over(w) * F.col("share") / open_)
    return split.withColumn("_cut", cut).withColumn("share", new).drop("_cut")


def sensitivity(rates: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """By rpgt: best less worst rate of cells with two gateways or more, weighted by attempts."""
    gaps = rates.groupBy(*cell).agg(F.count_distinct("gateway").alias("k"), (F.max("success_rate") - F.min("success_rate")).alias("gap"), F.sum("attempts").alias("n")).where("k >= 2")
    return gaps.groupBy("rpgt").agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("sensitivity"), F.count(F.lit(1)).alias("cells"))


def pooled_risk(cells: DataFrame, pool: Sequence[str], pseudo: float = 500.0) -> DataFrame:
    """Risk per sale, drawn to the pool's rate with ``pseudo`` sales.  Columns txn and risk."""
    w = Window.partitionBy(*pool)
    pooled = F.sum("risk").over(w) / F.sum("txn").over(w)
    return cells.withColumn("risk_rate", (F.col("risk") + pseudo * pooled) / (F.col("txn") + pseudo))


def gap_z(rates: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Gap of a cell's two best gateways over its standard error."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("success_rate"), "gateway"))
    var = F.col("success_rate") * (1 - F.col("success_rate")) / F.col("attempts")
    two = rates.withColumn("_r", rank).where("_r <= 2").withColumn("_v", var).groupBy(*cell).agg(
        F.max(F.when(F.col("_r") == 1, F.col("success_rate"))).alias("best"), F.max(F.when(F.col("_r") == 2, F.col("success_rate"))).alias("second"), F.sum("_v").alias("v"))
    return two.where("second is not null").select(*cell, (F.col("best") - F.col("second")).alias("gap"), F.try_divide(F.col("best") - F.col("second"), F.sqrt("v")).alias("z"))


def temperatures(rates: DataFrame, cell: Sequence[str], anchor: float = 0.17, ceiling: float = 0.30, most: float = 500.0) -> DataFrame:
    """(cell, z, temperature): how sharply a cell may prefer its best gateway, by how sure the gap of its two best is.

    ``rates``: cell, gateway, success_rate, attempts.  z is the gap over its standard error on at most ``most`` attempts, at least 0, and
    null where fewer than two gateways have attempts.  Temperatures are in proportion to z, so that the median cell's is ``anchor``,
    up to ``ceiling``; cells without z, and all where the median is about 0, have ``anchor``.
    """
    p = F.least(F.greatest(F.coalesce("success_rate", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    used = rates.withColumn("_p", F.when(F.col("attempts") > 0, p)).withColumn("_v", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-9)) / F.least("attempts", F.lit(most)))
    two = used.withColumn("_k", F.row_number().over(Window.partitionBy(*cell).orderBy(F.col("_p").desc_nulls_last(), "gateway"))).where("_k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    each = two.groupBy(*cell).agg((pick(1, "_p") - pick(2, "_p")).alias("_gap"), (pick(1, "_v") + pick(2, "_v")).alias("_var"))
    each = written(each.select(*cell, F.greatest(F.col("_gap") / F.sqrt("_var"), F.lit(0.0)).alias("z")), "gaps")
    ranked = running(each.where("z is not null").select("z"), ["z"])
    n = each.where("z is not null").count()
    median = (ranked.where(F.col("row").isin((n + 1) // 2, n // 2 + 1)).agg(F.avg("z")).first()[0] or 0.0) if n else 0.0
    scaled = F.least(F.col("z") * (anchor / median), F.lit(ceiling)) if median > 1e-9 else F.lit(anchor)
    return each.withColumn("temperature", F.coalesce(F.when(F.col("z").isNotNull(), scaled), F.lit(anchor)))
