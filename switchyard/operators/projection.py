"""Sub-cells, eligibility, and the before/after effect of a split."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import finite, share_of
from switchyard.operators.ordered import running
from switchyard.sources.shared import written

WHOLE = "_all_"


def subcell_fractions(volume: DataFrame, cell: Sequence[str], sub: Sequence[str] = ("provider", "country")) -> DataFrame:
    """(cell, sub, frac): share of each sub-cell in the age-0 volume; a cell without any is one ``_all_`` row."""
    sums = volume.where("t = 0").groupBy(*cell, *sub).agg(F.sum("txn_count").alias("v"))
    total = F.sum("v").over(Window.partitionBy(*cell))
    shared = sums.select(*cell, *sub, "v", total.alias("total"))
    some = shared.where("total > 0").select(*cell, *sub, (F.col("v") / F.col("total")).alias("frac"))
    none = volume.select(*cell).distinct().join(some.select(*cell).distinct(), list(cell), "left_anti")
    return some.unionByName(none.select(*cell, *[F.lit(WHOLE).alias(s) for s in sub], F.lit(1.0).alias("frac")))


def apportioned(frame: DataFrame, fractions: DataFrame, cell: Sequence[str], value: str, sub: Sequence[str] = ("provider", "country")) -> DataFrame:
    """Cell rows to sub-cell rows: ``value`` apportioned, the rest copied; cells without fractions stay whole."""
    out = frame.join(fractions, list(cell), "left")
    return out.withColumns({**{s: F.coalesce(s, F.lit(WHOLE)) for s in sub}, value: F.col(value) * F.coalesce("frac", F.lit(1.0))}).drop("frac")


def ban_predicate(rules: Sequence[Mapping[str, str]], columns: Sequence[str]) -> Column:
    """Rows that some rule bans: all its fields match, ``bin`` standing for ``bank``; a rule on an absent field bans nothing."""
    out = F.lit(False)
    for rule in rules:
        named = {("bank" if k == "bin" and "bin" not in columns else k): v for k, v in rule.items()}
        if not set(named) <= set(columns):
            continue
        hit = F.lit(True)
        for column, value in named.items():
            hit = hit & (F.lower(F.trim(column)) == value.strip().lower())
        out = out | F.coalesce(hit, F.lit(False))
    return out


def banned_out(split: DataFrame, ban: Column, cell: Sequence[str]) -> DataFrame:
    """Banned shares to 0 and the rest normalised; a cell left with nothing keeps its zeros."""
    return split.withColumn("share", F.when(ban, 0.0).otherwise(F.col("share"))).withColumn("share", share_of("share", cell, "keep"))


def capability_blend(split: DataFrame, cell: Sequence[str], wallet_fraction: str = "wallet_fraction", capable: str = "capable") -> DataFrame:
    """Share = fraction x (share among wallet-capable gateways) + (1 - fraction) x share; a cell without a capable gateway keeps its shares."""
    able = F.sum(F.when(F.col(capable), F.col("share")).otherwise(0.0)).over(Window.partitionBy(*cell))
    mine = F.when(F.col(capable), F.col("share")).otherwise(0.0) / able
    return split.withColumn("share", F.when(able > 0, F.col(wallet_fraction) * mine + (1 - F.col(wallet_fraction)) * F.col("share")).otherwise(F.col("share")))


def floored(split: DataFrame, cell: Sequence[str], masked: Column, floor: float) -> DataFrame:
    """Masked gateways get at least ``floor``, the others giving in proportion; a cell that cannot give stays."""
    w = Window.partitionBy(*cell)
    need = F.sum(F.when(masked, F.greatest(floor - F.col("share"), F.lit(0.0))).otherwise(0.0)).over(w)
    donors = F.sum(F.when(~masked, F.col("share")).otherwise(0.0)).over(w)
    new = F.when(masked, F.greatest("share", F.lit(floor))).otherwise(F.col("share") * (1 - need / donors))
    return split.withColumn("share", F.when((donors > 0) & (need <= donors), new).otherwise(F.col("share")))


def two_cohort(rows: DataFrame, split: DataFrame, group: Sequence[str]) -> DataFrame:
    """Projection of transactions: ``post = total * (base (1 - mv) + sum(base mv) * prop)``; held where the group has no proposed share.

    ``rows``: group, mid, txn, pro_rata, fcp1_frac; ``split``: group, mid, prop.
    """
    w = Window.partitionBy(*group)
    both = rows.join(split, [*group, "mid"], "left").withColumn("prop", F.coalesce("prop", F.lit(0.0))).withColumn("mv", F.col("pro_rata") * F.col("fcp1_frac"))
    total = F.sum("txn").over(w)
    based = both.withColumn("total", total).withColumn("base", finite(F.try_divide("txn", total))).withColumn("psum", F.sum("prop").over(w))
    pool = F.sum(F.col("base") * F.col("mv")).over(w)
    post = F.col("total") * (F.col("base") * (1 - F.col("mv")) + pool * F.col("prop") / F.col("psum"))
    return based.withColumn("post", F.when(F.col("psum") > 0, post).otherwise(F.col("txn"))).drop("psum")


def risk_projection(rows: DataFrame, shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Risk by (keys, mid, period, t): each row keeps ``1 - mv``; the pool moves by the origin cohort's proposed share among mids that carry risk.

    An aged row (period, t) belongs to the cohort of month period - t.  ``shares``: keys, mid, origin, prop.
    """
    w = Window.partitionBy(*keys, "period", "t")
    aged = rows.withColumn("origin", F.col("period") - F.col("t")).join(shares, [*keys, "mid", "origin"], "left")
    aged = aged.withColumn("mv", F.col("pro_rata") * F.col("fcp1_frac")).withColumn("p", F.when(F.col("risk") > 0, F.coalesce("prop", F.lit(0.0))).otherwise(0.0))
    psum, pool = F.sum("p").over(w), F.sum(F.col("risk") * F.col("mv")).over(w)
    post = F.col("risk") * (1 - F.col("mv")) + pool * F.col("p") / psum
    return aged.withColumn("post_risk", F.when(psum > 0, post).otherwise(F.col("risk"))).drop("p", "mv", "origin", "prop")


def keep_fraction(gateways: DataFrame, months: DataFrame) -> DataFrame:
    """(mid, m, keep): part of each month that a MID is open; a MID closes with its last gateway.  ``gateways``: mid, gateway, off_date (NULL: open)."""
    closed = gateways.groupBy("mid").agg(F.sum(F.col("off_date").isNull().cast("int")).alias("open"), F.max("off_date").alias("off"))
    each = closed.join(F.broadcast(months))  # a few months for each MID
    after = F.add_months("month_start", 1)
    part = F.datediff(F.least(F.greatest("off", "month_start"), after), F.col("month_start")) / F.datediff(after, F.col("month_start"))
    return each.select("mid", "m", F.when(F.col("open") > 0, 1.0).otherwise(part).alias("keep"))


def band_penalty(value: Column, floor: Column, ceiling: Column, priority: Column, fixed: float = 1.0, scale: float = 10.0, steep: bool = False) -> Column:
    """Priority-weighted penalty of a value outside its band: a fixed hit plus the squared (or exponential) relative breach; dust is ignored."""
    over = F.greatest((value - ceiling) / F.greatest(F.abs(ceiling), F.lit(1e-9)), F.lit(0.0))
    under = F.greatest((floor - value) / F.greatest(F.abs(floor), F.lit(1e-9)), F.lit(0.0))
    breach = F.greatest(F.coalesce(over, F.lit(0.0)), F.coalesce(under, F.lit(0.0)))
    size = F.exp(F.least(scale * breach, F.lit(50.0))) - 1 if steep else scale * breach * breach
    return F.when(breach > 1e-9, priority * (fixed + size)).otherwise(0.0)


def impact(split: DataFrame, cell: Sequence[str]) -> DataFrame:
    """By cell: baseline and proposed success and risk, volume, and share moved.  ``split``: cell, gateway, volume (of the cell), baseline_share, share, success_rate, risk_rate."""
    s = lambda share, rate: F.sum(F.col(share) * F.col(rate))
    return split.groupBy(*cell).agg(
        F.max("volume").alias("volume"), s("baseline_share", "success_rate").alias("base_success"), s("share", "success_rate").alias("new_success"),
        s("baseline_share", "risk_rate").alias("base_risk"), s("share", "risk_rate").alias("new_risk"), (F.sum(F.abs(F.col("share") - F.col("baseline_share"))) / 2).alias("moved"),
    )


def headline(cells: DataFrame) -> DataFrame:
    """One row: volume-weighted success and risk before and after, and the share of volume moved."""
    v = F.greatest(F.sum("volume"), F.lit(1.0))
    mean = lambda c: (F.sum(F.col("volume") * F.col(c)) / v).alias(c)
    return cells.agg(*[mean(c) for c in ("base_success", "new_success", "base_risk", "new_risk", "moved")])


def leaned(split: DataFrame, cell: Sequence[str], gamma: float) -> DataFrame:
    """Shares times exp(-gamma z), normalised within the cell; z is the risk rate standardised over all eligible rows, 0 for the others.

    ``split``: cell, gateway, share, risk_rate, eligible.  A ``gamma`` of 0 or less, or no spread, changes nothing but the sum.
    """
    if gamma <= 0:
        return split
    able = F.when(F.col("eligible"), F.col("risk_rate"))
    whole = F.broadcast(split.agg(F.avg(able).alias("_mean"), F.stddev_pop(able).alias("_sd")))  # one row
    z = F.when(F.col("eligible") & (F.col("_sd") > 1e-12), (F.col("risk_rate") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    w = split.join(whole).withColumn("_w", F.col("share") * F.exp(-gamma * z))
    total = F.sum("_w").over(Window.partitionBy(*cell))
    return w.withColumn("share", F.col("_w") / F.when(total > 1e-12, total).otherwise(1.0)).drop("_mean", "_sd", "_w")


def live_fraction(go_live: datetime.date, month0: datetime.date, month: Column) -> Column:
    """Part of month ``month`` (from month 0) after ``go_live``, by days; nothing before month 0."""
    start = F.add_months(F.lit(month0), month)
    after = F.add_months(start, F.lit(1))
    days = F.datediff(after, start)
    part = F.least(F.greatest(F.datediff(after, F.lit(go_live)) / days, F.lit(0.0)), F.lit(1.0))
    return F.when(month < 0, 0.0).otherwise(part)


def linear_projection(rows: DataFrame, shares: DataFrame, cell: Sequence[str], go_live: datetime.date, month0: datetime.date, keep: DataFrame) -> DataFrame:
    """(cell, mid, period, t, risk_pre, risk_post, txn_pre, txn_post) where a split moves all volume from ``go_live`` on, without a ramp or first payments.

    ``rows``: cell, mid, period, t, risk, txn; ``shares``: cell, mid, prop (any scale); ``keep``: mid, period, keep, the part of a month that a MID is on (else 1).
    What a switched-off MID loses goes to the cell's others, before and after.  Risk follows the month in which it was sold, to
    MIDs that have any risk in the cell.
    """
    group = [*cell, "period"]
    w = Window.partitionBy(*group)
    own = shares.withColumn("prop", share_of("prop", cell, "keep"))
    sold = rows.groupBy(*group, "mid").agg(F.sum(F.when(F.col("t") == 0, F.col("txn"))).alias("pre")).where("pre is not null")
    risky = rows.groupBy(*cell, "mid").agg((F.sum("risk") > 0).alias("_risky"))
    t0 = sold.join(own, [*cell, "mid"], "left").join(keep.select("mid", "period", "keep"), ["mid", "period"], "left").join(risky, [*cell, "mid"])
    t0 = t0.withColumn("keep", F.coalesce("keep", F.lit(1.0))).withColumn("f", live_fraction(go_live, month0, F.col("period")))
    on = F.col("pre") * F.col("keep")
    t0 = t0.withColumn("base", F.when(F.sum(on).over(w) > 0, on / F.sum(on).over(w)).otherwise(0.0))
    t0 = t0.withColumn("_p", F.when(F.col("keep") > 0, F.coalesce("prop", F.lit(0.0)) * F.col("keep")).otherwise(0.0)).withColumn("_psum", F.sum("_p").over(w))
    t0 = t0.withColumn("to", F.when(F.col("_psum") > 0, F.col("_p") / F.col("_psum")).otherwise(F.col("base")))
    t0 = t0.withColumn("post", F.sum("pre").over(w) * ((1 - F.col("f")) * F.col("base") + F.col("f") * F.col("to")))
    t0 = t0.withColumn("move", F.when(F.col("_psum") > 0, F.col("f")).otherwise(0.0)).withColumn("_v", F.when(F.col("_risky"), F.col("to")).otherwise(0.0))
    t0 = t0.withColumn("share", F.when(F.sum("_v").over(w) > 0, F.col("_v") / F.sum("_v").over(w)).otherwise(0.0))
    t0 = written(t0.select(*group, "mid", "pre", "post", "move", "share"), "months")  # a row for each MID and month of a cell
    origin = t0.select(*cell, "mid", F.col("period").alias("_o"), "move", "share")
    aged = rows.withColumn("_o", F.col("period") - F.col("t")).join(origin, [*cell, "mid", "_o"], "left").withColumn("move", F.coalesce("move", F.lit(0.0)))
    whole = F.sum("risk").over(Window.partitionBy(*group, "t"))
    after = F.col("risk") * (1 - F.col("move")) + whole * F.col("move") * F.coalesce("share", F.lit(0.0))
    out = aged.withColumn("risk_post", after).join(t0.select(*group, "mid", "pre", "post"), [*group, "mid"], "left")
    sale = lambda c: F.when(F.col("t") == 0, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return out.select(*cell, "mid", "period", "t", F.col("risk").alias("risk_pre"), "risk_post", sale("pre").alias("txn_pre"), sale("post").alias("txn_post"))


def moved_by_dial(variations: DataFrame) -> DataFrame:
    """(dial, moved_pct): per cent of the reference's volume that other gateways carry at each dial; the reference is the highest.

    ``variations``: dial, gateway, volume (of the cell), share; any further key columns.
    """
    sums = variations.groupBy("dial", "gateway").agg(F.sum(F.coalesce("share", F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))).alias("_v"))
    sums = written(sums, "by-dial")  # a row for each dial and gateway
    top = sums.join(sums.agg(F.max("dial").alias("dial")), "dial").select("gateway", F.col("_v").alias("_ref"))
    whole = F.broadcast(top.agg(F.greatest(F.sum("_ref"), F.lit(1e-9)).alias("_all")))  # one row
    grid = sums.select("dial").distinct().join(F.broadcast(top.select("gateway").union(sums.select("gateway")).distinct()))  # dials by gateways, some hundred rows
    both = grid.join(sums, ["dial", "gateway"], "left").join(top, "gateway", "left").join(whole)
    gap = F.abs(F.coalesce("_v", F.lit(0.0)) - F.coalesce("_ref", F.lit(0.0)))
    return both.groupBy("dial").agg((50 * F.sum(gap) / F.max("_all")).alias("moved_pct"))


def moved_curve(cells: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Cells by volume moved, the most first, with running totals: (cell, row, moved_volume, moved_so_far, volume_so_far).

    ``cells``: cell, volume, moved (share).  Volumes are decimals of six places, so totals are exact.  Ties go by the cell.
    """
    exact = lambda c: F.round(c, 6).cast("decimal(28,6)")
    rows = cells.select(*cell, exact(F.col("volume")).alias("_volume"), exact(F.col("volume") * F.col("moved")).alias("moved_volume"))
    found = running(rows, ["-moved_volume", *cell], {"moved_so_far": "moved_volume", "volume_so_far": "_volume"})
    return found.select(*cell, "row", *[F.col(c).cast("double").alias(c) for c in ("moved_volume", "moved_so_far", "volume_so_far")])


def standardised(frame: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """z-score within ``group``, population deviation; about no spread gives 0."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(value).over(w)
    return frame.withColumn(out, F.when(sd > 1e-12, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def tilted(split: DataFrame, cell: Sequence[str], risk: float, revenue: float) -> DataFrame:
    """Reference shares times exp(-risk z_risk + revenue z_revenue), normalised within the cell."""
    return split.withColumn("_x", F.col("share") * F.exp(-risk * F.col("z_risk") + revenue * F.col("z_revenue"))).withColumn("share", share_of("_x", cell, "even")).drop("_x")
