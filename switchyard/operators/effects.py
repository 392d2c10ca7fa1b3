"""Effects of a split down to sub-cells: share caps, back-fill, timing, evaluation and revenue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import share_of
from switchyard.operators.relational import with_fallback, without_covered

DUST = 1e-12


def _by_cell(split: DataFrame, cell: Sequence[str], sweep, sweeps: int) -> DataFrame:  # noqa: ANN001
    """Shares of each cell, as one short array, put through ``sweep`` up to ``sweeps`` times; other columns stay."""
    others = [c for c in split.columns if c not in cell and c != "gateway"]
    rows = F.array_sort(F.collect_list(F.struct("gateway", *others)))  # a cell's gateways: tens
    x = split.groupBy(*cell).agg(rows.alias("_g")).withColumn("_w", F.transform("_g", lambda g: g["share"]))
    x = x.withColumn("_w", F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), F.col("_w"), lambda w, _: sweep(w)))
    each = x.select(*cell, F.explode(F.arrays_zip("_g", "_w")).alias("_z")).withColumn("share", F.col("_z._w"))
    return each.select(*[c if c in cell or c == "share" else F.col(f"_z._g.{c}").alias(c) for c in split.columns])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def water_filled(split: DataFrame, cell: Sequence[str], cap: float, sweeps: int = 8) -> DataFrame:
    """No share above ``cap``: the excess goes to the cell's other used gateways in proportion to their room.

    Cells with fewer than two used gateways stay.  One sweep leaves nothing over unless the room is too small, as when
    ``cap`` times the used gateways is under 1; then all stand at the cap.
    """

    def sweep(w: Column) -> Column:
        excess = _total(F.transform(w, lambda x: F.greatest(x - cap, F.lit(0.0))))
        room = lambda x: F.when((x > DUST) & (x < cap - DUST), cap - x).otherwise(0.0)
        space = _total(F.transform(w, room))
        filled = F.transform(w, lambda x: F.when(x > cap, F.lit(cap)).otherwise(x + F.when(space > DUST, room(x) / space * F.least(excess, space)).otherwise(0.0)))
        return F.when((F.size(F.filter(w, lambda x: x > DUST)) >= 2) & (excess > DUST), filled).otherwise(w)

    return _by_cell(split, cell, sweep, sweeps)


def respilled(split: DataFrame, cell: Sequence[str], cap: float, sweeps: int = 12) -> DataFrame:
    """Cap with the excess handed to gateways below it in proportion to their shares, again and again; unused ones take part evenly where no other can."""

    def sweep(w: Column) -> Column:
        excess = _total(F.transform(w, lambda x: F.greatest(x - cap, F.lit(0.0))))
        below = _total(F.transform(w, lambda x: F.when(x <= cap, x).otherwise(0.0)))
        open_ = F.size(F.filter(w, lambda x: x <= cap))
        given = lambda x: F.when(below > 0, excess * x / below).otherwise(excess / open_)
        return F.when((excess > DUST) & (open_ > 0), F.transform(w, lambda x: F.when(x > cap, F.lit(cap)).otherwise(x + given(x)))).otherwise(w)

    return _by_cell(split, cell, sweep, sweeps)


def volume_capped(split: DataFrame, cell: Sequence[str], limits: DataFrame, most: float = 1.0) -> DataFrame:
    """MIDs kept to ``limit`` times their baseline volume: their shares shrink by one factor, and each cell's freed share goes to its other gateways, the least risky first, up to ``most``.

    ``split``: cell, gateway, mid, volume (of the cell), baseline_share, share, risk_rate; ``limits``: mid, limit.  All MIDs are
    measured before any is cut; what no gateway can take is spread by normalising.
    """
    v = F.col("volume")
    mids = split.groupBy("mid").agg(F.sum(v * F.col("baseline_share")).alias("_b"), F.sum(v * F.col("share")).alias("_p")).join(limits, "mid")
    over = mids.where((F.col("_b") > DUST) & (F.col("_p") > F.col("limit") * F.col("_b") + 1e-9)).select("mid", (F.col("limit") * F.col("_b") / F.col("_p")).alias("_f"))
    cut = split.join(over, "mid", "left").withColumn("_s", F.col("share") * F.coalesce("_f", F.lit(1.0)))
    w = Window.partitionBy(*cell)
    freed = F.sum(F.col("share") - F.col("_s")).over(w)
    room = F.when(F.col("_f").isNull(), F.greatest(most - F.col("_s"), F.lit(0.0))).otherwise(0.0)
    order = w.orderBy("risk_rate", "gateway").rowsBetween(Window.unboundedPreceding, -1)
    ready = cut.withColumn("_freed", freed).withColumn("_room", room).withColumn("_before", F.coalesce(F.sum("_room").over(order), F.lit(0.0)))
    taken = F.greatest(F.least(F.col("_room"), F.col("_freed") - F.col("_before")), F.lit(0.0))
    return ready.withColumn("share", F.col("_s") + taken).withColumn("share", share_of("share", cell, "keep")).drop("_f", "_s", "_freed", "_room", "_before")


def catch_all_blended(specific: DataFrame, catch_all: DataFrame, cell: Sequence[str]) -> DataFrame:
    """(cell, gateway, share): a cell with a positive specific share keeps those, normalised; only others take the catch-all's."""
    own, general = (f.where("share > 0").select(*cell, "gateway", "share") for f in (specific, catch_all))
    return own.unionByName(without_covered(general, own, cell)).withColumn("share", share_of("share", cell))


def wallet_segmented(split: DataFrame, incapable: Sequence[str], fractions: DataFrame, keys: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Each cell as two segments: ``non_wallet`` with its shares, ``wallet`` without incapable gateways, normalised (kept where none is left).

    The cell's volume is divided by its wallet fraction (``fractions``: keys, fraction; missing is 0).
    """
    if not incapable:
        return split.withColumn("segment", F.lit("all"))
    part = F.least(F.greatest(F.coalesce("fraction", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    both = split.join(fractions, list(keys), "left").withColumn("segment", F.explode(F.array(F.lit("non_wallet"), F.lit("wallet"))))
    wallet = F.col("segment") == "wallet"
    able = both.withColumn("_able", F.when(wallet & F.lower(F.trim("gateway")).isin(*[g.lower() for g in incapable]), 0.0).otherwise(F.col("share")))
    total = F.sum("_able").over(Window.partitionBy(*cell, "segment"))
    share = F.when(wallet & (total > 0), F.col("_able") / total).otherwise(F.col("share"))
    return able.withColumn("_share", share).withColumn("volume", F.col("volume") * F.when(wallet, part).otherwise(1 - part)).withColumn("share", F.col("_share")).drop("fraction", "_able", "_share")


def back_filled(rows: DataFrame, shares: DataFrame, cell: Sequence[str]) -> DataFrame:
    """``rows`` with zero rows at age 0, for every period of the cell, for MIDs that ``shares`` routes to and the cell lacks at age 0.

    Only cells that have an age-0 row are filled.  The timing columns come from the cell's youngest row of the period.
    """
    zero = rows.where("t = 0")
    missing = shares.select(*cell, "mid").distinct().join(zero.select(*cell).distinct(), list(cell), "left_semi").join(zero.select(*cell, "mid").distinct(), [*cell, "mid"], "left_anti")
    timing = rows.groupBy(*cell, "period").agg(F.min_by(F.struct("pro_rata", "fcp1_frac"), F.struct("t", "mid")).alias("_x"))
    filled = missing.join(timing, list(cell)).select(*cell, "mid", "period", F.lit(0).alias("t"), F.lit(0.0).alias("risk"), F.lit(0.0).alias("txn"), "_x.pro_rata", "_x.fcp1_frac")
    return rows.select(*filled.columns).unionByName(filled)


def granular_projection(rows: DataFrame, shares: DataFrame, cell: Sequence[str], cap: float = 1.0, floor: float = 0.0) -> DataFrame:
    """Before and after by (cell, mid, period, t): risk_pre, risk_post, txn_pre, txn_post.

    ``rows``: cell, mid, period, t, risk, txn, pro_rata, fcp1_frac; ``shares``: cell, mid, prop (any scale).
    Transactions: a cell's movable part (pro_rata times fcp1_frac) goes by the proposed shares, capped and floored.  Risk: a row moves by
    the fraction of the cohort's own month, its timing by the month it appears in, to MIDs that carried risk in the
    cohort's month; a group without such a MID stays.  What moves in equals what moves out, in every period.
    """
    full = back_filled(rows, shares, cell)
    group = [*cell, "period"]
    w = Window.partitionBy(*group)
    zero = full.where("t = 0").join(shares, [*cell, "mid"], "left").withColumn("prop", F.coalesce("prop", F.lit(0.0)))
    zero = zero.withColumn("psum", F.sum("prop").over(w)).withColumn("share", F.when(F.col("psum") > 0, F.col("prop") / F.col("psum")).otherwise(0.0))
    if floor > 0:
        least = F.when((F.col("prop") > 0), F.greatest("share", F.lit(floor))).otherwise(F.col("share"))
        zero = zero.withColumn("_l", least).withColumn("share", share_of("_l", group)).drop("_l")
    if cap < 1:
        zero = water_filled(zero.withColumnRenamed("mid", "gateway"), group, cap).withColumnRenamed("gateway", "mid")
    total, mv = F.sum("txn").over(w), F.col("pro_rata") * F.col("fcp1_frac")
    zero = zero.withColumn("total", total).withColumn("pool", F.sum(F.col("txn") * mv).over(w))
    post = F.when((F.col("psum") > 0) & (F.col("total") > 0), F.col("txn") * (1 - mv) + F.col("pool") * F.col("share")).otherwise(F.col("txn"))
    carries = F.when(F.col("risk") > 0, F.col("prop")).otherwise(0.0)
    zero = zero.withColumn("txn_post", post).withColumn("_c", carries).withColumn("to", share_of("_c", group))
    zero = zero.withColumn("part", F.when(F.col("psum") > 0, F.col("fcp1_frac")).otherwise(0.0))

    origin = zero.select(*cell, "mid", F.col("period").alias("origin"), "part", "to")
    timing = zero.groupBy(*group).agg(F.min_by("pro_rata", "mid").alias("timing"))
    aged = full.withColumn("origin", (F.col("period") - F.col("t")).cast("int")).join(origin, [*cell, "mid", "origin"], "left").join(timing, group, "left").join(zero.select(*group, "mid", "txn_post"), [*group, "mid"], "left")
    v = Window.partitionBy(*group, "t")
    can = aged.withColumn("to", F.coalesce("to", F.lit(0.0))).withColumn("tsum", F.sum("to").over(v))
    move = F.when((F.col("origin") >= 0) & (F.col("tsum") > DUST), F.coalesce("part", F.lit(0.0)) * F.coalesce("timing", F.lit(0.0))).otherwise(0.0)
    moved = can.withColumn("move", move).withColumn("in", F.sum(F.col("risk") * F.col("move")).over(v))
    risk = F.col("risk") * (1 - F.col("move")) + F.when(F.col("tsum") > DUST, F.col("in") * F.col("to") / F.col("tsum")).otherwise(0.0)
    sale = F.col("t") == 0
    return moved.select(*cell, "mid", "period", "t", F.col("risk").alias("risk_pre"), risk.alias("risk_post"), F.when(sale, F.col("txn")).otherwise(0.0).alias("txn_pre"), F.when(sale, F.coalesce("txn_post", F.lit(0.0))).otherwise(0.0).alias("txn_post"))


def conserved(projection: DataFrame) -> DataFrame:
    """(period, risk_gap, txn_gap): how far the totals after are from those before, relative to at least 1."""
    gap = lambda c: (F.abs(F.sum(f"{c}_post") - F.sum(f"{c}_pre")) / F.greatest(F.abs(F.sum(f"{c}_pre")), F.lit(1.0))).alias(f"{c}_gap")
    return projection.groupBy("period").agg(gap("risk"), gap("txn"))


def by_month(projection: DataFrame, months: Sequence[int] = range(6)) -> DataFrame:
    """One row for each MID with risk and transactions, before and after, of every month; months without rows are 0."""
    names = ("risk_pre", "risk_post", "txn_pre", "txn_post")
    wide = projection.groupBy("mid").pivot("period", list(months)).agg(*[F.sum(c).alias(c) for c in names])
    return wide.select("mid", *[F.coalesce(F.col(f"{m}_{c}"), F.lit(0.0)).alias(f"{c}_m{m}") for m in months for c in names])


def eligible_fraction(volume: DataFrame, cell: Sequence[str], restricted: Sequence[str], value: str = "n") -> DataFrame:
    """(cell, fcp1_frac): share of a cell's volume that may move: first payments, and first attempts only where the type is restricted; 1 for an empty cell."""
    ok = (F.col("fcp") == "1") & (~F.col("rpgt").isin(*restricted) | (F.col("attempt") == "1"))
    sums = volume.groupBy(*cell).agg(F.sum(value).alias("_n"), F.sum(F.when(ok, F.col(value)).otherwise(0)).alias("_e"))
    return sums.select(*cell, F.when(F.col("_n") > 0, F.least(F.greatest(F.col("_e") / F.col("_n"), F.lit(0.0)), F.lit(1.0))).otherwise(1.0).alias("fcp1_frac"))


def timed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` with pro_rata of the month they come from: (kind, origin, pro_rata) of ``starts``; 0 before month 0 and where unknown.  ``starts`` has a row for each kind and month."""
    joined = rows.withColumn("origin", (F.col("period") - F.col("t")).cast("int")).join(F.broadcast(starts), ["kind", "origin"], "left")
    return joined.withColumn("pro_rata", F.when(F.col("origin") < 0, 0.0).otherwise(F.coalesce("pro_rata", F.lit(0.0)))).drop("origin")


def started_fractions(go_live: Column, months: DataFrame, upto: DataFrame, weighted: str) -> DataFrame:
    """(kind, origin, pro_rata): part of each month (m, month_start) from ``go_live`` on, by days, and for the kind ``weighted`` by the days' weights (month, dom, upto)."""
    after = F.add_months("month_start", 1)
    days = F.datediff(after, F.col("month_start"))
    passed = F.greatest(F.least(F.datediff(go_live, F.col("month_start")), days), F.lit(0))
    each = months.withColumn("_passed", passed).withColumn("_days", days)
    joined = each.join(F.broadcast(upto), (F.month("month_start") == F.col("month")) & (F.col("_passed") + 1 == F.col("dom")), "left")
    linear = 1 - F.col("_passed") / F.col("_days")
    heavy = F.when(F.col("_passed") == 0, 1.0).when(F.col("_passed") >= F.col("_days"), 0.0).otherwise(1 - F.coalesce("upto", F.col("_passed") / F.col("_days")))
    kinds = F.array(F.struct(F.lit(weighted).alias("kind"), heavy.alias("pro_rata")), F.struct(F.lit("other").alias("kind"), linear.alias("pro_rata")))
    return joined.select(F.col("m").alias("origin"), F.explode(kinds).alias("x")).select("x.kind", "origin", "x.pro_rata")


def doomed(rows: DataFrame, dead: Column, keys: Sequence[str]) -> DataFrame:
    """Keys all of whose gateways are dead."""
    return rows.groupBy(*keys).agg(F.min(dead.cast("int")).alias("_d")).where("_d = 1").select(*keys)


def baseline(export: DataFrame, cell: Sequence[str], period: int = 0) -> DataFrame:
    """Baseline contract of an export (cell, gateway, period, txn, risk): volume, baseline_share and risk_rate of the period, deprecated gateway names merged, rows without volume left out."""
    from switchyard.functions.columns import canonical_gateway

    used = export.where((F.col("period") == period) & (F.col("txn") > 0)).withColumn("gateway", canonical_gateway(F.col("gateway")))
    sums = used.groupBy(*cell, "gateway").agg(F.sum("txn").alias("volume"), F.sum("risk").alias("_r"))
    return sums.withColumn("risk_rate", F.col("_r") / F.col("volume")).withColumn("baseline_share", share_of("volume", cell)).drop("_r")


def agreed(left: DataFrame, right: DataFrame, values: Sequence[str], relative: float = 0.005) -> DataFrame:
    """One row: totals of both tables and whether each pair agrees within ``relative`` (or 1)."""
    a = left.agg(*[F.sum(v).alias(f"{v}_left") for v in values])
    b = right.agg(*[F.sum(v).alias(f"{v}_right") for v in values])
    close = lambda v: (F.abs(F.col(f"{v}_left") - F.col(f"{v}_right")) <= F.greatest(F.lit(1.0), relative * F.abs(F.col(f"{v}_right")))).alias(f"{v}_agrees")
    return a.join(F.broadcast(b)).select("*", *[close(v) for v in values])  # one row each


def synthetic_baseline(rates: DataFrame, cell: Sequence[str], mean: float = 0.006, spread: float = 0.002) -> DataFrame:
    """A baseline from attempts alone: shares of attempts, and a risk rate drawn from a normal law by a hash of the key, so that it is the same every time; never below 0."""
    unit = lambda salt: (F.conv(F.substring(F.md5(F.concat_ws("|", *cell, "gateway", F.lit(salt))), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    normal = F.sqrt(-2 * F.log(unit("u"))) * F.cos(2 * F.pi() * unit("v"))
    return rates.withColumn("volume", F.col("attempts").cast("double")).withColumn("baseline_share", share_of("volume", cell)).withColumn("risk_rate", F.greatest(mean + spread * normal, F.lit(0.0)))


def evaluated(split: DataFrame, cells: DataFrame, gateways: DataFrame, cell: Sequence[str], ticket: float = 25.0) -> DataFrame:
    """Volume, attempts, successes and revenue of every cell and gateway before and after, with differences.

    ``split``: cell, gateway, volume (of the cell), baseline_share, share (normalised here); ``cells``: cell, attempts, success_rate, ticket;
    ``gateways``: cell, gateway, success_rate.  A gateway without a rate has its cell's; a cell without a ticket ``ticket``.
    """
    for c in ("share", "baseline_share"):
        split = split.withColumn(c, share_of(c, cell, "keep"))
    g = gateways.select(*cell, "gateway", F.col("success_rate").alias("_own"))
    x = split.join(cells.select(*cell, "attempts", F.col("success_rate").alias("_cell"), "ticket"), list(cell), "left").join(g, [*cell, "gateway"], "left")
    x = x.withColumn("rate", F.coalesce("_own", "_cell", F.lit(0.0))).withColumn("attempts", F.coalesce("attempts", F.lit(0)).cast("double")).withColumn("ticket", F.coalesce("ticket", F.lit(ticket)))
    for side, share in (("pre", "baseline_share"), ("post", "share")):
        x = x.withColumn(f"{side}_vol", F.col("volume") * F.col(share)).withColumn(f"{side}_succ", F.col("attempts") * F.col(share) * F.col("rate")).withColumn(f"{side}_rev", F.col(f"{side}_succ") * F.col("ticket"))
    return x.select(*cell, "gateway", "pre_vol", "post_vol", "pre_succ", "post_succ", "pre_rev", "post_rev", (F.col("post_vol") - F.col("pre_vol")).alias("vol_delta"), (F.col("post_rev") - F.col("pre_rev")).alias("rev_delta"), ((F.col("share") - F.col("baseline_share")) * 100).alias("share_delta_pp"))


def priced(projection: DataFrame, tickets: DataFrame, by_type: DataFrame) -> DataFrame:
    """Projection rows with ``ticket``: of type and currency, else the currency's mean ticket, else the type's, else the mean of all, else 0."""
    by_currency = tickets.groupBy("currency").agg(F.avg("ticket").alias("ticket"))
    mean = tickets.agg(F.avg("ticket").alias("_mean"))  # one row
    return with_fallback(projection.join(F.broadcast(mean)), [(tickets, ["rpgt", "currency"]), (by_currency, ["currency"]), (by_type, ["rpgt"])], "ticket", F.coalesce("_mean", F.lit(0.0)), "ticket").drop("_mean")


def feasible_first(objective: Column, violation: Column, tolerance: float = 1e-9) -> Column:
    """Sort key over all rows: feasible rows by objective, the best first; the others after the worst feasible, by violation."""
    ok = violation <= tolerance
    worst = F.min(F.when(ok, objective)).over(Window.partitionBy())
    return F.when(worst.isNull(), violation).when(ok, -objective).otherwise(violation - worst)
