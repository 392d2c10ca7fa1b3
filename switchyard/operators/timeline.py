"""Time-versioned routing rules: cleaning, stitching, validity within a month, and replay over volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import share_of
from switchyard.operators.relational import expanded, without_covered

FAR = "9999-12-31"


def cell_level_catch_all(rules: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Expanded rules go where their cell has a specific one; all other rules stay."""
    kind = F.col("rule_source")
    specific = rules.where(kind == "Specific")
    return rules.where(kind != "Expanded").unionByName(without_covered(rules.where(kind == "Expanded"), specific, cell))


def widened(rules: DataFrame, history: DataFrame, providers: Sequence[str], countries: Sequence[str], keys: Sequence[str] = ("rpgt", "currency", "provider", "country")) -> DataFrame:
    """Collective providers and countries to rows; rules for BIN ``other`` or ``all`` to every BIN in the history of their ``keys``, marked Expanded."""
    rows = expanded(expanded(rules, "provider", {"both": providers, "all": providers}), "country", {"both": countries, "all": countries})
    open_ = F.coalesce(F.lower(F.trim("bin")).isin("other", "all"), F.lit(False))
    known = history.select(*keys, F.col("bin").alias("_bin")).distinct()
    wide = rows.where(open_).join(known, list(keys)).withColumn("bin", F.col("_bin")).drop("_bin").withColumn("rule_source", F.lit("Expanded"))
    return rows.where(~open_).unionByName(wide)


def merged_histories(sheets: DataFrame, actuals: DataFrame, profile: Sequence[str], undated: str = "2020-01-01") -> DataFrame:
    """(profile, go_live, gateway, share, rule_source): rules of sheets, and what was routed (``Actuals``) before a profile's first sheet.

    Catch-all rules go where the profile has a specific one.  Rules without a date hold from ``undated``.  Of several rows of one
    profile, gateway and date the specific one counts, then the expanded one, then the largest share.
    """
    columns = [*profile, "go_live", "gateway", "share", "rule_source"]
    dated = lambda f: f.select(*columns).withColumn("go_live", F.coalesce("go_live", F.lit(undated).cast("date")))
    own = dated(cell_level_catch_all(sheets, profile))
    first = own.groupBy(*profile).agg(F.min("go_live").alias("_first"))
    before = dated(actuals).join(first, list(profile), "left").where(F.col("_first").isNull() | (F.col("go_live") < F.col("_first"))).drop("_first")
    rank = F.when(F.col("rule_source") == "Specific", 0).when(F.col("rule_source") == "Expanded", 1).otherwise(2)
    best = F.min_by(F.struct("share", "rule_source"), F.struct(rank, -F.col("share")))
    return own.unionByName(before).groupBy(*profile, "go_live", "gateway").agg(best.alias("_x")).select(*profile, "go_live", "gateway", "_x.share", "_x.rule_source")


def snapshot_shares(rules: DataFrame, profile: Sequence[str]) -> DataFrame:
    """Shares added up by profile, date and gateway, then normalised within profile and date; 0 if they total 0."""
    sums = rules.groupBy(*profile, "go_live", "gateway").agg(F.sum("share").alias("share"))
    return sums.withColumn("share", share_of("share", [*profile, "go_live"]))


def stitched(snapshots: DataFrame, profile: Sequence[str]) -> DataFrame:
    """Each snapshot valid until the profile's next date.  The lead runs over distinct dates, so gateways of one date share their end."""
    dates = snapshots.select(*profile, "go_live").distinct()
    until = F.coalesce(F.lead("go_live").over(Window.partitionBy(*profile).orderBy("go_live")), F.lit(FAR).cast("date"))
    return snapshots.join(dates.withColumn("until", until), [*profile, "go_live"])


def with_kills(snapshots: DataFrame, kills: DataFrame, profile: Sequence[str]) -> DataFrame:
    """Snapshots with gateways switched off.  ``kills``: gateway, kill_date (NULL: at once); one date for each gateway, the earliest.

    At a kill date every profile that routes to the gateway then gets a copy of its valid snapshot; in all snapshots from
    that date on the gateway's share is 0.
    """
    dead = kills.groupBy("gateway").agg(F.min(F.coalesce("kill_date", F.lit("1900-01-01").cast("date"))).alias("dead_from"))
    timeline = stitched(snapshots, profile)
    hit = timeline.join(F.broadcast(dead), "gateway").where((F.col("dead_from") > F.col("go_live")) & (F.col("dead_from") < F.col("until")))  # a list of gateways
    breaks = hit.select(*profile, "go_live", F.col("dead_from").alias("new_live")).distinct()
    copies = timeline.join(breaks, [*profile, "go_live"]).select(*profile, F.col("new_live").alias("go_live"), "gateway", "share")
    every = timeline.select(*profile, "go_live", "gateway", "share").unionByName(copies)
    out = every.join(F.broadcast(dead), "gateway", "left").withColumn("share", F.when(F.col("dead_from") <= F.col("go_live"), 0.0).otherwise(F.col("share"))).drop("dead_from")
    return snapshot_shares(out, profile)


def scoped_kills(snapshots: DataFrame, kills: DataFrame, profile: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(timeline of transactions, timeline of risk): ``with_kills`` for the kills of each.

    ``kills``: gateway, kill_date, scope: ``volume``, ``risk``, or ``both`` (null too); capitals do not matter.
    """
    scope = F.lower(F.coalesce("scope", F.lit("both")))
    some = lambda own: stitched(with_kills(snapshots, kills.where(scope.isin(own, "both")), profile), profile)
    return some("volume"), some("risk")


def month_fraction(start: Column, until: Column, month: Column) -> Column:
    """Part of the month that lies in [start, until), by days."""
    after = F.add_months(month, 1)
    days = F.datediff(F.least(until, after), F.greatest(start, month))
    return F.greatest(F.least(days / F.datediff(after, month), F.lit(1.0)), F.lit(0.0))


def cumulative_weights(weights: DataFrame) -> DataFrame:
    """(month, dom, upto): share of the month's weight before the day; even where the weights total 0."""
    w = Window.partitionBy("month")
    share = F.when(F.sum("w").over(w) > 0, F.col("w") / F.sum("w").over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w))
    shared = weights.select("month", "dom", share.alias("s"))
    return shared.select("month", "dom", F.coalesce(F.sum("s").over(w.orderBy("dom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("upto"))


def weighted_fraction(timeline: DataFrame, months: DataFrame, weights: DataFrame) -> DataFrame:
    """Timeline by month with ``w``, the weight of its valid days.  Weights are kept by month of the year (366 rows at most).

    A rule meets only the months its validity touches: the months are generated from its dates.
    """
    upto = cumulative_weights(weights)
    touched = overlapping(timeline, months)
    edges = touched.withColumn("_from", F.greatest("go_live", "month_start")).withColumn("_to", F.least("until", F.add_months("month_start", 1)))
    number = F.month("month_start")
    a = F.broadcast(upto.select(F.col("month").alias("_ma"), F.col("dom").alias("_da"), F.col("upto").alias("_wa")))
    b = F.broadcast(upto.select(F.col("month").alias("_mb"), F.col("dom").alias("_db"), F.col("upto").alias("_wb")))
    joined = edges.join(a, (number == F.col("_ma")) & (F.dayofmonth("_from") == F.col("_da")), "left").join(b, (number == F.col("_mb")) & (F.dayofmonth("_to") == F.col("_db")) & (F.col("_to") < F.add_months("month_start", 1)), "left")
    w = F.greatest(F.coalesce("_wb", F.lit(1.0)) - F.coalesce("_wa", F.lit(0.0)), F.lit(0.0))
    return joined.withColumn("w", w).drop("_ma", "_da", "_wa", "_mb", "_db", "_wb", "_from", "_to")


def overlapping(timeline: DataFrame, months: DataFrame) -> DataFrame:
    """Timeline rows with each forecast month (m, month_start) they touch; an equi-join on the month generated from the validity."""
    span = months.agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi"))
    bounded = timeline.join(F.broadcast(span))  # one row
    first, last = F.greatest(F.trunc("go_live", "month"), F.col("lo")), F.least(F.trunc(F.date_sub("until", 1), "month"), F.col("hi"))
    each = bounded.where(first <= last).withColumn("month_start", F.explode(F.sequence(first, last, F.expr("interval 1 month")))).drop("lo", "hi")
    return each.join(F.broadcast(months), "month_start")


def valid_weights(timeline: DataFrame, months: DataFrame) -> DataFrame:
    """(timeline, m, w): the linear part of each month in which a snapshot holds."""
    return overlapping(timeline, months).withColumn("w", month_fraction(F.col("go_live"), F.col("until"), F.col("month_start")))


def reroutable(rows: DataFrame, rules: DataFrame, profile: Sequence[str], restricted: Sequence[str]) -> Column | DataFrame:
    """Rows flagged ``movable``: first payment, a rule for the profile, and first attempt where the type is restricted."""
    have = rules.select(*profile).distinct().withColumn("_rule", F.lit(True))
    ok = (F.col("fcp") == "1") & F.col("_rule").isNotNull() & (~F.col("rpgt").isin(*restricted) | (F.col("attempt") == "1"))
    return rows.join(have, list(profile), "left").withColumn("movable", ok).drop("_rule")


def reallocated(volume: DataFrame, weights: DataFrame, profile: Sequence[str], before: bool = False, cohort: bool = False, gate: int | None = None, gated: float = 1.0) -> DataFrame:
    """Volume (profile, gateway, m, t, v) replayed over rule weights: destinations' moved volume and what stays at the source.

    Transactions move at age 0; risk moves only where t <= m.  ``before``: every month uses the weights of the month before
    month 0 (m = -1).  ``cohort``: risk uses the weights of the month its cohort was sold in, m - t.  Of risk older than
    ``gate`` months only the part ``gated`` moves.  Nothing is lost: moved plus staying equals the input.
    """
    keyed = volume.withColumn("_m", F.lit(-1) if before else F.col("m") - F.col("t") if cohort else F.col("m"))
    keyed = keyed.withColumn("_g", F.when(F.col("t") > gate, gated).otherwise(1.0) if gate is not None else F.lit(1.0))
    shares = weights.groupBy(*profile, F.col("m").alias("_m"), F.col("gateway").alias("_to")).agg(F.sum(F.col("w") * F.col("share")).alias("_part"))
    part = shares.groupBy(*profile, "_m").agg(F.sum("_part").alias("_total"))
    can = keyed.where(F.col("t") <= F.col("m"))
    moved = can.join(shares, [*profile, "_m"]).groupBy(*profile, F.col("_to").alias("gateway"), "m", "t").agg(F.sum(F.col("v") * F.col("_g") * F.col("_part")).alias("v"))
    stays = keyed.join(part, [*profile, "_m"], "left")
    left = stays.withColumn("v", F.when(F.col("t") <= F.col("m"), F.greatest(F.col("v") * (1 - F.col("_g") * F.coalesce("_total", F.lit(0.0))), F.lit(0.0))).otherwise(F.col("v")))
    return left.select(*profile, "gateway", "m", "t", "v").unionByName(moved).groupBy(*profile, "gateway", "m", "t").agg(F.sum("v").alias("v"))


def orphans_spread(volume: DataFrame, alive: Column, group: Sequence[str], value: str = "v") -> DataFrame:
    """Volume of dead gateways goes to the group's living ones in proportion, evenly where those have none; with none alive it stays, flagged ``stranded``."""
    w = Window.partitionBy(*group)
    flagged = volume.withColumn("_alive", alive)
    living, count = F.sum(F.when(F.col("_alive"), F.col(value)).otherwise(0.0)).over(w), F.sum(F.col("_alive").cast("int")).over(w)
    orphan = F.sum(F.when(~F.col("_alive"), F.col(value)).otherwise(0.0)).over(w)
    measured = flagged.select("*", living.alias("_living"), count.alias("_count"), orphan.alias("_orphan"))
    given = F.when(F.col("_living") > 0, F.col("_orphan") * F.col(value) / F.col("_living")).otherwise(F.col("_orphan") / F.col("_count"))
    new = F.when(F.col("_count") == 0, F.col(value)).when(F.col("_alive"), F.col(value) + given).otherwise(0.0)
    return measured.withColumn("stranded", F.col("_count") == 0).withColumn(value, new).drop("_alive", "_living", "_count", "_orphan")


def with_month_zero(after: DataFrame, volume: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``after`` (keys, m, t, v) with month 0 as it was in ``volume``: what has begun is not routed anew."""
    return after.where("m <> 0").select(*keys, "m", "t", "v").unionByName(volume.where("m = 0").groupBy(*keys, "m", "t").agg(F.sum("v").alias("v")))
