"""The production template: a split expanded by country and payment provider, capped, and put on a grid whose rows sum to 100 per cent.

Long form throughout, one row for each sub-cell and gateway; ``wide`` makes the sheet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import share_of
from switchyard.operators.effects import water_filled
from switchyard.operators.ordered import running
from switchyard.sources.shared import written

# Countries and providers of the template, in its order.
COUNTRIES = ("USA", "Non-USA")
PROVIDERS = ("GOOGLEPAY", "APPLEPAY", "non_gp_ap")
WALLETS = ("GOOGLEPAY", "APPLEPAY")


def sub_cells(split: DataFrame, cell: Sequence[str], presence: DataFrame, keys: Sequence[str] = ("currency", "bank")) -> DataFrame:
    """Each cell's shares (normalised) once for each of its countries and for each provider.

    ``presence``: keys, usa, other (volumes).  A cell without a row there has both countries, one with two zeros ``Non-USA``.
    """
    base = split.groupBy(*cell, "gateway").agg(F.sum(F.coalesce("share", F.lit(0.0))).alias("share")).withColumn("share", share_of("share", cell))
    met = base.join(presence.select(*keys, "usa", "other"), list(keys), "left")
    some = lambda c, name: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    seen = F.concat(some("usa", COUNTRIES[0]), some("other", COUNTRIES[1]))
    both = F.array(*[F.lit(c) for c in COUNTRIES])
    countries = F.when(F.col("usa").isNull() & F.col("other").isNull(), both).when(F.size(seen) == 0, F.array(F.lit(COUNTRIES[1]))).otherwise(seen)
    return met.withColumn("country", F.explode(countries)).withColumn("provider", F.explode(F.array(*[F.lit(p) for p in PROVIDERS]))).drop("usa", "other")


def enabled(rows: DataFrame, cell: Sequence[str], usa_only: Sequence[str], incapable: Sequence[str]) -> DataFrame:
    """Gateways that cannot serve a sub-cell (``usa_only`` elsewhere, ``incapable`` for wallets) lose their share to the others; a sub-cell without any left has none."""
    name = F.lower(F.trim("gateway"))
    barred = ((F.col("country") != COUNTRIES[0]) & name.isin(*[g.lower() for g in usa_only])) | (F.col("provider").isin(*WALLETS) & name.isin(*[g.lower() for g in incapable]))
    return rows.withColumn("share", F.when(barred, 0.0).otherwise(F.col("share"))).withColumn("share", share_of("share", cell))


def apportioned(rows: DataFrame, cell: Sequence[str], cap: float = 0.97, grid: int = 10_000) -> DataFrame:
    """``rows`` with ``units`` of ``grid``, which sum to it in every cell that has a share, none over ``cap`` where a cell uses two gateways or more.

    Each share is rounded; what is lacking goes to the used gateways with room, the largest first, as far as it reaches; what
    is too much is taken in the same order.  Where all room is too small (``cap`` times the gateways is under 1) the largest takes
    the rest.
    """
    w = Window.partitionBy(*cell)
    used = F.col("_u") > 0
    rounded = rows.withColumn("_u", F.round(F.col("share") * grid).cast("long")).withColumn("_n", F.sum((F.col("share") > 1e-12).cast("int")).over(w))
    limit = F.when(F.col("_n") >= 2, F.lit(round(cap * grid))).otherwise(F.lit(grid))
    lacking = F.when(F.sum("_u").over(w) > 0, grid - F.sum("_u").over(w)).otherwise(0)
    ready = rounded.withColumn("_limit", limit).withColumn("_r", lacking)
    room = F.when(~used, 0).when(F.col("_r") > 0, F.greatest(F.col("_limit") - F.col("_u"), F.lit(0))).otherwise(F.col("_u"))
    order = w.orderBy((~used).cast("int"), (F.col("_u") >= F.col("_limit")).cast("int"), F.col("_u").desc(), "gateway")
    ready = ready.withColumn("_room", room).withColumn("_k", F.row_number().over(order))
    before = F.coalesce(F.sum("_room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ready = ready.withColumn("_before", before).withColumn("_space", F.sum("_room").over(w))
    taken = F.greatest(F.least(F.col("_room"), F.abs("_r") - F.col("_before")), F.lit(0))
    rest = F.when(F.col("_k") == 1, F.greatest(F.abs("_r") - F.col("_space"), F.lit(0))).otherwise(0)
    units = F.col("_u") + F.signum("_r").cast("long") * (taken + rest)
    return ready.withColumn("units", units).drop("_u", "_n", "_limit", "_r", "_room", "_k", "_before", "_space")


def conditions(rows: DataFrame, group: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """(cell, check, condition): the sum of a sub-cell's units, and the number of its row of units among those of its ``group``, by first appearance."""
    others = [c for c in cell if c not in group]
    rank = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)).cast("int")
    parts = F.array_sort(F.collect_list(F.when(F.col("units") > 0, F.struct("gateway", "units"))))  # a sub-cell's gateways
    each = rows.groupBy(*cell).agg(parts.alias("_p"), F.sum("units").alias("check"))
    each = each.withColumn("signature", F.sha2(F.to_json("_p"), 256)).drop("_p")
    place = F.struct(*[rank("country", COUNTRIES).alias(c) if c == "country" else rank("provider", PROVIDERS).alias(c) if c == "provider" else F.col(c) for c in others])
    first = each.groupBy(*group, "signature").agg(F.min(place).alias("_first"))
    numbered = running(first, ["_first"], within=group).select(*group, "signature", F.col("row").alias("condition"))
    return each.join(numbered, [*group, "signature"]).select(*cell, "check", "condition")


def template(split: DataFrame, cell: Sequence[str], presence: DataFrame, usa_only: Sequence[str], incapable: Sequence[str], cap: float = 0.97, grid: int = 10_000, stage: str = "final") -> DataFrame:
    """(cell, country, provider, gateway, share, units) of a split; ``stage`` stops early: ``base``, ``zeroing``, ``waterfill`` or ``final`` (units)."""
    sub = [*cell, "country", "provider"]
    rows = sub_cells(split, cell, presence)
    if stage != "base":
        rows = enabled(rows, sub, usa_only, incapable)
    if stage in ("waterfill", "final") and cap < 1:
        rows = water_filled(rows, sub, cap)
    return apportioned(rows, sub, cap, grid) if stage == "final" else rows


def wide(rows: DataFrame, cell: Sequence[str], gateways: Sequence[str], grid: int = 10_000) -> DataFrame:
    """The sheet: one row for each sub-cell, a column of per cents for each gateway."""
    spread = rows.groupBy(*cell).pivot("gateway", list(gateways)).agg(F.sum("units"))
    return spread.select(*cell, *[F.round(F.coalesce(F.col(f"`{g}`"), F.lit(0)) * (100.0 / grid), 2).alias(g) for g in gateways])


def shares_of(sheet: DataFrame, cell: Sequence[str], gateways: Sequence[str]) -> DataFrame:
    """(cell, gateway, share) of a sheet of per cents: used gateways only, normalised within the row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("gateway"), F.col(f"`{g}`").cast("double").alias("share")) for g in gateways]))
    long = sheet.select(*cell, pairs.alias("x")).select(*cell, "x.gateway", "x.share").where("share > 0")
    return long.withColumn("share", share_of("share", cell))


def weighted(parts: Column, total: int = 1000, grid: int = 10_000) -> Column:
    """Connectors (gateway, units) with whole weights that sum to ``total``: rounded half to even, the difference spread one by one, the largest first."""
    raw = F.transform(parts, lambda x: F.struct((-F.bround(x["units"] * (total / grid)).cast("int")).alias("w"), x["gateway"].alias("gateway")))
    ranked = F.array_sort(raw)  # the largest weight first, then by gateway
    gap = F.lit(total) + F.aggregate(ranked, F.lit(0), lambda s, x: s + x["w"])
    n = F.size(ranked)
    step = lambda i: F.signum(gap).cast("int") * (F.floor(F.abs(gap) / n).cast("int") + (i < F.abs(gap) % n).cast("int"))
    return F.array_sort(F.transform(ranked, lambda x, i: F.struct(x["gateway"].alias("gateway"), (-x["w"] + step(i)).alias("weight"))))


def pools(rows: DataFrame, kind: str = "rpgt", currency: str = "currency", bank: str = "bank", special: Sequence[str] = (), chunk: int = 6500, extra: int = 200_000, total: int = 1000, grid: int = 10_000) -> DataFrame:
    """(kind, currency, country, providers, chunk, banks, connectors, priority): the fewest pools that route as the template (``rows``: sub-cells, gateway, units) does.

    Banks of one currency with the same shares in a country and for a provider share a pool; pools of the same banks and shares
    are one where they differ in the country alone (``All``), and then in providers alone: the two wallets, or all three.  A pool holds ``chunk`` banks at most.
    Priorities: narrow before general kinds (``special``), wallets before all.  Banks are told apart in sets by two 64-bit sums, so
    no set is held whole.  Sub-cells without units have no pool.
    """
    parts = F.array_sort(F.collect_list(F.struct("gateway", "units")))  # a sub-cell's gateways
    each = rows.where("units > 0").groupBy(kind, currency, bank, "country", "provider").agg(parts.alias("_parts"))
    each = written(each.withColumn("_sig", F.sha2(F.to_json("_parts"), 256)), "signatures")
    mark = lambda seed: F.sum(F.xxhash64(bank, F.lit(seed)).cast("decimal(38,0)"))
    sets = each.groupBy(kind, currency, "_sig", "country", "provider").agg(F.struct(F.count(F.lit(1)).alias("n"), mark(1).alias("a"), mark(2).alias("b")).alias("_set"))
    both = F.count_distinct("country") > 1
    label = F.when(both, "All").otherwise(F.max("country"))
    by_country = sets.groupBy(kind, currency, "_sig", "_set", "provider").agg(label.alias("country"), F.max("country").alias("_in"))
    met = by_country.groupBy(kind, currency, "_sig", "_set", "country").agg(F.array_sort(F.collect_set("provider")).alias("_all"), F.max("_in").alias("_in"))  # three at most
    wallets = F.array(*[F.lit(p) for p in sorted(WALLETS)])
    singles = F.transform("_all", lambda p: F.array(p))
    others = F.transform(F.array_except("_all", wallets), lambda p: F.array(p))
    has = F.size(F.array_intersect("_all", wallets)) == 2
    groups = F.when(F.size("_all") == 3, F.array("_all")).when(has, F.concat(F.array(wallets), others)).otherwise(singles)
    rules = met.withColumn("providers", F.explode(groups)).withColumn("_of", F.col("providers")[0])
    # The banks of a rule are those of any of its providers in any of its countries: all have the same.
    own = each.select(kind, currency, "_sig", F.col("country").alias("_in"), F.col("provider").alias("_of"), bank, "_parts")
    joined = rules.drop("_all").join(own, [kind, currency, "_sig", "_in", "_of"])
    keys = [kind, currency, "_sig", "_set", "country", "providers"]
    placed = joined.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(bank)) - 1) / chunk).cast("int"))
    found = placed.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(bank)).alias("banks"), F.first("_parts").alias("_parts"))  # ``chunk`` banks at most
    base = F.when(F.col(kind).isin(*special), 500_000).otherwise(100_000) if special else F.lit(100_000)
    priority = base + 200_000 + F.when(F.col("providers") == wallets, 100_000).otherwise(0) + extra
    return found.select(kind, currency, "country", "providers", "chunk", "banks", weighted(F.col("_parts"), total, grid).alias("connectors"), priority.cast("int").alias("priority"))


def pool_count(rows: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """(kind, pools) of a template."""
    kind = options.get("kind", "rpgt")
    return pools(rows, **options).groupBy(kind).agg(F.count(F.lit(1)).alias("pools"))
