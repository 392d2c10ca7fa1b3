"""Effects of a split: caps, segments, back-fill, the granular projection, evaluation and revenue."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions.columns import month_diff
from switchyard.operators import candidates as ca
from switchyard.operators import effects as ef
from switchyard.operators import projection as pr
from switchyard.operators import reports as rp
from switchyard.operators.rates import shrunk
from switchyard.operators.timeline import orphans_spread
from switchyard.plans.rates import CELL, RATES_SQL, SPLIT_SQL, cell_rates, risk_added, rounded, softmax_split, softmaxed
from switchyard.registry import query
from switchyard.sources.shared import written
from switchyard.sources.tables import ATTEMPTS_SQL, attempts

CELLS = "rpgt, currency, bank"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmax_split(spark, sf_dir).select(*CELL, "gateway", "volume", "baseline_share", "share", "success_rate", "risk_rate")


def _sweeps(cap: float, sweeps: int, given: str, ready: str) -> str:
    """The same step several times over: s0 holds the shares."""
    out, w = [f"s0 AS (SELECT {CELLS}, gateway, share AS w FROM split)"], f"(PARTITION BY {CELLS})"
    for k in range(1, sweeps + 1):
        out.append(f"""m{k} AS (SELECT *, sum(greatest(w - {cap}, 0)) OVER v AS excess, sum(CASE WHEN w > 1e-12 AND w < {cap} - 1e-12 THEN {cap} - w ELSE 0 END) OVER v AS space, sum(CASE WHEN w <= {cap} THEN w ELSE 0 END) OVER v AS below,
  sum(CASE WHEN w <= {cap} THEN 1 ELSE 0 END) OVER v AS open_, sum(CASE WHEN w > 1e-12 THEN 1 ELSE 0 END) OVER v AS used FROM s{k - 1} WINDOW v AS {w})""")
        out.append(f"s{k} AS (SELECT {CELLS}, gateway, CASE WHEN {ready} AND excess > 1e-12 THEN CASE WHEN w > {cap} THEN {cap} ELSE {given} END ELSE w END AS w FROM m{k})")
    return ", ".join(out)


WATER = "w + CASE WHEN space > 1e-12 THEN CASE WHEN w > 1e-12 AND w < {0} - 1e-12 THEN {0} - w ELSE 0 END / space * least(excess, space) ELSE 0 END"


@query(f"WITH {SPLIT_SQL}, {_sweeps(0.15, 4, WATER.format(0.15), 'used >= 2')} SELECT {CELLS}, gateway, round(w, 6) AS share FROM s4")
def effect_water_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ef.water_filled(_split(spark, sf_dir).select(*CELL, "gateway", "share"), CELL, 0.15, 4), 6, "share")


@query(f"WITH {SPLIT_SQL}, {_sweeps(0.14, 6, 'w + CASE WHEN below > 0 THEN excess * w / below ELSE excess / open_ END', 'open_ > 0')} SELECT {CELLS}, gateway, round(w, 6) AS share FROM s6")
def effect_respilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ef.respilled(_split(spark, sf_dir).select(*CELL, "gateway", "share"), CELL, 0.14, 6), 6, "share")


@query(f"""WITH {SPLIT_SQL}, s AS (SELECT *, 'mid_' || right(gateway, 1) AS mid FROM split), m AS (SELECT mid, sum(volume * baseline_share) AS b, sum(volume * share) AS p FROM s GROUP BY mid),
l(mid, lim) AS (VALUES ('mid_1', 0.5), ('mid_4', 0.8), ('mid_7', 9.0)), o AS (SELECT mid, lim * b / p AS f FROM m JOIN l USING (mid) WHERE b > 1e-12 AND p > lim * b + 1e-9),
c AS (SELECT s.*, f, share * coalesce(f, 1) AS k FROM s LEFT JOIN o USING (mid)), r AS (SELECT *, sum(share - k) OVER (PARTITION BY {CELLS}) AS freed, CASE WHEN f IS NULL THEN greatest(0.3 - k, 0) ELSE 0 END AS room FROM c),
t AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY {CELLS} ORDER BY risk_rate, gateway ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r), n AS (SELECT *, k + greatest(least(room, freed - before), 0) AS x FROM t)
SELECT {CELLS}, gateway, round(CASE WHEN sum(x) OVER w > 0 THEN x / sum(x) OVER w ELSE x END, 6) AS share FROM n WINDOW w AS (PARTITION BY {CELLS})""")
def effect_volume_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("mid_1", 0.5), ("mid_4", 0.8), ("mid_7", 9.0)], "mid string, limit double")
    s = _split(spark, sf_dir).withColumn("mid", F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))))
    return rounded(ef.volume_capped(s, CELL, limits, 0.3).select(*CELL, "gateway", "share"), 6, "share")


@query(f"""WITH {SPLIT_SQL}, own AS (SELECT {CELLS}, gateway, CASE WHEN length(bank) % 3 = 0 THEN share ELSE 0 END AS share FROM split WHERE length(bank) % 3 <> 1), c AS (SELECT DISTINCT {CELLS} FROM split),
g AS (SELECT gateway, 10.0 * (1 + CAST(right(gateway, 1) AS INTEGER) % 3) AS share FROM split GROUP BY gateway), ca AS (SELECT {CELLS}, gateway, share FROM c CROSS JOIN g),
both_ AS (SELECT * FROM own WHERE share > 0 UNION ALL SELECT * FROM ca WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.share > 0 AND o.rpgt = ca.rpgt AND o.currency = ca.currency AND o.bank = ca.bank))
SELECT {CELLS}, gateway, round(share / sum(share) OVER (PARTITION BY {CELLS}), 6) AS share FROM both_""")
def effect_catch_all_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _split(spark, sf_dir).select(*CELL, "gateway", "share")
    own = s.where("length(bank) % 3 <> 1").withColumn("share", F.when(F.length("bank") % 3 == 0, F.col("share")).otherwise(0.0))
    general = s.select(*CELL).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    general = general.select(*CELL, F.concat(F.lit("gw_"), F.col("k").cast("string")).alias("gateway"), (10.0 * (1 + F.col("k") % 3)).alias("share"))
    return rounded(ef.catch_all_blended(own, general, CELL), 6, "share")


@query(f"""WITH {SPLIT_SQL}, frac AS (SELECT bank, CASE WHEN bank = 'NATION_6' THEN NULL ELSE length(bank) / 10.0 END AS fraction FROM split GROUP BY bank),
x AS (SELECT s.*, least(greatest(coalesce(fraction, 0), 0), 1) AS part, seg.segment FROM split s LEFT JOIN frac USING (bank) CROSS JOIN (VALUES ('non_wallet'), ('wallet')) seg(segment)),
a AS (SELECT *, CASE WHEN segment = 'wallet' AND gateway IN ('gw_2', 'gw_5') THEN 0 ELSE share END AS able FROM x)
SELECT {CELLS}, gateway, segment, round(CASE WHEN segment = 'wallet' AND sum(able) OVER w > 0 THEN able / sum(able) OVER w ELSE share END, 6) AS share, round(volume * CASE WHEN segment = 'wallet' THEN part ELSE 1 - part END, 6) AS volume FROM a WINDOW w AS (PARTITION BY {CELLS}, segment)""")
def effect_wallet_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _split(spark, sf_dir).select(*CELL, "gateway", "share", "volume")
    f = s.select("bank").distinct().withColumn("fraction", F.when(F.col("bank") == "NATION_6", None).otherwise(F.length("bank") / 10.0))
    return rounded(ef.wallet_segmented(s, ["gw_2", "GW_5"], f, ["bank"], CELL).select(*CELL, "gateway", "segment", "share", "volume"), 6, "share", "volume")


# Rows of the projection: months 0 to 5 are January to June 1998; a cell is type, currency, provider and country.
SUB = ["rpgt", "currency", "provider", "country"]
SUBS = "rpgt, currency, provider, country"
GRAIN_SQL = (
    ATTEMPTS_SQL
    + f""", grain AS (SELECT {SUBS}, 'mid_' || right(gateway, 1) AS mid, CAST(month(day) - 1 AS INTEGER) AS period, CAST(least(greatest((year(day) - year(origin)) * 12 + month(day) - month(origin), 0), 9) AS INTEGER) AS t,
  CAST(count(*) FILTER (NOT success) AS DOUBLE) AS risk, CAST(count(*) AS DOUBLE) AS n FROM attempts WHERE day >= DATE '1998-01-01' AND day < DATE '1998-07-01' GROUP BY ALL),
prows AS (SELECT {SUBS}, mid, period, t, risk, CASE WHEN t = 0 THEN n ELSE 0 END AS txn, CASE WHEN period - t < 0 THEN 0 ELSE 0.5 + 0.1 * (period - t) END AS pro_rata, CAST(CASE WHEN country = 'USA' THEN 0.9 ELSE 0.8 END AS DOUBLE) AS fcp1_frac FROM grain),
pshares AS (SELECT {SUBS}, mid, CAST(1 + CAST(right(mid, 1) AS INTEGER) % 4 AS DOUBLE) AS prop FROM (SELECT DISTINCT {SUBS} FROM prows WHERE currency <> 'MACHINERY') CROSS JOIN (SELECT DISTINCT mid FROM prows) WHERE CAST(right(mid, 1) AS INTEGER) % 5 <> length(currency) % 5)"""
)
PROJECTED_SQL = f"""zcell AS (SELECT DISTINCT {SUBS} FROM prows WHERE t = 0), zmid AS (SELECT DISTINCT {SUBS}, mid FROM prows WHERE t = 0),
timing AS (SELECT {SUBS}, period, pro_rata, fcp1_frac FROM prows QUALIFY row_number() OVER (PARTITION BY {SUBS}, period ORDER BY t, mid) = 1),
filled AS (SELECT {SUBS}, mid, period, 0 AS t, 0.0::DOUBLE AS risk, 0.0::DOUBLE AS txn, pro_rata, fcp1_frac FROM (SELECT {SUBS}, mid FROM pshares SEMI JOIN zcell USING ({SUBS}) EXCEPT SELECT * FROM zmid) JOIN timing USING ({SUBS})),
full_ AS (SELECT {SUBS}, mid, period, t, risk, txn, pro_rata, fcp1_frac FROM prows UNION ALL SELECT {SUBS}, mid, period, t, risk, txn, pro_rata, fcp1_frac FROM filled),
z0 AS (SELECT f.*, coalesce(prop, 0) AS prop FROM full_ f LEFT JOIN pshares USING ({SUBS}, mid) WHERE t = 0), z1 AS (SELECT *, sum(prop) OVER w AS psum, sum(txn) OVER w AS total, sum(txn * (pro_rata * fcp1_frac)) OVER w AS pool, sum(CASE WHEN risk > 0 THEN prop ELSE 0 END) OVER w AS rsum FROM z0 WINDOW w AS (PARTITION BY {SUBS}, period)),
z AS (SELECT *, CASE WHEN psum > 0 AND total > 0 THEN txn * (1 - pro_rata * fcp1_frac) + pool * prop / psum ELSE txn END AS txn_post, CASE WHEN rsum > 0 THEN CASE WHEN risk > 0 THEN prop ELSE 0 END / rsum ELSE 0 END AS to_, CASE WHEN psum > 0 THEN fcp1_frac ELSE 0 END AS part FROM z1),
tm AS (SELECT {SUBS}, period, pro_rata AS timing FROM z QUALIFY row_number() OVER (PARTITION BY {SUBS}, period ORDER BY mid) = 1),
a AS (SELECT f.*, o.part, coalesce(o.to_, 0) AS to_, tm.timing, s.txn_post FROM full_ f LEFT JOIN z o ON o.rpgt = f.rpgt AND o.currency = f.currency AND o.provider = f.provider AND o.country = f.country AND o.mid = f.mid AND o.period = f.period - f.t LEFT JOIN tm ON tm.rpgt = f.rpgt AND tm.currency = f.currency AND tm.provider = f.provider AND tm.country = f.country AND tm.period = f.period
  LEFT JOIN z s ON s.rpgt = f.rpgt AND s.currency = f.currency AND s.provider = f.provider AND s.country = f.country AND s.mid = f.mid AND s.period = f.period),
b AS (SELECT *, sum(to_) OVER (PARTITION BY {SUBS}, period, t) AS tsum FROM a), c AS (SELECT *, CASE WHEN period - t >= 0 AND tsum > 1e-12 THEN coalesce(part, 0) * coalesce(timing, 0) ELSE 0 END AS move FROM b),
projected AS (SELECT {SUBS}, mid, period, t, risk AS risk_pre, risk * (1 - move) + CASE WHEN tsum > 1e-12 THEN sum(risk * move) OVER (PARTITION BY {SUBS}, period, t) * to_ / tsum ELSE 0 END AS risk_post, CASE WHEN t = 0 THEN txn ELSE 0 END AS txn_pre, CASE WHEN t = 0 THEN coalesce(txn_post, 0) ELSE 0 END AS txn_post FROM c)"""


def projection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir, datetime.date(1998, 1, 1), datetime.date(1998, 7, 1))
    age = F.least(F.greatest(month_diff(F.col("day"), F.col("origin")), F.lit(0)), F.lit(9))
    g = a.groupBy(*SUB, F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))).alias("mid"), (F.month("day") - 1).cast("int").alias("period"), age.alias("t"))
    g = g.agg(F.sum((~F.col("success")).cast("double")).alias("risk"), F.count(F.lit(1)).cast("double").alias("n"))
    born = F.col("period") - F.col("t")
    return g.select(*SUB, "mid", "period", "t", "risk", F.when(F.col("t") == 0, F.col("n")).otherwise(0.0).alias("txn"), F.when(born < 0, 0.0).otherwise(0.5 + 0.1 * born).alias("pro_rata"), F.when(F.col("country") == "USA", 0.9).otherwise(0.8).alias("fcp1_frac"))


def projection_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = written(projection_rows(spark, sf_dir), "projection-rows")  # used several times; its size follows the keys
    number = F.right("mid", F.lit(1)).cast("int")
    shares = rows.where("currency <> 'MACHINERY'").select(*SUB).distinct().join(F.broadcast(rows.select("mid").distinct()))  # a list of MIDs
    shares = shares.where(number % 5 != F.length("currency") % 5).withColumn("prop", (1 + number % 4).cast("double"))
    return rows, shares


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ef.granular_projection(*projection_inputs(spark, sf_dir), SUB)


VALUES = ["risk_pre", "risk_post", "txn_pre", "txn_post"]


@query(f"WITH {GRAIN_SQL}, {PROJECTED_SQL} SELECT {SUBS}, mid, period, t, round(risk_pre, 5) AS risk_pre, round(risk_post, 5) AS risk_post, round(txn_pre, 5) AS txn_pre, round(txn_post, 5) AS txn_post FROM projected")
def projection_granular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(projection(spark, sf_dir), 5, *VALUES)


@query(f"WITH {GRAIN_SQL}, {PROJECTED_SQL} SELECT mid, {', '.join(f'round(coalesce(sum({v}) FILTER (period = {m}), 0), 4) AS {v}_m{m}' for m in range(6) for v in VALUES)} FROM projected GROUP BY mid")
def projection_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ef.by_month(projection(spark, sf_dir)), 4, *[f"{v}_m{m}" for m in range(6) for v in VALUES])


@query(f"WITH {GRAIN_SQL}, {PROJECTED_SQL} SELECT period, round(abs(sum(risk_post) - sum(risk_pre)) / greatest(abs(sum(risk_pre)), 1), 6) AS risk_gap, round(abs(sum(txn_post) - sum(txn_pre)) / greatest(abs(sum(txn_pre)), 1), 6) AS txn_gap FROM projected GROUP BY period")
def projection_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ef.conserved(projection(spark, sf_dir)), 6, "risk_gap", "txn_gap")


# Four candidates: the proposed shares, ever more drawn to even ones.  The twin has them as part of a cell's key.
CANDIDATE_SQL = PROJECTED_SQL.replace(SUBS, f"candidate, {SUBS}").replace("prows", "crows").replace("pshares", "cshares")
for _alias in ("o", "tm", "s"):
    CANDIDATE_SQL = CANDIDATE_SQL.replace(f"{_alias}.rpgt = f.rpgt", f"{_alias}.candidate = f.candidate AND {_alias}.rpgt = f.rpgt")


def candidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(projection_rows(spark, sf_dir), "projection-rows")  # used several times; its size follows the keys
    number = F.right("mid", F.lit(1)).cast("int")
    shares = rows.where("currency <> 'MACHINERY'").select(*SUB).distinct().join(F.broadcast(rows.select("mid").distinct()))  # a list of MIDs
    shares = shares.where(number % 5 != F.length("currency") % 5).withColumn("props", F.array(*[(1 + number % 4) * (3 - c) + F.lit(2.0 * c) for c in range(4)]))
    return ca.projected(rows, shares, SUB, 4)


@query(f"""WITH {GRAIN_SQL}, four(candidate) AS (VALUES (0), (1), (2), (3)), crows AS (SELECT candidate, prows.* FROM prows, four), cshares AS (SELECT candidate, {SUBS}, mid, prop * (3 - candidate) + 2.0 * candidate AS prop FROM pshares, four), {CANDIDATE_SQL}
SELECT mid, period, candidate, round(sum(risk_pre), 5) AS risk_pre, round(sum(risk_post), 5) AS risk_post, round(sum(txn_pre), 5) AS txn_pre, round(sum(txn_post), 5) AS txn_post FROM projected GROUP BY ALL""")
def projection_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk and transactions of each MID and month under four candidate splits."""
    return rounded(ca.totals(candidate_projection(spark, sf_dir), 4), 5, *VALUES)


LINEAR_SQL = f"""own AS (SELECT {SUBS}, mid, prop / sum(prop) OVER (PARTITION BY {SUBS}) AS prop FROM pshares), kept(mid, period, keep) AS (VALUES ('mid_1', 1, 0.5), ('mid_1', 2, 0.0), ('mid_2', 2, 0.0)),
sold AS (SELECT {SUBS}, mid, period, sum(txn) AS pre FROM prows WHERE t = 0 GROUP BY ALL), risky AS (SELECT {SUBS}, mid, sum(risk) > 0 AS risky FROM prows GROUP BY ALL),
l0 AS (SELECT sold.*, prop, coalesce(keep, 1.0)::DOUBLE AS keep, risky, CASE WHEN period < 2 THEN 0.0 WHEN period = 2 THEN 21.0 / 31 ELSE 1.0 END::DOUBLE AS f FROM sold LEFT JOIN own USING ({SUBS}, mid) LEFT JOIN kept USING (mid, period) JOIN risky USING ({SUBS}, mid)),
l1 AS (SELECT *, CASE WHEN sum(pre * keep) OVER w > 0 THEN pre * keep / sum(pre * keep) OVER w ELSE 0 END AS base, coalesce(prop, 0) * keep AS p, sum(coalesce(prop, 0) * keep) OVER w AS psum FROM l0 WINDOW w AS (PARTITION BY {SUBS}, period)),
l2 AS (SELECT *, CASE WHEN psum > 0 THEN p / psum ELSE base END AS to_ FROM l1), l3 AS (SELECT *, sum(pre) OVER w * ((1 - f) * base + f * to_) AS post, CASE WHEN psum > 0 THEN f ELSE 0 END AS move, sum(CASE WHEN risky THEN to_ ELSE 0 END) OVER w AS vsum FROM l2 WINDOW w AS (PARTITION BY {SUBS}, period)),
l4 AS (SELECT *, CASE WHEN vsum > 0 AND risky THEN to_ / vsum ELSE 0 END AS share FROM l3),
linear AS (SELECT r.*, r.risk * (1 - coalesce(o.move, 0)) + sum(r.risk) OVER (PARTITION BY r.rpgt, r.currency, r.provider, r.country, r.period, r.t) * coalesce(o.move, 0) * coalesce(o.share, 0) AS risk_post, s.pre, s.post FROM prows r
  LEFT JOIN l4 o ON o.rpgt = r.rpgt AND o.currency = r.currency AND o.provider = r.provider AND o.country = r.country AND o.mid = r.mid AND o.period = r.period - r.t
  LEFT JOIN l4 s ON s.rpgt = r.rpgt AND s.currency = r.currency AND s.provider = r.provider AND s.country = r.country AND s.mid = r.mid AND s.period = r.period)"""


@query(f"WITH {GRAIN_SQL}, {LINEAR_SQL} SELECT mid, period, round(sum(risk), 4) AS risk_pre, round(sum(risk_post), 4) AS risk_post, round(sum(CASE WHEN t = 0 THEN pre ELSE 0 END), 4) AS txn_pre, round(sum(CASE WHEN t = 0 THEN post ELSE 0 END), 4) AS txn_post FROM linear GROUP BY ALL")
def projection_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that moves everything from the 11th of March 1998 (month 2) on, with two MIDs switched off."""
    rows, shares = projection_inputs(spark, sf_dir)
    keep = spark.createDataFrame([("mid_1", 1, 0.5), ("mid_1", 2, 0.0), ("mid_2", 2, 0.0)], "mid string, period int, keep double")
    found = pr.linear_projection(rows, shares, SUB, datetime.date(1998, 3, 11), datetime.date(1998, 1, 1), keep)
    return found.groupBy("mid", "period").agg(*[F.round(F.sum(v), 4).alias(v) for v in VALUES])


TICKETS_SQL = """tickets AS (SELECT rpgt, currency, CAST(sum(amount) FILTER (success) AS DOUBLE) / count(*) FILTER (success) AS ticket FROM attempts WHERE day >= DATE '1997-12-01' AND day < DATE '1998-01-01' AND NOT (currency = 'BUILDING' AND rpgt = '2-HIGH') AND currency <> 'FURNITURE' GROUP BY ALL HAVING count(*) FILTER (success) > 0),
by_type AS (SELECT rpgt, avg(ticket) AS ticket FROM tickets WHERE rpgt <> '5-LOW' GROUP BY rpgt)"""


@query(f"""WITH {GRAIN_SQL}, {PROJECTED_SQL}, {TICKETS_SQL}, bc AS (SELECT currency, avg(ticket) AS ticket FROM tickets GROUP BY currency), mean AS (SELECT avg(ticket) AS ticket FROM tickets),
x AS (SELECT p.*, coalesce(t.ticket, bc.ticket, y.ticket, mean.ticket, 0) AS ticket FROM (SELECT rpgt, currency, mid, period, sum(txn_pre) AS txn_pre, sum(txn_post) AS txn_post FROM projected GROUP BY ALL) p LEFT JOIN tickets t ON t.rpgt = p.rpgt AND t.currency = p.currency LEFT JOIN bc ON bc.currency = p.currency LEFT JOIN by_type y ON y.rpgt = p.rpgt, mean)
SELECT mid, period, round(sum(txn_pre), 4) AS txn_pre, round(sum(txn_post), 4) AS txn_post, round(sum(txn_pre * ticket), 2) AS revenue_pre, round(sum(txn_post * ticket), 2) AS revenue_post FROM x GROUP BY ALL""")
def projection_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir, datetime.date(1997, 12, 1), datetime.date(1998, 1, 1)).where("success and not (currency = 'BUILDING' and rpgt = '2-HIGH') and currency <> 'FURNITURE'")
    tickets = a.groupBy("rpgt", "currency").agg((F.sum("amount") / F.count(F.lit(1))).alias("ticket"))
    by_type = tickets.where("rpgt <> '5-LOW'").groupBy("rpgt").agg(F.avg("ticket").alias("ticket"))
    p = projection(spark, sf_dir).groupBy("rpgt", "currency", "mid", "period").agg(F.sum("txn_pre").alias("txn_pre"), F.sum("txn_post").alias("txn_post"))
    x = ef.priced(p, tickets, by_type)
    money = lambda c: F.round(F.sum(F.col(f"txn_{c}") * F.col("ticket")), 2).alias(f"revenue_{c}")
    return x.groupBy("mid", "period").agg(F.round(F.sum("txn_pre"), 4).alias("txn_pre"), F.round(F.sum("txn_post"), 4).alias("txn_post"), money("pre"), money("post"))


@query(f"""WITH {SPLIT_SQL}, c AS (SELECT {CELLS}, count(*) AS attempts, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS cell, CASE WHEN bank = 'NATION_18' THEN NULL ELSE CAST(sum(CAST(amount AS DECIMAL(18, 2))) FILTER (success) AS DOUBLE) / count(*) FILTER (success) END AS ticket FROM attempts GROUP BY rpgt, currency, bank),
g AS (SELECT {CELLS}, gateway, success_rate AS own FROM rates WHERE gateway <> 'gw_6'),
x AS (SELECT s.{CELLS.replace(', ', ', s.')}, s.gateway, s.volume, s.share, s.baseline_share, coalesce(own, cell, 0) AS rate, CAST(coalesce(c.attempts, 0) AS DOUBLE) AS attempts, coalesce(ticket, 25.0) AS ticket FROM split s LEFT JOIN c USING ({CELLS}) LEFT JOIN g USING ({CELLS}, gateway)),
y AS (SELECT *, volume * baseline_share AS pre_vol, volume * share AS post_vol, attempts * baseline_share * rate AS pre_succ, attempts * share * rate AS post_succ FROM x)
SELECT {CELLS}, gateway, round(pre_vol, 4) AS pre_vol, round(post_vol, 4) AS post_vol, round(pre_succ, 4) AS pre_succ, round(post_succ, 4) AS post_succ, round(pre_succ * ticket, 5) AS pre_rev, round(post_succ * ticket, 5) AS post_rev, round(post_vol - pre_vol, 4) AS vol_delta, round(post_succ * ticket - pre_succ * ticket, 5) AS rev_delta, round((share - baseline_share) * 100, 4) AS share_delta_pp FROM y""")
def impact_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = F.when(F.col("success"), F.col("amount").cast("decimal(18,2)"))  # exact sums, whatever their order
    tallies = attempts(spark, sf_dir).groupBy(*CELL, "gateway").agg(F.sum(F.lit(1.0)).alias("n"), F.sum(F.col("success").cast("double")).alias("s"), F.sum(won).alias("won"), F.count(won).alias("wins"))
    tallies = written(tallies, "tallies")  # one scan; its size follows the keys
    a = tallies.groupBy(*CELL).agg(F.sum("n").cast("long").alias("attempts"), (F.sum("s") / F.sum("n")).alias("success_rate"), (F.sum("won").cast("double") / F.sum("wins")).alias("ticket"))
    cells = a.withColumn("ticket", F.when(F.col("bank") != "NATION_18", F.col("ticket")))
    rates = risk_added(shrunk(tallies))
    split = softmaxed(rates).select(*CELL, "gateway", "volume", "baseline_share", "share", "success_rate", "risk_rate")
    out = ef.evaluated(split, cells, rates.where("gateway <> 'gw_6'"), CELL)
    return rounded(rounded(rounded(out, 4, "pre_vol", "post_vol", "pre_succ", "post_succ", "vol_delta", "share_delta_pp"), 5, "pre_rev", "post_rev"), 5, "rev_delta")


EXPORT_SQL = """export AS (SELECT rpgt, currency, bank, CASE WHEN line_no % 3 = 0 THEN gateway || '-x' ELSE gateway END AS gateway, CAST(month(day) - 1 AS INTEGER) AS period, count(*) AS txn, count(*) FILTER (NOT success) AS risk FROM attempts WHERE day >= DATE '1998-01-01' AND day < DATE '1998-04-01' GROUP BY ALL)"""


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir, datetime.date(1998, 1, 1), datetime.date(1998, 4, 1))
    named = F.when(F.col("line_no") % 3 == 0, F.concat("gateway", F.lit("-x"))).otherwise(F.col("gateway"))
    return a.groupBy(*CELL, named.alias("gateway"), (F.month("day") - 1).cast("int").alias("period")).agg(F.count(F.lit(1)).alias("txn"), F.sum((~F.col("success")).cast("long")).alias("risk"))


def _baseline_sql(period: int) -> str:
    return f"""WITH {ATTEMPTS_SQL}, {EXPORT_SQL}, b AS (SELECT {CELLS}, regexp_replace(gateway, '-x$', '') AS gateway, CAST(sum(txn) AS BIGINT) AS volume, sum(risk) AS r FROM export WHERE period = {period} AND txn > 0 GROUP BY ALL)
SELECT {CELLS}, gateway, volume, round(r / volume, 6) AS risk_rate, round(CAST(volume AS DOUBLE) / sum(volume) OVER (PARTITION BY {CELLS}), 6) AS baseline_share FROM b"""


@query(_baseline_sql(0))
def baseline_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ef.baseline(export(spark, sf_dir), CELL), 6, "risk_rate", "baseline_share")


@query(_baseline_sql(1))
def baseline_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ef.baseline(export(spark, sf_dir), CELL, 1), 6, "risk_rate", "baseline_share")


@query(f"""WITH {GRAIN_SQL}, {EXPORT_SQL}, f AS (SELECT CAST(sum(txn) AS DOUBLE) AS txn_left, CAST(sum(risk) AS DOUBLE) AS risk_left FROM prows WHERE period = 0), b AS (SELECT CAST(sum(txn) AS DOUBLE) AS txn_right, CAST(sum(risk) AS DOUBLE) AS risk_right FROM export WHERE period = 0)
SELECT *, abs(txn_left - txn_right) <= greatest(1.0, 0.005 * abs(txn_right)) AS txn_agrees, abs(risk_left - risk_right) <= greatest(1.0, 0.005 * abs(risk_right)) AS risk_agrees FROM f, b""")
def baseline_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the fine export against the coarse one: risk agrees, transactions do not, since the fine one counts new sales alone."""
    fine = projection_rows(spark, sf_dir).where("period = 0").select("txn", "risk")
    coarse = export(spark, sf_dir).where("period = 0").select(F.col("txn").cast("double").alias("txn"), F.col("risk").cast("double").alias("risk"))
    return ef.agreed(fine, coarse, ["txn", "risk"])


_UNIT = "(CAST(CAST('0x' || substr(md5(rpgt || '|' || currency || '|' || bank || '|' || gateway || '|{0}'), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0"


@query(f"""WITH {RATES_SQL} SELECT {CELLS}, gateway, CAST(attempts AS DOUBLE) AS volume, round(CAST(attempts AS DOUBLE) / sum(attempts) OVER (PARTITION BY {CELLS}), 6) AS baseline_share,
round(greatest(0.006 + 0.002 * sqrt(-2 * ln({_UNIT.format('u')})) * cos(2 * pi() * {_UNIT.format('v')}), 0), 8) AS risk_rate FROM rates""")
def baseline_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = cell_rates(spark, sf_dir).select(*CELL, "gateway", "attempts")
    return rounded(rounded(ef.synthetic_baseline(rates, CELL).select(*CELL, "gateway", "volume", "baseline_share", "risk_rate"), 6, "baseline_share"), 8, "risk_rate")


FCP_SQL = """fcp AS (SELECT rpgt, currency, 'mid_' || right(gateway, 1) AS mid, CASE WHEN line_no = 1 THEN '1' ELSE '2+' END AS fcp, CASE WHEN quantity < 25 THEN '1' ELSE '2+' END AS attempt, count(*) AS n FROM attempts GROUP BY ALL)"""


@query(f"""WITH {ATTEMPTS_SQL}, {FCP_SQL} SELECT rpgt, currency, mid, round(CAST(sum(CASE WHEN fcp = '1' AND (rpgt NOT IN ('1-URGENT', '2-HIGH') OR attempt = '1') THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS fcp1_frac FROM fcp GROUP BY ALL""")
def effect_eligible_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).select("rpgt", "currency", F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))).alias("mid"), F.when(F.col("line_no") == 1, "1").otherwise("2+").alias("fcp"), F.when(F.col("quantity") < 25, "1").otherwise("2+").alias("attempt"))
    n = a.groupBy(*a.columns).agg(F.count(F.lit(1)).alias("n"))
    return rounded(ef.eligible_fraction(n, ["rpgt", "currency", "mid"], ["1-URGENT", "2-HIGH"]), 6, "fcp1_frac")


@query(f"""WITH {ATTEMPTS_SQL}, live AS (SELECT DATE '1998-03-11' AS g), months AS (SELECT CAST(range AS INTEGER) AS m, CAST(DATE '1998-01-01' + to_months(CAST(range AS INTEGER)) AS DATE) AS ms FROM range(-9, 6)),
ev AS (SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS dom, count(*) AS n FROM events GROUP BY ALL), sh AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY month) AS share FROM ev), bd AS (SELECT month, dom, avg(share) OVER (PARTITION BY month, CASE WHEN dom = 1 THEN 1 WHEN dom <= 28 THEN 2 ELSE 3 END) AS w FROM sh),
up AS (SELECT month, dom, coalesce(sum(w) OVER (PARTITION BY month ORDER BY dom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY month) AS upto FROM bd),
p AS (SELECT m, month(ms) AS month, greatest(least(date_diff('day', ms, g), date_diff('day', ms, CAST(ms + INTERVAL 1 MONTH AS DATE))), 0) AS passed, date_diff('day', ms, CAST(ms + INTERVAL 1 MONTH AS DATE)) AS days FROM months, live),
st AS (SELECT 'other' AS kind, m AS origin, 1 - CAST(passed AS DOUBLE) / days AS pro_rata FROM p UNION ALL SELECT 'weighted', m, CASE WHEN passed = 0 THEN 1.0 WHEN passed >= days THEN 0.0 ELSE 1 - coalesce(upto, CAST(passed AS DOUBLE) / days) END FROM p LEFT JOIN up ON up.month = p.month AND up.dom = p.passed + 1),
r AS (SELECT CASE WHEN rpgt = '3-MEDIUM' THEN 'weighted' ELSE 'other' END AS kind, CAST(month(day) - 1 AS INTEGER) AS period, CAST(least(greatest((year(day) - year(origin)) * 12 + month(day) - month(origin), 0), 9) AS INTEGER) AS t, count(*) AS n FROM attempts WHERE day >= DATE '1998-01-01' AND day < DATE '1998-07-01' GROUP BY ALL)
SELECT r.kind, period, t, n, round(CASE WHEN period - t < 0 THEN 0.0 ELSE coalesce(pro_rata, 0) END, 6) AS pro_rata FROM r LEFT JOIN st ON st.kind = r.kind AND st.origin = period - t""")
def effect_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.operators.timeline import cumulative_weights
    from switchyard.plans.relational import daily_weights

    months = spark.range(-9, 6).select(F.col("id").cast("int").alias("m"), F.add_months(F.lit(datetime.date(1998, 1, 1)), F.col("id").cast("int")).alias("month_start"))
    starts = ef.started_fractions(F.lit(datetime.date(1998, 3, 11)), months, cumulative_weights(daily_weights(spark, sf_dir)), "weighted")
    a = attempts(spark, sf_dir, datetime.date(1998, 1, 1), datetime.date(1998, 7, 1))
    age = F.least(F.greatest(month_diff(F.col("day"), F.col("origin")), F.lit(0)), F.lit(9))
    rows = a.groupBy(F.when(F.col("rpgt") == "3-MEDIUM", "weighted").otherwise("other").alias("kind"), (F.month("day") - 1).cast("int").alias("period"), age.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return ef.timed(rows, starts).select("kind", "period", "t", "n", F.round("pro_rata", 6).alias("pro_rata"))


@query(f"""WITH {ATTEMPTS_SQL}, v AS (SELECT rpgt, currency, bank, gateway, CAST(count(*) AS DOUBLE) AS pre, CAST(count(*) FILTER (success) AS DOUBLE) AS post, gateway IN ('gw_1', 'gw_2', 'gw_3') AS dead FROM attempts WHERE day >= DATE '1998-03-01' AND day < DATE '1998-04-01' GROUP BY ALL),
d AS (SELECT {CELLS} FROM v GROUP BY ALL HAVING bool_and(dead)), s AS (SELECT v.*, CASE WHEN d.bank IS NOT NULL THEN 0 ELSE post END AS q FROM v LEFT JOIN d USING ({CELLS})),
x AS (SELECT *, sum(CASE WHEN dead THEN 0 ELSE q END) OVER w AS living, sum(CASE WHEN dead THEN 0 ELSE 1 END) OVER w AS n, sum(CASE WHEN dead THEN q ELSE 0 END) OVER w AS orphan, sum(CASE WHEN dead THEN 0 ELSE pre END) OVER w AS living0, sum(CASE WHEN dead THEN pre ELSE 0 END) OVER w AS orphan0 FROM s WINDOW w AS (PARTITION BY {CELLS}))
SELECT {CELLS}, gateway, round(CASE WHEN n = 0 THEN pre WHEN dead THEN 0 ELSE pre + CASE WHEN living0 > 0 THEN orphan0 * pre / living0 ELSE orphan0 / n END END, 4) AS pre, round(CASE WHEN n = 0 THEN q WHEN dead THEN 0 ELSE q + CASE WHEN living > 0 THEN orphan * q / living ELSE orphan / n END END, 4) AS post FROM x""")
def allocation_death_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles without a living gateway lose their volume after the change; in both scenarios dead gateways' volume goes to the living."""
    a = attempts(spark, sf_dir, datetime.date(1998, 3, 1), datetime.date(1998, 4, 1))
    v = a.groupBy(*CELL, "gateway").agg(F.count(F.lit(1)).cast("double").alias("pre"), F.sum(F.col("success").cast("double")).alias("post"))
    dead = F.col("gateway").isin("gw_1", "gw_2", "gw_3")
    v = v.join(ef.doomed(v, dead, CELL).withColumn("_doomed", F.lit(True)), CELL, "left").withColumn("post", F.when(F.col("_doomed"), 0.0).otherwise(F.col("post"))).drop("_doomed")
    for side in ("pre", "post"):
        v = orphans_spread(v, ~dead, CELL, side).drop("stranded")
    return rounded(v, 4, "pre", "post")


@query(f"""WITH {SPLIT_SQL}, g AS (SELECT gateway, sum(volume * share * success_rate) AS objective, greatest(sum(volume * share * risk_rate) / sum(volume * share) - 0.035, 0) AS violation FROM split GROUP BY gateway), m AS (SELECT min(objective) FILTER (violation <= 1e-9) AS worst FROM g)
SELECT gateway, round(CASE WHEN worst IS NULL THEN violation WHEN violation <= 1e-9 THEN -objective ELSE violation - worst END, 4) AS key FROM g, m""")
def ranking_feasible_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("volume") * F.col("share")
    g = _split(spark, sf_dir).groupBy("gateway").agg(F.sum(v * F.col("success_rate")).alias("objective"), F.greatest(F.sum(v * F.col("risk_rate")) / F.sum(v) - 0.035, F.lit(0.0)).alias("violation"))
    return g.select("gateway", F.round(ef.feasible_first(F.col("objective"), F.col("violation")), 4).alias("key"))


@query(f"""WITH {ATTEMPTS_SQL}, g AS (SELECT rpgt, currency, bank, gateway, count(*) AS attempts, count(*) FILTER (success) AS success, coalesce(sum(CAST(amount AS DECIMAL(18, 2))) FILTER (success), 0) AS won FROM attempts WHERE day > DATE '1998-08-01' AND day <= DATE '1998-08-31' GROUP BY ALL),
s AS (SELECT *, CAST(success AS DOUBLE) / attempts AS gateway_rate, CAST(sum(success) OVER c AS DOUBLE) / sum(attempts) OVER c AS cell_rate, CASE WHEN sum(success) OVER b > 0 THEN CAST(sum(won) OVER b AS DOUBLE) / sum(success) OVER b ELSE 25.0 END AS ticket,
  sum(success) OVER c AS cs, sum(won) OVER c AS cw FROM g WINDOW c AS (PARTITION BY rpgt, currency, bank), b AS (PARTITION BY currency, bank))
SELECT rpgt, currency, bank, gateway, attempts, success, round(gateway_rate, 6) AS gateway_rate, round(cell_rate, 6) AS cell_rate, round(ticket, 4) AS ticket, round(CASE WHEN cs > 0 THEN CAST(cw AS DOUBLE) / cs ELSE ticket END, 4) AS type_ticket FROM s""")
def impact_base_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and tickets of the last thirty days, on three levels from one tally."""
    a = attempts(spark, sf_dir, datetime.date(1998, 8, 2), datetime.date(1998, 9, 1))
    found = rp.base_metrics(a, datetime.date(1998, 8, 31))
    return rounded(rounded(found, 6, "gateway_rate", "cell_rate"), 4, "ticket", "type_ticket")


@query(f"""WITH {ATTEMPTS_SQL}, p AS (SELECT rpgt, count(*) * (30.0 / 20) AS projected FROM attempts WHERE day BETWEEN DATE '1998-06-01' AND DATE '1998-06-20' AND rpgt <> '4-NOT SPECIFIED' GROUP BY rpgt),
k(rpgt, less) AS (VALUES ('1-URGENT', 50.0), ('2-HIGH', 0.0), ('4-NOT SPECIFIED', 0.0), ('5-LOW', 100000.0)) SELECT rpgt, CAST(greatest(coalesce(round_even(projected, 0), 0) - less, 0) AS BIGINT) AS units FROM k LEFT JOIN p USING (rpgt)""")
def forecast_month_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month 0 by type: the projection in whole units, less agreed amounts, never below 0."""
    a = attempts(spark, sf_dir, datetime.date(1998, 6, 1), datetime.date(1998, 6, 21)).where("rpgt <> '4-NOT SPECIFIED'")
    p = a.groupBy("rpgt").agg((F.count(F.lit(1)) * 1.5).alias("projected"))
    return rp.month_filled(p, ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"], {"1-URGENT": 50.0, "5-LOW": 100_000.0})
