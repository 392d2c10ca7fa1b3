"""Success-rate, risk-rate and engine queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchyard.operators import prices as pc
from switchyard.operators import projection as pr
from switchyard.operators import rates as ra
from switchyard.operators import solvers as so
from switchyard.operators import violations as vi
from switchyard.registry import query
from switchyard.sources.tables import ATTEMPTS_SQL, attempts, table

CELL = ["rpgt", "currency", "bank"]

RATES_SQL = (
    ATTEMPTS_SQL
    + """, cells AS (
  SELECT rpgt, currency, bank, gateway, count(*) AS n, count(*) FILTER (success) AS s FROM attempts GROUP BY ALL),
priors AS (SELECT rpgt, gateway, CAST(sum(s) AS DOUBLE) / sum(n) AS prior_rate FROM cells GROUP BY ALL),
rates AS (
  SELECT rpgt, currency, bank, gateway, n AS attempts, s AS success, CAST(s AS DOUBLE) / n AS raw_rate, prior_rate,
         (s + 50.0 * prior_rate) / (n + 50.0) AS success_rate, (n - s + 5.0 * (1 - prior_rate)) / (n + 5.0) / 10 AS risk_rate
  FROM cells JOIN priors USING (rpgt, gateway))"""
)


def cell_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk success and a risk rate of every cell and gateway."""
    return risk_added(ra.shrunk_success(attempts(spark, sf_dir)))


def risk_added(rates: DataFrame) -> DataFrame:
    return rates.withColumn("risk_rate", (F.col("attempts") - F.col("success") + 5.0 * (1 - F.col("prior_rate"))) / (F.col("attempts") + 5.0) / 10)


def rounded(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {RATES_SQL} SELECT rpgt, currency, bank, gateway, attempts, success, round(raw_rate, 6) AS raw_rate, round(prior_rate, 6) AS prior_rate, round(success_rate, 6) AS success_rate FROM rates")
def rates_shrunk_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ra.shrunk_success(attempts(spark, sf_dir)), 6, "raw_rate", "prior_rate", "success_rate")


@query(f"""WITH {ATTEMPTS_SQL}, last AS (SELECT max(day) AS d FROM attempts),
w AS (SELECT gateway, currency, pow(0.5, date_diff('day', day, d) / 180.0) AS w, success FROM attempts, last)
SELECT gateway, currency, round(sum(w), 4) AS weight, round(sum(CASE WHEN success THEN w ELSE 0 END) / sum(w), 6) AS rate FROM w GROUP BY ALL""")
def rates_time_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    latest = a.agg(F.max("day").alias("latest"))  # one row
    weight = ra.decay_weight(F.col("day"), F.col("latest"), 180.0)
    out = ra.tallied(a.join(F.broadcast(latest)), ["gateway", "currency"], weight)
    return out.select("gateway", "currency", F.round("n", 4).alias("weight"), F.round(F.col("s") / F.col("n"), 6).alias("rate"))


@query(f"""WITH {RATES_SQL}, m AS (SELECT rpgt, currency, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(n * pow(CAST(s AS DOUBLE) / n, 2)) AS q FROM cells GROUP BY ALL),
x AS (SELECT *, CAST(s AS DOUBLE) / n AS mu, greatest(q / n - pow(CAST(s AS DOUBLE) / n, 2), 0) - (CAST(s AS DOUBLE) / n) * (1 - CAST(s AS DOUBLE) / n) * k / n AS ex FROM m)
SELECT rpgt, currency, round(mu, 6) AS mu, round(CASE WHEN k < 2 THEN 50.0 WHEN mu <= 0 OR mu >= 1 THEN 50.0 WHEN ex <= 1e-9 THEN 5000.0 ELSE least(greatest(mu * (1 - mu) / ex - 1, 1.0), 5000.0) END, 3) AS kappa FROM x""")
def rates_moment_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ra.tallied(attempts(spark, sf_dir), [*CELL, "gateway"])
    return rounded(rounded(ra.moment_kappa(cells, ["rpgt", "currency"], 50.0), 6, "mu"), 3, "kappa")


@query(f"""WITH {RATES_SQL}, l0 AS (SELECT sum(s) * 1.0 / sum(n) AS rate FROM cells),
l1 AS (SELECT gateway, (sum(s) + 40.0 * any_value(rate)) / (sum(n) + 40.0) AS rate FROM cells, l0 GROUP BY ALL),
l2 AS (SELECT gateway, rpgt, (sum(s) + 40.0 * any_value(rate)) / (sum(n) + 40.0) AS rate FROM cells JOIN l1 USING (gateway) GROUP BY ALL),
l3 AS (SELECT gateway, rpgt, currency, (sum(s) + 40.0 * any_value(rate)) / (sum(n) + 40.0) AS rate FROM cells JOIN l2 USING (gateway, rpgt) GROUP BY ALL),
l4 AS (SELECT gateway, rpgt, currency, bank, (sum(s) + 40.0 * any_value(rate)) / (sum(n) + 40.0) AS rate FROM cells JOIN l3 USING (gateway, rpgt, currency) GROUP BY ALL)
SELECT gateway, rpgt, currency, bank, round(rate, 6) AS rate FROM l4""")
def rates_backed_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ra.tallied(attempts(spark, sf_dir), [*CELL, "gateway"])
    levels = [[], ["gateway"], ["gateway", "rpgt"], ["gateway", "rpgt", "currency"], ["gateway", "rpgt", "currency", "bank"]]
    return rounded(ra.backed_off(cells, levels, 40.0), 6, "rate")


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type <> 'error') AS s FROM events GROUP BY ALL),
r AS (SELECT *, max(CASE WHEN s > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS seen FROM d)
SELECT user_id, CAST(sum(CASE WHEN seen = 0 THEN n ELSE 0 END) AS BIGINT) AS run_attempts, max(CASE WHEN s > 0 THEN day END) AS last_success FROM r GROUP BY user_id HAVING sum(CASE WHEN seen = 0 THEN n ELSE 0 END) >= 1""")
def rates_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") != "error").cast("long")).alias("s"))
    return ra.blocked_pairs(daily, ["user_id"], 1)


@query(f"""WITH {RATES_SQL}, g AS (SELECT rpgt, currency, bank, max(success_rate) - min(success_rate) AS gap, sum(attempts) AS n FROM rates GROUP BY ALL HAVING count(DISTINCT gateway) >= 2)
SELECT rpgt, round(sum(gap * n) / sum(n), 6) AS sensitivity, count(*) AS cells FROM g GROUP BY rpgt""")
def rates_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ra.sensitivity(cell_rates(spark, sf_dir)), 6, "sensitivity")


@query(f"""WITH {ATTEMPTS_SQL}, c AS (SELECT rpgt, currency, gateway, count(*) AS txn, count(*) FILTER (NOT success) AS risk FROM attempts GROUP BY ALL)
SELECT rpgt, currency, gateway, txn, risk, round((risk + 500.0 * sum(risk) OVER (PARTITION BY rpgt) / sum(txn) OVER (PARTITION BY rpgt)) / (txn + 500.0), 6) AS risk_rate FROM c""")
def rates_pooled_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = attempts(spark, sf_dir).groupBy("rpgt", "currency", "gateway").agg(F.count(F.lit(1)).alias("txn"), F.sum((~F.col("success")).cast("long")).alias("risk"))
    return rounded(ra.pooled_risk(c, ["rpgt"]), 6, "risk_rate")


@query(f"""WITH {RATES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY rpgt, currency, bank ORDER BY success_rate DESC, gateway) AS r, success_rate * (1 - success_rate) / attempts AS v FROM rates)
SELECT rpgt, currency, bank, round(max(success_rate) - min(success_rate), 6) AS gap, round((max(success_rate) - min(success_rate)) / sqrt(sum(v)), 4) AS z FROM o WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2""")
def rates_top_two_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(ra.gap_z(cell_rates(spark, sf_dir)), 6, "gap"), 4, "z")


SPLIT_SQL = (
    RATES_SQL
    + """, e AS (SELECT *, exp(100 * 0.2 * (success_rate - risk_rate) - max(100 * 0.2 * (success_rate - risk_rate)) OVER w) AS e FROM rates WINDOW w AS (PARTITION BY rpgt, currency, bank)),
f AS (SELECT *, greatest(e / sum(e) OVER w, least(0.02, 1.0 / count(*) OVER w)) AS f FROM e WINDOW w AS (PARTITION BY rpgt, currency, bank)),
split AS (SELECT rpgt, currency, bank, gateway, attempts, success, success_rate, risk_rate, f / sum(f) OVER w AS share, CAST(attempts AS DOUBLE) / sum(attempts) OVER w AS baseline_share, CAST(sum(attempts) OVER w AS DOUBLE) AS volume FROM f WINDOW w AS (PARTITION BY rpgt, currency, bank))"""
)


def softmax_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax shares with the baseline shares and volumes of the cells."""
    return softmaxed(cell_rates(spark, sf_dir))


def softmaxed(rates: DataFrame) -> DataFrame:
    s = so.softmax_reference(rates, CELL, 0.2, 1.0, 0.02)
    total = F.sum("attempts").over(Window.partitionBy(*CELL))
    return s.withColumn("baseline_share", F.col("attempts") / total).withColumn("volume", total.cast("double"))


@query(f"WITH {SPLIT_SQL} SELECT rpgt, currency, bank, gateway, round(share, 6) AS share FROM split")
def split_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(softmax_split(spark, sf_dir).select(*CELL, "gateway", "share"), 6, "share")


@query(f"""WITH {RATES_SQL}, o AS (SELECT *, greatest(0.6, 1.0 / count(*) OVER (PARTITION BY rpgt, currency, bank)) AS cap, row_number() OVER (PARTITION BY rpgt, currency, bank ORDER BY success_rate DESC, gateway) - 1 AS k FROM rates)
SELECT rpgt, currency, bank, gateway, round(greatest(least(cap, 1 - cap * k), 0), 6) AS share FROM o""")
def split_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(so.greedy_reference(cell_rates(spark, sf_dir), CELL).select(*CELL, "gateway", "share"), 6, "share")


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cell_rates(spark, sf_dir).withColumn("banned", (F.col("gateway") == "gw_9") & (F.col("currency") == "BUILDING")).withColumn("forced", F.col("gateway") == "gw_1")
    return so.bounded(r, CELL)


@query(f"""WITH {RATES_SQL}, b AS (SELECT *, gateway = 'gw_9' AND currency = 'BUILDING' AS banned, gateway = 'gw_1' AS forced FROM rates),
u AS (SELECT *, CASE WHEN banned THEN 0.0 ELSE 0.97 END AS u, CASE WHEN forced AND NOT banned THEN 0.01 ELSE 0.0 END AS l FROM b)
SELECT rpgt, currency, bank, gateway, CAST(CASE WHEN sum(u) OVER w < 1 THEN CASE WHEN banned THEN 0.0 ELSE 1.0 END ELSE u END AS DOUBLE) AS upper, CAST(CASE WHEN sum(l) OVER w > 1 THEN l / sum(l) OVER w ELSE l END AS DOUBLE) AS lower
FROM u WINDOW w AS (PARTITION BY rpgt, currency, bank)""")
def split_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problems(spark, sf_dir).select(*CELL, "gateway", F.col("upper").cast("double").alias("upper"), F.col("lower").cast("double").alias("lower"))


@query()
def split_probability_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.solved(_problems(spark, sf_dir), CELL, "thompson", 0.05)


@query()
def split_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.solved(_problems(spark, sf_dir), CELL, "portfolio", 0.05)


@query()
def split_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.solved(_problems(spark, sf_dir), CELL, "entropy", 0.05)


@query(f"""WITH {SPLIT_SQL}, z AS (SELECT *, CASE WHEN stddev_pop(risk_rate) OVER w > 1e-12 THEN (risk_rate - avg(risk_rate) OVER w) / stddev_pop(risk_rate) OVER w ELSE 0 END AS zr, CASE WHEN stddev_pop(success_rate) OVER w > 1e-12 THEN (success_rate - avg(success_rate) OVER w) / stddev_pop(success_rate) OVER w ELSE 0 END AS zq FROM split WINDOW w AS (PARTITION BY rpgt, currency, bank)),
x AS (SELECT *, share * exp(-0.5 * zr + 0.3 * zq) AS x FROM z)
SELECT rpgt, currency, bank, gateway, round(zr, 4) AS z_risk, round(x / sum(x) OVER (PARTITION BY rpgt, currency, bank), 6) AS share FROM x""")
def split_tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pr.standardised(softmax_split(spark, sf_dir), CELL, "risk_rate", "z_risk")
    s = pr.standardised(s, CELL, "success_rate", "z_revenue")
    return rounded(rounded(pr.tilted(s, CELL, 0.5, 0.3).select(*CELL, "gateway", "z_risk", "share"), 6, "share"), 4, "z_risk")


@query(f"""WITH {SPLIT_SQL}, b AS (SELECT *, gateway IN ('gw_3', 'gw_4') AS blocked FROM split),
c AS (SELECT *, CASE WHEN blocked THEN greatest(share - 0.02, 0) ELSE 0 END AS cut FROM b),
o AS (SELECT *, sum(CASE WHEN blocked THEN 0 ELSE share END) OVER w AS open, sum(cut) OVER w AS freed FROM c WINDOW w AS (PARTITION BY rpgt, currency, bank))
SELECT rpgt, currency, bank, gateway, round(CASE WHEN open <= 0 THEN share WHEN blocked THEN share - cut ELSE share + freed * share / open END, 6) AS share FROM o""")
def split_blocked_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = softmax_split(spark, sf_dir).select(*CELL, "gateway", "share").withColumn("blocked", F.col("gateway").isin("gw_3", "gw_4"))
    return rounded(ra.blocked_capped(s, CELL, 0.02).select(*CELL, "gateway", "share"), 6, "share")


@query(f"""WITH {SPLIT_SQL}, x AS (SELECT *, CASE WHEN lower(trim(gateway)) = 'gw_2' AND lower(trim(bank)) = 'nation_6' OR lower(trim(gateway)) = 'gw_5' THEN 0.0 ELSE share END AS s FROM split)
SELECT rpgt, currency, bank, gateway, round(CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE s END, 6) AS share FROM x WINDOW w AS (PARTITION BY rpgt, currency, bank)""")
def split_banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = softmax_split(spark, sf_dir).select(*CELL, "gateway", "share")
    ban = pr.ban_predicate([{"gateway": "gw_2", "bin": "NATION_6"}, {"gateway": "gw_5"}, {"gateway": "gw_6", "season": "x"}], s.columns)
    return rounded(pr.banned_out(s, ban, CELL), 6, "share")


@query(f"""WITH {SPLIT_SQL}, c AS (SELECT *, gateway NOT IN ('gw_0', 'gw_7') AS capable FROM split), a AS (SELECT *, sum(CASE WHEN capable THEN share ELSE 0 END) OVER (PARTITION BY rpgt, currency, bank) AS able FROM c)
SELECT rpgt, currency, bank, gateway, round(CASE WHEN able > 0 THEN 0.3 * (CASE WHEN capable THEN share ELSE 0 END) / able + 0.7 * share ELSE share END, 6) AS share FROM a""")
def split_capability_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = softmax_split(spark, sf_dir).select(*CELL, "gateway", "share").withColumn("capable", ~F.col("gateway").isin("gw_0", "gw_7")).withColumn("wallet_fraction", F.lit(0.3))
    return rounded(pr.capability_blend(s, CELL).select(*CELL, "gateway", "share"), 6, "share")


@query(f"""WITH {SPLIT_SQL}, m AS (SELECT *, gateway IN ('gw_1', 'gw_8') AS masked FROM split), n AS (SELECT *, sum(CASE WHEN masked THEN greatest(0.05 - share, 0) ELSE 0 END) OVER w AS need, sum(CASE WHEN masked THEN 0 ELSE share END) OVER w AS donors FROM m WINDOW w AS (PARTITION BY rpgt, currency, bank))
SELECT rpgt, currency, bank, gateway, round(CASE WHEN donors > 0 AND need <= donors THEN CASE WHEN masked THEN greatest(share, 0.05) ELSE share * (1 - need / donors) END ELSE share END, 6) AS share FROM n""")
def split_floored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = softmax_split(spark, sf_dir).select(*CELL, "gateway", "share")
    return rounded(pr.floored(s, CELL, F.col("gateway").isin("gw_1", "gw_8"), 0.05), 6, "share")


@query(f"""WITH {SPLIT_SQL} SELECT rpgt, currency, bank, max(volume) AS volume, round(sum(baseline_share * success_rate), 6) AS base_success, round(sum(share * success_rate), 6) AS new_success, round(sum(baseline_share * risk_rate), 6) AS base_risk, round(sum(share * risk_rate), 6) AS new_risk, round(sum(abs(share - baseline_share)) / 2, 6) AS moved FROM split GROUP BY ALL""")
def impact_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pr.impact(softmax_split(spark, sf_dir), CELL), 6, "base_success", "new_success", "base_risk", "new_risk", "moved")


@query(f"""WITH {SPLIT_SQL}, c AS (SELECT max(volume) AS v, sum(baseline_share * success_rate) AS bs, sum(share * success_rate) AS ns, sum(baseline_share * risk_rate) AS br, sum(share * risk_rate) AS nr, sum(abs(share - baseline_share)) / 2 AS m FROM split GROUP BY rpgt, currency, bank)
SELECT round(sum(v * bs) / sum(v), 6) AS base_success, round(sum(v * ns) / sum(v), 6) AS new_success, round(sum(v * br) / sum(v), 6) AS base_risk, round(sum(v * nr) / sum(v), 6) AS new_risk, round(sum(v * m) / sum(v), 6) AS moved FROM c""")
def impact_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pr.headline(pr.impact(softmax_split(spark, sf_dir), CELL)), 6, "base_success", "new_success", "base_risk", "new_risk", "moved")


@query(f"""WITH {SPLIT_SQL}, m AS (SELECT 'mid_' || right(gateway, 1) AS mid, sum(volume * share) AS txn, sum(volume * share * risk_rate) AS risk FROM split GROUP BY ALL),
b AS (SELECT *, greatest((risk / txn - 0.04) / 0.04, 0) AS over, greatest((100.0 - txn) / 100.0, 0) AS under FROM m)
SELECT mid, round(txn, 3) AS txn, round(risk / txn, 6) AS rate, round(CASE WHEN over > 1e-9 THEN 3 * (1 + 10 * over * over) ELSE 0 END, 4) AS rate_penalty, round(CASE WHEN under > 1e-9 THEN 2 * (1 + 10 * under * under) ELSE 0 END, 4) AS floor_penalty FROM b""")
def impact_band_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("volume") * F.col("share")
    m = softmax_split(spark, sf_dir).groupBy(F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))).alias("mid")).agg(F.sum(v).alias("txn"), F.sum(v * F.col("risk_rate")).alias("risk"))
    none = F.lit(None).cast("double")
    return m.select(
        "mid", F.round("txn", 3).alias("txn"), F.round(F.col("risk") / F.col("txn"), 6).alias("rate"),
        F.round(pr.band_penalty(F.col("risk") / F.col("txn"), none, F.lit(0.04), F.lit(3)), 4).alias("rate_penalty"), F.round(pr.band_penalty(F.col("txn"), F.lit(100.0), none, F.lit(2)), 4).alias("floor_penalty"),
    )


@query(f"""WITH {SPLIT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rpgt, currency, bank ORDER BY share DESC, gateway) AS k FROM split)
SELECT gateway, round(sum(volume * baseline_share), 3) AS before, round(sum(volume * share), 3) AS after, round(sum(CASE WHEN k = 1 THEN volume ELSE 0 END), 3) AS winner FROM r GROUP BY gateway""")
def impact_winner_takes_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("share"), "gateway"))
    s = softmax_split(spark, sf_dir).withColumn("k", k)
    total = lambda c, name: F.round(F.sum(c), 3).alias(name)
    return s.groupBy("gateway").agg(total(F.col("volume") * F.col("baseline_share"), "before"), total(F.col("volume") * F.col("share"), "after"), total(F.when(F.col("k") == 1, F.col("volume")).otherwise(0.0), "winner"))


@query(f"""WITH {SPLIT_SQL}, b AS (SELECT bank, sum(volume * baseline_share * success_rate) AS bs, sum(volume * share * success_rate) AS ns, sum(volume * share) AS v FROM split GROUP BY bank)
SELECT bank, round(bs / v, 6) AS base_success, round(ns / v, 6) AS new_success, round(100 * (ns - bs) / (SELECT sum(v) FROM b), 6) AS bridge_pp FROM b""")
def impact_bank_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    v = F.col("volume")
    b = softmax_split(spark, sf_dir).groupBy("bank").agg(F.sum(v * F.col("baseline_share") * F.col("success_rate")).alias("bs"), F.sum(v * F.col("share") * F.col("success_rate")).alias("ns"), F.sum(v * F.col("share")).alias("v"))
    every = F.sum("v").over(Window.partitionBy())  # one row for each bank
    return b.select("bank", F.round(F.col("bs") / F.col("v"), 6).alias("base_success"), F.round(F.col("ns") / F.col("v"), 6).alias("new_success"), F.round(100 * (F.col("ns") - F.col("bs")) / every, 6).alias("bridge_pp"))


def _shaved_sql(cap: float, rounds: int) -> str:
    """The same pass several times over: s0 holds the shares."""
    out = ["s0 AS (SELECT rpgt, currency, bank, gateway, 'mid_' || right(gateway, 1) AS mid, volume, risk_rate, share AS w FROM split)"]
    for k in range(1, rounds + 1):
        out.append(f"""m{k} AS (SELECT mid, sum(volume * w * risk_rate) / greatest(sum(volume * w), 1e-9) AS rate FROM s{k - 1} GROUP BY mid),
k{k} AS (SELECT s.*, rate > {cap} AS over, w * CASE WHEN rate > {cap} THEN {cap} / rate ELSE 1 END AS kept FROM s{k - 1} s JOIN m{k} USING (mid)),
t{k} AS (SELECT *, sum(CASE WHEN NOT over THEN kept ELSE 0 END) OVER c AS room, sum(w - kept) OVER c AS freed FROM k{k} WINDOW c AS (PARTITION BY rpgt, currency, bank)),
s{k} AS (SELECT rpgt, currency, bank, gateway, mid, volume, risk_rate, CASE WHEN room <= 0 THEN w WHEN over THEN kept ELSE kept * (1 + freed / room) END AS w FROM t{k})""")
    return ", ".join(out)


@query(f"WITH {SPLIT_SQL}, {_shaved_sql(0.0281, 4)} SELECT rpgt, currency, bank, gateway, round(w, 6) AS share FROM s4")
def split_rate_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = softmax_split(spark, sf_dir).withColumn("mid", F.concat(F.lit("mid_"), F.right("gateway", F.lit(1)))).select(*CELL, "gateway", "mid", "volume", "share", "risk_rate")
    return so.shaved(s, CELL, 0.0281).select(*CELL, "gateway", F.round("share", 6).alias("share"))


CHAIN = [["gateway"], ["rpgt"], ["bank"], ["bank", "rpgt"], ["bank", "rpgt", "currency"], ["bank", "rpgt", "currency", "gateway"]]


def _chain_sql() -> str:
    out = ["c0 AS (SELECT *, n - s AS f, (SELECT CAST(sum(n - s) AS DOUBLE) / sum(n) FROM cells) AS est FROM cells)"]
    for k, keys in enumerate(CHAIN, 1):
        by = ", ".join(keys)
        out.append(f"g{k} AS (SELECT {by}, CAST(sum(n) AS DOUBLE) AS gn, CAST(sum(n - s) AS DOUBLE) AS gf FROM cells GROUP BY ALL)")
        out.append(f"m{k} AS (SELECT count(*) AS k, sum(gf) / sum(gn) AS mu, sum(gn * pow(gf / gn, 2)) / sum(gn) AS q, sum(gn) AS n FROM g{k})")
        out.append(f"x{k} AS (SELECT k, mu, greatest(q - mu * mu, 0) - mu * (1 - mu) * k / n AS ex FROM m{k})")
        out.append(f"k{k} AS (SELECT CASE WHEN k < 2 THEN 50.0 WHEN mu <= 0 OR mu >= 1 THEN 5000.0 WHEN ex <= 1e-12 THEN 5000.0 ELSE least(greatest(mu * (1 - mu) / ex - 1, 1.0), 5000.0) END AS kappa FROM x{k})")
        out.append(f"c{k} AS (SELECT c.* EXCLUDE (est), (gf + kappa * est) / (gn + kappa) AS est FROM c{k - 1} c JOIN g{k} USING ({by}), k{k})")
    return ", ".join(out)


@query(f"WITH {RATES_SQL}, {_chain_sql()} SELECT rpgt, currency, bank, gateway, round(est, 6) AS rate FROM c{len(CHAIN)}")
def rates_refitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk rate of every cell and gateway, the bank's rate being the main support of thin cells."""
    a = attempts(spark, sf_dir).select(*CELL, "gateway", (~F.col("success")).alias("success"))
    return rounded(ra.refitted(ra.tallied(a, [*CELL, "gateway"]), CHAIN).select(*CELL, "gateway", "rate"), 6, "rate")


@query(f"""WITH {ATTEMPTS_SQL}, r AS (SELECT currency, bank, gateway, count(*) AS n, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS p FROM attempts GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY currency, bank ORDER BY p DESC, gateway) AS k, greatest(p * (1 - p), 1e-9) / least(n, 20.0) AS v FROM r),
z AS (SELECT currency, bank, CASE WHEN count(*) = 2 THEN greatest((max(p) - min(p)) / sqrt(sum(v)), 0) END AS z FROM o WHERE k <= 2 GROUP BY ALL), m AS (SELECT median(z) AS m FROM z)
SELECT currency, bank, round(z, 6) AS z, round(CASE WHEN z IS NULL OR m <= 1e-9 THEN 0.17 ELSE least(z * (0.17 / m), 0.3) END, 6) AS temperature FROM z, m""")
def rates_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax temperature of every bank and currency, anchored at the median cell."""
    each = attempts(spark, sf_dir).groupBy("currency", "bank", "gateway").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("s"))
    found = ra.temperatures(each.withColumn("success_rate", F.col("s") / F.col("attempts")), ["currency", "bank"], most=20.0)
    return rounded(found, 6, "z", "temperature")


@query(f"""WITH {SPLIT_SQL}, c AS (SELECT rpgt, currency, bank, CAST(round(max(volume), 6) AS DECIMAL(28, 6)) AS v, CAST(round(max(volume) * sum(abs(share - baseline_share)) / 2, 6) AS DECIMAL(28, 6)) AS m FROM split GROUP BY ALL)
SELECT rpgt, currency, bank, row_number() OVER w AS row, CAST(m AS DOUBLE) AS moved_volume, CAST(sum(m) OVER w AS DOUBLE) AS moved_so_far, CAST(sum(v) OVER w AS DOUBLE) AS volume_so_far FROM c WINDOW w AS (ORDER BY m DESC, rpgt, currency, bank ROWS UNBOUNDED PRECEDING)""")
def impact_moved_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which few cells move most of the volume: running totals over all cells."""
    return pr.moved_curve(pr.impact(softmax_split(spark, sf_dir), CELL), CELL)


@query(f"""WITH {SPLIT_SQL}, d(dial) AS (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)), s AS (SELECT dial, gateway, sum(volume * (dial * share + (1 - dial) * baseline_share)) AS v FROM split, d GROUP BY ALL),
t AS (SELECT gateway, v AS r FROM s WHERE dial = 1.0) SELECT CAST(dial AS DOUBLE) AS dial, round(50 * sum(abs(v - r)) / sum(r), 6) AS moved_pct FROM s JOIN t USING (gateway) GROUP BY ALL""")
def impact_moved_by_dial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cent of the volume that has to move as the dial leaves the proposed split for the baseline."""
    dials = F.explode(F.array(*[F.lit(k / 4) for k in range(5)]))
    s = softmax_split(spark, sf_dir).withColumn("dial", dials)
    mixed = s.withColumn("share", F.col("dial") * F.col("share") + (1 - F.col("dial")) * F.col("baseline_share"))
    return rounded(pr.moved_by_dial(mixed.select("dial", *CELL, "gateway", "volume", "share")), 6, "moved_pct")


def _priced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = softmax_split(spark, sf_dir).withColumn("mid", F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))))
    return pc.price_capped(s.select(*CELL, "gateway", "mid", "volume", "share", "risk_rate"), CELL, 0.0281, most=0.97)


@query()
def split_price_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split nearest to the softmax split in which no MID is over its risk rate."""
    return _priced(spark, sf_dir)[0].select(*CELL, "gateway", "mid", "reference", "share")


@query()
def split_price_capped_mids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MIDs' rates in that split, their prices, and whether each holds its cap."""
    return _priced(spark, sf_dir)[1]


CAPS = [("mid_1", 5900.0), ("mid_4", 7000.0), ("mid_7", 5000.0), ("mid_8", None)]
BANDS = [("mid_0", 100.0, None, 90.0, 1), ("mid_2", 100.0, 120.0, None, 1), ("mid_5", 50.0, 10.0, 45.0, 2), ("mid_6", 80.0, 79.0, 79.5, 2), ("mid_9", 10.0, 12.0, 20.0, None)]
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
BREACH_SQL = f"""{SPLIT_SQL}, s AS (SELECT *, 'mid_' || right(gateway, 1) AS mid, CASE WHEN CAST(right(gateway, 1) AS INTEGER) % 2 = 0 THEN 'a' ELSE 'b' END AS scheme, count(*) OVER (PARTITION BY rpgt, currency, bank) AS n FROM split),
caps(mid, cap) AS (VALUES {_values(CAPS)}), bands(mid, value, floor, ceiling, priority) AS (VALUES {_values(BANDS)}),
m0 AS (SELECT mid, scheme, sum(volume * share) AS volume, sum(volume * share * risk_rate) AS risk, sum(volume * baseline_share) AS base FROM s GROUP BY ALL), m AS (SELECT *, CASE WHEN base > 0 THEN base / (avg(base) FILTER (base > 0) OVER ()) ELSE 1 END AS weight FROM m0),
b AS (SELECT m.*, volume / base * value AS v, floor, ceiling, priority, weight * pow(5000.0, 1 - coalesce(priority, 1)) AS w FROM m JOIN bands USING (mid)),
found AS (SELECT 'rate_cap' AS kind, mid, scheme, NULL AS priority, risk / volume / 0.028 - 1 AS over, weight FROM m UNION ALL SELECT 'volume_cap', mid, scheme, NULL, volume / cap - 1, weight FROM m JOIN caps USING (mid)
  UNION ALL SELECT 'band_ceiling', mid, scheme, priority, v / ceiling - 1, w FROM b UNION ALL SELECT 'band_floor', mid, scheme, priority, 1 - v / floor, w FROM b
  UNION ALL SELECT 'max_share', mid, scheme, NULL, (share - 0.15) / 0.15, 1 FROM s UNION ALL SELECT 'floor', mid, scheme, NULL, (least(0.06, 1.0 / n) - share) / 0.06, 1 FROM s WHERE n >= 2),
breaches AS (SELECT *, (1 + 10 * over * over) * weight AS penalty FROM found WHERE over > 1e-9)"""


def _breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.right("gateway", F.lit(1))
    s = softmax_split(spark, sf_dir).withColumn("mid", F.concat(F.lit("mid_"), number)).withColumn("scheme", F.when(number.cast("int") % 2 == 0, "a").otherwise("b"))
    caps = spark.createDataFrame(CAPS, "mid string, cap double")
    bands = spark.createDataFrame(BANDS, "mid string, value double, floor double, ceiling double, priority int")
    return vi.breaches(s, CELL, 0.028, caps, bands, 0.15, 0.06)


@query(f"""WITH {BREACH_SQL}, r AS (SELECT kind, mid, scheme, coalesce(priority, 0) AS priority, over, penalty FROM breaches),
g AS (SELECT kind, mid, scheme, priority, GROUPING(kind, mid, scheme, priority) AS id, count(*) AS breaches, sum(penalty) AS penalty, max(over) AS worst, max(over) FILTER (kind NOT IN ('band_floor', 'floor')) AS shed, max((over, mid))[2] AS worst_mid FROM r GROUP BY GROUPING SETS ((), (kind), (mid), (kind, scheme), (kind, mid), (kind, priority)))
SELECT CASE id WHEN 15 THEN 'all' WHEN 7 THEN 'kind' WHEN 11 THEN 'mid' WHEN 5 THEN 'kind and scheme' WHEN 3 THEN 'kind and mid' ELSE 'kind and priority' END AS level, kind, mid, scheme, priority, breaches, round(penalty, 3) AS penalty, round(worst, 6) AS worst, round(shed, 6) AS worst_to_shed, worst_mid FROM g""")
def impact_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All breaches of the softmax split, added up by kind, MID, scheme and priority in one pass."""
    return rounded(rounded(vi.report(_breaches(spark, sf_dir)), 3, "penalty"), 6, "worst", "worst_to_shed")


@query(f"""WITH {RATES_SQL}, b AS (SELECT rpgt, currency, bank, count(*) AS k, CAST(sum(attempts) AS DOUBLE) AS n, CAST(sum(success) AS DOUBLE) AS s, sum(attempts * (CAST(success AS DOUBLE) / attempts) * (CAST(success AS DOUBLE) / attempts)) AS q FROM rates WHERE gateway < 'gw_6' GROUP BY ALL),
c AS (SELECT *, greatest(q - n * (s / n) * (s / n), 0) - (s / n) * (1 - s / n) * k AS spread FROM b), x AS (SELECT rpgt, currency, sum(s) / sum(n) AS mu, sum(n) FILTER (k >= 2) AS w, sum(spread) FILTER (k >= 2) AS x FROM c GROUP BY ALL)
SELECT rpgt, currency, round(mu, 6) AS mu, round(CASE WHEN w IS NULL OR mu <= 0 OR mu >= 1 THEN 50 WHEN x / w <= 1e-9 THEN 5000 ELSE least(greatest(mu * (1 - mu) / (x / w) - 1, 1), 5000) END, 3) AS kappa FROM x""")
def rates_within_bank_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of the prior from the spread of gateways within banks."""
    cells = ra.tallied(attempts(spark, sf_dir).where("gateway < 'gw_6'"), [*CELL, "gateway"])
    return rounded(rounded(ra.within_kappa(cells, ["rpgt", "currency"]), 6, "mu"), 3, "kappa")


@query(f"""WITH {SPLIT_SQL}, able AS (SELECT *, gateway <> 'gw_3' AS eligible FROM split), book AS (SELECT avg(risk_rate) AS m, stddev_pop(risk_rate) AS sd FROM able WHERE eligible),
tilted AS (SELECT *, share * exp(-0.4 * CASE WHEN eligible THEN (risk_rate - m) / sd ELSE 0 END) AS w FROM able, book) SELECT rpgt, currency, bank, gateway, round(w / sum(w) OVER (PARTITION BY rpgt, currency, bank), 6) AS share FROM tilted""")
def split_leaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split drawn to lower risk, standardised over the whole book."""
    s = softmax_split(spark, sf_dir).withColumn("eligible", F.col("gateway") != "gw_3")
    return rounded(pr.leaned(s, CELL, 0.4).select(*CELL, "gateway", "share"), 6, "share")


@query()
def split_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-risk splits of every cell at five positions of the slider."""
    return so.swept(_problems(spark, sf_dir), CELL, "portfolio", 0.02, [0.0, 0.25, 0.5, 0.75, 1.0])
