"""Queries that bind the column functions and the reports."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import columns as co
from switchyard.operators import forecast as fc
from switchyard.operators import relational as rl
from switchyard.operators import reports as rp
from switchyard.plans.effects import GRAIN_SQL, PROJECTED_SQL, projection
from switchyard.plans.forecasting import VOLUME_SQL, txn_history, volume
from switchyard.registry import query
from switchyard.sources.tables import ATTEMPTS_SQL, MONTH0, attempts, history, table

CARDS = "CASE p_size % 9 WHEN 0 THEN 'debit nyce' WHEN 1 THEN 'pulse star' WHEN 2 THEN 'mc_google_pay' WHEN 3 THEN 'mc_applepay' WHEN 4 THEN 'maestro_usa' WHEN 5 THEN 'old maestro' WHEN 6 THEN 'visa gold' WHEN 7 THEN NULL ELSE 'plain' END"


@query(f"""WITH x AS (SELECT {CARDS} AS card, CASE WHEN p_partkey % 2 = 0 THEN 'amex' ELSE 'diners' END AS account, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 5 END AS renewal, p_brand AS company FROM part)
SELECT CASE WHEN card LIKE '%nyce%' THEN 'nyce' WHEN card LIKE '%pulse%' THEN 'pulse' WHEN card LIKE '%accel%' THEN 'accel' WHEN card LIKE '%star%' THEN 'star' WHEN card LIKE '%mc\\_google\\_pay%' ESCAPE '\\' THEN 'mastercard' WHEN card LIKE '%mc\\_applepay%' ESCAPE '\\' THEN 'mastercard' WHEN card LIKE '%maestro%' OR card LIKE '%mastercard%' THEN 'mastercard' WHEN card LIKE '%visa%' THEN 'visa' ELSE account END AS scheme,
CASE WHEN company <> 'Brand#11' AND CAST(renewal AS VARCHAR) IN ('1', '2', '3') THEN 'sticky' ELSE 'non_sticky' END AS sticky, CASE WHEN renewal <> 1 THEN '2+' ELSE '1' END AS attempt, count(*) AS n FROM x GROUP BY ALL""")
def classify_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select(F.expr(CARDS).alias("card"), F.when(k % 2 == 0, "amex").otherwise("diners").alias("account"), F.when(k % 5 != 0, k % 5).alias("renewal"), F.col("p_brand").alias("company"))
    return x.groupBy(co.card_scheme(F.col("card"), F.col("account")).alias("scheme"), co.sticky_flag(F.col("renewal"), F.col("company"), "Brand#11").alias("sticky"), co.first_payment_flag(F.col("renewal")).alias("attempt")).agg(F.count(F.lit(1)).alias("n"))


GROUPS = {"1-URGENT": {"south": ["NATION_1", "NATION_2"], "north": ["nation_3"]}, "2-HIGH": {"all": ["NATION_4"]}}
LEVELS = {"1-URGENT": ["rpgt"]}


@query(f"""WITH {ATTEMPTS_SQL} SELECT CASE WHEN rpgt = '1-URGENT' AND lower(bank) IN ('nation_1', 'nation_2') THEN rpgt || '|south' WHEN rpgt = '1-URGENT' AND lower(bank) = 'nation_3' THEN rpgt || '|north' WHEN rpgt = '2-HIGH' AND lower(bank) = 'nation_4' THEN currency || '|' || rpgt || '|all' ELSE currency || '|' || rpgt END AS key, count(*) AS n FROM attempts GROUP BY ALL""")
def key_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = co.poly_key(["currency", "rpgt"], GROUPS, LEVELS, F.col("rpgt"), F.col("bank"))
    return attempts(spark, sf_dir).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


NAMES = {"1-urgent": "Urgent", "5-low": "Low"}
OFF = {"GW_1-x": {"target": 0, "apply_to": "trx"}, "gw_2": {"target": 0, "apply_to": "risk"}, "gw_3": {"target": 5, "apply_to": "both"}, "gw_4 ": {"target": "0", "apply_to": "Both"}}
BANKS = {"nation_1": "Parent A", "NATION_2": "Parent A", "nation_3": "Parent B"}


@query(f"""WITH {ATTEMPTS_SQL}, x AS (SELECT CASE rpgt WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' ELSE rpgt END AS kind, CASE bank WHEN 'NATION_1' THEN 'Parent A' WHEN 'NATION_2' THEN 'Parent A' WHEN 'NATION_3' THEN 'Parent B' ELSE bank END AS parent,
CASE WHEN CAST(order_id AS VARCHAR) LIKE '4%' THEN 0 ELSE amount END AS amount, CASE WHEN success THEN 1 ELSE 0 END AS won FROM attempts WHERE gateway NOT IN ('gw_1', 'gw_4') AND currency NOT IN ('MACHINERY', 'FURNITURE') AND day >= DATE '1998-01-01')
SELECT kind, parent, count(*) AS n, round(sum(amount), 2) AS amount FROM x WHERE amount > 0 OR won > 0 GROUP BY ALL""")
def filter_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir, datetime.date(1998, 1, 1)).where(~F.col("gateway").isin(*co.switched_off(OFF)) & ~F.col("currency").isin("MACHINERY", "FURNITURE"))
    x = a.select(co.mapped(F.col("rpgt"), NAMES).alias("kind"), co.mapped(F.col("bank"), BANKS).alias("parent"), co.zeroed(F.col("amount"), F.col("order_id"), "4").alias("amount"), F.col("success").cast("int").alias("won"))
    return x.where(co.any_positive(F.col("amount"), F.col("won"))).groupBy("kind", "parent").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, currency, bank, provider, country, gateway, count(*) AS success_count, count(*) AS attempt_count FROM attempts WHERE day >= DATE '1998-08-01' AND day < DATE '1998-10-01' GROUP BY ALL""")
def extract_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir, datetime.date(1998, 8, 1), datetime.date(1998, 10, 1))
    return rp.recent(a.withColumn("period", co.month_diff(F.lit(MONTH0), F.col("day"))), ["rpgt", "currency", "bank", "provider", "country", "gateway"])


REPORT_SQL = f"WITH {GRAIN_SQL}, {PROJECTED_SQL}"


@query(f"{REPORT_SQL} SELECT mid, rpgt, period, t, round(sum(risk_pre), 6) AS risk_pre, round(sum(risk_post), 6) AS risk_post, round(sum(txn_pre), 6) AS txn_pre, round(sum(txn_post), 6) AS txn_post FROM projected GROUP BY ALL HAVING greatest(sum(risk_pre), sum(risk_post), sum(txn_pre), sum(txn_post)) > 0")
def report_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.rounded(rp.summed(projection(spark, sf_dir), ["mid", "rpgt", "period", "t"]), 6)


@query(f"""{REPORT_SQL} SELECT mid, rpgt, currency, period, round(sum(risk_pre), 6) AS risk_pre, round(sum(risk_post), 6) AS risk_post, round(sum(txn_pre), 6) AS txn_pre, round(sum(txn_post), 6) AS txn_post, round(sum(risk_post) - sum(risk_pre), 6) AS risk_diff, round(sum(txn_post) - sum(txn_pre), 6) AS txn_diff
FROM projected GROUP BY ALL HAVING greatest(sum(risk_pre), sum(risk_post), sum(txn_pre), sum(txn_post)) > 0""")
def report_granular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.granular(projection(spark, sf_dir), ["mid", "rpgt", "currency", "period"], 6)


def _effective_sql(keys: str, period: int) -> str:
    return f"""{REPORT_SQL}, e AS (SELECT {keys}, sum(risk_pre) AS rp, sum(risk_post) AS rq, sum(txn_pre) AS tp, sum(txn_post) AS tq FROM projected WHERE period = {period} GROUP BY ALL)
SELECT {keys}, round(tq, 4) AS forecast_sales, round(rq, 4) AS forecast_risk, round(coalesce(rq / nullif(tq, 0), 0), 6) AS forecast_rate, round(tp, 4) AS sim_sales, round(rp, 4) AS sim_risk, round(coalesce(rp / nullif(tp, 0), 0), 6) AS sim_rate FROM e WHERE tq > 5 OR rq > 1"""


@query(_effective_sql("mid, rpgt, currency", 0))
def report_effective_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.effective_rate(projection(spark, sf_dir), ["mid", "rpgt", "currency"], 0, 5.0)


@query(_effective_sql("mid, rpgt, currency, country", 1))
def report_effective_rate_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second scheme reports period 1 at a finer grain."""
    return rp.effective_rate(projection(spark, sf_dir), ["mid", "rpgt", "currency", "country"], 1, 5.0)


@query(f"""{REPORT_SQL}, w AS (SELECT mid, {", ".join(f"coalesce(sum(risk_pre) FILTER (period = {m}), 0) AS r{m}, coalesce(sum(risk_post) FILTER (period = {m}), 0) AS q{m}, coalesce(sum(txn_pre) FILTER (period = {m}), 0) AS t{m}, coalesce(sum(txn_post) FILTER (period = {m}), 0) AS u{m}" for m in range(6))} FROM projected GROUP BY mid),
h AS (SELECT CASE WHEN gateway = 'gw_9' THEN 'Unmapped' ELSE 'mid_' || right(gateway, 1) END AS mid, count(*) AS a, count(*) FILTER (success) AS s, count(*) FILTER (NOT success) AS v FROM attempts WHERE day >= DATE '1997-12-01' AND day < DATE '1998-01-01' GROUP BY ALL),
j AS (SELECT coalesce(w.mid, h.mid) AS mid, coalesce(a, 0) AS a, coalesce(s, 0) AS s, coalesce(v, 0) AS v, {", ".join(f"coalesce({c}{m}, 0) AS {c}{m}" for m in range(6) for c in "rqtu")} FROM w FULL JOIN h ON w.mid = h.mid)
SELECT mid, a AS attempts_pre, s AS transactions_pre, v AS risk_pre, round(CASE WHEN a > 0 THEN CAST(s AS DOUBLE) / a ELSE 0 END, 6) AS success_rate_pre, round(CASE WHEN s > 0 THEN CAST(v AS DOUBLE) / s ELSE 0 END, 6) AS risk_ratio_pre,
{", ".join(f"round(r{m}, 4) AS fc_risk_m{m}, round(t{m}, 4) AS fc_txn_m{m}, round(CASE WHEN t{m} > 0 THEN r{m} / t{m} ELSE 0 END, 6) AS fc_rate_m{m}, round(q{m}, 4) AS fc_risk_post_m{m}, round(u{m}, 4) AS fc_txn_post_m{m}" for m in range(6))} FROM j WHERE q0 > 0 OR s > 0 OR u0 > 0""")
def report_mid_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir, datetime.date(1997, 12, 1), datetime.date(1998, 1, 1))
    mid = F.when(F.col("gateway") == "gw_9", "Unmapped").otherwise(F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))))
    past = a.groupBy(mid.alias("mid")).agg(F.count(F.lit(1)).alias("attempts_pre"), F.sum(F.col("success").cast("long")).alias("transactions_pre"), F.sum((~F.col("success")).cast("long")).alias("risk_pre"))
    return rp.mid_level(projection(spark, sf_dir), past)


@query(f"""WITH {ATTEMPTS_SQL}, r AS (SELECT 'mid_' || right(gateway, 1) AS mid, bank, CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, CAST(least(greatest((year(day) - year(origin)) * 12 + month(day) - month(origin), 0), 9) AS INTEGER) AS t, count(*) FILTER (NOT success) AS risk, count(*) AS txn FROM attempts WHERE day >= DATE '1998-01-01' AND day < DATE '1998-10-01' GROUP BY ALL),
a AS (SELECT mid, bank, period + t AS origin, CAST(sum(risk) AS BIGINT) AS risk FROM r WHERE risk > 0 GROUP BY ALL), b AS (SELECT mid, bank, period AS origin, CAST(sum(txn) AS BIGINT) AS txn FROM r WHERE t = 0 GROUP BY ALL)
SELECT coalesce(a.mid, b.mid) AS mid, coalesce(a.bank, b.bank) AS bank, coalesce(a.origin, b.origin) AS origin, coalesce(risk, 0) AS risk, coalesce(txn, 0) AS txn FROM a FULL JOIN b ON a.mid = b.mid AND a.bank = b.bank AND a.origin = b.origin WHERE coalesce(a.origin, b.origin) BETWEEN 0 AND 5""")
def report_cohort_by_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir, ["bank", "gateway"]).withColumn("mid", F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))))
    rows = h.groupBy("mid", "bank", "period", "t").agg(F.sum(F.when(~F.col("success"), F.col("n")).otherwise(0)).alias("risk"), F.sum("n").alias("txn"))
    return rp.cohorts(rows, ["mid", "bank"])


@query(f"""WITH {ATTEMPTS_SQL}, g AS (SELECT gateway, sum(CAST(amount AS DECIMAL(18, 2))) AS amount FROM attempts WHERE success GROUP BY gateway) SELECT gateway, CAST(amount AS DOUBLE) AS amount, round(100 * CAST(amount AS DOUBLE) / CAST(sum(amount) OVER () AS DOUBLE), 6) AS per_cent FROM g ORDER BY amount DESC, gateway LIMIT 4""")
def report_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = attempts(spark, sf_dir).where("success").groupBy("gateway").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))
    return rp.contributors(g, "gateway", "amount", 4).withColumn("per_cent", F.round("per_cent", 6))


@query(f"""WITH {VOLUME_SQL}, txn AS (SELECT CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, rpgt, currency, gateway, count(*) AS txn_count FROM attempts WHERE day >= DATE '1998-01-01' AND day < DATE '1998-10-01' GROUP BY ALL),
past AS (SELECT rpgt || '|' || currency AS prof, gateway, period, sum(txn_count) AS n FROM txn WHERE NOT (period = 2 AND currency = 'BUILDING') GROUP BY ALL), deep AS (SELECT prof, gateway, sum(n) AS n FROM past WHERE NOT prof LIKE '2-HIGH%' GROUP BY ALL),
slots AS (SELECT DISTINCT prof, gateway, period FROM (SELECT rpgt || '|' || currency AS prof, gateway FROM volume), (SELECT CAST(range AS INTEGER) AS period FROM range(9))),
x AS (SELECT s.*, coalesce(p.n, 0) AS p, coalesce(d.n, 0) AS d FROM slots s LEFT JOIN past p ON p.prof = s.prof AND p.gateway = s.gateway AND p.period = s.period LEFT JOIN deep d ON d.prof = s.prof AND d.gateway = s.gateway),
r AS (SELECT *, CASE WHEN sum(p) OVER w > 0 THEN p WHEN sum(d) OVER w > 0 THEN d ELSE 1 END AS raw FROM x WINDOW w AS (PARTITION BY prof, period))
SELECT prof, gateway, period, round(CAST(raw AS DOUBLE) / sum(raw) OVER (PARTITION BY prof, period), 6) AS share FROM r""")
def forecast_period_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, prof = history(spark, sf_dir), F.concat_ws("|", "rpgt", "currency").alias("prof")
    past = txn_history(h).where("not (period = 2 and currency = 'BUILDING')").groupBy(prof, "gateway", "period").agg(F.sum("txn_count").alias("n"))
    deep = past.where("prof not like '2-HIGH%'").groupBy("prof", "gateway").agg(F.sum("n").alias("n"))
    return fc.period_shares(volume(h).select(prof, "gateway").distinct(), past, deep, 9).withColumn("share", F.round("share", 6))


@query(f"""WITH {ATTEMPTS_SQL}, c AS (SELECT rpgt, currency, bank, gateway, count(*) AS n FROM attempts GROUP BY ALL), f AS (SELECT rpgt, currency, gateway, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS rate FROM attempts WHERE day < DATE '1996-01-01' AND bank <> 'NATION_1' GROUP BY ALL HAVING count(*) >= 25), g AS (SELECT CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS rate FROM attempts)
SELECT rpgt, currency, bank, gateway, n, round(coalesce(f.rate, g.rate), 6) AS rate, f.rate IS NULL AS pooled FROM c LEFT JOIN f USING (rpgt, currency, gateway), g""")
def join_pooled_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, key = attempts(spark, sf_dir), ["rpgt", "currency", "gateway"]
    won = F.sum(F.col("success").cast("long")) / F.count(F.lit(1))
    fine = a.where("day < date'1996-01-01' and bank <> 'NATION_1'").groupBy(*key).agg(won.alias("rate"), F.count(F.lit(1)).alias("n")).where("n >= 25")
    cells = a.groupBy("rpgt", "currency", "bank", "gateway").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(a.agg(won.alias("_all"))))  # one row
    return rl.with_pool(cells, fine, key, "rate", F.col("_all")).drop("_all").withColumn("rate", F.round("rate", 6))
