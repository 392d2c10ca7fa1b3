"""Forecast queries: mapping, volumes, curves, tails and shares.

Each query writes the monthly history once (``history``) and derives everything else from that small table.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions.columns import share_of
from switchyard.operators import forecast as fc
from switchyard.operators.relational import most_used
from switchyard.registry import query
from switchyard.sources.shared import written
from switchyard.sources.tables import ATTEMPTS_SQL, RISK_B_SQL, RISK_SQL, attempts, history, risk_of

# Units of the plan by transaction type.
MACRO = [("1-URGENT", 4000.0), ("2-HIGH", 3500.0), ("3-MEDIUM", 3000.0), ("5-LOW", 2500.0)]
MACRO_SQL = "macro(rpgt, units0) AS (VALUES " + ", ".join(f"('{r}', CAST({u} AS DOUBLE))" for r, u in MACRO) + ")"
MONTHS_SQL = "months(m) AS (SELECT CAST(range AS INTEGER) FROM range(6))"
MAPPING_SQL = ATTEMPTS_SQL + """, mapping AS (SELECT rpgt, currency, gateway, count(*) AS trx FROM attempts WHERE day >= DATE '1998-06-01' AND day < DATE '1998-09-01' GROUP BY ALL)"""


def mapping(h: DataFrame) -> DataFrame:
    """Transactions by profile of the three months before month 0."""
    return h.where("period between 1 and 3").groupBy("rpgt", "currency", "gateway").agg(F.sum("n").alias("trx"))


def macro(spark: SparkSession) -> DataFrame:
    """(rpgt, m, units): plan units, growing by 2 % a month."""
    rows = [(r, m, u * (1 + 0.02 * m)) for r, u in MACRO for m in range(6)]
    return spark.createDataFrame(rows, "rpgt string, m int, units double").coalesce(1)


@query(f"WITH {MAPPING_SQL} SELECT rpgt, currency, gateway, trx, round(CAST(trx AS DOUBLE) / sum(trx) OVER (PARTITION BY rpgt), 8) AS mapping_pct FROM mapping")
def forecast_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.mapping_percent(mapping(history(spark, sf_dir))).withColumn("mapping_pct", F.round("mapping_pct", 8))


@query(f"WITH {MAPPING_SQL} SELECT rpgt, currency, gateway, round(CASE gateway WHEN 'gw_1' THEN trx * 500.0 / sum(trx) OVER (PARTITION BY gateway) WHEN 'gw_4' THEN 0.0 ELSE trx END, 6) AS trx FROM mapping")
def forecast_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([("gw_1", 500.0), ("gw_4", 0.0)], "gateway string, target double")
    return fc.overridden(mapping(history(spark, sf_dir)), targets).select("rpgt", "currency", "gateway", F.round("trx", 6).alias("trx"))


VOLUME_SQL = MAPPING_SQL + f""", {MACRO_SQL}, {MONTHS_SQL}, volume AS (
  SELECT rpgt, currency, gateway, m, coalesce(units0 * (1 + 0.02 * m), 0) * trx / sum(trx) OVER (PARTITION BY rpgt, m) AS trx FROM mapping LEFT JOIN macro USING (rpgt), months)"""


def volume(h: DataFrame) -> DataFrame:
    """Forecast volume by month; types outside the plan get month rows of 0."""
    mapped = fc.mapping_percent(mapping(h)).drop("trx")
    planned = macro(h.sparkSession)
    types = mapped.select("rpgt").distinct()
    every = types.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(5)))).join(planned, ["rpgt", "m"], "left")
    return fc.forecast_volume(mapped, every)


@query(f"WITH {VOLUME_SQL} SELECT rpgt, currency, gateway, m, round(trx, 4) AS trx FROM volume")
def forecast_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(history(spark, sf_dir)).select("rpgt", "currency", "gateway", "m", F.round("trx", 4).alias("trx"))


@query(f"""WITH {VOLUME_SQL}, z AS (SELECT rpgt, sum(CASE WHEN m = 0 THEN trx ELSE 0 END) AS z FROM volume GROUP BY rpgt), mix(rpgt, ratio) AS (VALUES ('1-URGENT', 0.5), ('2-HIGH', 0.3), ('3-MEDIUM', 0.2))
SELECT rpgt, currency, gateway, m, round(CASE WHEN z > 0 THEN trx * 20000.0 * coalesce(ratio, 0) / z ELSE 0 END, 4) AS trx FROM volume JOIN z USING (rpgt) LEFT JOIN mix USING (rpgt)""")
def forecast_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = spark.createDataFrame([("1-URGENT", 0.5), ("2-HIGH", 0.3), ("3-MEDIUM", 0.2)], "rpgt string, ratio double")
    return fc.to_target(volume(history(spark, sf_dir)), 20000.0, mix).select("rpgt", "currency", "gateway", "m", F.round("trx", 4).alias("trx"))


def _curve_sql(keys: str, name: str) -> str:
    return f"""{name} AS (SELECT k.*, CAST(a.t AS INTEGER) AS t, coalesce(CAST(r AS DOUBLE) / nullif(total, 0), 0) AS pct, coalesce(r, 0) AS seen
  FROM (SELECT {keys}, sum(risk_count) AS total FROM risk_history WHERE period <= 6 GROUP BY ALL) k CROSS JOIN (SELECT range AS t FROM range(10)) a
  LEFT JOIN (SELECT {keys}, t, sum(risk_count) AS r FROM risk_history WHERE period <= 6 GROUP BY ALL) s USING ({keys}, t))"""


@query(f"WITH {RISK_SQL}, {_curve_sql('rpgt, currency', 'curve')} SELECT rpgt, currency, t, round(pct, 6) AS pct FROM curve")
def forecast_decay_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.decay_curve(risk_of(history(spark, sf_dir)), ["rpgt", "currency"]).select("rpgt", "currency", "t", F.round("pct", 6).alias("pct"))


@query(f"""WITH {RISK_SQL}, {_curve_sql('rpgt, currency, gateway', 'fine')}, {_curve_sql('rpgt, currency', 'base')}, w AS (SELECT rpgt, currency, gateway, sum(risk_count) AS weight FROM risk_history WHERE period <= 6 GROUP BY ALL)
SELECT rpgt, currency, gateway, t, round(CASE WHEN weight < 50 AND base.pct IS NOT NULL THEN base.pct ELSE fine.pct END, 6) AS pct FROM fine JOIN w USING (rpgt, currency, gateway) LEFT JOIN base USING (rpgt, currency, t)""")
def forecast_curve_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.curves_with_base(risk_of(history(spark, sf_dir)), ["rpgt", "currency", "gateway"], ["rpgt", "currency"]).withColumn("pct", F.round("pct", 6))


TXN_SQL = """txn AS (SELECT CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, rpgt, currency, gateway, count(*) AS txn_count FROM attempts WHERE (1998 - year(day)) * 12 + 9 - month(day) BETWEEN 0 AND 8 GROUP BY ALL)"""


def txn_history(h: DataFrame) -> DataFrame:
    return h.groupBy("period", "rpgt", "currency", "gateway").agg(F.sum("n").alias("txn_count"))


RATE0_SQL = f"""{TXN_SQL}, rate0 AS (SELECT rpgt, currency, coalesce(coalesce(r, 0) / nullif(v, 0), 0) AS rate0 FROM (SELECT rpgt, currency, sum(txn_count * pow(0.8, period)) AS v FROM txn WHERE period < 6 GROUP BY ALL)
  LEFT JOIN (SELECT rpgt, currency, sum(risk_count * pow(0.8, period)) AS r FROM risk_history WHERE period < 6 AND t = 0 GROUP BY ALL) USING (rpgt, currency))"""


@query(f"WITH {RISK_SQL}, {RATE0_SQL} SELECT rpgt, currency, round(rate0, 6) AS rate0 FROM rate0")
def forecast_base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return fc.base_rate(risk_of(h), txn_history(h), ["rpgt", "currency"]).withColumn("rate0", F.round("rate0", 6))


FACTOR_SQL = """pairs AS (SELECT rpgt, currency, CAST(t + p AS INTEGER) AS age, CAST(p AS INTEGER) AS period, t, seen, total FROM curve CROSS JOIN (SELECT range AS p FROM range(7)) WHERE t + p BETWEEN 1 AND 9),
factor AS (SELECT rpgt, currency, age, coalesce(CAST(sum(coalesce(r, 0)) * any_value(total) AS DOUBLE) / nullif(sum(seen), 0), 0) AS factor FROM pairs LEFT JOIN (SELECT rpgt, currency, period, t, sum(risk_count) AS r FROM risk_history GROUP BY ALL) USING (rpgt, currency, period, t) GROUP BY ALL)"""


@query(f"WITH {RISK_SQL}, {_curve_sql('rpgt, currency', 'curve')}, {FACTOR_SQL} SELECT rpgt, currency, age, round(factor, 4) AS factor FROM factor")
def forecast_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = risk_of(history(spark, sf_dir))
    return fc.extrapolation(h, fc.decay_curve(h, ["rpgt", "currency"]), ["rpgt", "currency"]).withColumn("factor", F.round("factor", 4))


DAYS = [31, 30, 31, 30, 31, 31]
_TAILS = f""", {_curve_sql('rpgt, currency', 'curve')}, {FACTOR_SQL}, {RATE0_SQL}, mapping AS (SELECT rpgt, currency, gateway, count(*) AS trx FROM attempts WHERE day >= DATE '1998-06-01' AND day < DATE '1998-09-01' GROUP BY ALL), {MACRO_SQL}, {MONTHS_SQL},
volume AS (SELECT rpgt, currency, gateway, m, coalesce(units0 * (1 + 0.02 * m), 0) * trx / sum(trx) OVER (PARTITION BY rpgt, m) AS trx FROM mapping LEFT JOIN macro USING (rpgt), months),
sold AS (SELECT rpgt, currency, m, sum(trx) AS trx FROM volume GROUP BY ALL), days(m, days) AS (VALUES {", ".join(f"({m}, {d})" for m, d in enumerate(DAYS))}),
c0 AS (SELECT rpgt, currency, pct AS c0 FROM curve WHERE t = 0),
raw AS (SELECT rpgt, currency, m, t, sum(raw) AS raw FROM (
  SELECT rpgt, currency, m + t AS m, t, CASE WHEN c0 > 0 THEN trx * rate0 / c0 * pct WHEN t = 0 THEN trx * rate0 ELSE 0 END AS raw FROM sold JOIN rate0 USING (rpgt, currency) JOIN curve USING (rpgt, currency) JOIN c0 USING (rpgt, currency) WHERE m + t < 6
  UNION ALL SELECT rpgt, currency, t - age AS m, t, factor * pct FROM factor JOIN curve USING (rpgt, currency) WHERE t >= age AND t - age < 6) GROUP BY ALL),
risk AS (SELECT rpgt, currency, CAST(m AS INTEGER) AS m, CAST(t AS INTEGER) AS t, sum(x) AS risk FROM (SELECT rpgt, currency, m, t, raw * days / 30.4167 AS x FROM raw JOIN days USING (m) UNION ALL SELECT rpgt, currency, m + 1, t + 1, raw * (1 - days / 30.4167) FROM raw JOIN days USING (m) WHERE m + 1 < 6 AND t + 1 < 10) GROUP BY ALL)"""
TAILS_SQL, TAILS_B_SQL = RISK_SQL + _TAILS, RISK_B_SQL + _TAILS


def risk_tails(h: DataFrame, scheme: str = "a") -> DataFrame:
    spark, keys, risk = h.sparkSession, ["rpgt", "currency"], risk_of(h, scheme)
    curves = written(fc.decay_curve(risk, keys), "curves")  # used several times; ten rows for each key
    sold = volume(h).groupBy(*keys, "m").agg(F.sum("trx").alias("trx"))
    days = spark.createDataFrame([(m, float(d)) for m, d in enumerate(DAYS)], "m int, days double")
    return fc.tails(sold, fc.base_rate(risk, txn_history(h), keys), curves, fc.extrapolation(risk, curves, keys), keys, days)


@query(f"WITH {TAILS_SQL} SELECT rpgt, currency, m, t, round(risk, 3) AS risk FROM risk")
def forecast_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_tails(history(spark, sf_dir)).withColumn("risk", F.round("risk", 3))


@query(f"WITH {TAILS_SQL} SELECT m, round(sum(risk), 2) AS risk FROM risk GROUP BY m")
def forecast_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_tails(history(spark, sf_dir)).groupBy("m").agg(F.round(F.sum("risk"), 2).alias("risk"))


SHARES_SQL = """future AS (SELECT rpgt || '|' || currency AS prof, gateway, sum(trx) AS f FROM volume GROUP BY ALL), past AS (SELECT rpgt || '|' || currency AS prof, gateway, period, sum(txn_count) AS n FROM txn GROUP BY ALL),
both_ AS (SELECT coalesce(future.prof, h.prof) AS prof, coalesce(future.gateway, h.gateway) AS gateway, coalesce(f, 0) AS f, coalesce(h, 0) AS h FROM future FULL JOIN (SELECT prof, gateway, sum(n) AS h FROM past GROUP BY ALL) h ON future.prof = h.prof AND future.gateway = h.gateway),
raws AS (SELECT prof, gateway, CASE WHEN sum(f) OVER w > 0 THEN f WHEN sum(h) OVER w > 0 THEN h ELSE 1 END AS raw FROM both_ WINDOW w AS (PARTITION BY prof)), shares AS (SELECT prof, gateway, raw / sum(raw) OVER (PARTITION BY prof) AS share FROM raws)"""


def future_shares(h: DataFrame) -> DataFrame:
    prof = F.concat_ws("|", "rpgt", "currency").alias("prof")
    v = volume(h).groupBy(prof, "gateway").agg(F.sum("trx").alias("trx"))
    past = txn_history(h).groupBy(prof, "gateway").agg(F.sum("txn_count").alias("txn_count"))
    return fc.waterfall_shares(v, past)


@query(f"WITH {VOLUME_SQL}, {TXN_SQL}, {SHARES_SQL} SELECT prof, gateway, round(share, 6) AS share FROM shares")
def forecast_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return future_shares(history(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"""WITH {TAILS_SQL}, {SHARES_SQL}, pshare AS (SELECT prof, gateway, period, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY prof, period) AS ps FROM past)
SELECT r.prof, s.gateway, m, t, round(risk * CASE WHEN m >= t THEN share ELSE coalesce(ps, share) END, 4) AS risk FROM (SELECT rpgt || '|' || currency AS prof, m, t, risk FROM risk) r JOIN shares s ON r.prof = s.prof LEFT JOIN pshare p ON p.prof = r.prof AND p.gateway = s.gateway AND p.period = t - m - 1""")
def forecast_origin_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, prof = history(spark, sf_dir), F.concat_ws("|", "rpgt", "currency").alias("prof")
    past = txn_history(h).groupBy(prof, "gateway", "period").agg(F.sum("txn_count").alias("n")).withColumn("share", share_of("n", ["prof", "period"])).drop("n")
    risk = risk_tails(h).select(prof, "m", "t", "risk")
    return fc.origin_locked(risk, future_shares(h), past).withColumn("risk", F.round("risk", 4))


@query(f"""WITH {TAILS_SQL}, l AS (SELECT rpgt, currency, t, sum(risk_count) * 31 / 30.4167 AS risk FROM risk_history WHERE period = 0 GROUP BY ALL)
SELECT rpgt, currency, CAST(m AS INTEGER) AS m, t, round(sum(risk), 3) AS risk FROM (SELECT rpgt, currency, m + 1 AS m, t, risk FROM risk WHERE m + 1 < 6 UNION ALL SELECT rpgt, currency, 0, t, risk FROM l) GROUP BY ALL""")
def forecast_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    last = risk_of(h).where("period = 0").groupBy("rpgt", "currency", "t").agg(F.sum("risk_count").alias("risk_count"))
    return fc.shifted(risk_tails(h), last, ["rpgt", "currency"], 31).withColumn("risk", F.round("risk", 3))


@query(f"WITH {RISK_SQL}, l AS (SELECT min(period) AS l FROM risk_history WHERE period > 1) SELECT CAST(period - l AS INTEGER) AS period, sum(risk_count) AS risk FROM risk_history, l WHERE period > 1 GROUP BY ALL")
def forecast_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.aligned(risk_of(history(spark, sf_dir)).where("period > 1")).groupBy("period").agg(F.sum("risk_count").alias("risk"))


# The second scheme: another risk event through the same operators.


@query(f"WITH {RISK_B_SQL}, {_curve_sql('rpgt, currency', 'curve')} SELECT rpgt, currency, t, round(pct, 6) AS pct FROM curve")
def forecast_decay_curve_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fc.decay_curve(risk_of(history(spark, sf_dir), "b"), ["rpgt", "currency"]).select("rpgt", "currency", "t", F.round("pct", 6).alias("pct"))


@query(f"WITH {TAILS_B_SQL} SELECT rpgt, currency, m, t, round(risk, 3) AS risk FROM risk")
def forecast_tails_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_tails(history(spark, sf_dir), "b").withColumn("risk", F.round("risk", 3))


@query(f"""WITH {TAILS_B_SQL}, l AS (SELECT rpgt, currency, t, sum(risk_count) * 31 / 30.4167 AS risk FROM risk_history WHERE period = 0 GROUP BY ALL)
SELECT rpgt, currency, CAST(m AS INTEGER) AS m, t, round(sum(risk), 3) AS risk FROM (SELECT rpgt, currency, m + 1 AS m, t, risk FROM risk WHERE m + 1 < 6 UNION ALL SELECT rpgt, currency, 0, t, risk FROM l) GROUP BY ALL""")
def forecast_shifted_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    last = risk_of(h, "b").where("period = 0").groupBy("rpgt", "currency", "t").agg(F.sum("risk_count").alias("risk_count"))
    return fc.shifted(risk_tails(h, "b"), last, ["rpgt", "currency"], 31).withColumn("risk", F.round("risk", 3))


@query(f"""WITH {ATTEMPTS_SQL}, profs AS (SELECT DISTINCT rpgt, currency, bank FROM attempts), known AS (SELECT DISTINCT rpgt, currency, bank FROM attempts WHERE day >= DATE '1998-06-01' AND day < DATE '1998-06-04'),
lost AS (SELECT * FROM profs EXCEPT SELECT * FROM known), a AS (SELECT rpgt, currency, bank, gateway, count(*) AS n FROM attempts WHERE success AND day >= DATE '1998-01-01' GROUP BY ALL),
a1 AS (SELECT rpgt, currency, bank, gateway FROM a QUALIFY row_number() OVER (PARTITION BY rpgt, currency, bank ORDER BY n DESC, gateway) = 1),
b AS (SELECT bank, gateway, count(*) AS n FROM attempts WHERE day >= DATE '1995-01-01' GROUP BY ALL), b1 AS (SELECT bank, gateway FROM b WHERE bank <> 'NATION_6' QUALIFY row_number() OVER (PARTITION BY bank ORDER BY n DESC, gateway) = 1)
SELECT rpgt, currency, bank, coalesce(a1.gateway, b1.gateway, 'unmapped') AS gateway, 1.0::DOUBLE AS share FROM lost LEFT JOIN a1 USING (rpgt, currency, bank) LEFT JOIN b1 USING (bank)""")
def forecast_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles without a mapping get the gateway of their attempts, else the commonest of their bank, else ``unmapped``."""
    key = ["rpgt", "currency", "bank"]
    day = F.col("day")
    late = (day >= F.lit("1998-06-01").cast("date")) & (day < F.lit("1998-06-04").cast("date"))
    tallies = attempts(spark, sf_dir).groupBy(*key, "gateway").agg(F.count_if(late).alias("late"), F.count_if(F.col("success") & (day >= F.lit("1998-01-01").cast("date"))).alias("own"), F.count_if(day >= F.lit("1995-01-01").cast("date")).alias("of_bank"))
    a = written(tallies, "tallies")  # one scan; its size follows the keys
    known = a.where("late > 0").select(*key).distinct()
    own = most_used(a.where("own > 0"), key, "gateway", "own")
    by_bank = most_used(a.where("of_bank > 0 and bank <> 'NATION_6'").groupBy("bank", "gateway").agg(F.sum("of_bank").alias("of_bank")), ["bank"], "gateway", "of_bank")
    return fc.rescued(a.select(*key).distinct(), known, [(own, key), (by_bank, ["bank"])], key)


@query(f"""WITH {TAILS_SQL} SELECT rpgt, currency, m, round(sum(risk), 3) AS risk FROM (
  SELECT rpgt, currency, CAST(m AS INTEGER) AS m, risk FROM risk UNION ALL SELECT rpgt, currency, CAST(-period AS INTEGER) AS m, CAST(risk_count AS DOUBLE) AS risk FROM risk_history WHERE period BETWEEN 0 AND 3) GROUP BY ALL""")
def forecast_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History (months up to 0) and forecast in one table."""
    h = history(spark, sf_dir)
    past = risk_of(h).where("period between 0 and 3").select("rpgt", "currency", (-F.col("period")).cast("int").alias("m"), F.col("risk_count").cast("double").alias("risk"))
    return fc.joined_history(past, risk_tails(h).select("rpgt", "currency", "m", "risk"), ["rpgt", "currency", "m"], "risk").withColumn("risk", F.round("risk", 3))


INHERIT = {"5-LOW": "3-MEDIUM", "4-NOT SPECIFIED": "2-HIGH"}  # types whose curve another type's stands in for


@query(f"""WITH {RISK_SQL}, own AS (SELECT * FROM risk_history WHERE rpgt NOT IN ('5-LOW', '4-NOT SPECIFIED') OR length(currency) <> 8), {_curve_sql('rpgt, currency', 'curve').replace('FROM risk_history', 'FROM own')},
want AS (SELECT DISTINCT rpgt, currency, CASE rpgt WHEN '5-LOW' THEN '3-MEDIUM' WHEN '4-NOT SPECIFIED' THEN '2-HIGH' END AS other FROM risk_history), ages AS (SELECT CAST(range AS INTEGER) AS t FROM range(10))
SELECT w.rpgt, w.currency, ages.t, round(coalesce(c.pct, i.pct, 0), 6) AS pct FROM want w CROSS JOIN ages LEFT JOIN curve c ON c.rpgt = w.rpgt AND c.currency = w.currency AND c.t = ages.t LEFT JOIN curve i ON i.rpgt = w.other AND i.currency = w.currency AND i.t = ages.t""")
def forecast_curve_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = risk_of(history(spark, sf_dir))
    own = risk.where("rpgt not in ('5-LOW', '4-NOT SPECIFIED') or length(currency) <> 8")
    out = fc.inherited(risk.select("rpgt", "currency").distinct(), fc.decay_curve(own, ["rpgt", "currency"]), INHERIT, ["currency"])
    return out.withColumn("pct", F.round("pct", 6))


@query(f"""WITH {ATTEMPTS_SQL}, v AS (SELECT rpgt, currency, gateway, count(*) AS n FROM attempts WHERE day >= DATE '1998-08-01' AND day < DATE '1998-09-01' GROUP BY ALL),
d(gateway, end_day) AS (VALUES ('gw_1', NULL), ('gw_2', 10), ('gw_3', 20)), k AS (SELECT v.*, d.gateway AS dead, end_day FROM v LEFT JOIN d USING (gateway)),
s AS (SELECT *, CAST(n AS DOUBLE) * CASE WHEN end_day IS NULL THEN 1 ELSE 31.0 / end_day END AS x FROM k WHERE dead IS NULL OR end_day IS NOT NULL)
SELECT rpgt, currency, gateway, round(x / sum(x) OVER (PARTITION BY rpgt, currency), 6) AS share, 'Actuals' AS rule_source FROM s""")
def forecast_actual_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    deaths = spark.createDataFrame([("gw_1", None), ("gw_2", 10), ("gw_3", 20)], "gateway string, end_day int")
    v = attempts(spark, sf_dir, datetime.date(1998, 8, 1), datetime.date(1998, 9, 1)).groupBy("rpgt", "currency", "gateway").agg(F.count(F.lit(1)).alias("n"))
    return fc.actual_rules(v, deaths, ["rpgt", "currency"], 31).withColumn("share", F.round("share", 6))
