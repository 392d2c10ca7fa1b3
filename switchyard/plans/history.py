"""History extracts: attempts, risk counts, mappings, month projections and benchmarks, one function for each family.

The scheme is a parameter: it picks the event predicate and the card filter.  ``as_of`` replaces the current date.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import AVERAGE_MONTH, month_diff, month_factor
from switchyard.operators.relational import first_of
from switchyard.registry import query
from switchyard.sources.io import cached_partitions
from switchyard.sources.shared import folder
from switchyard.sources.tables import ATTEMPTS_SQL, MONTH0, attempts, event


def attempts_extract(rows: DataFrame, start: datetime.date, end: datetime.date, gateways: list[str] | None = None) -> DataFrame:
    """Row-level attempts of [start, end) with success, failure and attempt flags and the bank's short name."""
    short = F.coalesce(F.try_element_at(F.split("bank", " "), F.lit(2)), F.col("bank"))
    out = rows.where((F.col("day") >= start) & (F.col("day") < end))
    out = out.where(F.col("gateway").isin(gateways)) if gateways else out
    return out.select("day", "rpgt", "currency", "gateway", F.upper(F.regexp_replace(F.trim(short), r"[^\w\s]", "")).alias("bank"), F.col("success").cast("int").alias("success"), (~F.col("success")).cast("int").alias("failure"), F.lit(1).alias("attempt"), F.round("amount", 2).alias("amount"), "order_id", "line_no")


def risk_counts(rows: DataFrame, scheme: str, keys: list[str], month0: datetime.date = MONTH0, months: int = 9) -> DataFrame:
    """Distinct events by keys, period and age (0 to 9), scaled to an average month by the latest origin's month."""
    period, age = month_diff(F.lit(month0), F.col("day")), F.least(F.greatest(month_diff(F.col("day"), F.col("origin")), F.lit(0)), F.lit(9))
    near = (F.col("day") >= F.add_months(F.lit(month0), -months)) & (F.col("day") < F.lit(month0))
    found = F.count_distinct(F.when(event(scheme), F.concat_ws("_", F.col("order_id").cast("string"), F.col("line_no").cast("string"))))
    return rows.where(near).groupBy(*keys, period.alias("period"), age.alias("t")).agg((found * month_factor(F.max("origin"))).alias("risk_count"))


def of_scheme(rows: DataFrame, scheme: str) -> DataFrame:
    """Rows of a scheme's cards: all for a, those of one provider for b."""
    return rows if scheme == "a" else rows.where("provider = 'O'")


def banded_weights(daily: DataFrame) -> DataFrame:
    """(month, dom, w): of counts ``n`` by month and day, each day's share of its month, averaged over the first day, the 2nd to 28th, and the rest."""
    share = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("month")))
    band = F.when(F.col("dom") == 1, "HIGH").when(F.col("dom") <= 28, "MID").otherwise("LOW")
    ready = daily.withColumn("share", share).withColumn("band", band)
    return ready.select("month", "dom", F.avg("share").over(Window.partitionBy("month", "band")).alias("w"))


def longterm_mapping(rows: DataFrame) -> DataFrame:
    """Distinct transactions by type, currency, gateway and company (a group of banks)."""
    company = F.when(F.col("bank").like("NATION\\_1%"), "group_a").when(F.col("bank").like("NATION\\_2_"), "group_u").otherwise("rest")
    return rows.groupBy("rpgt", "currency", "gateway", company.alias("company")).agg(F.count_distinct("order_id").alias("trx_count"))


COMPANY_SQL = "CASE WHEN bank LIKE 'NATION!_1%' ESCAPE '!' THEN 'group_a' WHEN bank LIKE 'NATION!_2_' ESCAPE '!' THEN 'group_u' ELSE 'rest' END"


def transaction_counts(rows: DataFrame, keys: list[str], month0: datetime.date = MONTH0, months: int = 9, scheme: str = "a") -> DataFrame:
    """Distinct transactions by keys and period, scaled by the latest record's month."""
    counted = F.col("order_id") if scheme == "a" else F.when(F.col("provider") == "O", F.col("order_id"))
    near = (F.col("day") >= F.add_months(F.lit(month0), -months)) & (F.col("day") < F.lit(month0))
    return rows.where(near).groupBy(*keys, month_diff(F.lit(month0), F.col("day")).alias("period")).agg((F.count_distinct(counted) * month_factor(F.max("day"))).alias("txn_count"))


def projected_month(rows: DataFrame, keys: list[str], as_of: datetime.date) -> DataFrame:
    """Month estimate: from day 14 on the month's own daily rate, before that the rate of the last 14 days, times the month's days.  Yesterday is the last complete day."""
    yesterday = as_of - datetime.timedelta(days=1)
    first, days = yesterday.replace(day=1), ((yesterday.replace(day=28) + datetime.timedelta(days=4)).replace(day=1) - datetime.timedelta(days=1)).day
    span = yesterday.day if yesterday.day >= 14 else 14
    start = first if yesterday.day >= 14 else yesterday - datetime.timedelta(days=13)
    return rows.where(F.col("day").between(start, yesterday)).groupBy(*keys).agg((F.count(F.lit(1)) * (days / span)).alias("projected"))


def macro_units(rows: DataFrame, plan: DataFrame, month: datetime.date, transactions: Column | None = None, purchases: Column | None = None) -> DataFrame:
    """Plan units times the ratio of transactions to purchases in the month before ``month``; a type without history keeps NULL."""
    transactions = F.count_distinct("order_id") if transactions is None else transactions
    purchases = F.count_distinct(F.when(F.col("success"), F.col("order_id"))) if purchases is None else purchases
    last = rows.where((F.col("day") >= F.add_months(F.lit(month), -1)) & (F.col("day") < F.lit(month)))
    ratio = last.groupBy("rpgt").agg(F.try_divide(transactions, purchases).alias("ratio"))
    return plan.join(ratio, "rpgt", "left").withColumn("fcst_units", F.col("units") * F.col("ratio"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT day, rpgt, currency, gateway, upper(regexp_replace(trim(coalesce(string_split(bank, ' ')[2], bank)), '[^\\w\\s]', '', 'g')) AS bank, CAST(success AS INTEGER) AS success, CAST(NOT success AS INTEGER) AS failure, 1 AS attempt, round(amount, 2) AS amount, order_id, line_no
FROM attempts WHERE day >= DATE '1998-03-01' AND day < DATE '1998-04-01' AND gateway IN ('gw_1', 'gw_2', 'gw_3')""")
def extract_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_extract(attempts(spark, sf_dir, datetime.date(1998, 3, 1), datetime.date(1998, 4, 1)), datetime.date(1998, 3, 1), datetime.date(1998, 4, 1), ["gw_1", "gw_2", "gw_3"])


def _risk_sql(keys: str, condition: str) -> str:
    return f"""WITH {ATTEMPTS_SQL} SELECT {keys}, CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, CAST(least(greatest((year(day) - year(origin)) * 12 + month(day) - month(origin), 0), 9) AS INTEGER) AS t,
round(count(DISTINCT CASE WHEN {condition} THEN CAST(order_id AS VARCHAR) || '_' || CAST(line_no AS VARCHAR) END) * 30.4167 / day(last_day(max(origin))), 4) AS risk_count FROM attempts WHERE day >= DATE '1997-12-01' AND day < DATE '1998-09-01' GROUP BY ALL"""


@query(_risk_sql("rpgt, currency, provider, country", "NOT success"))
def extract_risk_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_counts(attempts(spark, sf_dir, datetime.date(1997, 12, 1), MONTH0), "a", ["rpgt", "currency", "provider", "country"]).withColumn("risk_count", F.round("risk_count", 4))


@query(_risk_sql("rpgt, currency, provider, country", "NOT success AND provider = 'O'"))
def extract_risk_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_counts(attempts(spark, sf_dir, datetime.date(1997, 12, 1), MONTH0), "b", ["rpgt", "currency", "provider", "country"]).withColumn("risk_count", F.round("risk_count", 4))


@query(_risk_sql("rpgt, currency, gateway", "NOT success"))
def extract_risk_by_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_counts(attempts(spark, sf_dir, datetime.date(1997, 12, 1), MONTH0), "a", ["rpgt", "currency", "gateway"]).withColumn("risk_count", F.round("risk_count", 4))


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, currency, gateway, CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, round(count(DISTINCT order_id) * 30.4167 / day(last_day(max(day))), 4) AS txn_count
FROM attempts WHERE day >= DATE '1997-12-01' AND day < DATE '1998-09-01' GROUP BY ALL""")
def extract_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transaction_counts(attempts(spark, sf_dir, datetime.date(1997, 12, 1), MONTH0), ["rpgt", "currency", "gateway"]).withColumn("txn_count", F.round("txn_count", 4))


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, currency, gateway, {COMPANY_SQL} AS company, count(DISTINCT order_id) AS trx_count FROM attempts WHERE day >= DATE '1998-01-01' AND day < DATE '1998-07-01' GROUP BY ALL""")
def extract_longterm_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longterm_mapping(attempts(spark, sf_dir, datetime.date(1998, 1, 1), datetime.date(1998, 7, 1)))


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, currency, gateway, {COMPANY_SQL} AS company, count(DISTINCT order_id) AS trx_count FROM attempts WHERE provider = 'O' AND day >= DATE '1998-08-01' AND day < DATE '1998-09-01' GROUP BY ALL""")
def extract_longterm_mapping_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second scheme: its own cards in the last full month."""
    return longterm_mapping(of_scheme(attempts(spark, sf_dir, datetime.date(1998, 8, 1), MONTH0), "b"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, currency, gateway, CASE WHEN line_no = 1 THEN '1' ELSE '2+' END AS fcp, CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, round(count(DISTINCT CASE WHEN provider = 'O' THEN order_id END) * 30.4167 / day(last_day(max(day))), 4) AS txn_count
FROM attempts WHERE day >= DATE '1997-12-01' AND day < DATE '1998-09-01' GROUP BY ALL""")
def extract_transactions_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second scheme: only its cards count, but a key without them keeps a row of 0."""
    fcp = F.when(F.col("line_no") == 1, "1").otherwise("2+")
    rows = attempts(spark, sf_dir, datetime.date(1997, 12, 1), MONTH0).withColumn("fcp", fcp)
    return transaction_counts(rows, ["rpgt", "currency", "gateway", "fcp"], scheme="b").withColumn("txn_count", F.round("txn_count", 4))


@query(f"""WITH {ATTEMPTS_SQL}, plan(rpgt, units) AS (VALUES ('1-URGENT', 700.0::DOUBLE), ('3-MEDIUM', 600.0::DOUBLE), ('absent', 10.0::DOUBLE)), r AS (SELECT rpgt, CAST(count(DISTINCT (order_id, line_no)) AS DOUBLE) / nullif(count(DISTINCT order_id), 0) AS ratio FROM attempts WHERE amount > 0 AND success AND right(gateway, 2) <> '_9' AND day >= DATE '1998-08-01' AND day < DATE '1998-09-01' GROUP BY rpgt)
SELECT rpgt, units, round(ratio, 6) AS ratio, round(units * ratio, 4) AS fcst_units FROM plan LEFT JOIN r USING (rpgt)""")
def extract_macro_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second scheme: paid lines for each order of the last full month, without one kind of account."""
    plan = spark.createDataFrame([("1-URGENT", 700.0), ("3-MEDIUM", 600.0), ("absent", 10.0)], "rpgt string, units double")
    paid = attempts(spark, sf_dir, datetime.date(1998, 8, 1), MONTH0).where("amount > 0 AND success").where(~F.col("gateway").endswith("_9"))
    out = macro_units(paid, plan, MONTH0, F.count_distinct("order_id", "line_no"), F.count_distinct("order_id"))
    return out.select("rpgt", "units", F.round("ratio", 6).alias("ratio"), F.round("fcst_units", 4).alias("fcst_units"))


@query(f"""WITH {ATTEMPTS_SQL}, d AS (SELECT strftime(day, '%Y-%m') AS month, CAST(day(day) AS INTEGER) AS dom, count(DISTINCT CASE WHEN provider = 'O' THEN order_id END) AS n FROM attempts WHERE rpgt = '1-URGENT' AND currency IN ('BUILDING', 'MACHINERY') AND day >= DATE '1997-09-01' AND day < DATE '1998-09-01' GROUP BY ALL),
s AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY month) > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY month) END AS share FROM d)
SELECT month, dom, round(avg(share) OVER (PARTITION BY month, CASE WHEN dom = 1 THEN 'HIGH' WHEN dom <= 28 THEN 'MID' ELSE 'LOW' END), 8) AS weight FROM s""")
def extract_daily_weights_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second scheme: each day's share of a type's transactions in its month, averaged over the first day, the middle and the end."""
    rows = attempts(spark, sf_dir, datetime.date(1997, 9, 1), MONTH0).where("rpgt = '1-URGENT' AND currency IN ('BUILDING', 'MACHINERY')")
    n = F.count_distinct(F.when(F.col("provider") == "O", F.col("order_id")))
    daily = rows.groupBy(F.date_format("day", "yyyy-MM").alias("month"), F.dayofmonth("day").alias("dom")).agg(n.alias("n"))
    return banded_weights(daily).select("month", "dom", F.round("w", 8).alias("weight"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, round(count(*) * (30.0 / 20), 4) AS projected FROM attempts WHERE day BETWEEN DATE '1998-06-01' AND DATE '1998-06-20' GROUP BY rpgt""")
def extract_month_projection_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_month(attempts(spark, sf_dir), ["rpgt"], datetime.date(1998, 6, 21)).withColumn("projected", F.round("projected", 4))


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, round(count(*) * (30.0 / 14), 4) AS projected FROM attempts WHERE day BETWEEN DATE '1998-05-25' AND DATE '1998-06-07' GROUP BY rpgt""")
def extract_month_projection_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected_month(attempts(spark, sf_dir), ["rpgt"], datetime.date(1998, 6, 8)).withColumn("projected", F.round("projected", 4))


@query(f"""WITH {ATTEMPTS_SQL}, plan(rpgt, units) AS (VALUES ('1-URGENT', 900.0::DOUBLE), ('2-HIGH', 800.0::DOUBLE), ('absent', 10.0::DOUBLE)), r AS (SELECT rpgt, CAST(count(DISTINCT order_id) AS DOUBLE) / nullif(count(DISTINCT CASE WHEN success THEN order_id END), 0) AS ratio FROM attempts WHERE day >= DATE '1998-08-01' AND day < DATE '1998-09-01' GROUP BY rpgt)
SELECT rpgt, units, round(ratio, 6) AS ratio, round(units * ratio, 4) AS fcst_units FROM plan LEFT JOIN r USING (rpgt)""")
def extract_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.createDataFrame([("1-URGENT", 900.0), ("2-HIGH", 800.0), ("absent", 10.0)], "rpgt string, units double")
    out = macro_units(attempts(spark, sf_dir), plan, MONTH0)
    return out.select("rpgt", "units", F.round("ratio", 6).alias("ratio"), F.round("fcst_units", 4).alias("fcst_units"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT gateway, currency, count(*) AS attempts, count(*) FILTER (success) AS successes, round(sum(CASE WHEN success THEN amount ELSE 0 END), 2) AS revenue FROM attempts WHERE day >= DATE '1998-01-01' AND day < DATE '1998-04-01' GROUP BY ALL""")
def extract_processor_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir, datetime.date(1998, 1, 1), datetime.date(1998, 4, 1))
    return a.groupBy("gateway", "currency").agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.col("success").cast("long")).alias("successes"), F.round(F.sum(F.when(F.col("success"), F.col("amount")).otherwise(0.0)), 2).alias("revenue"))


@query(f"""WITH {ATTEMPTS_SQL}, x AS (SELECT DISTINCT payer, day, amount, order_id, line_no, country, row_number() OVER (PARTITION BY payer ORDER BY country = 'USA' DESC, day, order_id, line_no, amount) AS k FROM attempts)
SELECT payer, day, order_id, country FROM x WHERE k = 1""")
def extract_first_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.col("country") == "USA"), F.asc("day"), F.asc("order_id"), F.asc("line_no"), F.asc("amount")]
    return first_of(attempts(spark, sf_dir), ["payer"], order).select("payer", "day", "order_id", "country")


@query(f"""WITH {ATTEMPTS_SQL}, r AS (SELECT 'mid_' || right(gateway, 1) AS mid, CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, CAST(least(greatest((year(day) - year(origin)) * 12 + month(day) - month(origin), 0), 9) AS INTEGER) AS t, count(*) FILTER (NOT success) AS risk, count(*) AS txn FROM attempts WHERE (1998 - year(day)) * 12 + 9 - month(day) BETWEEN 0 AND 8 GROUP BY ALL)
SELECT a.mid, a.origin, a.risk, coalesce(b.txn, 0) AS txn FROM (SELECT mid, period + t AS origin, CAST(sum(risk) AS BIGINT) AS risk FROM r WHERE period + t BETWEEN 0 AND 5 GROUP BY ALL) a LEFT JOIN (SELECT mid, period AS origin, CAST(sum(txn) AS BIGINT) AS txn FROM r WHERE t = 0 GROUP BY ALL) b USING (mid, origin)""")
def report_cohort_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    period, age = month_diff(F.lit(MONTH0), F.col("day")), F.least(F.greatest(month_diff(F.col("day"), F.col("origin")), F.lit(0)), F.lit(9))
    a = attempts(spark, sf_dir, datetime.date(1998, 1, 1), datetime.date(1998, 10, 1)).select(F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))).alias("mid"), period.alias("period"), age.alias("t"), (~F.col("success")).cast("long").alias("risk")).where("period between 0 and 8")
    life = a.groupBy("mid", (F.col("period") + F.col("t")).alias("origin")).agg(F.sum("risk").alias("risk")).where("origin between 0 and 5")
    sold = a.where("t = 0").groupBy("mid", F.col("period").alias("origin")).agg(F.count(F.lit(1)).alias("txn"))
    return life.join(sold, ["mid", "origin"], "left").na.fill(0, ["txn"])


@query(f"""WITH {ATTEMPTS_SQL}, p AS (SELECT gateway, CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, success, amount FROM attempts)
SELECT gateway, {", ".join(f"count(*) FILTER (period = {k} AND NOT success) AS risk_{k}, count(*) FILTER (period = {k}) AS txn_{k}" for k in range(3))}, round(100.0 * count(*) FILTER (period = 0 AND NOT success) / nullif(count(*) FILTER (period = 0), 0), 4) AS rate_0 FROM p WHERE period BETWEEN 0 AND 2 GROUP BY gateway""")
def report_by_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = attempts(spark, sf_dir, datetime.date(1998, 7, 1), datetime.date(1998, 10, 1)).withColumn("period", month_diff(F.lit(MONTH0), F.col("day")))
    wide = p.groupBy("gateway").pivot("period", [0, 1, 2]).agg(F.sum((~F.col("success")).cast("long")).alias("risk"), F.count(F.lit(1)).alias("txn"))
    out = wide.select("gateway", *[F.coalesce(F.col(f"{k}_{v}"), F.lit(0)).cast("long").alias(f"{v}_{k}") for k in range(3) for v in ("risk", "txn")])
    return out.withColumn("rate_0", F.round(F.try_divide(100.0 * F.col("risk_0"), F.col("txn_0")), 4))


@query(f"""WITH {ATTEMPTS_SQL}, b AS (SELECT gateway, currency, CASE WHEN year(day) = 1997 THEN 'before' ELSE 'after' END AS w, count(*) AS n FROM attempts WHERE year(day) IN (1997, 1998) GROUP BY ALL), s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY currency, w) AS share FROM b)
SELECT gateway, count(DISTINCT CASE WHEN w = 'before' AND share > 0.1 THEN currency END) AS before, count(DISTINCT CASE WHEN w = 'after' AND share > 0.1 THEN currency END) AS after FROM s GROUP BY gateway""")
def report_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.functions.columns import share_of

    w = F.when(F.year("day") == 1997, "before").otherwise("after")
    b = attempts(spark, sf_dir, datetime.date(1997, 1, 1), datetime.date(1999, 1, 1)).groupBy("gateway", "currency", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", share_of("n", ["currency", "w"]))
    wide = lambda k: F.count_distinct(F.when((F.col("w") == k) & (F.col("share") > 0.1), F.col("currency"))).alias(k)
    return b.groupBy("gateway").agg(wide("before"), wide("after"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT gateway, CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period, round(count(*) FILTER (NOT success) * CAST(day(last_day(max(origin))) AS DOUBLE) / 30.4167, 4) AS raw FROM attempts WHERE (1998 - year(day)) * 12 + 9 - month(day) BETWEEN 0 AND 5 GROUP BY ALL""")
def report_raw_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = month_diff(F.lit(MONTH0), F.col("day"))
    a = attempts(spark, sf_dir, datetime.date(1998, 4, 1), datetime.date(1998, 10, 1)).withColumn("period", period)
    return a.groupBy("gateway", "period").agg(F.round(F.sum((~F.col("success")).cast("long")) * F.dayofmonth(F.last_day(F.max("origin"))).cast("double") / AVERAGE_MONTH, 4).alias("raw"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT strftime(day, '%Y-%m') AS month, lower(rpgt) || '|' || lower(currency) AS profile, count(*) AS n, count(*) FILTER (success) AS success FROM attempts WHERE day >= DATE '1998-02-01' AND day < DATE '1998-05-01' GROUP BY ALL""")
def extract_cached_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three months from a cache by month, of which an earlier call has left two: only the third is computed."""

    def compute(months: list[str]) -> DataFrame:
        first, last = min(months), max(months)
        since = datetime.date(int(first[:4]), int(first[5:]), 1)
        until = datetime.date(int(last[:4]) + int(last[5:]) // 12, int(last[5:]) % 12 + 1, 1)
        rows = attempts(spark, sf_dir, since, until).withColumn("month", F.date_format("day", "yyyy-MM"))
        return rows.groupBy("month", "rpgt", "currency").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("success"))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select("month", F.concat_ws("|", F.lower("rpgt"), F.lower("currency")).alias("profile"), "n", "success")

    path = f"{folder(spark)}/switchyard-{uuid.uuid4().hex}-months"
    cached_partitions(spark, path, "month", ["1998-01", "1998-02", "1998-03"], compute, keyed)
    found, _ = cached_partitions(spark, path, "month", ["1998-02", "1998-03", "1998-04"], compute, keyed)
    return found.select(F.col("month").cast("string").alias("month"), "profile", "n", "success")
