"""Queries that bind the relational helpers and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchyard.functions import columns as co
from switchyard.operators import relational as rl
from switchyard.plans.history import banded_weights
from switchyard.registry import query
from switchyard.sources.tables import ATTEMPTS_SQL, attempts, sold, table

# Attempts with every kind of field, from the lines' own numbers.
FIELDS_LIST = [
    "CASE WHEN l_returnflag = 'R' THEN 'refund' WHEN l_linenumber % 3 = 0 THEN 'auth' WHEN l_linenumber % 3 = 1 THEN 'capture' ELSE 'captureauth' END AS transaction",
    "CASE WHEN l_linestatus = 'O' THEN 'order' ELSE 'invoice' END AS payment",
    "CASE WHEN l_quantity = 48 THEN 80.0 WHEN l_quantity = 11 THEN NULL ELSE l_quantity END AS amount",
    "CASE l_suppkey % 4 WHEN 0 THEN 'paypal' WHEN 1 THEN 'creditcard' WHEN 2 THEN 'google_pay' ELSE 'voucher' END AS method",
    "CASE l_partkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE NULL END AS product_group",
    "CASE WHEN l_partkey % 2 = 0 THEN 'paypal' ELSE 'processor_a' END AS processor",
    "CASE WHEN l_orderkey % 2 = 0 THEN 'processor_b' ELSE 'other' END AS gateway_processor",
    "l_returnflag = 'A' AS success",
    "l_linenumber % 2 AS fcp",
    "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_suppkey % 2 END AS attempt",
    "l_suppkey % 5 AS attempt_number",
]
FIELDS = ", ".join(FIELDS_LIST)


def _arms() -> str:
    """The table of attempt types as SQL."""
    names, out = ("transaction", "payment", "amount", "method", "product_group", "processor", "gateway_processor"), []
    for kind, *asked in co.ATTEMPTS:
        parts = [f"({want.replace('a ', n + ' ')})" if want.startswith("a ") else f"{n} <> '{want[1:]}'" if want.startswith("!") else f"{n} IN ({', '.join(repr(x) for x in want.split(','))})" for n, want in zip(names, asked, strict=True) if want]
        out.append(f"WHEN {' AND '.join(parts)} THEN '{kind}'")
    return f"CASE {' '.join(out)} ELSE 'Error' END"


@query(f"WITH x AS (SELECT {FIELDS} FROM lineitem) SELECT {_arms()} AS rpgt, count(*) AS n, round(sum(amount), 2) AS amount FROM x GROUP BY ALL")
def classify_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = co.attempt_type(table(spark, sf_dir, "lineitem").selectExpr(*FIELDS_LIST))
    return x.groupBy("rpgt").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


FIRST = "(method <> 'paypal' AND fcp = 1 AND attempt = 1) OR (method = 'paypal' AND fcp = 1 AND attempt_number < 3)"


@query(f"WITH x AS (SELECT {FIELDS} FROM lineitem) SELECT method, count(*) FILTER ({FIRST}) AS attempts, count(*) FILTER (({FIRST}) AND success) AS successes, count(*) FILTER (({FIRST}) AND NOT success) AS failures FROM x GROUP BY ALL")
def classify_attempt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = co.attempt_flags(table(spark, sf_dir, "lineitem").selectExpr(*FIELDS_LIST))
    total = lambda c, name: F.sum(F.col(c).cast("long")).alias(name)
    return x.groupBy("method").agg(total("initial_attempt", "attempts"), total("initial_success", "successes"), total("initial_failure", "failures"))


@query("""WITH x AS (SELECT p_size % 4 AS rebill, CASE p_size % 3 WHEN 0 THEN 'P1M' WHEN 1 THEN 'P1Y' ELSE NULL END AS term, CASE WHEN p_size % 7 = 0 THEN 'upgrade' ELSE 'none' END AS action, CASE WHEN p_size % 11 = 0 THEN 'addon' ELSE 'base' END AS grp, CASE WHEN p_size % 13 = 0 THEN 'Refund' ELSE 'Sale' END AS record FROM part)
SELECT CASE WHEN rebill = 0 AND term IN ('P1M', 'P30D') THEN 'monthly initial' WHEN rebill = 0 AND term IN ('P1Y', 'P12M') THEN 'annual initial' WHEN rebill = 1 AND term IN ('P1M', 'P30D') THEN 'monthly first renewal' WHEN rebill > 1 AND term IN ('P1M', 'P30D') THEN 'monthly renewal'
  WHEN rebill > 0 AND term IN ('P1Y', 'P12M') THEN 'annual renewal' WHEN action = 'upgrade' AND grp <> 'addon' THEN 'upgrade' WHEN grp = 'addon' THEN 'addon' WHEN lower(record) = 'refund' THEN 'refund' ELSE 'Other' END AS rpgt, count(*) AS n FROM x GROUP BY ALL""")
def classify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    x = table(spark, sf_dir, "part").select(
        (s % 4).alias("rebill"), F.when(s % 3 == 0, "P1M").when(s % 3 == 1, "P1Y").alias("term"), F.when(s % 7 == 0, "upgrade").otherwise("none").alias("action"),
        F.when(s % 11 == 0, "addon").otherwise("base").alias("grp"), F.when(s % 13 == 0, "Refund").otherwise("Sale").alias("record"))
    return x.groupBy(co.record_type(*(F.col(c) for c in ("rebill", "term", "action", "grp", "record"))).alias("rpgt")).agg(F.count(F.lit(1)).alias("n"))


SCHEME = "CASE p_size % 6 WHEN 0 THEN 'Maestro Debit' WHEN 1 THEN 'MASTER_CARD' WHEN 2 THEN 'American Express' WHEN 3 THEN 'VISA' WHEN 4 THEN 'Unknown x' ELSE NULL END"
PROVIDER = "CASE p_size % 4 WHEN 0 THEN 'GOOGLE_PAY' WHEN 1 THEN 'applepay' WHEN 2 THEN 'card' ELSE NULL END"


@query(f"""WITH x AS (SELECT {SCHEME} AS s, {PROVIDER} AS p, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 3 END AS n, CASE p_size % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'DE' ELSE NULL END AS c FROM part)
SELECT CASE WHEN s IS NULL OR lower(s) LIKE '%unknown%' THEN 'unknown' WHEN lower(s) LIKE '%maestro%' OR lower(s) LIKE '%master_card%' THEN 'mastercard' WHEN lower(s) LIKE '%american%' AND lower(s) LIKE '%express%' THEN 'amex' ELSE lower(s) END AS account,
  CASE WHEN p NOT IN ('GOOGLE_PAY', 'applepay') THEN 'non_wallet' ELSE p END AS listed, CASE WHEN upper(p) LIKE '%GOOGLE%' THEN 'googlepay' WHEN upper(p) LIKE '%APPLE%' THEN 'applepay' ELSE 'non_wallet' END AS liked,
  CASE WHEN n <> 1 THEN '2+' ELSE '1' END AS fcp, CASE WHEN upper(c) IN ('US', 'USA') THEN 'USA' ELSE 'Non-USA' END AS country, count(*) AS n FROM x GROUP BY ALL""")
def classify_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    x = table(spark, sf_dir, "part").select(F.expr(SCHEME).alias("s"), F.expr(PROVIDER).alias("p"), F.when(s % 5 == 0, None).otherwise(s % 3).alias("n"), F.when(s % 3 == 0, "us").when(s % 3 == 1, "DE").alias("c"))
    return x.groupBy(
        co.account_type(F.col("s")).alias("account"), co.provider_listed(F.col("p"), ["GOOGLE_PAY", "applepay"]).alias("listed"), co.provider_like(F.col("p"), {"%GOOGLE%": "googlepay", "%APPLE%": "applepay"}).alias("liked"),
        co.first_payment_flag(F.col("n")).alias("fcp"), co.country_flag(F.col("c")).alias("country")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT lower(trim(rpgt)) || '|' || lower(currency) || '|' || regexp_replace(CAST(order_id AS VARCHAR) || '.0', '\\.0$', '') AS key, regexp_replace(gateway || '-x', '-x$', '') AS gateway, count(*) AS n
FROM attempts WHERE day >= DATE '1998-01-01' AND day < DATE '1998-04-01' AND NOT (rpgt = '1-URGENT' AND provider = 'O' AND success) AND currency NOT IN ('MACHINERY') AND bank NOT LIKE 'NATION_24%' GROUP BY ALL""")
def filter_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).where("day >= date'1998-01-01' and day < date'1998-04-01'")
    a = a.where(~((F.col("rpgt") == "1-URGENT") & (F.col("provider") == "O") & F.col("success")) & ~F.col("currency").isin("MACHINERY") & ~F.col("bank").like("NATION_24%"))
    key = co.composite_key([F.col("rpgt"), F.col("currency"), F.concat(F.col("order_id").cast("string"), F.lit(".0"))])
    return a.groupBy(key.alias("key"), co.canonical_gateway(F.concat("gateway", F.lit("-x"))).alias("gateway")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, c_mktsegment FROM r LEFT JOIN customer ON o_custkey = c_custkey WHERE k = 1""")
def join_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = rl.first_of(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_totalprice"), F.asc("o_orderkey")])
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"), "c_mktsegment")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return rl.without_covered(table(spark, sf_dir, "customer"), o, ["c_custkey"]).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query(f"""WITH {ATTEMPTS_SQL}, s AS (SELECT bank, gateway, CAST(count(*) AS DOUBLE) AS v FROM attempts GROUP BY ALL), m AS (SELECT bank, gateway, count(*) * 2.5 AS v FROM attempts WHERE NOT success GROUP BY ALL)
SELECT bank, gateway, round(greatest(s.v - coalesce(m.v, 0), 0), 4) AS v FROM s LEFT JOIN m USING (bank, gateway)""")
def join_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    s = a.groupBy("bank", "gateway").agg(F.count(F.lit(1)).cast("double").alias("v"))
    m = a.where("not success").groupBy("bank", "gateway").agg((F.count(F.lit(1)) * 2.5).alias("v"))
    return rl.remainder_after(s, m, ["bank", "gateway"], "v").select("bank", "gateway", F.round("v", 4).alias("v"))


@query("""WITH a AS (SELECT l_suppkey AS k, count(*) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT s_suppkey AS k, round(s_acctbal, 2) AS y FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.k = b.k""")
def join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.round("s_acctbal", 2).alias("y"))
    return a.join(b, "k", "full_outer").na.fill(0)


@query(f"""WITH {ATTEMPTS_SQL}, c AS (SELECT rpgt, currency, bank, avg(amount) AS t FROM attempts WHERE success AND provider = 'F' GROUP BY ALL HAVING count(*) >= 5),
u AS (SELECT currency, avg(amount) AS t FROM attempts WHERE success GROUP BY ALL), k AS (SELECT DISTINCT rpgt, currency, bank FROM attempts)
SELECT rpgt, currency, bank, round(coalesce(c.t, u.t, 0), 6) AS ticket FROM k LEFT JOIN c USING (rpgt, currency, bank) LEFT JOIN u USING (currency)""")
def join_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    mean = F.avg("amount").alias("t")
    fine = a.where("success and provider = 'F'").groupBy("rpgt", "currency", "bank").agg(mean, F.count(F.lit(1)).alias("n")).where("n >= 5")
    coarse = a.where("success").groupBy("currency").agg(mean)
    out = rl.with_fallback(a.select("rpgt", "currency", "bank").distinct(), [(fine, ["rpgt", "currency", "bank"]), (coarse, ["currency"])], "t", F.lit(0.0), "ticket")
    return out.select("rpgt", "currency", "bank", F.round("ticket", 6).alias("ticket"))


@query(f"""WITH {ATTEMPTS_SQL}, p AS (SELECT DISTINCT bank FROM attempts), m AS (SELECT DISTINCT gateway, year(day) AS y FROM attempts WHERE year(day) = 1997), h AS (SELECT bank, gateway, count(*) AS n FROM attempts WHERE year(day) = 1997 AND rpgt = '1-URGENT' GROUP BY ALL)
SELECT bank, gateway, n FROM h UNION ALL SELECT bank, gateway, 0 FROM p, m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.bank = p.bank AND h.gateway = m.gateway)""")
def join_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing pairs get zero rows: each bank's gateways are listed once, then the known ones taken out."""
    a = attempts(spark, sf_dir).where("year(day) = 1997")
    have = a.where("rpgt = '1-URGENT'").groupBy("bank", "gateway").agg(F.count(F.lit(1)).alias("n"))
    names = a.agg(F.collect_set("gateway").alias("all"))  # ten gateways
    every = attempts(spark, sf_dir).select("bank").distinct().join(F.broadcast(names)).select("bank", F.explode("all").alias("gateway"))
    return have.unionByName(rl.without_covered(every, have, ["bank", "gateway"]).withColumn("n", F.lit(0).cast("long")))


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, currency, count(DISTINCT CASE WHEN NOT success THEN order_id END) AS failed_orders, count(DISTINCT CAST(order_id AS VARCHAR) || '_' || provider) AS records,
round(count(DISTINCT order_id) * 30.4167 / day(last_day(max(day))), 4) AS normalised, round(CAST(count(DISTINCT CASE WHEN success THEN order_id END) AS DOUBLE) / nullif(count(DISTINCT order_id), 0), 6) AS ratio FROM attempts GROUP BY ALL""")
def aggregate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines become one row for each order before they meet it, so no row is copied for a count and no set is held.

    The partitions are as many as the lines ask for (their number stands in the files' footers), so a task's memory stays as it is.
    """
    last, some = F.max("day").alias("day"), lambda c: F.max(c).alias(c)
    success = F.col("l_returnflag") != "R"
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", F.to_date("l_shipdate").alias("day"), success.alias("success"), (~success).alias("failed"))
    n_parts = max(1, -(-table(spark, sf_dir, "lineitem").count() // 250_000))
    records = lines.repartition(n_parts, "l_orderkey").groupBy("l_orderkey", "l_linestatus").agg(some("success"), some("failed"), last)
    records = records.groupBy("l_orderkey").agg(some("success"), some("failed"), F.count("l_linestatus").alias("records"), last)
    joined = records.join(sold(spark, sf_dir).repartition(n_parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    orders = joined.groupBy(F.col("o_orderpriority").alias("rpgt"), F.col("c_mktsegment").alias("currency"), F.col("l_orderkey").alias("order_id")).agg(some("success"), some("failed"), some("records"), last)
    n, having = F.count("order_id"), lambda c: F.count(F.when(F.col(c), F.col("order_id")))
    return orders.groupBy("rpgt", "currency").agg(
        having("failed").alias("failed_orders"), F.sum("records").alias("records"), F.round(n * co.month_factor(F.max("day")), 4).alias("normalised"), F.round(F.try_divide(having("success"), n), 6).alias("ratio"))


@query("""WITH v AS (SELECT user_id, event_type AS e, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, e) AS k FROM v)
SELECT user_id, e AS event_type FROM r WHERE k = 1""")
def aggregate_commonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.commonest(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id"], "event_type")


@query("""WITH s AS (SELECT n_name AS nation, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), t AS (SELECT * FROM s ORDER BY abs(v) DESC, nation LIMIT 5)
SELECT nation, v FROM t UNION ALL SELECT 'Other', round(sum(v), 2) FROM s WHERE nation NOT IN (SELECT nation FROM t)""")
def top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), F.col("o_totalprice").alias("v"))
    return rl.top_with_other(rows, "nation", "v", 5).select("nation", F.round("v", 2).alias("v"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT coalesce(gateway, 'TOTAL') AS gateway, count(*) AS n, count(*) FILTER (success) AS s FROM attempts GROUP BY ROLLUP (gateway)""")
def report_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).select("gateway", F.lit(1).cast("long").alias("n"), F.col("success").cast("long").alias("s"))
    return rl.with_total(a, "gateway", ["n", "s"])


@query(f"""WITH {ATTEMPTS_SQL}, a AS (SELECT rpgt, currency, CAST(sum(CAST(amount AS DECIMAL(18, 3))) AS DOUBLE) AS v FROM attempts GROUP BY ALL), b AS (SELECT rpgt, currency, CAST(sum(CAST(amount * CASE WHEN success THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS DECIMAL(18, 3))) AS DOUBLE) AS v FROM attempts WHERE bank <> 'NATION_18' GROUP BY ALL),
d AS (SELECT concat_ws('|', rpgt, currency) AS key, coalesce(a.v, 0) - coalesce(b.v, 0) AS d FROM a FULL JOIN b USING (rpgt, currency))
SELECT count(*) AS keys, CAST(sum(CASE WHEN abs(d) > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS beyond, max_by(key, abs(d)) AS worst, round(max(abs(d)), 3) AS difference FROM d""")
def report_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = lambda c: c.cast("decimal(18,3)").alias("amount")  # noqa: E731  # sums that do not depend on the order of adding
    a = attempts(spark, sf_dir)
    part = a.where("bank <> 'NATION_18'").select("rpgt", "currency", exact(F.col("amount") * F.when(F.col("success"), 1.0).otherwise(0.5)))
    return rl.reconciled(a.select("rpgt", "currency", exact(F.col("amount"))), part, ["rpgt", "currency"], "amount", 100000.0).withColumn("difference", F.round("difference", 3))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (value > 10) AS s FROM events GROUP BY ALL)
SELECT day, event_type, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY day), 6) AS share, round(CAST(s AS DOUBLE) / n, 6) AS rate, round(CAST(sum(s) OVER (PARTITION BY day) - s AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY day) - n, 0), 6) AS others FROM d""")
def window_rate_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 10).cast("long")).alias("s"))
    w = Window.partitionBy("day")
    return d.select("day", "event_type", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), F.round(F.col("s") / F.col("n"), 6).alias("rate"), F.round(F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")), 6).alias("others"))


@query("""WITH d AS (SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS dom, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY month) AS share FROM d),
b AS (SELECT *, CASE WHEN dom = 1 THEN 'HIGH' WHEN dom <= 28 THEN 'MID' ELSE 'LOW' END AS band FROM s)
SELECT month, dom, round(avg(share) OVER (PARTITION BY month, band), 8) AS weight FROM b""")
def window_daily_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_weights(spark, sf_dir).select("month", "dom", F.round("w", 8).alias("weight"))


def daily_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, dom, w): each day's share of its month, averaged over the first day, the 2nd to 28th, and the rest."""
    d = table(spark, sf_dir, "events").groupBy(F.month("ts").alias("month"), F.dayofmonth("ts").alias("dom")).agg(F.count(F.lit(1)).alias("n"))
    return banded_weights(d)


@query(f"""WITH {ATTEMPTS_SQL} SELECT rpgt, gateway, count(*) FILTER (provider = 'F' AND success) AS f_good, count(*) FILTER (provider = 'F') AS f_all, count(*) FILTER (provider = 'O' AND success) AS o_good, count(*) FILTER (provider = 'O') AS o_all FROM attempts GROUP BY ALL""")
def reshape_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = attempts(spark, sf_dir).groupBy("rpgt", "gateway").pivot("provider", ["F", "O"]).agg(F.sum(F.col("success").cast("long")).alias("good"), F.count(F.lit(1)).alias("all"))
    return p.select("rpgt", "gateway", *[F.coalesce(F.col(f"{k}_{v}"), F.lit(0)).cast("long").alias(f"{k.lower()}_{v}") for k in "FO" for v in ("good", "all")])


@query("""WITH w AS (SELECT s_suppkey AS id, CAST(s_suppkey % 40 AS VARCHAR) || '%' AS gw_a, CAST(s_nationkey AS VARCHAR) AS gw_b, CASE WHEN s_suppkey % 3 = 0 THEN 'n/a' ELSE '7.5%' END AS gw_c FROM supplier)
SELECT id, gateway, CAST(replace(t, '%', '') AS DOUBLE) AS share FROM (UNPIVOT w ON gw_a, gw_b, gw_c INTO NAME gateway VALUE t) WHERE try_cast(replace(t, '%', '') AS DOUBLE) > 0""")
def reshape_long_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    wide = table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat((k % 40).cast("string"), F.lit("%")).alias("gw_a"), F.col("s_nationkey").cast("string").alias("gw_b"), F.when(k % 3 == 0, "n/a").otherwise("7.5%").alias("gw_c"))
    return rl.long_shares(wide, ["id"], ["gw_a", "gw_b", "gw_c"])


@query("""WITH r AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'gp' ELSE 'Both' END AS provider FROM part)
SELECT id, unnest(CASE WHEN lower(provider) = 'both' THEN ['gp', 'card'] ELSE [provider] END) AS provider FROM r""")
def expand_collective(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 3
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(s == 0, "both").when(s == 1, "gp").otherwise("Both").alias("provider"))
    return rl.expanded(r, "provider", {"both": ["gp", "card"]})


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, md5(event_type || '|' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS VARCHAR)) AS tag FROM events GROUP BY ALL")
def scan_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.md5(F.concat_ws("|", "event_type", F.col("k").cast("string"))))


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 0")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    both = table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).unionByName(n.select(F.col("n_name").alias("name")))
    return both.exceptAll(n.where("n_regionkey = 0").select(F.col("n_name").alias("name"))).distinct()
