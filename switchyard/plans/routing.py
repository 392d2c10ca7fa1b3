"""Rule timeline, reallocation and projection queries."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators import projection as pr
from switchyard.operators import timeline as tl
from switchyard.plans.relational import daily_weights
from switchyard.registry import query
from switchyard.sources.io import rule_sheets, write_report
from switchyard.sources.shared import folder, written
from switchyard.sources.tables import ATTEMPTS_SQL, attempts

PROFILE = ["rpgt", "currency"]
MONTH0 = datetime.date(1998, 9, 1)
# Rules follow from the keys: each profile has three dates; on each, the gateways whose number fits get a share.
RULES_SQL = (
    ATTEMPTS_SQL
    + """, rules AS (
  SELECT rpgt, currency, CAST(DATE '1998-08-10' + CAST(k * 40 + length(rpgt) AS INTEGER) AS DATE) AS go_live, gateway, CAST((CAST(right(gateway, 1) AS INTEGER) + k) % 4 + 1 AS DOUBLE) AS share
  FROM (SELECT DISTINCT rpgt, currency, gateway FROM attempts), (SELECT CAST(range AS INTEGER) AS k FROM range(3)) WHERE (CAST(right(gateway, 1) AS INTEGER) + k + length(currency)) % 3 <> 0)"""
)
SNAP_SQL = """snap AS (SELECT rpgt, currency, go_live, gateway, share / sum(share) OVER (PARTITION BY rpgt, currency, go_live) AS share FROM rules)"""
TIME_SQL = """dates AS (SELECT rpgt, currency, go_live, coalesce(lead(go_live) OVER (PARTITION BY rpgt, currency ORDER BY go_live), DATE '9999-12-31') AS until FROM (SELECT DISTINCT rpgt, currency, go_live FROM snap)),
timeline AS (SELECT * FROM snap JOIN dates USING (rpgt, currency, go_live)),
months AS (SELECT CAST(range AS INTEGER) AS m, CAST(DATE '1998-09-01' + to_months(CAST(range AS INTEGER)) AS DATE) AS month_start FROM range(-1, 6))"""
WEIGHT_SQL = """weights AS (SELECT rpgt, currency, go_live, until, gateway, share, m, greatest(least(CAST(date_diff('day', greatest(go_live, month_start), least(until, CAST(month_start + INTERVAL 1 MONTH AS DATE))) AS DOUBLE) / date_diff('day', month_start, CAST(month_start + INTERVAL 1 MONTH AS DATE)), 1), 0) AS w
  FROM timeline JOIN months ON go_live < month_start + INTERVAL 1 MONTH AND until > month_start)"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.right("gateway", F.lit(1)).cast("int")
    keys = written(attempts(spark, sf_dir).select("rpgt", "currency", "gateway").distinct(), "rule-keys").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    keys = keys.where((g + F.col("k") + F.length("currency")) % 3 != 0)
    return keys.select("rpgt", "currency", F.date_add(F.lit(datetime.date(1998, 8, 10)), F.col("k") * 40 + F.length("rpgt")).alias("go_live"), "gateway", ((g + F.col("k")) % 4 + 1).cast("double").alias("share"))


def months(spark: SparkSession) -> DataFrame:
    """(m, month_start) for the month before month 0 to month 5."""
    return spark.range(-1, 6).select(F.col("id").cast("int").alias("m"), F.add_months(F.lit(MONTH0), F.col("id").cast("int")).alias("month_start"))


@query(f"WITH {RULES_SQL}, {SNAP_SQL}, {TIME_SQL} SELECT rpgt, currency, go_live, until, gateway, round(share, 6) AS share FROM timeline")
def timeline_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.stitched(tl.snapshot_shares(rules(spark, sf_dir), PROFILE), PROFILE).select(*PROFILE, "go_live", "until", "gateway", F.round("share", 6).alias("share"))


@query(f"""WITH {RULES_SQL}, {SNAP_SQL}, {TIME_SQL}, dead(gateway, dead_from) AS (VALUES ('gw_1', DATE '1998-10-05'), ('gw_2', DATE '1998-10-05'), ('gw_3', DATE '1900-01-01')),
breaks AS (SELECT DISTINCT rpgt, currency, go_live, dead_from FROM timeline JOIN dead USING (gateway) WHERE dead_from > go_live AND dead_from < until),
every_ AS (SELECT rpgt, currency, go_live, gateway, share FROM timeline UNION ALL SELECT rpgt, currency, b.dead_from, gateway, share FROM timeline JOIN breaks b USING (rpgt, currency, go_live)),
z AS (SELECT rpgt, currency, go_live, gateway, sum(CASE WHEN dead_from <= go_live THEN 0.0 ELSE share END) AS share FROM every_ LEFT JOIN dead USING (gateway) GROUP BY ALL)
SELECT rpgt, currency, go_live, gateway, round(CASE WHEN sum(share) OVER w > 0 THEN share / sum(share) OVER w ELSE 0 END, 6) AS share FROM z WINDOW w AS (PARTITION BY rpgt, currency, go_live)""")
def timeline_kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = datetime.date(1998, 10, 5)
    kills = spark.createDataFrame([("gw_1", day), ("gw_2", day), ("gw_3", None)], "gateway string, kill_date date")
    return tl.with_kills(tl.snapshot_shares(rules(spark, sf_dir), PROFILE), kills, PROFILE).withColumn("share", F.round("share", 6))


@query(f"WITH {RULES_SQL}, {SNAP_SQL}, {TIME_SQL}, {WEIGHT_SQL} SELECT rpgt, currency, gateway, m, round(sum(w * share), 6) AS part FROM weights GROUP BY ALL")
def timeline_month_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir)
    return w.groupBy(*PROFILE, "gateway", "m").agg(F.round(F.sum(F.col("w") * F.col("share")), 6).alias("part"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.valid_weights(tl.stitched(tl.snapshot_shares(rules(spark, sf_dir), PROFILE), PROFILE), months(spark))


@query("""WITH d AS (SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS dom, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY month) AS share FROM d),
b AS (SELECT month, dom, avg(share) OVER (PARTITION BY month, CASE WHEN dom = 1 THEN 1 WHEN dom <= 28 THEN 2 ELSE 3 END) AS w FROM s)
SELECT month, dom, round(coalesce(sum(w) OVER (PARTITION BY month ORDER BY dom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY month), 8) AS upto FROM b""")
def timeline_weighted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.cumulative_weights(daily_weights(spark, sf_dir)).withColumn("upto", F.round("upto", 8))


VOL_SQL = """vol AS (SELECT rpgt, currency, gateway, m, CAST(0 AS INTEGER) AS t, CAST(count(*) AS DOUBLE) AS v FROM attempts, months WHERE year(day) = 1997 AND m >= 0 GROUP BY ALL
  UNION ALL SELECT rpgt, currency, gateway, m, CAST(3 AS INTEGER), CAST(count(*) AS DOUBLE) FROM attempts, months WHERE year(day) = 1997 AND m >= 0 AND NOT success GROUP BY ALL)"""


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month repeats the volume of 1997: sales at age 0, failures at age 3."""
    a = attempts(spark, sf_dir, datetime.date(1997, 1, 1), datetime.date(1998, 1, 1))
    sales = a.groupBy("rpgt", "currency", "gateway").agg(F.count(F.lit(1)).cast("double").alias("v"), F.sum((~F.col("success")).cast("double")).alias("r"))
    each = written(sales, "sales").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(5))))  # used several times
    return each.select("rpgt", "currency", "gateway", "m", F.lit(0).alias("t"), "v").unionByName(each.where("r > 0").select("rpgt", "currency", "gateway", "m", F.lit(3).alias("t"), F.col("r").alias("v")))


@query(f"""WITH {RULES_SQL}, {SNAP_SQL}, {TIME_SQL}, {WEIGHT_SQL}, {VOL_SQL}, part AS (SELECT rpgt, currency, m, gateway, sum(w * share) AS p FROM weights GROUP BY ALL), tot AS (SELECT rpgt, currency, m, sum(p) AS p FROM part GROUP BY ALL)
SELECT rpgt, currency, gateway, m, t, round(sum(v), 6) AS v FROM (
  SELECT rpgt, currency, vol.gateway, m, t, CASE WHEN t <= m THEN greatest(v * (1 - coalesce(p, 0)), 0) ELSE v END AS v FROM vol LEFT JOIN tot USING (rpgt, currency, m)
  UNION ALL SELECT vol.rpgt, vol.currency, part.gateway, vol.m, t, v * p FROM vol JOIN part ON vol.rpgt = part.rpgt AND vol.currency = part.currency AND vol.m = part.m WHERE t <= vol.m) GROUP BY ALL""")
def allocation_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.reallocated(volume(spark, sf_dir), weights(spark, sf_dir), PROFILE).withColumn("v", F.round("v", 6))


@query(f"""WITH {RULES_SQL}, {SNAP_SQL}, {TIME_SQL}, {WEIGHT_SQL}, {VOL_SQL}, part AS (SELECT rpgt, currency, m, gateway, sum(w * share) AS p FROM weights GROUP BY ALL), tot AS (SELECT rpgt, currency, m, sum(p) AS p FROM part GROUP BY ALL), g AS (SELECT *, CASE WHEN t > 2 THEN 0.4 ELSE 1.0 END AS g FROM vol),
b AS (SELECT rpgt, currency, gateway, m, t, sum(v) AS v FROM (SELECT g.rpgt, g.currency, g.gateway, g.m, t, CASE WHEN t <= g.m THEN greatest(v * (1 - g * coalesce(p, 0)), 0) ELSE v END AS v FROM g LEFT JOIN tot ON tot.rpgt = g.rpgt AND tot.currency = g.currency AND tot.m = g.m - t
  UNION ALL SELECT g.rpgt, g.currency, part.gateway, g.m, t, v * g * p FROM g JOIN part ON g.rpgt = part.rpgt AND g.currency = part.currency AND g.m - t = part.m WHERE t <= g.m) GROUP BY ALL)
SELECT rpgt, currency, gateway, m, t, round(v, 6) AS v FROM (SELECT * FROM b WHERE m <> 0 UNION ALL SELECT rpgt, currency, gateway, m, t, sum(v) FROM vol WHERE m = 0 GROUP BY ALL)""")
def allocation_after_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second scheme: risk follows the rules of its cohort's month, old risk moves in part, month 0 stays."""
    v = volume(spark, sf_dir)
    after = tl.reallocated(v, weights(spark, sf_dir), PROFILE, cohort=True, gate=2, gated=0.4)
    return tl.with_month_zero(after, v, [*PROFILE, "gateway"]).withColumn("v", F.round("v", 6))


@query(f"""WITH {RULES_SQL}, {SNAP_SQL}, {TIME_SQL}, {WEIGHT_SQL}, {VOL_SQL}, part AS (SELECT rpgt, currency, gateway, sum(w * share) AS p FROM weights WHERE m = -1 GROUP BY ALL), tot AS (SELECT rpgt, currency, sum(p) AS p FROM part GROUP BY ALL)
SELECT m, t, round(sum(v), 3) AS v, count(DISTINCT gateway) AS gateways FROM (
  SELECT rpgt, currency, vol.gateway, m, t, CASE WHEN t <= m THEN greatest(v * (1 - coalesce(p, 0)), 0) ELSE v END AS v FROM vol LEFT JOIN tot USING (rpgt, currency)
  UNION ALL SELECT vol.rpgt, vol.currency, part.gateway, vol.m, t, v * p FROM vol JOIN part ON vol.rpgt = part.rpgt AND vol.currency = part.currency WHERE t <= vol.m) GROUP BY ALL""")
def allocation_before_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tl.reallocated(volume(spark, sf_dir), weights(spark, sf_dir), PROFILE, before=True)
    return r.groupBy("m", "t").agg(F.round(F.sum("v"), 3).alias("v"), F.count_distinct("gateway").alias("gateways"))


@query(f"""WITH {RULES_SQL}, {SNAP_SQL}, {TIME_SQL}, {VOL_SQL}, a AS (SELECT *, gateway NOT IN ('gw_1', 'gw_2') AS alive FROM vol WHERE m = 2),
b AS (SELECT *, sum(CASE WHEN alive THEN v ELSE 0 END) OVER w AS living, sum(CASE WHEN alive THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN alive THEN 0 ELSE v END) OVER w AS orphan FROM a WINDOW w AS (PARTITION BY rpgt, currency, t))
SELECT rpgt, currency, gateway, t, round(CASE WHEN n = 0 THEN v WHEN alive THEN v + CASE WHEN living > 0 THEN orphan * v / living ELSE orphan / n END ELSE 0 END, 4) AS v, n = 0 AS stranded FROM b""")
def allocation_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = volume(spark, sf_dir).where("m = 2")
    return tl.orphans_spread(v, ~F.col("gateway").isin("gw_1", "gw_2"), [*PROFILE, "t"]).select(*PROFILE, "gateway", "t", F.round("v", 4).alias("v"), "stranded")


@query(f"""WITH {RULES_SQL}, p AS (SELECT rpgt, currency, bank, CASE WHEN line_no = 1 THEN '1' ELSE '2+' END AS fcp, CASE WHEN quantity < 25 THEN '1' ELSE '2+' END AS attempt FROM attempts),
k AS (SELECT DISTINCT rpgt, currency FROM rules WHERE share > 3)
SELECT rpgt, count(*) AS n, count(*) FILTER (fcp = '1' AND k.rpgt IS NOT NULL AND (p.rpgt NOT IN ('1-URGENT') OR attempt = '1')) AS movable FROM p LEFT JOIN k USING (rpgt, currency) GROUP BY rpgt""")
def allocation_reroutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).select("rpgt", "currency", F.when(F.col("line_no") == 1, "1").otherwise("2+").alias("fcp"), F.when(F.col("quantity") < 25, "1").otherwise("2+").alias("attempt"))
    r = tl.reroutable(a, rules(spark, sf_dir).where("share > 3"), PROFILE, ["1-URGENT"])
    return r.groupBy("rpgt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("movable").cast("long")).alias("movable"))


@query(f"""WITH {ATTEMPTS_SQL}, r AS (SELECT DISTINCT rpgt, currency, bank, gateway, CASE WHEN length(bank) % 2 = 0 THEN 'Specific' WHEN success THEN 'Expanded' ELSE 'Actuals' END AS rule_source FROM attempts WHERE year(day) = 1996)
SELECT * FROM r WHERE rule_source <> 'Expanded' OR NOT EXISTS (SELECT 1 FROM r s WHERE s.rule_source = 'Specific' AND s.rpgt = r.rpgt AND s.currency = r.currency)""")
def rules_catch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir, datetime.date(1996, 1, 1), datetime.date(1997, 1, 1))
    kind = F.when(F.length("bank") % 2 == 0, "Specific").when(F.col("success"), "Expanded").otherwise("Actuals")
    return tl.cell_level_catch_all(a.select("rpgt", "currency", "bank", "gateway", kind.alias("rule_source")).distinct(), ["rpgt", "currency"])


@query(f"""WITH {ATTEMPTS_SQL}, v AS (SELECT rpgt, currency, bank, provider, country, count(*) AS v FROM attempts WHERE NOT success GROUP BY ALL), f AS (SELECT *, CAST(v AS DOUBLE) / sum(v) OVER (PARTITION BY rpgt, currency, bank) AS frac FROM v),
c AS (SELECT rpgt, currency, bank, CAST(count(*) AS DOUBLE) AS volume FROM attempts GROUP BY ALL)
SELECT rpgt, currency, bank, coalesce(provider, '_all_') AS provider, coalesce(country, '_all_') AS country, round(volume * coalesce(frac, 1), 5) AS volume FROM c LEFT JOIN f USING (rpgt, currency, bank)""")
def subcell_apportioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = ["rpgt", "currency", "bank"]
    fine = attempts(spark, sf_dir).groupBy(*cell, "provider", "country").agg(F.sum((~F.col("success")).cast("long")).alias("txn_count"), F.count(F.lit(1)).alias("n"))
    fine = written(fine, "fine")  # used four times; its size follows the keys
    export = fine.withColumn("t", F.lit(0)).where("txn_count > 0")
    cells = fine.groupBy(*cell).agg(F.sum("n").cast("double").alias("volume"))
    return pr.apportioned(cells, pr.subcell_fractions(export, cell), cell, "volume").select(*cell, "provider", "country", F.round("volume", 5).alias("volume"))


COHORT_SQL = """x AS (SELECT rpgt, currency, 'mid_' || right(gateway, 1) AS mid, CAST(count(*) AS DOUBLE) AS txn, 0.5 + length(currency) / 40.0 AS pro_rata, 0.8 AS fcp1_frac FROM attempts WHERE year(day) = 1997 GROUP BY ALL),
p AS (SELECT rpgt, currency, mid, (CAST(right(mid, 1) AS INTEGER) % 3) / sum(CAST(right(mid, 1) AS INTEGER) % 3) OVER (PARTITION BY rpgt, currency) AS prop FROM x WHERE currency <> 'MACHINERY')"""


@query(f"""WITH {ATTEMPTS_SQL}, {COHORT_SQL}, j AS (SELECT x.*, coalesce(prop, 0) AS prop, pro_rata * fcp1_frac AS mv, sum(txn) OVER (PARTITION BY rpgt, currency) AS total FROM x LEFT JOIN p USING (rpgt, currency, mid)),
k AS (SELECT *, sum(txn / total * mv) OVER w AS pool, sum(prop) OVER w AS ps FROM j WINDOW w AS (PARTITION BY rpgt, currency))
SELECT rpgt, currency, mid, txn, round(CASE WHEN ps > 0 THEN total * (txn / total * (1 - mv) + pool * prop / ps) ELSE txn END, 5) AS post FROM k""")
def projection_two_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    mid = F.concat(F.lit("mid_"), F.right("gateway", F.lit(1)))
    x = attempts(spark, sf_dir, datetime.date(1997, 1, 1), datetime.date(1998, 1, 1)).groupBy("rpgt", "currency", mid.alias("mid")).agg(F.count(F.lit(1)).cast("double").alias("txn"))
    x = x.withColumn("pro_rata", 0.5 + F.length("currency") / 40.0).withColumn("fcp1_frac", F.lit(0.8))
    n = F.right("mid", F.lit(1)).cast("int") % 3
    p = x.where("currency <> 'MACHINERY'").select("rpgt", "currency", "mid", (n / F.sum(n).over(Window.partitionBy("rpgt", "currency"))).alias("prop"))
    return pr.two_cohort(x, p, ["rpgt", "currency"]).select("rpgt", "currency", "mid", "txn", F.round("post", 5).alias("post"))


@query(f"""WITH {ATTEMPTS_SQL}, r AS (SELECT currency, 'mid_' || right(gateway, 1) AS mid, CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) % 6 AS period, CAST(least(greatest((year(day) - year(origin)) * 12 + month(day) - month(origin), 0), 9) AS INTEGER) AS t, CAST(count(*) AS DOUBLE) AS risk FROM attempts WHERE NOT success AND year(day) IN (1997, 1998) AND (1998 - year(day)) * 12 + 9 - month(day) >= 0 GROUP BY ALL),
q AS (SELECT r.*, period - t AS origin, 0.6 * 0.8 AS mv, CASE WHEN period - t >= 0 THEN 1 + (CAST(right(mid, 1) AS INTEGER) + period - t) % 4 ELSE 0 END AS prop FROM r),
w AS (SELECT *, sum(CASE WHEN risk > 0 THEN prop ELSE 0 END) OVER v AS ps, sum(risk * mv) OVER v AS pool FROM q WINDOW v AS (PARTITION BY currency, period, t))
SELECT currency, mid, period, t, risk, round(CASE WHEN ps > 0 THEN risk * (1 - mv) + pool * prop / ps ELSE risk END, 5) AS post_risk FROM w""")
def projection_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.functions.columns import month_diff

    period = month_diff(F.lit(MONTH0), F.col("day"))
    age = F.least(F.greatest(month_diff(F.col("day"), F.col("origin")), F.lit(0)), F.lit(9))
    a = attempts(spark, sf_dir, datetime.date(1997, 1, 1), datetime.date(1998, 10, 1)).where("not success").withColumn("p", period).where("p >= 0")
    r = a.groupBy("currency", F.concat(F.lit("mid_"), F.right("gateway", F.lit(1))).alias("mid"), (F.col("p") % 6).alias("period"), age.alias("t")).agg(F.count(F.lit(1)).cast("double").alias("risk"))
    r = r.withColumn("pro_rata", F.lit(0.6)).withColumn("fcp1_frac", F.lit(0.8))
    keys = r.select("currency", "mid", (F.col("period") - F.col("t")).alias("origin")).distinct().where("origin >= 0")
    shares = keys.withColumn("prop", (1 + (F.right("mid", F.lit(1)).cast("int") + F.col("origin")) % 4).cast("double"))
    return pr.risk_projection(r, shares, ["currency"]).select("currency", "mid", "period", "t", "risk", F.round("post_risk", 5).alias("post_risk"))


@query("""WITH g AS (SELECT 'mid_' || CAST(s_nationkey % 7 AS VARCHAR) AS mid, 'gw_' || CAST(s_suppkey AS VARCHAR) AS gateway, CASE WHEN s_nationkey % 7 = 3 AND s_suppkey % 5 = 0 THEN NULL ELSE DATE '1998-09-01' + CAST(s_suppkey % 150 AS INTEGER) END AS off FROM supplier),
c AS (SELECT mid, sum(CASE WHEN off IS NULL THEN 1 ELSE 0 END) AS open, max(off) AS off FROM g GROUP BY mid), months AS (SELECT CAST(range AS INTEGER) AS m, CAST(DATE '1998-09-01' + to_months(CAST(range AS INTEGER)) AS DATE) AS ms FROM range(-1, 6))
SELECT mid, m, round(CASE WHEN open > 0 THEN 1.0 ELSE CAST(date_diff('day', ms, least(greatest(off, ms), CAST(ms + INTERVAL 1 MONTH AS DATE))) AS DOUBLE) / date_diff('day', ms, CAST(ms + INTERVAL 1 MONTH AS DATE)) END, 6) AS keep FROM c, months""")
def projection_keep_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.sources.tables import table

    n, k = F.col("s_nationkey") % 7, F.col("s_suppkey")
    off = F.when((n == 3) & (k % 5 == 0), F.lit(None).cast("date")).otherwise(F.date_add(F.lit(MONTH0), (k % 150).cast("int")))
    g = table(spark, sf_dir, "supplier").select(F.concat(F.lit("mid_"), n.cast("string")).alias("mid"), F.concat(F.lit("gw_"), k.cast("string")).alias("gateway"), off.alias("off_date"))
    return pr.keep_fraction(g, months(spark)).withColumn("keep", F.round(F.col("keep").cast("double"), 6))


# Two sheets, from the keys: rows for some banks, and in the first one for all others at home; shares are texts in per cent.
CELL = ["rpgt", "currency", "bin", "provider", "country"]
_CELLS = ", ".join(CELL)
GATEWAYS = [f"gw_{k}" for k in range(10)]
LIVE = ("15/09/1998", "20/10/1998")
SHEET_SQL = f"""{ATTEMPTS_SQL}, keyed AS (SELECT DISTINCT rpgt, currency, bank AS bin FROM attempts), known AS (SELECT DISTINCT rpgt, currency, provider, country, bank AS bin FROM attempts), k(k, go_live) AS (VALUES (0, DATE '1998-09-15'), (1, DATE '1998-10-20')), g AS (SELECT CAST(range AS INTEGER) AS g FROM range(10)),
specific AS (SELECT rpgt, currency, bin, provider, country, go_live, 'gw_' || g AS gateway, 10.0 * ((g + k) % 4) AS share, 'Specific' AS rule_source FROM keyed, k, g, (VALUES ('O'), ('F')) p(provider), (VALUES ('USA'), ('Non-USA')) c(country) WHERE (length(bin) + length(rpgt) + k) % 3 = 0 AND (g + k) % 4 > 0),
other AS (SELECT rpgt, currency, bin, provider, country, DATE '1998-09-15' AS go_live, 'gw_' || g AS gateway, 5.0 * (1 + g % 3) AS share, 'Expanded' AS rule_source FROM known, g WHERE country = 'USA'),
sheets AS (SELECT * FROM specific UNION ALL SELECT other.* FROM other ANTI JOIN specific USING ({_CELLS})), first AS (SELECT {_CELLS}, min(go_live) AS first FROM sheets GROUP BY ALL),
actuals AS (SELECT rpgt, currency, bank AS bin, provider, country, CAST(date_trunc('month', day) AS DATE) AS go_live, gateway, CAST(count(*) AS DOUBLE) AS share, 'Actuals' AS rule_source FROM attempts WHERE day >= DATE '1998-07-01' GROUP BY ALL),
merged AS (SELECT * FROM sheets UNION ALL SELECT a.* FROM actuals a LEFT JOIN first USING ({_CELLS}) WHERE first IS NULL OR a.go_live < first)"""


def sheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets written as CSV and read again, widened, and merged with what was routed before them."""
    a = attempts(spark, sf_dir)
    cells = written(a.groupBy("rpgt", "currency", F.col("bank").alias("bin"), "provider", "country", "gateway", F.trunc("day", "month").alias("month")).agg(F.count(F.lit(1)).alias("n")), "cells")
    sheets = f"{folder(spark)}/switchyard-{uuid.uuid4().hex}-sheets"
    banks = cells.select("rpgt", "currency", "bin").distinct()
    percent = lambda v: F.concat(v.cast("string"), F.lit("%"))
    for k, live in enumerate(LIVE):
        rows = banks.where((F.length("bin") + F.length("rpgt") + k) % 3 == 0).select("*", F.lit("all").alias("provider"), F.lit("all").alias("country"), F.lit(live).alias("GO LIVE"), *[percent(F.lit(10 * ((g + k) % 4))).alias(name) for g, name in enumerate(GATEWAYS)])
        if k == 0:
            rows = rows.unionByName(banks.select("rpgt", "currency").distinct().select("*", F.lit("Other").alias("bin"), F.lit("all").alias("provider"), F.lit("USA").alias("country"), F.lit(live).alias("GO LIVE"), *[percent(F.lit(5 * (1 + g % 3))).alias(name) for g, name in enumerate(GATEWAYS)]))
        write_report(rows, f"{sheets}/{k}", "csv")
    read = rule_sheets(spark, f"{sheets}/*", CELL).withColumn("rule_source", F.lit("Specific"))
    wide = tl.widened(read, cells, ["O", "F"], ["USA", "Non-USA"])
    actuals = cells.where("month >= DATE '1998-07-01'").groupBy(*CELL, F.col("month").alias("go_live"), "gateway").agg(F.sum("n").cast("double").alias("share")).withColumn("rule_source", F.lit("Actuals"))
    return written(tl.merged_histories(wide, actuals, CELL), "merged-rules")


@query(f"WITH {SHEET_SQL} SELECT {_CELLS}, go_live, gateway, CAST(share AS DOUBLE) AS share, rule_source FROM merged")
def rules_from_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_rules(spark, sf_dir)


@query(f"""WITH {SHEET_SQL}, snap AS (SELECT {_CELLS}, go_live, gateway, share / sum(share) OVER (PARTITION BY {_CELLS}, go_live) AS share FROM merged), {TIME_SQL.replace("rpgt, currency", _CELLS)}, {WEIGHT_SQL.replace("rpgt, currency", _CELLS)},
d AS (SELECT CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS dom, count(*) AS n FROM events GROUP BY ALL), ds AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY month) AS share FROM d),
db AS (SELECT month, dom, avg(share) OVER (PARTITION BY month, CASE WHEN dom = 1 THEN 1 WHEN dom <= 28 THEN 2 ELSE 3 END) AS w FROM ds), up AS (SELECT month, dom, coalesce(sum(w) OVER (PARTITION BY month ORDER BY dom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY month) AS upto FROM db),
edges AS (SELECT weights.*, greatest(go_live, month_start) AS f, CAST(month_start + INTERVAL 1 MONTH AS DATE) AS after FROM weights JOIN months USING (m)),
heavy AS (SELECT e.* REPLACE (CASE WHEN rpgt = '1-URGENT' THEN greatest(CASE WHEN until < after THEN coalesce(b.upto, 1) ELSE 1 END - coalesce(a.upto, 0), 0) ELSE w END AS w) FROM edges e LEFT JOIN up a ON a.month = month(month_start(m)) AND a.dom = day(f) LEFT JOIN up b ON b.month = month(month_start(m)) AND b.dom = day(until) AND until < after),
part AS (SELECT {_CELLS}, m, gateway, sum(w * share) AS p FROM heavy GROUP BY ALL), tot AS (SELECT {_CELLS}, m, sum(p) AS p FROM part GROUP BY ALL),
vol AS (SELECT rpgt, currency, bank AS bin, provider, country, gateway, m, CAST(0 AS INTEGER) AS t, CAST(count(*) AS DOUBLE) AS v FROM attempts, months WHERE year(day) = 1997 AND m >= 0 GROUP BY ALL
  UNION ALL SELECT rpgt, currency, bank, provider, country, gateway, m, CAST(3 AS INTEGER), CAST(count(*) AS DOUBLE) FROM attempts, months WHERE year(day) = 1997 AND m >= 0 AND NOT success GROUP BY ALL)
SELECT rpgt, currency, gateway, m, t, round(sum(v), 5) AS v FROM (
  SELECT rpgt, currency, vol.gateway, m, t, CASE WHEN t <= m THEN greatest(v * (1 - coalesce(p, 0)), 0) ELSE v END AS v FROM vol LEFT JOIN tot USING ({_CELLS}, m)
  UNION ALL SELECT vol.rpgt, vol.currency, part.gateway, vol.m, t, v * p FROM vol JOIN part USING ({_CELLS}, m) WHERE t <= vol.m) GROUP BY ALL""".replace("month(month_start(m))", "month(after - INTERVAL 1 DAY)"))
def allocation_from_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from sheets, replayed over the volume; months of one type are weighted by the days' traffic, the others by days."""
    timeline = written(tl.stitched(tl.snapshot_shares(sheet_rules(spark, sf_dir), CELL), CELL), "timeline")
    heavy = F.col("rpgt") == "1-URGENT"
    by_days = tl.valid_weights(timeline.where(~heavy), months(spark))
    by_traffic = tl.weighted_fraction(timeline.where(heavy), months(spark), daily_weights(spark, sf_dir))
    a = attempts(spark, sf_dir, datetime.date(1997, 1, 1), datetime.date(1998, 1, 1)).withColumnRenamed("bank", "bin")
    sales = a.groupBy(*CELL, "gateway").agg(F.count(F.lit(1)).cast("double").alias("v"), F.sum((~F.col("success")).cast("double")).alias("r"))
    each = written(sales, "sales").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(5))))
    v = each.select(*CELL, "gateway", "m", F.lit(0).alias("t"), "v").unionByName(each.where("r > 0").select(*CELL, "gateway", "m", F.lit(3).alias("t"), F.col("r").alias("v")))
    after = tl.reallocated(v, by_days.unionByName(by_traffic.select(*by_days.columns)), CELL)
    return after.groupBy("rpgt", "currency", "gateway", "m", "t").agg(F.round(F.sum("v"), 5).alias("v"))


SCOPED = [("gw_1", datetime.date(1998, 10, 5), "volume"), ("gw_2", datetime.date(1998, 10, 5), "RISK"), ("gw_3", None, None), ("gw_4", datetime.date(1998, 9, 20), "risk")]


def _killed_sql(name: str, dead: str) -> str:
    """SNAP to weights with the kills of one scope."""
    by = "rpgt, currency"
    return f"""{name}dead(gateway, dead_from) AS (VALUES {dead}), {name}breaks AS (SELECT DISTINCT {by}, go_live, dead_from FROM timeline JOIN {name}dead USING (gateway) WHERE dead_from > go_live AND dead_from < until),
{name}every AS (SELECT {by}, go_live, gateway, share FROM timeline UNION ALL SELECT {by}, b.dead_from, gateway, share FROM timeline JOIN {name}breaks b USING ({by}, go_live)),
{name}z AS (SELECT {by}, go_live, gateway, sum(CASE WHEN dead_from <= go_live THEN 0.0 ELSE share END) AS share FROM {name}every LEFT JOIN {name}dead USING (gateway) GROUP BY ALL),
{name}snap AS (SELECT {by}, go_live, gateway, CASE WHEN sum(share) OVER w > 0 THEN share / sum(share) OVER w ELSE 0 END AS share FROM {name}z WINDOW w AS (PARTITION BY {by}, go_live)),
{name}dates AS (SELECT {by}, go_live, coalesce(lead(go_live) OVER (PARTITION BY {by} ORDER BY go_live), DATE '9999-12-31') AS until FROM (SELECT DISTINCT {by}, go_live FROM {name}snap)),
{name}timeline AS (SELECT * FROM {name}snap JOIN {name}dates USING ({by}, go_live)), {WEIGHT_SQL.replace("weights AS", f"{name}weights AS").replace("FROM timeline", f"FROM {name}timeline")},
{name}part AS (SELECT {by}, m, gateway, sum(w * share) AS p FROM {name}weights GROUP BY ALL), {name}tot AS (SELECT {by}, m, sum(p) AS p FROM {name}part GROUP BY ALL),
{name}moved AS (SELECT {by}, vol.gateway, m, t, CASE WHEN t <= m THEN greatest(v * (1 - coalesce(p, 0)), 0) ELSE v END AS v FROM vol LEFT JOIN {name}tot USING ({by}, m) UNION ALL SELECT vol.rpgt, vol.currency, k.gateway, vol.m, t, v * p FROM vol JOIN {name}part k ON vol.rpgt = k.rpgt AND vol.currency = k.currency AND vol.m = k.m WHERE t <= vol.m)"""


_VOLUME = "('gw_1', DATE '1998-10-05'), ('gw_3', DATE '1900-01-01')"
_RISK = "('gw_2', DATE '1998-10-05'), ('gw_3', DATE '1900-01-01'), ('gw_4', DATE '1998-09-20')"


@query(f"""WITH {RULES_SQL}, {SNAP_SQL}, {TIME_SQL}, {VOL_SQL}, {_killed_sql("v_", _VOLUME)}, {_killed_sql("r_", _RISK)}
SELECT rpgt, currency, gateway, m, t, round(sum(v), 6) AS v FROM (SELECT * FROM v_moved WHERE t = 0 UNION ALL SELECT * FROM r_moved WHERE t > 0) GROUP BY ALL""")
def allocation_scoped_kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gateways switched off for transactions, for risk, or for both: sales follow the one timeline, risk the other."""
    kills = spark.createDataFrame(SCOPED, "gateway string, kill_date date, scope string")
    snapshots = written(tl.snapshot_shares(rules(spark, sf_dir), PROFILE), "snapshots")
    of_volume, of_risk = tl.scoped_kills(snapshots, kills, PROFILE)
    v = volume(spark, sf_dir)
    sold = tl.reallocated(v.where("t = 0"), tl.valid_weights(of_volume, months(spark)), PROFILE)
    risk = tl.reallocated(v.where("t > 0"), tl.valid_weights(of_risk, months(spark)), PROFILE)
    return sold.unionByName(risk).withColumn("v", F.round("v", 6))
