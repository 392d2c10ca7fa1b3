"""Compression and rule-generation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators import budget as bu
from switchyard.operators import compression as cm
from switchyard.operators import drift as dr
from switchyard.operators import template as te
from switchyard.plans.rates import CELL, SPLIT_SQL, softmax_split
from switchyard.registry import query
from switchyard.sources.shared import written
from switchyard.sources.tables import attempts


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmax_split(spark, sf_dir).select(*CELL, "gateway", "share", "volume")


@query(f"""WITH {SPLIT_SQL}, cut AS (SELECT *, CAST(floor(share * 1000 + 1e-9) AS INTEGER) AS whole, share * 1000 - floor(share * 1000 + 1e-9) AS d FROM split),
r AS (SELECT *, row_number() OVER (PARTITION BY rpgt, currency, bank ORDER BY round(d, 9) DESC, gateway) AS k, 1000 - sum(whole) OVER (PARTITION BY rpgt, currency, bank) AS left_ FROM cut)
SELECT rpgt, currency, bank, gateway, CAST(whole + CASE WHEN k <= left_ THEN 1 ELSE 0 END AS INTEGER) AS weight FROM r""")
def rules_whole_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.whole_weights(_split(spark, sf_dir), CELL).select(*CELL, "gateway", "weight")


@query(f"""WITH {SPLIT_SQL}, w AS (SELECT rpgt, currency, bank, list_sort(list(gateway)) AS g FROM split WHERE share > 0.15 GROUP BY ALL) SELECT rpgt, currency, array_to_string(g, ',') AS signature, count(*) AS banks FROM w GROUP BY ALL""")
def rules_gateway_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _split(spark, sf_dir).where("share > 0.15").groupBy(*CELL).agg(F.array_join(F.array_sort(F.collect_list("gateway")), ",").alias("signature"))
    return g.groupBy("rpgt", "currency", "signature").agg(F.count(F.lit(1)).alias("banks"))


@query(f"""WITH {SPLIT_SQL} SELECT rpgt, currency, bank, string_agg(gateway || '=' || format('{{:.3f}}', round(share, 3)), ',' ORDER BY gateway) AS signature FROM split WHERE share > 0 GROUP BY ALL""")
def rules_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.signatures(_split(spark, sf_dir), CELL, 3)


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares rounded to tenths, so that banks share rules."""
    from switchyard.functions.columns import share_of

    return _split(spark, sf_dir).withColumn("share", F.round("share", 1)).withColumn("share", share_of("share", CELL, "even"))


POOLS_SQL = f"""{SPLIT_SQL}, tenths AS (SELECT rpgt, currency, bank, gateway, round(share, 1) AS r FROM split), coarse AS (SELECT *, CASE WHEN sum(r) OVER w > 0 THEN r / sum(r) OVER w ELSE 1.0 / count(*) OVER w END AS x FROM tenths WINDOW w AS (PARTITION BY rpgt, currency, bank)),
cut AS (SELECT *, CAST(floor(x * 1000 + 1e-9) AS INTEGER) AS whole, x * 1000 - floor(x * 1000 + 1e-9) AS d FROM coarse), placed AS (SELECT *, row_number() OVER (PARTITION BY rpgt, currency, bank ORDER BY round(d, 9) DESC, gateway) AS k, 1000 - sum(whole) OVER (PARTITION BY rpgt, currency, bank) AS rest FROM cut),
weights AS (SELECT rpgt, currency, bank, gateway, CAST(whole + CASE WHEN k <= rest THEN 1 ELSE 0 END AS INTEGER) AS weight FROM placed),
connected AS (SELECT rpgt, currency, bank, string_agg('{{"gateway":"' || gateway || '","weight":' || weight || '}}', ',' ORDER BY gateway) AS c, list({{'gateway': gateway, 'weight': weight}} ORDER BY gateway) AS parts FROM weights WHERE weight > 0 GROUP BY ALL),
pools AS (SELECT rpgt, currency, c, parts, list(bank ORDER BY bank) AS banks FROM connected GROUP BY ALL), ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY len(banks), rpgt, currency, '[' || c || ']') AS INTEGER) AS priority FROM pools)"""
_IN = """'{"key":"' || {0} || '","operator":"IN","values":["' || {1} || '"]}'"""


@query(f"""WITH {POOLS_SQL} SELECT priority, '{{"kind":"ConnectorPool","selector":{{"priority":' || priority || ',"expressions":[' || {_IN.replace("{0}", "'rpgt'").replace("{1}", "rpgt")} || ',' || {_IN.replace("{0}", "'currency'").replace("{1}", "currency")} || ',' || {_IN.replace("{0}", "'bank'").replace("{1}", """array_to_string(banks, '","')""")} || ']}},"spec":{{"connectors":[' || c || ']}}}}' AS json FROM ranked""")
def rules_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.rule_json(cm.pools(_coarse(spark, sf_dir), CELL, "bank"), ["rpgt", "currency"])


@query(f"""WITH {POOLS_SQL}, found AS (SELECT priority, unnest(parts) AS x FROM ranked WHERE rpgt = '1-URGENT' AND currency = 'BUILDING' AND list_contains(banks, 'NATION_6')) SELECT priority, x.gateway AS gateway, x.weight AS weight FROM found""")
def rules_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.matched_rules(rules_json(spark, sf_dir), {"rpgt": "1-URGENT", "currency": "BUILDING", "bank": "NATION_6"})


@query()
def rules_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.clustered(_split(spark, sf_dir), CELL, ["rpgt", "currency"], [f"gw_{k}" for k in range(10)], 0.8)


@query()
def rules_cluster_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = written(_split(spark, sf_dir), "split")  # its size follows the keys
    return cm.accuracy(before, cm.clustered(before, CELL, ["rpgt", "currency"], [f"gw_{k}" for k in range(10)], 0.8), CELL)


USA_ONLY, INCAPABLE = ["gw_1", "gw_2", "gw_3", "gw_7"], ["gw_4", "gw_5", "gw_6"]
SUB = [*CELL, "country", "provider"]
_SUB = ", ".join(SUB)
TEMPLATE_SQL = f"""{SPLIT_SQL}, sums AS (SELECT rpgt, currency, bank, gateway, pow(share, 3) AS s FROM split), base AS (SELECT rpgt, currency, bank, gateway, s / sum(s) OVER (PARTITION BY rpgt, currency, bank) AS share FROM sums),
presence AS (SELECT currency, bank, count(*) FILTER (country = 'USA') AS usa, count(*) FILTER (country <> 'USA') AS other FROM attempts WHERE length(bank) % 3 <> 0 GROUP BY ALL),
sub AS (SELECT base.*, country, provider FROM base LEFT JOIN presence USING (currency, bank), (VALUES ('USA'), ('Non-USA')) c(country), (VALUES ('GOOGLEPAY'), ('APPLEPAY'), ('non_gp_ap')) p(provider)
  WHERE usa IS NULL OR (country = 'USA' AND usa > 0) OR (country = 'Non-USA' AND (other > 0 OR usa = 0))),
able AS (SELECT * REPLACE (CASE WHEN (country <> 'USA' AND gateway IN ('gw_1', 'gw_2', 'gw_3', 'gw_7')) OR (provider <> 'non_gp_ap' AND gateway IN ('gw_4', 'gw_5', 'gw_6')) THEN 0 ELSE share END AS share) FROM sub),
n AS (SELECT * REPLACE (CASE WHEN sum(share) OVER w > 0 THEN share / sum(share) OVER w ELSE 0 END AS share) FROM able WINDOW w AS (PARTITION BY {_SUB})),
m AS (SELECT *, sum(greatest(share - 0.4, 0)) OVER w AS excess, sum(CASE WHEN share > 1e-12 AND share < 0.4 - 1e-12 THEN 0.4 - share ELSE 0 END) OVER w AS space, sum(CASE WHEN share > 1e-12 THEN 1 ELSE 0 END) OVER w AS used FROM n WINDOW w AS (PARTITION BY {_SUB})),
filled AS (SELECT {_SUB}, gateway, used, CASE WHEN used >= 2 AND excess > 1e-12 THEN CASE WHEN share > 0.4 THEN 0.4 WHEN share > 1e-12 AND share < 0.4 - 1e-12 AND space > 1e-12 THEN share + (0.4 - share) / space * least(excess, space) ELSE share END ELSE share END AS share FROM m),
u AS (SELECT *, CAST(round(share * 10000) AS BIGINT) AS u, CASE WHEN used >= 2 THEN 4000 ELSE 10000 END AS lim FROM filled),
r AS (SELECT *, CASE WHEN sum(u) OVER w > 0 THEN 10000 - sum(u) OVER w ELSE 0 END AS r FROM u WINDOW w AS (PARTITION BY {_SUB})),
room AS (SELECT *, CASE WHEN u = 0 THEN 0 WHEN r > 0 THEN greatest(lim - u, 0) ELSE u END AS room FROM r),
pushed AS (SELECT *, coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(room) OVER (PARTITION BY {_SUB}) AS space, row_number() OVER o AS k FROM room WINDOW o AS (PARTITION BY {_SUB} ORDER BY u = 0, u >= lim, u DESC, gateway)),
sheet AS (SELECT {_SUB}, gateway, CAST(u + sign(r) * (greatest(least(room, abs(r) - before), 0) + CASE WHEN k = 1 THEN greatest(abs(r) - space, 0) ELSE 0 END) AS BIGINT) AS units FROM pushed)"""


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts at home and abroad, for most banks: the others are taken to have both."""
    a = attempts(spark, sf_dir).where("length(bank) % 3 <> 0")
    return a.groupBy("currency", "bank").agg(F.count_if(F.col("country") == "USA").alias("usa"), F.count_if(F.col("country") != "USA").alias("other"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    steep = _split(spark, sf_dir).withColumn("share", F.pow("share", F.lit(3.0)))
    return te.template(steep, CELL, _presence(spark, sf_dir), USA_ONLY, INCAPABLE, 0.4)


@query(f"WITH {TEMPLATE_SQL} SELECT {_SUB}, gateway, units FROM sheet")
def rules_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir).select(*SUB, "gateway", "units")


@query(f"""WITH {TEMPLATE_SQL}, sig AS (SELECT {_SUB}, sum(units) AS "check", string_agg(gateway || ':' || units, ',' ORDER BY gateway) FILTER (units > 0) AS signature FROM sheet GROUP BY ALL),
fst AS (SELECT *, min((currency, bank, country <> 'USA', CASE provider WHEN 'GOOGLEPAY' THEN 1 WHEN 'APPLEPAY' THEN 2 ELSE 3 END)) OVER (PARTITION BY rpgt, coalesce(signature, '')) AS first FROM sig)
SELECT {_SUB}, CAST("check" AS BIGINT) AS "check", dense_rank() OVER (PARTITION BY rpgt ORDER BY first) AS condition FROM fst""")
def rules_template_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's sum and condition code: rows of one type with the same shares have the same."""
    rows = written(_sheet(spark, sf_dir).select(*SUB, "gateway", "units"), "template")
    return te.conditions(rows, ["rpgt"], SUB)


@query()
def rules_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split with 100 rules over all types and currencies."""
    return bu.compressed(_split(spark, sf_dir), CELL, ["rpgt", "currency"], [f"gw_{k}" for k in range(10)], budget=100, fine=25)[0]


@query()
def rules_budget_allotment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of 100 rules each type and currency gets, and the volume that they still route elsewhere."""
    return bu.compressed(_split(spark, sf_dir), CELL, ["rpgt", "currency"], [f"gw_{k}" for k in range(10)], budget=100, fine=25)[1].select(F.col("_g").alias("of"), "k", "loss", F.col("w").alias("volume"))


@query()
def rules_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the split against those of a later one: two types exchanged, one currency routed anew, some banks gone."""
    split = written(_coarse(spark, sf_dir), "coarse")
    swapped = F.when(F.col("rpgt") == "5-LOW", "2-HIGH").when(F.col("rpgt") == "2-HIGH", "5-LOW").otherwise(F.col("rpgt"))
    anew = F.when(F.col("currency") == "BUILDING", F.reverse("gateway")).otherwise(F.col("gateway"))
    later = split.where("length(bank) > 8 OR currency <> 'MACHINERY'").withColumn("rpgt", swapped).withColumn("gateway", anew)
    rules = lambda s: cm.rule_json(cm.pools(s, CELL, "bank"), ["rpgt", "currency"])
    return dr.drift(rules(split), rules(later))


# A template on a grid of twentieths, so that banks share pools.
POOLED_SQL = f"""{TEMPLATE_SQL.replace("10000", "20").replace("4000", "8")}, sig AS (SELECT {_SUB}, string_agg(gateway || ':' || units, ',' ORDER BY gateway) AS sig, list({{'gateway': gateway, 'units': units}} ORDER BY gateway) AS parts FROM sheet WHERE units > 0 GROUP BY ALL),
sets AS (SELECT rpgt, currency, sig, parts, country, provider, list(bank ORDER BY bank) AS banks FROM sig GROUP BY ALL),
labelled AS (SELECT rpgt, currency, sig, parts, banks, provider, CASE WHEN count(DISTINCT country) > 1 THEN 'All' ELSE max(country) END AS country FROM sets GROUP BY ALL),
met AS (SELECT rpgt, currency, sig, parts, banks, country, list(provider ORDER BY provider) AS p FROM labelled GROUP BY ALL),
rules AS (SELECT *, unnest(CASE WHEN len(p) = 3 THEN [p] WHEN list_has_all(p, ['APPLEPAY', 'GOOGLEPAY']) THEN list_concat([['APPLEPAY', 'GOOGLEPAY']], list_transform(list_filter(p, lambda v: v NOT IN ('APPLEPAY', 'GOOGLEPAY')), lambda v: [v])) ELSE list_transform(p, lambda v: [v]) END) AS providers FROM met),
raw AS (SELECT *, list_sort(list_transform(parts, lambda v: {{'w': -CAST(round_even(v.units * 50.0, 0) AS INTEGER), 'gateway': v.gateway}})) AS r FROM rules),
gaps AS (SELECT *, 1000 + list_sum(list_transform(r, lambda v: v.w)) AS gap FROM raw),
pools AS (SELECT rpgt, currency, country, providers, banks, list_sort(list_transform(r, lambda v, i: {{'gateway': v.gateway, 'weight': -v.w + CAST(sign(gap) AS INTEGER) * (CAST(abs(gap) // len(r) AS INTEGER) + CASE WHEN i - 1 < abs(gap) % len(r) THEN 1 ELSE 0 END)}})) AS connectors,
  CASE WHEN rpgt = '5-LOW' THEN 500000 ELSE 100000 END + 200000 + CASE WHEN providers = ['APPLEPAY', 'GOOGLEPAY'] THEN 100000 ELSE 0 END + 200000 AS priority FROM gaps)"""


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    steep = _split(spark, sf_dir).withColumn("share", F.pow("share", F.lit(3.0)))
    rows = te.template(steep, CELL, _presence(spark, sf_dir), USA_ONLY, INCAPABLE, 0.4, 20)
    return te.pools(rows.select(*SUB, "gateway", "units"), special=["5-LOW"], grid=20)


@query(f"""WITH {POOLED_SQL} SELECT rpgt, currency, country, array_to_string(providers, '+') AS providers, array_to_string(banks, '|') AS banks, array_to_string(list_transform(connectors, lambda v: v.gateway || ':' || v.weight), ',') AS connectors, CAST(priority AS INTEGER) AS priority FROM pools""")
def rules_template_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools of a template: countries and providers with the same shares are combined."""
    text = F.transform("connectors", lambda x: F.concat_ws(":", x["gateway"], x["weight"].cast("string")))
    return _pooled(spark, sf_dir).select("rpgt", "currency", "country", F.array_join("providers", "+").alias("providers"), F.array_join("banks", "|").alias("banks"), F.array_join(text, ",").alias("connectors"), "priority")


@query(f"WITH {POOLED_SQL} SELECT rpgt, count(*) AS pools, max(priority) AS top FROM pools GROUP BY rpgt")
def rules_pool_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir).groupBy("rpgt").agg(F.count(F.lit(1)).alias("pools"), F.max("priority").alias("top"))


@query(f"WITH {TEMPLATE_SQL} SELECT {_SUB}, gateway, round(CAST(units AS DOUBLE) / sum(units) OVER (PARTITION BY {_SUB}), 6) AS share FROM sheet WHERE units > 0 AND rpgt <> '3-MEDIUM'")
def rules_of_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's sheet read back as rules; one type is left to its actuals."""
    names = [f"gw_{k}" for k in range(10)]
    sheet = te.wide(_sheet(spark, sf_dir).select(*SUB, "gateway", "units"), SUB, names)
    return te.shares_of(sheet.where("rpgt <> '3-MEDIUM'"), SUB, names).withColumn("share", F.round("share", 6))
