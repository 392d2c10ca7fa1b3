"""Tables by name and the routing roles bound to them."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions.columns import month_diff
from switchyard.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their payers: o_orderkey, o_custkey, o_orderdate, o_orderpriority, c_mktsegment, n_name, n_regionkey."""
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    payers = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "n_regionkey")
    return orders.join(payers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "c_mktsegment", "n_name", "n_regionkey")


def attempts(spark: SparkSession, sf_dir: str, since: datetime.date | None = None, until: datetime.date | None = None) -> DataFrame:
    """Payment attempts of [since, until): day, origin, rpgt, currency, bank, gateway, provider, country, success, amount, quantity and the line's ids.

    Equal to ``ATTEMPTS_SQL``.  Orders meet their payers first, so lines are shuffled once; the range of days is written on the
    stored column, so the scan sees it.  The only broadcast is ``nation``, a table of 25 rows at any scale.
    """
    lines = table(spark, sf_dir, "lineitem")
    at = lambda d: F.lit(d).cast(lines.schema["l_shipdate"].dataType)
    lines = lines.where(F.col("l_shipdate") >= at(since)) if since else lines
    lines = lines.where(F.col("l_shipdate") < at(until)) if until else lines
    return (
        lines.join(sold(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.to_date("l_shipdate").alias("day"), F.to_date("o_orderdate").alias("origin"), F.col("o_orderpriority").alias("rpgt"), F.col("c_mktsegment").alias("currency"),
            F.col("n_name").alias("bank"), F.concat(F.lit("gw_"), (F.col("l_suppkey") % 10).cast("string")).alias("gateway"), F.col("l_linestatus").alias("provider"),
            F.when(F.col("n_regionkey") == 1, "USA").otherwise("Non-USA").alias("country"), (F.col("l_returnflag") != "R").alias("success"), F.col("l_extendedprice").alias("amount"),
            F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("o_custkey").alias("payer"),
        )
    )


ATTEMPTS_SQL = """attempts AS (
  SELECT CAST(l_shipdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS origin, o_orderpriority AS rpgt, c_mktsegment AS currency,
         n_name AS bank, 'gw_' || CAST(l_suppkey % 10 AS VARCHAR) AS gateway, l_linestatus AS provider,
         CASE WHEN n_regionkey = 1 THEN 'USA' ELSE 'Non-USA' END AS country, l_returnflag <> 'R' AS success,
         l_extendedprice AS amount, l_quantity AS quantity, l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS payer
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


MONTH0 = datetime.date(1998, 9, 1)


def history(spark: SparkSession, sf_dir: str, keys: Sequence[str] = ("rpgt", "currency", "gateway")) -> DataFrame:
    """(period, t, keys, provider, success, n): attempts by month before the last full one (0 to 8), age 0 to 9 and keys.

    All forecasts come from this table.  It is written once for each call, so a plan that uses it many times has one scan of the
    lines and one wide shuffle; its size follows the keys, not the traffic.
    """
    first = datetime.date(1998, 1, 1)  # period 8
    a = attempts(spark, sf_dir, since=first, until=datetime.date(1998, 10, 1))
    period = month_diff(F.lit(MONTH0), F.col("day"))
    age = F.least(F.greatest(month_diff(F.col("day"), F.col("origin")), F.lit(0)), F.lit(9))
    counts = a.select(period.alias("period"), age.alias("t"), *keys, "provider", "success").groupBy("period", "t", *keys, "provider", "success").agg(F.count(F.lit(1)).alias("n"))
    return written(counts, "history")


def event(scheme: str) -> Column:
    """The risk event of a scheme: any failure, or failures of one provider (chargebacks)."""
    failed = ~F.col("success")
    return failed if scheme == "a" else failed & (F.col("provider") == "O")


def risk_of(counts: DataFrame, scheme: str = "a", keys: Sequence[str] = ("rpgt", "currency", "gateway")) -> DataFrame:
    """(period, t, keys, risk_count) of ``history``.  Equal to ``RISK_SQL`` for scheme a, ``RISK_B_SQL`` for b."""
    return counts.where(event(scheme)).groupBy("period", "t", *keys).agg(F.sum("n").alias("risk_count"))


def risk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_of(history(spark, sf_dir))


RISK_SQL = (
    ATTEMPTS_SQL
    + """, risk_history AS (
  SELECT CAST((1998 - year(day)) * 12 + 9 - month(day) AS INTEGER) AS period,
         CAST(least(greatest((year(day) - year(origin)) * 12 + month(day) - month(origin), 0), 9) AS INTEGER) AS t,
         rpgt, currency, gateway, count(*) AS risk_count
  FROM attempts WHERE NOT success AND (1998 - year(day)) * 12 + 9 - month(day) BETWEEN 0 AND 8 GROUP BY ALL)"""
)
RISK_B_SQL = RISK_SQL.replace("WHERE NOT success AND", "WHERE NOT success AND provider = 'O' AND")
