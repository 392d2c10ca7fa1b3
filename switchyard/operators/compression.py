"""Compression of a split to few rules, and the rules as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import share_of
from switchyard.operators.budget import compressed
from switchyard.operators.ordered import running


def signatures(split: DataFrame, cell: Sequence[str], digits: int = 4) -> DataFrame:
    """(cell, signature): gateways with rounded shares, in order; cells of one signature can share a rule without loss."""
    parts = F.array_sort(F.collect_list(F.struct("gateway", F.round("share", digits).alias("share"))))  # a cell's gateways
    text = F.array_join(F.transform(parts, lambda x: F.concat_ws("=", x["gateway"], F.format_number(x["share"], digits))), ",")
    return split.where("share > 0").groupBy(*cell).agg(text.alias("signature"))


def whole_weights(split: DataFrame, cell: Sequence[str], total: int = 1000) -> DataFrame:
    """Integer weights that sum to ``total``: rounded down, the rest to the largest fractions."""
    raw = F.col("share") * total
    floored = split.withColumn("_f", F.floor(raw + 1e-9).cast("int")).withColumn("_d", raw - F.col("_f"))
    w = Window.partitionBy(*cell)
    left = F.lit(total) - F.sum("_f").over(w)
    rank = F.row_number().over(w.orderBy(F.round("_d", 9).desc(), "gateway"))
    return floored.withColumn("weight", (F.col("_f") + (rank <= left).cast("int")).cast("int")).drop("_f", "_d")


def pools(split: DataFrame, cell: Sequence[str], bank: str, chunk: int = 6500, total: int = 1000) -> DataFrame:
    """One row for each rule: other cell columns, banks (sorted, at most ``chunk``), connectors and the number of the chunk."""
    others = [c for c in cell if c != bank]
    weighted = whole_weights(split, cell, total).where("weight > 0")
    by_cell = weighted.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("gateway", "weight"))).alias("connectors"))
    ranked = by_cell.withColumn("_n", F.row_number().over(Window.partitionBy(*others, "connectors").orderBy(bank)) - 1)
    return ranked.groupBy(*others, "connectors", F.floor(F.col("_n") / chunk).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(bank)).alias("banks"))


def rule_json(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(priority, json): a ``ConnectorPool`` document for each rule; narrower rules come first, then by content."""
    expressions = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit("IN").alias("operator"), F.array(F.col(k).cast("string")).alias("values")) for k in keys],
        F.struct(F.lit("bank").alias("key"), F.lit("IN").alias("operator"), F.col("banks").alias("values")),
    )
    sized = rules.withColumn("_size", F.size("banks")).withColumn("_text", F.to_json("connectors"))
    ranked = running(sized, ["_size", *keys, "chunk", "_text"]).withColumn("priority", F.col("row").cast("int"))
    body = F.struct(F.lit("ConnectorPool").alias("kind"), F.struct("priority", expressions.alias("expressions")).alias("selector"), F.struct("connectors").alias("spec"))
    return ranked.select("priority", F.to_json(body).alias("json"))


RULE_SCHEMA = "kind string, selector struct<priority:int,expressions:array<struct<key:string,operator:string,values:array<string>>>>, spec struct<connectors:array<struct<gateway:string,weight:int>>>"


def matched_rules(rules: DataFrame, profile: dict[str, str]) -> DataFrame:
    """Rules (json) whose expressions all hold for the profile, by priority."""
    parsed = rules.select(F.from_json("json", RULE_SCHEMA).alias("r")).where("r.kind = 'ConnectorPool'")
    facts = F.create_map(*[F.lit(x) for pair in profile.items() for x in pair])
    return parsed.where(F.forall("r.selector.expressions", lambda e: F.array_contains(e["values"], F.element_at(facts, e["key"])))).select("r.selector.priority", F.explode("r.spec.connectors").alias("c")).select("priority", "c.gateway", "c.weight").orderBy("priority", "gateway")


def clustered(split: DataFrame, cell: Sequence[str], group: Sequence[str], gateways: Sequence[str], target: float = 0.95, most: float = 0.97, fine: int = 256) -> DataFrame:
    """(cell, cluster, gateway, share): in each ``group`` the cells share few splits, as few as keep ``target`` of the volume routed as before.

    Up to ``fine`` splits a group (``budget.compressed``).  Centroids are capped at ``most``.  Columns share and volume.
    """
    return compressed(split, cell, group, gateways, target=target, fine=fine, most=most)[0]


def accuracy(before: DataFrame, after: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Per cent of volume routed as before: (1 - sum w L1 / 2 sum w) 100."""
    a = before.select(*cell, "gateway", F.col("share").alias("a"), "volume")
    b = after.select(*cell, "gateway", F.col("share").alias("b"))
    weight = before.groupBy(*cell).agg(F.max("volume").alias("w"))
    both = a.drop("volume").join(b, [*cell, "gateway"], "full_outer").groupBy(*cell).agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("l1")).join(weight, list(cell))
    return both.agg(((1 - F.sum(F.col("w") * F.col("l1")) / (2 * F.sum("w"))) * 100).alias("accuracy"))
