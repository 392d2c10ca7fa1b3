"""Drift between two sets of nested rule documents, whatever the order of their keys and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from switchyard.operators.compression import RULE_SCHEMA


def canonical(value: Column, kind: DataType) -> Column:
    """``value`` with fields by name and lists sorted, on every level."""
    if isinstance(kind, StructType):
        inner = F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.array_sort(F.transform(value, lambda x: canonical(x, kind.elementType)))
    if isinstance(kind, MapType):
        return F.array_sort(F.map_entries(value))
    return value


def digest(value: Column, kind: DataType) -> Column:
    return F.sha2(F.to_json(F.struct(canonical(value, kind).alias("v"))), 256)


def identified(rules: DataFrame, type_key: str = "rpgt") -> DataFrame:
    """(type, id, rest, body, n) of documents (json): digests of the selector, of the selector without its type, and of the connectors.

    Equal documents are counted.  Priorities are left out: they follow from the set as a whole.  Unreadable documents and other
    kinds are left out.
    """
    spark = rules.sparkSession
    kind = spark.createDataFrame([], RULE_SCHEMA).schema
    parsed = rules.select(F.from_json("json", RULE_SCHEMA).alias("r")).where("r.kind = 'ConnectorPool'")
    asked, made = "r.selector.expressions", "r.spec.connectors"
    of = lambda name: kind[name.split(".")[1]].dataType[name.split(".")[2]].dataType
    own = F.flatten(F.transform(F.filter(asked, lambda e: e["key"] == type_key), lambda e: e["values"]))
    rest = F.filter(asked, lambda e: e["key"] != type_key)
    each = parsed.select(
        F.array_join(F.array_sort(own), "|").alias("type"), digest(F.col(asked), of(asked)).alias("id"), digest(rest, of(asked)).alias("rest"), digest(F.col(made), of(made)).alias("body")
    )
    return each.groupBy("type", "id", "rest", "body").agg(F.count(F.lit(1)).alias("n"))


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, left over, right over): documents paired one to one by ``keys``, in the order of their types and digests.

    Counts stand for equal documents: an interval of numbers within the key for each row, and pairs where intervals meet.
    """
    order = ["type", "id", "body"]

    def numbered(f: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # distinct documents of one key
        rows = f.withColumn("_from", F.coalesce(F.sum("n").over(w), F.lit(0)))
        total = F.sum("n").over(Window.partitionBy(*keys))
        return rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ("type", "id", "rest", "body", "n", "_from")], total.alias(f"{side}_total"))

    a, b = numbered(left, "a"), numbered(right, "b")
    low, high = F.greatest("a__from", "b__from"), F.least(F.col("a__from") + F.col("a_n"), F.col("b__from") + F.col("b_n"))
    pairs = a.join(b, list(keys)).where(low < high).select(F.col("a_type").alias("was"), F.col("b_type").alias("type"), F.col("b_id").alias("id"), (high - low).alias("n"))

    def over(mine: DataFrame, side: str, other: DataFrame, theirs: str) -> DataFrame:
        met = other.select(*keys, F.col(f"{theirs}_total").alias("_met")).distinct()
        rows = mine.join(met, list(keys), "left")
        left_ = F.least(F.col(f"{side}_n"), F.col(f"{side}__from") + F.col(f"{side}_n") - F.coalesce("_met", F.lit(0)))
        names = [F.col(f"{side}_{c}").alias(c) for c in ("type", "id", "rest", "body")]
        return rows.select(*names, left_.alias("n")).where("n > 0")

    return pairs, over(a, "a", b, "b"), over(b, "b", a, "a")


def drift(before: DataFrame, after: DataFrame, type_key: str = "rpgt") -> DataFrame:
    """(status, was, type, n): documents of two sets (json), paired one to one: ``same``; ``changed`` (one selector, other connectors); ``moved``
    (all the same but the type); ``dropped`` and ``added``."""
    a, b = identified(before, type_key), identified(after, type_key)
    out = []
    for status, keys in (("same", ["id", "body"]), ("changed", ["id"]), ("moved", ["rest", "body"])):
        pairs, a, b = _matched(a, b, keys)
        out.append(pairs.select(F.lit(status).alias("status"), "was", "type", "n"))
    out.append(a.select(F.lit("dropped").alias("status"), F.col("type").alias("was"), F.lit(None).cast("string").alias("type"), "n"))
    out.append(b.select(F.lit("added").alias("status"), F.lit(None).cast("string").alias("was"), "type", "n"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.groupBy("status", "was", "type").agg(F.sum("n").alias("n"))
