"""Row numbers and running totals along a global order, without a window over one task.

Rows are range-sorted into partitions; each numbers its own, and gets what all before it add up to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.sources.shared import written


def running(frame: DataFrame, order: Sequence[str], sums: Mapping[str, str] | None = None, within: Sequence[str] = (), part: int = 1_000_000) -> DataFrame:
    """``frame`` with ``row`` (from 1) and running totals (``sums``: name of the total -> column) along ``order``, anew for each ``within``.

    ``order`` names columns, a leading - for descending; it should leave no ties, or those rows come in any order.  A partition
    holds about ``part`` rows.  Totals of integers and decimals are exact.
    """
    sums, keys = dict(sums or {}), list(within)
    if "_at" in frame.columns or "_part" in frame.columns:
        raise ValueError("the columns _at and _part are taken")
    frame = written(frame, "unordered")
    by = [F.col(c) for c in keys] + [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    ranged = frame.repartitionByRange(max(1, -(-frame.count() // part)), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()  # the partition's number, then the row's in it
    placed = written(ranged.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), "ordered")
    total = {"_rows": F.count(F.lit(1)), **{f"_{name}": F.sum(c) for name, c in sums.items()}}
    parts = placed.groupBy("_part", *keys).agg(*[c.alias(n) for n, c in total.items()])
    if keys:  # a key's rows: one for each partition that it is in
        w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = parts.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in total])
        same = F.col("_part") == F.col("_of")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        joined = placed.join(before, same).drop("_of", *[f"_of_{k}" for k in keys])
    else:
        rows, so_far, table = sorted(parts.collect(), key=lambda r: r["_part"]), dict.fromkeys(total), []  # one for each partition
        for r in rows:
            table.append((r["_part"], *[so_far[n] or 0 if n == "_rows" else so_far[n] for n in total]))
            so_far = {n: r[n] if so_far[n] is None else so_far[n] + (r[n] or 0) for n in total}
        before = placed.sparkSession.createDataFrame(table, parts.select("_part", *total).schema)
        joined = placed.join(F.broadcast(before), "_part")
    here = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = joined.withColumn("row", F.count(F.lit(1)).over(here) + F.col("_rows"))
    for name, column in sums.items():
        found = found.withColumn(name, F.coalesce(F.sum(column).over(here), F.lit(0)) + F.coalesce(f"_{name}", F.lit(0)))
    return found.drop("_at", "_part", *total)
