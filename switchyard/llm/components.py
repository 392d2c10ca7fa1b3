"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.scratch import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b) -> (id, comp): every linked id with the smallest id that it reaches.

    Each round gives a node the least label among itself and its neighbours, then follows that label one step further.
    Labels live in tables in the shared folder, never on the driver.  Raises if ``rounds`` do not suffice.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("id").alias("at"), F.col("comp").alias("there"))
        moved = step.join(jump, step.next == jump.at, "left").select("id", F.col("comp").alias("old"), F.least("next", F.coalesce("there", "next")).alias("comp"))
        moved = stored(moved, "labels")
        labels = moved.select("id", "comp")
        if moved.where("old <> comp").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
