"""Compression of a split to a given number of rules over all groups, or to the fewest that keep a share of the volume in place.

Every group's cells are clustered into fine clusters by weighted k-means, all groups at once, each task adding up its part of the
centroids.  Ward's tree over a group's fine clusters nests them, so one pass over the cells gives the loss (volume routed elsewhere)
for every number of rules.  Segments of the curves' convex hulls, sorted by gain a rule, are taken up to the budget by a running total.

The centroids of all groups are known to every task: their number is that of the rules at the finest, which ``LIMIT`` bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.operators.ordered import running
from switchyard.sources.shared import written

LIMIT = 256 << 20  # bytes of centroids that are broadcast
_NODES = "_g string, node int, parent int, x array<double>"


def vectors(split: DataFrame, cell: Sequence[str], group: Sequence[str], gateways: Sequence[str]) -> DataFrame:
    """(cell, _g, x, w): each cell's shares over ``gateways``, normalised, its volume, and its group as text.  Cells without shares are left out."""
    vector = F.map_from_entries(F.collect_list(F.struct("gateway", "share")))  # a cell's gateways
    wide = split.where(F.col("share") > 0).groupBy(*cell).agg(vector.alias("m"), F.max(F.coalesce(F.col("volume"), F.lit(0.0))).cast("double").alias("w"))
    x = F.array(*[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)) for n in gateways])
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    ready = wide.select(*cell, F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("_g"), F.greatest("w", F.lit(1e-6)).alias("w"), x.alias("x")).withColumn("_t", total).where("_t > 0")
    return ready.withColumn("x", F.transform("x", lambda v: F.round(v / F.col("_t"), 12))).drop("_t")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid; no array of rows by centroids by gateways."""
    return ((centres * centres).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def _by_group(batch: pa.RecordBatch, size: int = 8192) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, rows of the batch, their vectors), in pieces."""
    names = np.array(batch.column("_g").to_pylist(), dtype=object)
    x = _matrix(batch.column("x"))
    for g in dict.fromkeys(names.tolist()):
        at = np.flatnonzero(names == g)
        for k in range(0, len(at), size):
            yield g, at[k : k + size], x[at[k : k + size]]


def lloyd(points: DataFrame, k: int, rounds: int = 30) -> dict[str, np.ndarray]:
    """Centroids of each group by weighted k-means: ``points`` has _g, x, w, no x twice in a group.  It starts from the ``k`` heaviest points, ties by their vectors, so it is the same every time."""
    heavy = Window.partitionBy("_g").orderBy(F.desc("w"), "x")
    first = points.withColumn("_r", F.row_number().over(heavy)).where(F.col("_r") <= k).orderBy("_g", "_r").select("_g", "x").collect()
    centres: dict[str, np.ndarray] = {}
    for r in first:
        centres.setdefault(r["_g"], []).append(r["x"])
    centres = {g: np.array(c) for g, c in centres.items()}
    if sum(c.nbytes for c in centres.values()) > LIMIT:
        raise ValueError(f"{k} fine clusters of {len(centres)} groups are over {LIMIT} bytes; take fewer")
    width = max((c.shape[1] for c in centres.values()), default=0)
    for _ in range(rounds):
        told = centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                w = batch.column("w").to_numpy(zero_copy_only=False)
                for g, at, x in _by_group(batch):
                    c = _nearest(x, told[g])  # noqa: B023
                    part = sums.setdefault(g, np.zeros((len(told[g]), x.shape[1] + 1)))  # noqa: B023
                    np.add.at(part, c, np.column_stack([x * w[at, None], w[at]]))
            rows = [(g, c, part[c]) for g, part in sums.items() for c in np.flatnonzero(part[:, -1]).tolist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["_g", "c", "s"])

        sums = points.mapInArrow(run, "_g string, c int, s array<double>").groupBy("_g", "c").agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width + 1)])
        new = {g: c.copy() for g, c in centres.items()}
        for r in sums.collect():  # a row for each centroid
            row = np.array([r[f"s{j}"] for j in range(width + 1)])
            new[r["_g"]][r["c"]] = row[:-1] / row[-1]
        moved = max((np.abs(new[g] - centres[g]).max() for g in centres), default=0.0)
        centres = new
        if moved < 1e-12:
            break
    return centres


def _ward(g: pd.DataFrame) -> pd.DataFrame:
    """Ward's tree of one group's fine clusters: leaves 0 to n - 1, then a node for each merge; the root's parent is -1."""
    g = g.sort_values("c").reset_index(drop=True)
    x, w, n = np.array(g["x"].tolist(), dtype=float), g["w"].to_numpy(float), len(g)
    x, w = np.vstack([x, np.zeros((n - 1, x.shape[1]))]), np.append(w, np.zeros(n - 1))
    parent, live = np.full(2 * n - 1, -1), list(range(n))
    for new in range(n, 2 * n - 1):
        some = np.array(live)
        far = ((x[some] ** 2).sum(axis=1)[:, None] + (x[some] ** 2).sum(axis=1)[None] - 2 * x[some] @ x[some].T) * (w[some][:, None] * w[some][None] / (w[some][:, None] + w[some][None]))
        far[np.tril_indices(len(some))] = np.inf
        a, b = np.unravel_index(far.argmin(), far.shape)
        a, b = live[a], live[b]
        w[new], x[new] = w[a] + w[b], (w[a] * x[a] + w[b] * x[b]) / (w[a] + w[b])
        parent[[a, b]] = new
        live = [k for k in live if k not in (a, b)] + [new]
    return pd.DataFrame({"_g": g["_g"].iloc[0], "node": np.arange(2 * n - 1, dtype="int32"), "parent": parent.astype("int32"), "x": list(x)})


def trees(points: DataFrame, k: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each group the parents and centroids of its tree's nodes."""
    spark, centres = points.sparkSession, lloyd(points, k)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, out = batch.column("w").to_numpy(zero_copy_only=False), []
            for g, at, x in _by_group(batch):
                sums = np.bincount(_nearest(x, centres[g]), w[at], minlength=len(centres[g]))
                out += [(g, c, v) for c, v in enumerate(sums.tolist()) if v > 0]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64()), strict=True)], names=["_g", "c", "w"])

    weights = points.mapInArrow(weigh, "_g string, c int, w double").groupBy("_g", "c").agg(F.sum("w").alias("w"))
    fine = spark.createDataFrame([(g, c, row.tolist()) for g, some in centres.items() for c, row in enumerate(some)], "_g string, c int, x array<double>")
    found: dict[str, list] = {}
    for r in weights.join(fine, ["_g", "c"]).groupBy("_g").applyInPandas(_ward, _NODES).orderBy("_g", "node").collect():
        found.setdefault(r["_g"], []).append((r["parent"], r["x"]))
    return {g: (np.array([p for p, _ in rows]), np.array([x for _, x in rows])) for g, rows in found.items()}


def _leaves(parent: np.ndarray) -> int:
    return (len(parent) + 1) // 2


def curves(points: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(_g, k, loss): volume routed elsewhere with k rules, for every k up to the fine clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost: dict[str, np.ndarray] = {}
        for batch in batches:
            w = batch.column("w").to_numpy(zero_copy_only=False)
            for g, at, x in _by_group(batch):
                parent, centres = known[g]
                node, sums = _nearest(x, centres[: _leaves(parent)]), lost.setdefault(g, np.zeros(len(parent)))
                here, rows = node, np.arange(len(at))
                while len(rows):  # up the tree, all rows at once
                    np.add.at(sums, here, w[at[rows]] * np.abs(x[rows] - centres[here]).sum(axis=1) / 2)
                    up = parent[here]
                    rows, here = rows[up >= 0], up[up >= 0]
        rows = [(g, n, v) for g, some in lost.items() for n, v in enumerate(some.tolist())]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64()), strict=True)], names=["_g", "node", "loss"])

    def curve(g: pd.DataFrame) -> pd.DataFrame:
        name = g["_g"].iloc[0]
        parent = known[name][0]
        loss, n = g.set_index("node")["loss"].reindex(range(len(parent)), fill_value=0.0).to_numpy(), _leaves(parent)
        out = [loss[:n].sum()]
        for new in range(n, len(parent)):  # each merge is one rule less
            out.append(out[-1] + loss[new] - loss[parent == new].sum())
        return pd.DataFrame({"_g": name, "k": np.arange(n, 0, -1, dtype="int32"), "loss": out})

    nodes = points.mapInArrow(run, "_g string, node int, loss double").groupBy("_g", "node").agg(F.sum("loss").alias("loss"))
    return nodes.groupBy("_g").applyInPandas(curve, "_g string, k int, loss double")  # a group's nodes


def hull(curve: DataFrame) -> DataFrame:
    """(_g, start, k, gain, rate): segments of each curve's lower convex hull from one rule on, while the loss falls; the rate falls from segment to segment."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        k, loss = g["k"].to_numpy(), g["loss"].to_numpy()
        at, out = 0, []
        while at < len(k) - 1:
            slope = (loss[at] - loss[at + 1 :]) / (k[at + 1 :] - k[at])
            best = slope.max()
            if best <= 1e-9:
                break
            to = at + 1 + int(np.flatnonzero(slope >= best - 1e-12 * abs(best))[-1])
            out.append((g["_g"].iloc[0], int(k[at]), int(k[to]), float(loss[at] - loss[to]), float(best)))
            at = to
        return pd.DataFrame(out, columns=["_g", "start", "k", "gain", "rate"])

    return curve.groupBy("_g").applyInPandas(run, "_g string, start int, k int, gain double, rate double")


def allotted(curve: DataFrame, budget: int, costs: DataFrame | None = None) -> DataFrame:
    """(_g, k, loss): rules for each group, ``budget`` of them in all at most but one a group at least, so that the loss is least.

    ``costs``: _g, cost: the pools that one rule of a group makes; else 1.  The segments with the most gain a pool are taken first;
    of the first that does not fit whole, as much as fits.
    """
    curve = written(curve, "curve")
    cost = curve.select("_g").distinct()
    cost = written(cost.join(costs, "_g", "left").select("_g", F.coalesce("cost", F.lit(1)).cast("long").alias("cost")) if costs is not None else cost.withColumn("cost", F.lit(1).cast("long")), "costs")
    left = budget - (cost.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0])
    parts = hull(curve).join(cost, "_g").select("_g", "start", "k", (F.col("rate") / F.col("cost")).alias("rate"), ((F.col("k") - F.col("start")) * F.col("cost")).alias("units"), "cost")
    taken = running(parts, ["-rate", "_g", "start"], {"used": "units"})
    over = F.greatest(F.col("used") - F.lit(max(left, 0)), F.lit(0))
    reach = F.when(over <= 0, F.col("k")).when(over < F.col("units"), F.col("k") - F.ceil(over / F.col("cost")).cast("int")).otherwise(F.lit(1))
    most = taken.groupBy("_g").agg(F.max(reach).alias("most"))
    able = curve.join(most, "_g", "left").where(F.col("k") <= F.coalesce("most", F.lit(1)))
    return able.groupBy("_g").agg(F.min(F.struct("loss", "k")).alias("x")).select("_g", "x.k", "x.loss")


def kept_to(curve: DataFrame, volumes: DataFrame, target: float) -> DataFrame:
    """(_g, k, loss): the fewest rules with which each group keeps ``target`` of its volume in place, or its fine clusters where none do."""
    able = curve.join(volumes, "_g").withColumn("ok", (F.col("loss") <= (1 - target) * F.col("w") + 1e-9).cast("int"))
    best = F.min(F.struct((1 - F.col("ok")).alias("bad"), F.when(F.col("ok") == 1, F.col("k")).otherwise(-F.col("k")).alias("n"), "k", "loss"))
    return able.groupBy("_g").agg(best.alias("x")).select("_g", "x.k", "x.loss")


def _spilt(x: np.ndarray, cap: float) -> np.ndarray:
    """Shares capped, the excess going to the other used ones in proportion, until none is over."""
    for _ in range(50):
        over = x > cap + 1e-12
        open_ = ~over & (x > 0)
        if not over.any() or not open_.any():
            break
        excess = (x[over] - cap).sum()
        x = np.where(over, cap, x)
        x = np.where(open_, x + excess * x / x[open_].sum(), x)
    return x


def compressed(split: DataFrame, cell: Sequence[str], group: Sequence[str], gateways: Sequence[str], budget: int | None = None, target: float | None = None, fine: int = 64, most: float = 0.97, costs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, allotment): (cell, cluster, gateway, share) with each cell at its cluster's centroid, capped at ``most``; (_g, k, loss, w).

    ``split``: cell, gateway, share, volume (of the cell); either ``budget`` rules over all groups, or as few in each as keep
    ``target`` of its volume in place.  Null volumes count as nothing, cells without shares are left out, repeated cells are not
    expected.  An empty split gives two empty tables.
    """
    names = list(gateways)
    cells = written(vectors(split, cell, group, names), "vectors")
    points = written(cells.groupBy("_g", "x").agg(F.sum("w").alias("w")), "points")
    known = trees(points, fine)
    curve = written(curves(points, known), "curves")
    volumes = points.groupBy("_g").agg(F.sum("w").alias("w"))
    chosen = allotted(curve, budget, costs) if budget is not None else kept_to(curve, volumes, target)
    chosen = written(chosen, "allotted")
    k_of = {r["_g"]: r["k"] for r in chosen.collect()}  # groups
    # The rule of each leaf: its highest ancestor among the first merges, as many as leave k nodes.
    rules = {}
    for g, (parent, centres) in known.items():
        n = _leaves(parent)
        at, last = np.arange(n), 2 * n - k_of[g]
        while (climb := (parent[at] >= 0) & (parent[at] < last)).any():
            at = np.where(climb, parent[at], at)
        rules[g] = (centres[:n], at, {int(a): _spilt(centres[a] / max(centres[a].sum(), 1e-12), most) for a in np.unique(at)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, share = np.zeros(batch.num_rows, dtype=np.int32), np.zeros((batch.num_rows, len(names)))
            for g, at, x in _by_group(batch):
                leaves, node, shares = rules[g]
                cluster[at] = node[_nearest(x, leaves)]
                share[at] = np.array([shares[c] for c in cluster[at].tolist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cell), pa.array(cluster), pa.array(list(share), pa.list_(pa.float64()))], names=[*cell, "cluster", "share"])

    types = dict(cells.dtypes)
    each = cells.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in cell), "cluster int, share array<double>"]))
    long = each.select(*cell, "cluster", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("gateway"), F.col("share"))).alias("z"))
    return long.select(*cell, "cluster", F.col("z.gateway").alias("gateway"), F.col("z.share").alias("share")).where("share > 1e-9"), chosen.join(volumes, "_g")
