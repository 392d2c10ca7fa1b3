"""Caps on the risk rate of each MID over all of its cells, with the least movement of shares: prices for MIDs, cells solved in parallel.

The problem is a linear one: the sum of |share - reference| is least, each cell's shares sum to 1 within their bounds, and each MID's
volume-weighted risk is at most ``cap`` times its volume.  Its dual has one price for each MID.  Given the prices every cell is
solved alone; Spark adds up the MIDs' excess and how it answers to prices, and the driver takes damped Newton steps on these few numbers.
A small square term, reduced in stages, makes the answer of a cell unique.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.sources.shared import written

STAGES = (1.0, 0.1, 0.01, 0.002)
DAMPING = (0.0, 1e-6, 1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 1e2, 1e4)
_FIELDS = ("mid", "pull", "ref", "lower", "upper")


def answers(cost: np.ndarray, ref: np.ndarray, lower: np.ndarray, upper: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell (a row), the shares that minimise sum |x - ref| + square/2 (x - ref)^2 + cost x on the simplex within bounds, and which of them answer to a small change of cost.

    Given the multiplier of the sum, each share is a clipped soft threshold; the multiplier is found by bisection.
    """

    def shares(nu: np.ndarray) -> np.ndarray:
        t = -cost - nu[:, None]
        return np.clip(ref + np.sign(t) * np.maximum(np.abs(t) - 1, 0) / square, lower, upper)

    reach = 1 + 2 * square
    low, high = (-cost).min(axis=1) - reach, (-cost).max(axis=1) + reach
    for _ in range(70):
        nu = (low + high) / 2
        much = shares(nu).sum(axis=1) > 1
        low, high = np.where(much, nu, low), np.where(much, high, nu)
    x, y = shares(low), shares(high)  # sums just over and just under 1
    gap = x.sum(axis=1) - y.sum(axis=1)
    part = np.where(gap > 0, (1 - y.sum(axis=1)) / np.where(gap > 0, gap, 1), 0)[:, None]
    x = y + np.clip(part, 0, 1) * (x - y)
    free = (np.abs(-cost - high[:, None]) > 1) & (x > lower + 1e-12) & (x < upper - 1e-12)
    return x, free


def _padded(column: pa.Array, fill: float) -> np.ndarray:
    """Lists of different lengths as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), max(int(sizes.max(initial=1)), 1)), fill)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """mid (-1 where padded), pull, ref, lower, upper."""
    return tuple(_padded(batch.column(f), -1.0 if f == "mid" else 0.0) for f in _FIELDS)


def _measured(cells: DataFrame, prices: Sequence[np.ndarray], square: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each vector of prices: the dual's value, the MIDs' excess, and the matrix by which the excess falls with the prices."""
    n_mids = len(prices[0])
    tables = [np.append(p, 0.0) for p in prices]  # the last is for padding

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], float] = {}

        def add(k: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
            some, at = np.unique(rows.astype(np.int64) << 32 | columns.astype(np.int64), return_inverse=True)
            for key, v in zip(some.tolist(), np.bincount(at, values).tolist(), strict=True):
                place = (k, key >> 32, key & 0xFFFFFFFF)
                sums[place] = sums.get(place, 0.0) + v

        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                mid, pull, ref, lower, upper = _unpacked(whole.slice(start, 2000))
                mid, real = mid.astype(np.int64), mid >= 0
                for k, table in enumerate(tables):
                    cost = table[mid] * pull
                    x, free = answers(cost, ref, lower, upper, square)
                    gap = x - ref
                    value = (np.abs(gap) + square / 2 * gap * gap + cost * x).sum()
                    add(k, np.array([n_mids]), np.array([0]), np.array([value]))
                    add(k, mid[real], np.full(real.sum(), n_mids), (pull * x)[real])
                    n_free = free.sum(axis=1)
                    each = np.where(free, pull, 0.0)
                    cross = each[:, :, None] * each[:, None, :] * (np.eye(each.shape[1])[None] - 1 / np.maximum(n_free, 1)[:, None, None]) / square
                    both = free[:, :, None] & free[:, None, :]
                    at = np.nonzero(both)
                    add(k, mid[at[0], at[1]], mid[at[0], at[2]], cross[at])
        rows = [(*place, v) for place, v in sums.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["k", "m", "n", "v"])

    found = [(0.0, np.zeros(n_mids), np.zeros((n_mids, n_mids))) for _ in prices]
    for k, m, n, v in cells.mapInArrow(run, "k int, m long, n long, v double").groupBy("k", "m", "n").agg(F.sum("v")).collect():  # MIDs by MIDs at most
        value, excess, fall = found[k]
        if m == n_mids:
            found[k] = (value + v, excess, fall)
        elif n == n_mids:
            excess[m] += v
        else:
            fall[m, n] += v
    return found


def price_capped(split: DataFrame, cell: Sequence[str], cap: float, least: float = 0.0, most: float = 1.0, passes: int = 15) -> tuple[DataFrame, DataFrame]:
    """(shares, mids): the split nearest to ``split`` in which every MID's risk rate is at most ``cap``.

    ``split``: cell, gateway, mid, volume (of the cell), share, risk_rate.  ``shares``: cell, gateway, mid, volume, risk_rate, reference, share; ``mids``: mid,
    volume, rate, price, held.  Shares lie between ``least`` and ``most``; a cell of one gateway stays.  Where no split holds all caps,
    ``held`` is false for MIDs over theirs, and the shares are those of the last prices.  Cells with null shares or rates count
    them as 0; an empty split gives two empty tables.  The movement is within a thousandth of the least.
    """
    spark = split.sparkSession
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    rows = written(split.select(*cell, "gateway", "mid", zero("volume"), zero("share"), zero("risk_rate")), "capped")
    aim = cap * (1 - 1e-5)  # so that the caps hold after rounding
    weight = F.col("volume") * (F.col("risk_rate") - aim)
    known = rows.groupBy("mid").agg(F.max(F.abs(weight)).alias("scale")).orderBy("mid").collect()  # MIDs
    names, scale = [r.mid for r in known], np.array([max(r.scale, 1e-12) for r in known])
    table = spark.createDataFrame([(m, k, float(s)) for k, (m, s) in enumerate(zip(names, scale, strict=True))], f"mid {dict(rows.dtypes)['mid']}, _m int, _s double")
    placed = rows.join(F.broadcast(table), "mid")
    order = F.array_sort(F.collect_list(F.struct("gateway", "mid", "_m", (weight / F.col("_s")).alias("pull"), "share", "volume", "risk_rate")))  # a cell's gateways
    one = F.size("g") < 2
    take = lambda f: F.transform("g", f)
    cells = placed.groupBy(*cell).agg(order.alias("g")).select(
        *cell, "g", take(lambda x: x["_m"].cast("double")).alias("mid"), take(lambda x: x["pull"]).alias("pull"), take(lambda x: x["share"]).alias("ref"),
        take(lambda x: F.when(one, x["share"]).otherwise(F.lit(least))).alias("lower"), take(lambda x: F.when(one, x["share"]).otherwise(F.lit(most))).alias("upper"),
    )
    cells = written(cells, "cells")
    prices = _ascent(cells.select(*_FIELDS), len(names), passes) if names else np.zeros(0)
    told = np.append(prices, 0.0)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mid, pull, ref, lower, upper = _unpacked(batch)
            x, _ = answers(told[mid.astype(np.int64)] * pull, ref, lower, upper, STAGES[-1])
            sizes = np.diff(batch.column("mid").offsets.to_numpy())
            shares = pa.array([row[:n] for row, n in zip(x, sizes, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*cell, "g")), shares], names=[*cell, "g", "x"])

    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    solved = cells.mapInArrow(solve, ", ".join([*(f"`{c}` {types[c]}" for c in (*cell, "g")), "x array<double>"]))
    each = solved.select(*cell, F.explode(F.arrays_zip("g", "x")).alias("z"))
    shares = written(each.select(*cell, *[F.col(f"z.g.{c}").alias(c) for c in ("gateway", "mid", "volume", "risk_rate")], F.col("z.g.share").alias("reference"), F.col("z.x").alias("share")), "shares")
    v = F.col("volume") * F.col("share")
    sums = shares.groupBy("mid").agg(F.sum(v).alias("volume"), (F.sum(v * F.col("risk_rate")) / F.greatest(F.sum(v), F.lit(1e-12))).alias("rate"))
    price = spark.createDataFrame([(m, float(p / s)) for m, p, s in zip(names, prices, scale, strict=True)], f"mid {dict(rows.dtypes)['mid']}, price double")
    return shares, sums.join(F.broadcast(price), "mid").select("mid", "volume", "rate", "price", (F.col("rate") <= cap + 1e-12).alias("held"))


def _ascent(cells: DataFrame, n_mids: int, passes: int) -> np.ndarray:
    """Prices at which no MID is over its cap, or the last ones where there are none."""
    prices, n_cells = np.zeros(n_mids), cells.count()
    for square in STAGES:
        (value, excess, fall), damped = _measured(cells, [prices], square)[0], 1.0
        for _ in range(passes if square > STAGES[-1] else 4 * passes):
            slack = np.abs(excess[prices > 0]).max(initial=0.0)
            if excess.max() <= 1e-9 and slack <= 1e-7 * max(1.0, n_cells):
                break
            if value > 2 * n_cells * (1 + square):  # over what any split can cost: there is none
                return prices
            live = (prices > 0) | (excess > 0)
            part, pull = fall[np.ix_(live, live)], excess[live]
            size, reach = max(np.diag(part).max(initial=0.0), 1e-9), np.maximum(prices[live], 1.0)
            tried = []
            for much in DAMPING:
                move = np.linalg.lstsq(part + max(much * damped, 1e-12) * size * np.eye(len(part)), pull, rcond=None)[0]
                move *= min(1.0, 1 / np.max(np.abs(move) / reach, initial=1e-12))  # where nothing answers, prices at most double
                tried.append(prices.copy())
                tried[-1][live] = np.maximum(prices[live] + move, 0.0)
            results = _measured(cells, tried, square)
            best = max(range(len(tried)), key=lambda k: results[k][0])
            if results[best][0] > value:
                prices, (value, excess, fall) = tried[best], results[best]
                damped = max(damped / 1e3, 1.0)
            elif damped > 1e9:
                break
            else:
                damped *= 1e4  # the best price is nearer than the least step
    return prices
