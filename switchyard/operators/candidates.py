"""Many candidate splits projected at once.

Candidates are arrays: a row of the export, and a MID's proposed share, stand once, whatever the number of candidates.  Each cell is
projected for all of them by one pass over its rows; totals are added up element by element.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUST = 1e-12


def _water_filled(w: np.ndarray, cap: float, sweeps: int = 8) -> np.ndarray:
    """Columns of shares (gateways by candidates) capped, the excess going to the used ones by their room."""
    for _ in range(sweeps):
        excess = np.maximum(w - cap, 0).sum(axis=0)
        room = np.where((w > DUST) & (w < cap - DUST), cap - w, 0)
        space = room.sum(axis=0)
        filled = np.where(w > cap, cap, w + np.where(space > DUST, room / np.maximum(space, DUST) * np.minimum(excess, space), 0))
        w = np.where(((w > DUST).sum(axis=0) >= 2) & (excess > DUST), filled, w)
    return w


def _over(values: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, values / np.where(total > 0, total, 1), 0)


def _cell(rows: pd.DataFrame, shares: pd.DataFrame, k: int, cap: float, floor: float) -> pd.DataFrame:
    """One cell's rows (mid, period, t, risk, txn, pro_rata, fcp1_frac), with MIDs filled in, and risk_post and txn_post as lists."""
    props = dict(zip(shares["mid"], shares["props"], strict=True))
    sales = rows[rows.t == 0]
    if len(sales):
        missing = [m for m in props if m not in set(sales["mid"])]
        timing = rows.sort_values(["t", "mid"]).drop_duplicates("period")[["period", "pro_rata", "fcp1_frac"]]
        more = [timing.assign(mid=m, t=0, risk=0.0, txn=0.0) for m in missing]
        rows = pd.concat([rows, *more], ignore_index=True)
    n = len(rows)
    prop = np.array([np.zeros(k) if (p := props.get(m)) is None else np.nan_to_num(np.array(p, dtype=float)) for m in rows["mid"]]).reshape(n, k)
    period, t, risk, txn = (rows[c].to_numpy() for c in ("period", "t", "risk", "txn"))
    ramp, able = (np.nan_to_num(rows[c].to_numpy(float)) for c in ("pro_rata", "fcp1_frac"))
    after, to, part, timing_of, place = txn[:, None].repeat(k, axis=1).astype(float), np.zeros((n, k)), np.zeros((n, k)), {}, {}
    for p in np.unique(period[t == 0]):
        at = np.flatnonzero((period == p) & (t == 0))
        psum = prop[at].sum(axis=0)
        share = _over(prop[at], psum)
        if floor > 0:
            least = np.where(prop[at] > 0, np.maximum(share, floor), share)
            share = _over(least, least.sum(axis=0))
        if cap < 1:
            share = _water_filled(share, cap)
        moving = ramp[at] * able[at]
        pool = (txn[at] * moving).sum()
        ready = (psum > 0) & (txn[at].sum() > 0)
        after[at] = np.where(ready, (txn[at] * (1 - moving))[:, None] + pool * share, txn[at][:, None])
        carries = np.where(risk[at][:, None] > 0, prop[at], 0)
        to[at] = _over(carries, carries.sum(axis=0))
        part[at] = np.where(psum > 0, able[at][:, None], 0)
        names = rows["mid"].to_numpy()[at]
        timing_of[p] = ramp[at[np.argsort(names, kind="stable")[0]]]
        place.update({(m, p): i for m, i in zip(names, at, strict=True)})
    origin = np.array([place.get(key, -1) for key in zip(rows["mid"], period - t, strict=True)], dtype=int)
    own_to, own_part = np.where(origin[:, None] >= 0, to[origin], 0), np.where(origin[:, None] >= 0, part[origin], 0)
    risk_post = np.zeros((n, k))
    keys, group = np.unique(np.stack([period, t]), axis=1, return_inverse=True)
    for g in range(keys.shape[1]):
        at = np.flatnonzero(group.ravel() == g)
        p, age = keys[:, g]
        tsum = own_to[at].sum(axis=0)
        move = np.where((p - age >= 0) & (tsum > DUST), own_part[at] * timing_of.get(p, 0.0), 0)
        come = (risk[at][:, None] * move).sum(axis=0)
        risk_post[at] = risk[at][:, None] * (1 - move) + np.where(tsum > DUST, come * _over(own_to[at], tsum), 0)
    return rows.assign(risk_post=list(risk_post), txn_post=list(np.where((t == 0)[:, None], after, 0)), txn_pre=np.where(t == 0, txn, 0.0))


def projected(rows: DataFrame, shares: DataFrame, cell: Sequence[str], k: int, cap: float = 1.0, floor: float = 0.0) -> DataFrame:
    """(cell, mid, period, t, risk_pre, txn_pre, risk_post, txn_post): the last two are arrays of the ``k`` candidates' values.

    ``rows``: cell, mid, period, t, risk, txn, pro_rata, fcp1_frac, one row for each MID, period and age of a cell; ``shares``: cell, mid, props (an
    array, any scale; null counts as 0).  Each candidate is what ``granular_projection`` gives for its shares alone.  A cell's rows,
    its MIDs by months by ages, are in one task.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*cell, "mid")), "period int, t int, risk_pre double, txn_pre double, risk_post array<double>, txn_post array<double>"])
    names = [*cell, "mid", "period", "t", "risk_pre", "txn_pre", "risk_post", "txn_post"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        found = _cell(left.drop(columns=list(cell)), right, k, cap, floor)
        return found.assign(risk_pre=found["risk"], **{c: left[c].iloc[0] for c in cell})[names]

    used = rows.select(*cell, "mid", F.col("period").cast("int").alias("period"), F.col("t").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("risk", "txn", "pro_rata", "fcp1_frac")])
    given = shares.select(*[F.col(c).alias(f"_of_{c}") for c in cell], "mid", "props")  # so that rows and shares of one table do not clash
    return used.groupBy(*cell).cogroup(given.groupBy(*[f"_of_{c}" for c in cell])).applyInPandas(run, schema)


def totals(projection: DataFrame, k: int, keys: Sequence[str] = ("mid", "period")) -> DataFrame:
    """(keys, candidate, risk_pre, risk_post, txn_pre, txn_post): sums of each candidate; the arrays are added up element by element before they become rows."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c in ("risk_post", "txn_post") for i in range(k)]
    added = projection.groupBy(*keys).agg(F.sum("risk_pre").alias("risk_pre"), F.sum("txn_pre").alias("txn_pre"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.col(f"risk_post_{i}").alias("risk_post"), F.col(f"txn_post_{i}").alias("txn_post")) for i in range(k)]))
    return added.withColumn("_x", each).select(*keys, "_x.candidate", "risk_pre", "_x.risk_post", "txn_pre", "_x.txn_post")
