"""Split engines: gateway shares of each cell under bounds and a risk limit.

Softmax and greedy references are window expressions.  The others solve one small cell at a time (tens of gateways) with NumPy
over batches of cells; Spark spreads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.functions.columns import share_of
from switchyard.sources.shared import written


def bounded(frame: DataFrame, cell: Sequence[str], most: float = 0.97, forced: float = 0.01) -> DataFrame:
    """Columns lower and upper: caps of ``most``, 0 where banned, at least ``forced`` where forced; caps relax to 1 where they cannot sum to 1, floors shrink where they exceed it."""
    w = Window.partitionBy(*cell)
    upper, lower = F.when(F.col("banned"), 0.0).otherwise(most), F.when(F.col("forced") & ~F.col("banned"), forced).otherwise(0.0)
    out = frame.withColumn("upper", upper).withColumn("lower", lower)
    relaxed = F.when(F.sum("upper").over(w) < 1, F.when(F.col("banned"), 0.0).otherwise(1.0)).otherwise(F.col("upper"))
    scaled = F.when(F.sum("lower").over(w) > 1, F.col("lower") / F.sum("lower").over(w)).otherwise(F.col("lower"))
    return out.select("*", relaxed.alias("_u"), scaled.alias("_l")).drop("upper", "lower").withColumnsRenamed({"_u": "upper", "_l": "lower"})


def softmax_reference(rates: DataFrame, cell: Sequence[str], temperature: float = 1.0, gamma: float = 1.0, floor: float = 0.0) -> DataFrame:
    """Shares in proportion to exp(100 temperature (success - gamma risk)), each at least min(floor, 1/n), normalised."""
    w = Window.partitionBy(*cell)
    score = 100 * temperature * (F.col("success_rate") - gamma * F.col("risk_rate"))
    out = rates.withColumn("_z", score).withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w))).withColumn("_s", share_of("_e", cell))
    least = F.least(F.lit(floor), 1.0 / F.count(F.lit(1)).over(w))
    return out.withColumn("_f", F.greatest("_s", least)).withColumn("share", share_of("_f", cell)).drop("_z", "_e", "_s", "_f")


def greedy_reference(rates: DataFrame, cell: Sequence[str], cap: float = 0.6) -> DataFrame:
    """Best gateways first, each filled up to ``cap`` until the cell is full."""
    order = Window.partitionBy(*cell).orderBy(F.desc("success_rate"), "gateway")
    n = F.count(F.lit(1)).over(Window.partitionBy(*cell))
    most = F.greatest(F.lit(cap), 1.0 / n)
    return rates.withColumn("share", F.greatest(F.least(most, 1 - most * (F.row_number().over(order) - 1)), F.lit(0.0)))


def project_box(x: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Nearest point with sum 1 and lower <= x <= upper: the sum is piecewise linear in a common shift, exact between its corners."""
    corners = np.sort(np.concatenate([lower - x, upper - x]))
    sums = np.clip(x + corners[:, None], lower, upper).sum(axis=1)
    k = int(np.searchsorted(sums, 1.0))
    if k == 0 or k == len(sums):
        return np.clip(x + corners[min(k, len(corners) - 1)], lower, upper)
    part = (1.0 - sums[k - 1]) / max(sums[k] - sums[k - 1], 1e-300)
    return np.clip(x + corners[k - 1] + part * (corners[k] - corners[k - 1]), lower, upper)


def project_capped(x: np.ndarray, lower: np.ndarray, upper: np.ndarray, risk: np.ndarray, cap: float, steps: int = 50) -> np.ndarray:
    """The same under risk @ x <= cap, by bisection on the price of risk; the least risky point where the cap cannot be met."""
    best = project_box(x, lower, upper)
    if best @ risk <= cap:
        return best
    lo, hi = 0.0, 1.0
    while hi < 1e9 and project_box(x - hi * risk, lower, upper) @ risk > cap:
        hi *= 4
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if project_box(x - mid * risk, lower, upper) @ risk <= cap else (mid, hi)
    return project_box(x - hi * risk, lower, upper)


def _grid(a: np.ndarray, b: np.ndarray, nodes: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """A grid that is fine where some beta law has its weight, and each law's weights on it."""
    mean, sd = a / (a + b), np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    ends = np.geomspace(1e-10, 0.1, 400)  # a law may have its weight at an end
    x = np.unique(np.concatenate([(np.arange(nodes) + 0.5) / nodes, ends, 1 - ends, *(np.clip(m + s * np.linspace(-8, 8, 241), 1e-7, 1 - 1e-7) for m, s in zip(mean, sd, strict=True))]))
    log_density = (a - 1)[:, None] * np.log(x) + (b - 1)[:, None] * np.log1p(-x)
    density = np.exp(log_density - log_density.max(axis=1, keepdims=True)) * np.gradient(x)
    return x, density / density.sum(axis=1, keepdims=True)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantiles of beta laws, read off a fine grid."""
    x, weight = _grid(a, b)
    upto = np.cumsum(weight, axis=1) - weight / 2
    return np.array([np.interp(q, row, x) for row in upto])


def probability_best(g: dict[str, np.ndarray], pooled: float = 8.0, gamma: float = 0.0, temperature: float = 0.05) -> np.ndarray:
    """P(gateway has the best success) under independent beta posteriors; a gateway without attempts has a weak posterior at its pooled rate.  ``gamma`` tilts towards low risk."""
    won, n, seen = g["success"], g["attempts"], g["attempts"] > 0
    a, b = np.where(seen, won, g["prior_rate"] * pooled) + 1, np.where(seen, n - won, (1 - g["prior_rate"]) * pooled) + 1
    _, density = _grid(a, b)
    below = np.maximum(np.cumsum(density, axis=1) - density / 2, 1e-300)
    win = (density * np.exp(np.log(below).sum(axis=0) - np.log(below))).sum(axis=1)
    win = win / win.sum() * np.exp(-gamma * 100 * temperature * g["risk_rate"])
    return win / win.sum()


def mean_downside(g: dict[str, np.ndarray], aversion: float = 0.4, tail: float = 0.95, steps: int = 400) -> np.ndarray:
    """Success less the downside of risk: minimises ``-x success + gamma sqrt(sum x^2 d^2)`` within the bounds.

    ``d`` is how far the upper 95 % quantile of a gateway's risk rate lies above the rate; ``gamma`` makes an average downside cost
    ``aversion`` of the cell's average success.  Projected gradient with a step that halves until the value falls.
    """
    open_ = g["upper"] > 0
    risk, n = np.clip(g["risk_rate"], 0, 1), np.maximum(g["attempts"], 1)
    gap = beta_quantile(tail, risk * n + 0.5, (1 - risk) * n + 0.5) - risk
    d, gain = np.where(open_, np.maximum(gap, 0), 0.0), np.where(open_, g["success_rate"], 0.0)
    mean = gain[open_].mean() if open_.any() else 0.0
    gamma = min(aversion * mean / max(d[open_].mean(), 1e-4 * mean), 5000.0) if mean > 0 else 0.0
    spread = lambda x: np.sqrt((x * x * d * d).sum() + 1e-12)
    value = lambda x: -x @ gain + gamma * spread(x)
    x, step = project_box(np.maximum(gain, 1e-9) / max(gain.sum(), 1e-9), g["lower"], g["upper"]), 1.0
    for _ in range(steps):
        slope = -gain + gamma * d * d * x / spread(x)
        while step > 1e-12:
            new = project_box(x - step * slope, g["lower"], g["upper"])
            if value(new) <= value(x) - 1e-4 / step * ((new - x) ** 2).sum():
                break
            step /= 2
        if np.abs(new - x).max() < 1e-10:
            break
        x, step = new, step * 1.5
    return x


def most_even(g: dict[str, np.ndarray], weight: float = 0.02, cap: float = np.inf) -> np.ndarray:
    """Maximum of success plus ``weight`` times entropy within the bounds and under risk @ x <= cap.

    At the maximum x = exp((success - price risk) / weight - level), clipped to its bounds; the level makes the sum 1, the price is 0
    or the one that meets the cap.  Where no split meets the cap, the least risky one.
    """
    lower, upper, risk = np.maximum(g["lower"], 1e-12), np.maximum(g["upper"], 1e-12), g["risk_rate"]

    def at(price: float) -> np.ndarray:
        z = (g["success_rate"] - price * risk) / weight
        z = z - z.max()
        lo, hi = z.min() - 40.0, np.log(len(z)) + 40.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(np.exp(z - mid), lower, upper).sum() > 1 else (lo, mid)
        return np.clip(np.exp(z - hi), lower, upper)

    x = at(0.0)
    if x @ risk > cap:
        lo, hi = 0.0, 1.0
        while hi < 1e7 and at(hi) @ risk > cap:
            hi *= 4
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if at(mid) @ risk <= cap else (mid, hi)
        x = at(hi)
    return x / x.sum()


ENGINES: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] = {"thompson": probability_best, "portfolio": mean_downside, "entropy": most_even}
FIELDS = ("attempts", "success", "success_rate", "risk_rate", "prior_rate", "lower", "upper")


def solve_cell(g: dict[str, np.ndarray], engine: str, risk_cap: float, slider: float) -> np.ndarray:
    """Shares of one cell.  At ``slider`` 1 the cap is not imposed; below, the imposed cap lies between the hard cap and the unrestricted risk."""
    x = project_box(ENGINES[engine](g), g["lower"], g["upper"])
    free = x @ g["risk_rate"]
    if slider >= 1 or free <= risk_cap:
        return x
    cap = risk_cap + slider * (free - risk_cap)
    return most_even(g, cap=cap) if engine == "entropy" else project_capped(x, g["lower"], g["upper"], g["risk_rate"], cap)


def swept(problems: DataFrame, cell: Sequence[str], engine: str, risk_cap: float, sliders: Sequence[float]) -> DataFrame:
    """``solved`` at each of some positions of the slider, which is a column ``slider`` of the result: one pass, and each cell's answers in one task."""
    return solved(problems, cell, engine, risk_cap, list(sliders))


def solved(problems: DataFrame, cell: Sequence[str], engine: str, risk_cap: float, slider: float | Sequence[float] = 0.5) -> DataFrame:
    """(cell, gateway, share, expected_success, expected_risk, feasible); with several sliders also ``slider``.

    ``problems``: cell, gateway and the columns ``FIELDS``.  ``feasible`` is against the hard cap.  A cell, tens of gateways, is one row of
    arrays; a task takes its cells batch by batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"share": [], "expected_success": [], "expected_risk": [], "feasible": []}
            for row, at in zip(batch["g"], batch["slider"], strict=True):
                g = {f: np.array([r[f] for r in row], dtype=float) for f in FIELDS}
                x = solve_cell(g, engine, risk_cap, at)
                out["share"].append(x)
                out["expected_success"].append(float(x @ g["success_rate"]))
                out["expected_risk"].append(float(x @ g["risk_rate"]))
                out["feasible"].append(bool(x @ g["risk_rate"] <= risk_cap + 1e-9))
            yield batch[[*cell, "slider"]].assign(gateway=[[r["gateway"] for r in row] for row in batch["g"]], **out)

    types = dict(problems.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cell), "slider double, gateway array<string>, share array<double>, expected_success double, expected_risk double, feasible boolean"])
    rows = problems.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("gateway", *[F.col(f).cast("double").alias(f) for f in FIELDS]))).alias("g"))
    positions = [float(v) for v in slider] if isinstance(slider, Sequence) else [float(slider)]
    rows = rows.withColumn("slider", F.explode(F.array(*[F.lit(v) for v in positions])))
    keys = [*cell, "slider"] if isinstance(slider, Sequence) else list(cell)
    each = rows.mapInPandas(run, schema).select(*keys, F.explode(F.arrays_zip("gateway", "share")).alias("x"), "expected_success", "expected_risk", "feasible")
    return each.select(*keys, "x.gateway", "x.share", "expected_success", "expected_risk", "feasible")


def lexicographic_best(candidates: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The candidate with least band breach, then least violation, then most conversion, then least id."""
    order = F.struct(F.col("band"), F.col("violation"), (-F.col("conversion")).alias("c"), F.col("candidate"))
    return candidates.groupBy(*group).agg(F.min_by(F.struct(*candidates.columns), order).alias("_x")).select("_x.*")


def shaved(split: DataFrame, cell: Sequence[str], cap: float, rounds: int = 4) -> DataFrame:
    """MIDs over the risk rate ``cap`` lose share in proportion to their excess, to the other gateways of each cell; ``rounds`` passes.

    ``split``: cell, gateway, mid, volume, share, risk_rate.
    """
    for _ in range(rounds):
        split = written(split, "shaved")  # used twice in a pass; its size follows the keys
        v = F.col("volume") * F.col("share")
        mids = split.groupBy("mid").agg((F.sum(v * F.col("risk_rate")) / F.greatest(F.sum(v), F.lit(1e-9))).alias("_rate"))
        factor = F.when(F.col("_rate") > cap, cap / F.col("_rate")).otherwise(1.0)
        cut = split.join(mids, "mid").withColumn("_k", F.col("share") * factor).withColumn("_over", F.col("_rate") > cap)
        w = Window.partitionBy(*cell)
        room, freed = F.sum(F.when(~F.col("_over"), F.col("_k")).otherwise(0.0)).over(w), F.sum(F.col("share") - F.col("_k")).over(w)
        new = F.when(room <= 0, F.col("share")).when(F.col("_over"), F.col("_k")).otherwise(F.col("_k") * (1 + freed / room))
        split = cut.withColumn("_new", new).withColumn("share", F.col("_new")).drop("_k", "_over", "_rate", "_new")
    return split
