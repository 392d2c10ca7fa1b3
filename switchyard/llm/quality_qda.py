"""Quality classification by a regularised quadratic discriminant.

Method: document statistics are transformed to be nearer to normal; each class has a mean and a covariance shrunk towards the pooled
one and towards a scaled identity.  A score is the difference of the classes' Mahalanobis log-densities, computed with
Cholesky factors that are made once, and mapped to a probability by a calibrated logistic curve.

Scale: counts, sums and products of the labelled rows are added up on the executors (a few hundred numbers reach the driver),
calibration reads a histogram of fixed size, and scoring is a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.doc_stats import LONGS, document_statistics
from switchyard.llm.labelled import labels_of, logistic, remainder
from switchyard.llm.scratch import stored


@dataclass(frozen=True)
class Discriminant:
    """``pooled`` and ``ridge``: shares of the pooled covariance and of the scaled identity in a class covariance; labels with remainder ``held`` of ``folds`` are never read."""

    pooled: float = 0.2
    ridge: float = 0.05
    folds: int = 3
    held: int = 1
    bins: int = 400


def transformed(batch: pa.RecordBatch) -> np.ndarray:
    """Features of statistics: logs of counts, square roots of shares."""
    v = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in LONGS}
    n, lines, chars, letters = (np.maximum(v[c], 1) for c in ("n_words", "n_lines", "word_chars", "n_letters"))
    root = lambda a, b: np.sqrt(np.clip(a / b, 0, 4))
    return np.column_stack([
        np.log1p(v["n_words"]), np.log1p(v["word_chars"] / n), root(v["n_symbols"], n), root(v["n_dup_lines"], lines), root(v["n_repeat_words"], n),
        np.log1p(v["n_distinct"]) - 0.85 * np.log1p(v["n_words"]), root(v["n_adjacent"], n), root(v["n_upper"], letters), root(v["n_digits"], chars),
        root(v["n_pipes"], n), root(v["n_ended"], lines), root(v["n_stop"], n), root(v["n_wide"], letters), root(v["n_marks"], n), np.log1p(n / lines), np.log1p(v["longest_line"]),
    ])


@dataclass(frozen=True)
class Model:
    """For each class: mean, inverse Cholesky factor, log determinant and log prior; and the logistic curve."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float
    intercept: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        d = [offset - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True)]
        return np.clip(d[1] - d[0], -200, 200)


def fit(rows: DataFrame, p: Discriminant) -> Model | float:
    """``rows``: statistics with ``y``.  Without two rows of either class: the share of label 1."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), transformed(batch)])
            y = batch.column(batch.schema.get_field_index("y")).to_numpy()
            for c in (0, 1):
                total[c] = total.get(c, 0) + x[y == c].T @ x[y == c]
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size), pa.array(np.arange(m.size)), pa.array(m.ravel())], names=["y", "at", "value"])

    summed = rows.mapInArrow(moments, "y long, at long, value double").groupBy("y", "at").agg(F.sum("value").alias("value")).toPandas()
    size = int(round(max(summed["at"].max() + 1, 1) ** 0.5)) if len(summed) else 0
    tables = []
    for c in (0, 1):
        m, part = np.zeros(size * size), summed[summed["y"] == c]
        m[part["at"].to_numpy(dtype=int)] = part["value"].to_numpy()
        tables.append(m.reshape(size, size))
    n = np.array([t[0, 0] if size else 0 for t in tables])
    if n.min() < 2:
        return float((n[1] + 0.5) / (n.sum() + 1))
    means = np.stack([t[0, 1:] / t[0, 0] for t in tables])
    scatter = [t[1:, 1:] - t[0, 0] * np.outer(m, m) for t, m in zip(tables, means, strict=True)]
    pooled = sum(scatter) / n.sum()
    factors, offsets = [], []
    for k, s in enumerate(scatter):
        own = s / n[k]
        weight = n[k] / (n[k] + 4 * len(own))  # fewer rows lean more on the pooled covariance
        mix = weight * (1 - p.pooled) * own + (1 - weight * (1 - p.pooled)) * pooled
        mix = (1 - p.ridge) * mix + p.ridge * np.diag(np.maximum(np.diag(pooled), 1e-4))
        lower = np.linalg.cholesky(mix)
        factors.append(np.linalg.inv(lower))
        offsets.append(-np.log(np.diag(lower)).sum() + np.log(n[k] / n.sum()))
    model = Model(means, np.stack(factors), np.array(offsets), 1.0, 0.0)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), pa.array(np.round(model.difference(transformed(batch)) * p.bins / 400).astype(np.int64))], names=["y", "bin"])

    bins = rows.mapInArrow(differences, "y int, bin long").groupBy("y", "bin").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 2 * bins rows
    w = logistic((bins["bin"].to_numpy(dtype=float) * 400 / p.bins / 10)[:, None], bins["y"].to_numpy(dtype=float), bins["n"].to_numpy(dtype=float))
    return Model(model.means, model.factors, model.offsets, float(w[0]) / 10, float(w[1]))


def quality_report(docs: DataFrame, labels: DataFrame, p: Discriminant = Discriminant()) -> DataFrame:
    """``docs`` (doc_id, text, ...) and ``labels`` (doc_id, quality) -> doc_id, held_out, score, predicted, difference: one row per input row.

    Null and empty texts are scored from statistics of 0.  A null doc_id stays null; of several labels of one id the larger
    holds; other columns are ignored; empty input gives an empty result; without both classes every score is the share.
    """
    stats = stored(document_statistics(docs), "statistics")
    known = labels_of(labels, "quality").where(remainder(F.col("doc_id"), p.folds) != p.held)
    model = fit(stored(stats.join(known, "doc_id"), "labelled"), p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, Model):
                d = model.difference(transformed(batch))
                score = 1 / (1 + np.exp(-np.clip(model.slope * d + model.intercept, -30, 30)))
            else:
                d, score = np.zeros(batch.num_rows), np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(d)], names=["doc_id", "score", "predicted", "difference"])

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int, difference double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), p.folds) == p.held).alias("held_out"), "score", "predicted", "difference")
