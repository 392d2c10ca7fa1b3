"""Toxicity by compression distance.

Method: two zstandard dictionaries are trained, one on toxic and one on ordinary text.  Windows of a document are compressed with
either; the distance of a window is how many bytes fewer it takes with the toxic dictionary.  A document's score is a
logistic function, calibrated on labelled documents, of its largest distances, of how many windows reach each threshold,
and of its length.

Training: samples are runs of ``run`` words.  Most of a toxic document is ordinary, so a dictionary of its whole text would
compress both classes alike; samples are mined instead.  In each round, dictionaries trained on one half of the samples are
tried on the other, and the runs that they tell apart best train the next.  At last each chosen run is cut to the part with
the greatest distance.  No list of words is made, and no count of words is looked at.

Calibration: the same is done for each half of the labelled documents, and the weights are fitted to the distances of the other
half, so they are never fitted to documents that a dictionary has seen; classes weigh as they were sampled.

Scale: the fit uses at most ``sample`` labelled documents of each class and ``windows`` runs of each, chosen by a hash, in one
task for each of three dictionaries; only dictionaries and ``sample`` rows of features reach the driver.  Scoring is one
scan without a shuffle over whole texts; distances of short windows are remembered in a bounded table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.labelled import labels_of, logistic, remainder
from switchyard.llm.scratch import stored
from switchyard.llm.text import kept, sliced, texts

MARKS = b".,!?;:|#*$%&<>\"'()[]{}@^~`=_/\\+-"
TAIL = b" \x01every window of a text ends alike\x02"  # without it, matches near a window's end are not found
REACH = range(2, 9)


@dataclass(frozen=True)
class Distance:
    """``sample``: labelled documents of each class at most, ``windows``: runs of words of each; ``run``: words in a run; ``size`` and ``ordinary``: bytes of the dictionaries; ``segment``: of the parts that are chosen for the toxic one; ``share``: of the runs, how many the last rounds keep; ``window``: bytes of a window at most; labels with remainder ``held`` of ``folds`` are never read."""

    sample: int = 4000
    windows: int = 300_000
    run: int = 2
    size: int = 8192
    segment: int = 20
    ordinary: int = 65536
    rounds: int = 5
    trims: int = 2
    share: float = 0.03
    least: int = 3
    level: int = 12
    window: int = 48
    folds: int = 5
    held: int = 0
    seed: int = 23


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def words(text: bytes, window: int = 48) -> list[bytes]:
    """Lower-cased words without outer marks.  A longer one gives windows that overlap by half."""
    found = [w.strip(MARKS) for w in text.lower().split()]
    if len(max(found, key=len, default=b"")) <= window:
        return found
    return [w[k : k + window] for w in found for k in range(0, max(1, len(w) - window // 2), window // 2)]


def runs(text: bytes, p: Distance) -> list[bytes]:
    """Overlapping runs of words, as training samples."""
    some = words(text, p.window)
    return [b" " + b" ".join(some[k : k + p.run]) + b" " for k in range(max(1, len(some) - p.run + 1))] if some else []


def compressor(content: bytes, level: int) -> Callable[[bytes], int]:
    """Length of a window compressed with ``content`` as the dictionary."""
    content += TAIL
    p = zstandard.ZstdCompressionParameters.from_level(level, source_size=96, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    compress = zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress
    return lambda window: len(compress(window + TAIL))


def trained(size: int, samples: list[bytes], segment: int = 16) -> bytes:
    """Content of a dictionary trained on the samples; smaller where they are few, and the samples themselves where they do not suffice at all."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(samples)[-4096:]


def padded(cores: list[bytes], segment: int, n: int = 16) -> list[bytes]:
    """Samples of ``n`` cores, each with blanks up to a segment's length, so that a segment holds a core whole."""
    wide = [c.ljust(segment) for c in cores]
    return [b"".join(wide[k : k + n]) for k in range(0, len(wide), n)]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], p: Distance) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary from distinct runs of either class, in a fixed order.

    The toxic dictionary ends with what was trained on toxic text and begins with the ordinary one, as toxic documents are
    ordinary text for the most part.
    """
    plain = trained(p.ordinary, ordinary)
    shared, by_plain = set(ordinary), compressor(plain, p.level)
    runs_ = [w for w in toxic if w not in shared]
    side = np.array([zlib.crc32(w) % 2 for w in runs_])
    score, share = np.array([by_plain(w) for w in runs_]), 0.4  # first the runs that ordinary text explains least
    for _ in range(p.rounds):
        best = np.argsort(-score, kind="stable")[: max(200, int(len(runs_) * share))]
        score = np.zeros(len(runs_))
        for q in (0, 1):
            by_toxic = compressor(plain + trained(p.size, [runs_[k] for k in best if side[k] == q]), p.level)
            for k in np.flatnonzero(side != q):
                score[k] = by_plain(runs_[k]) - by_toxic(runs_[k])
        share = max(share / 2.5, p.share)
    best = [k for k in np.argsort(-score, kind="stable")[: max(200, int(len(runs_) * share))] if score[k] > 0]
    samples = {q: [runs_[k] for k in best if side[k] == q] for q in (0, 1)}
    for _ in range(p.trims):  # to the part of each run that a dictionary of the other half tells apart best
        cores: dict[int, list[bytes]] = {0: [], 1: []}
        for q in (0, 1):
            by_toxic = compressor(plain + trained(p.size, padded(samples[1 - q], p.segment), p.segment), p.level)
            for k in best:
                if side[k] == q:
                    some = runs_[k].split()
                    parts = [b" " + b" ".join(some[i:j]) + b" " for i in range(len(some)) for j in range(i + 1, len(some) + 1)]
                    found = max(((by_plain(x) - by_toxic(x), -len(x), x) for x in parts), default=(0, 0, b""))
                    if found[0] >= p.least:
                        cores[q].append(found[2])
        samples = cores
    return plain + trained(p.size, padded(samples[0] + samples[1], p.segment), p.segment), plain


class Windows(dict):
    """Distance of each window: bytes that the toxic dictionary saves over the ordinary one.  Bounded."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int, limit: int = 150_000):
        super().__init__()
        self.by_toxic, self.by_ordinary, self.limit = compressor(toxic, level), compressor(ordinary, level), limit

    def __missing__(self, word: bytes) -> int:
        window = b" " + word + b" "
        value = self.by_ordinary(window) - self.by_toxic(window)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


def features(text: bytes, distances: Windows, p: Distance) -> list[float]:
    """The five largest distances, how many reach each threshold, and the number of windows; the last two as logarithms."""
    some = words(text, p.window)
    if not some:
        return [0.0] * (6 + len(REACH))
    d = np.fromiter(map(distances.__getitem__, some), dtype=np.int64, count=len(some))
    top = np.sort(np.append(d[d >= 1], [0] * 5))[-5:]
    return [*top.astype(float), *(math.log1p(int((d >= t).sum())) for t in REACH), math.log(len(d))]


def fit(docs: DataFrame, labels: DataFrame, p: Distance = Distance()) -> Model:
    """The model from ``labels`` (doc_id, toxic) whose remainder is not held out.  Without both classes: a constant.  Of rows with one doc_id one is used."""
    known = labels_of(labels, "toxic").where(remainder(F.col("doc_id"), p.folds) != p.held)
    order = F.xxhash64("doc_id", F.lit(p.seed))
    some = known.where("y = 0").orderBy(order).limit(p.sample).union(known.where("y = 1").orderBy(order).limit(p.sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"])  # at most twice ``sample`` rows
    rows = stored(rows.select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id", F.lit(p.seed + 1)), F.lit(2)).cast("int").alias("half")), "labelled")

    n = {(r.y, r.half): r.n for r in rows.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = ([n.get((y, h), 0) for h in (0, 1)] for y in (0, 1))
    if not all(n0) or not all(n1):
        share = min(max((sum(n1) + 0.5) / (sum(n0) + sum(n1) + 1), 1e-3), 1 - 1e-3)
        return Model(b"", b"", (0.0,) * (6 + len(REACH)) + (math.log(share / (1 - share)),))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, y, h) for t, y, h in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for w in set(runs(t, p))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in found], pa.binary()), pa.array([y for _, y, _ in found], pa.int32()), pa.array([h for _, _, h in found], pa.int32())], names=["w", "y", "half"])

    chosen = rows.select("text", "y", "half").mapInArrow(sampled, "w binary, y int, half int").withColumn("part", F.explode(F.array("half", F.lit(2)))).groupBy("part", "y", "w").agg(F.xxhash64("w", F.lit(p.seed)).alias("o"))
    firsts = [chosen.where((F.col("part") == part) & (F.col("y") == y)).orderBy("o", "w").limit(p.windows) for part in (0, 1, 2) for y in (0, 1)]
    samples = firsts[0]
    for more in firsts[1:]:
        samples = samples.unionByName(more)
    samples = stored(samples.select("part", "y", "w", "o"), "samples")

    def made(group: pa.Table) -> pa.Table:
        ranked = sorted(zip(group["o"].to_pylist(), group["w"].to_pylist(), group["y"].to_pylist(), strict=True))
        toxic, ordinary = dictionaries([w for _, w, y in ranked if y], [w for _, w, y in ranked if not y], p)
        return pa.table({"part": group["part"][:1], "toxic": pa.array([toxic], pa.binary()), "ordinary": pa.array([ordinary], pa.binary())})

    pairs = {r.part: (bytes(r.toxic), bytes(r.ordinary)) for r in samples.groupBy("part").applyInArrow(made, "part int, toxic binary, ordinary binary").collect()}  # three rows

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Windows(*pairs[h], p.level) for h in (0, 1)]
        for batch in batches:
            x = [features(t, tables[1 - h], p) for t, h in zip(texts(batch.column(1)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    table = rows.repartition("doc_id").mapInArrow(measured, "y int, x array<double>").toPandas()  # at most twice ``sample`` rows
    x, y = np.array(table["x"].tolist(), dtype=float), table["y"].to_numpy(dtype=float)
    return Model(*pairs[2], tuple(float(v) for v in logistic(x, y, ridge=1.0)))


def toxicity(docs: DataFrame, model: Model, p: Distance = Distance()) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, score, predicted, top_distance: one row per input row.

    Null and empty texts have no windows; their score is the intercept's.  A null doc_id stays null; repeated rows each give
    a row; other columns are ignored; empty input gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances, w = kept(("windows", hash(model), p.level), lambda: Windows(model.toxic, model.ordinary, p.level)), np.array(model.weights)
        for batch in sliced(batches, 1):
            x = np.array([features(t, distances, p) for t in texts(batch.column(1))], dtype=float).reshape(-1, len(w) - 1)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(x[:, 4])], names=["doc_id", "score", "predicted", "top_distance"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, top_distance double")


def toxicity_report(docs: DataFrame, labels: DataFrame, p: Distance = Distance()) -> DataFrame:
    """doc_id, held_out, score, predicted, top_distance of every row."""
    scored = toxicity(docs, fit(docs, labels, p), p)
    return scored.select("doc_id", (remainder(F.col("doc_id"), p.folds) == p.held).alias("held_out"), "score", "predicted", "top_distance")
