"""Source divergence audit: how far the word use of each source lies from that of its language and of the other sources.

Method: integer dictionaries.  The kept terms of a language stand in sorted arrays, one for each chunk of a range partition;
``searchsorted`` turns terms into ids, ``bincount`` turns (source, id) into dense vectors of counts.  Ids follow UTF-8 order,
so ties of equal value are broken by id, and all arithmetic is on integers.

Scale: texts are read once and reduced to counts inside the scan; only (language, source, term) counts are shuffled.  Sorted
by range, a language of any size is split over tasks, and a task holds one chunk: as many terms as fit ``cells`` counts over
the language's sources.  Sums over chunks are sums of integers.  The list of (language, source) groups, as long as the square
root of the result, is what the tasks get.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchyard.llm.scratch import stored
from switchyard.llm.text import sliced, texts

_COUNTS = "lang string, source string, term binary, n long, docs long"
_PARTS = "lang string, source string, part string, item binary, at long, value long"
# A-Z to a-z; all other bytes up to 0x7F but a-z to the space; bytes of longer code points stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Audit:
    """``least``: documents that a kept term is in; ``top``: terms listed for a group; ``cells``: counts in one dense chunk; ``held``: terms held by a scan before they are handed on; ``rows``: rows of counts in a range partition; ``piece``: bytes of a text split at once."""

    least: int = 10
    top: int = 10
    cells: int = 1 << 18
    held: int = 300_000
    rows: int = 1_000_000
    piece: int = 1 << 20


def terms_of(text: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each stretch of about ``piece`` bytes; none is cut."""
    at = 0
    while at < len(text):
        end = at + piece
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


def term_counts(docs: DataFrame, p: Audit) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): partial sums.  Every group has a row for the empty term, of 0 occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in seen.items():
                terms = list(n)
                rows = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()), pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([in_docs[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            seen.clear()

        held = 0
        for batch in sliced(batches, 2):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                if (lang, source) not in seen:
                    seen[lang, source] = (Counter({b"": 0}), Counter({b"": 0}))
                n, in_docs = seen[lang, source]
                before, mine = len(n), set()
                for words in terms_of(text, p.piece):
                    n.update(words)
                    mine.update(words)
                in_docs.update(mine)
                held += len(n) - before
            if held > p.held:
                yield from flush()
                held = 0
        yield from flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probabilities(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (N + 2 V)), by three steps of long division, exact while N is below 9 * 10^15."""
    over = n + 2 * v
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // over
        rest = rest % over
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); at most 10^18 in between."""
    return (p - q) ** 2 // (p + q)


def divergence(docs: DataFrame, p: Audit = Audit()) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, ...) -> lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language and its distance.  Part ``term``: the ``top`` terms that the source uses
    more than its language does.  Null text, lang and source are ''.  Repeated rows count each; doc_id and other columns are
    ignored.  A text without terms, however long, adds nothing but its group.  A language without kept terms has distances of
    0 and no terms.  Ties go by UTF-8 bytes of the item.  Empty input gives no rows.
    """
    spark = docs.sparkSession
    counted = term_counts(docs, p)
    own = Window.partitionBy("lang", "term")  # a row for each source
    counted = counted.withColumn("all", F.sum("docs").over(own)).where((F.col("all") >= p.least) | (F.length("term") == 0))
    counted = stored(counted.select("lang", "source", "term", "n"), "terms")
    sources = counted.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = F.count_distinct(F.when(F.length("term") > 0, F.col("term")))
    vocabulary = counted.groupBy("lang").agg(kept.alias("v"), F.sum("n").alias("n"))
    groups = [(r.lang, r.source, r.n) for r in sources.collect()]  # as the docstring of the module says
    langs = {r.lang: (r.v, r.n) for r in vocabulary.collect()}
    if not groups:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    known: dict[str, tuple[int, int, list[str], np.ndarray]] = {}
    for lang in langs:
        some = sorted((s.encode(), s, n) for x, s, n in groups if x == lang)
        known[lang] = (*langs[lang], [s for _, s, _ in some], np.array([n for *_, n in some], dtype=np.int64))
    told = spark.sparkContext.broadcast({k: tuple(v) for k, v in known.items()})

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
        """Rows of one language whose terms are consecutive, whole terms, up to a chunk."""
        lang, rows, last, n_terms = None, [], None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != lang or (row[2] != last and n_terms * len(told.value[lang][2]) >= p.cells):
                    if rows:
                        yield lang, rows
                    lang, rows, n_terms, last = row[0], [], 0, None
                n_terms, last = n_terms + (row[2] != last), row[2]
                rows.append(row)
        if rows:
            yield lang, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40  # ranges are in order, and so are ids
        for lang, rows in chunks(batches):
            v, n_all, names, n_of = told.value[lang]
            terms = np.array(sorted({r[2] for r in rows}), dtype=object)
            ids = np.searchsorted(terms, np.array([r[2] for r in rows], dtype=object))
            place = {s: k for k, s in enumerate(names)}
            at = np.fromiter((place[r[1]] for r in rows), np.int64, len(rows))
            size = len(names) * len(terms)
            weights = np.array([r[3] for r in rows], dtype=np.int64)
            exact = np.bincount(at * len(terms) + ids, weights & 0xFFFFFFFF, minlength=size).astype(np.int64) + (np.bincount(at * len(terms) + ids, weights >> 32, minlength=size).astype(np.int64) << 32)
            counts = exact.reshape(len(names), len(terms))
            mine = probabilities(counts, n_of[:, None], v)
            whole = probabilities(counts.sum(axis=0), np.int64(n_all), v)
            out: dict[str, list] = {"source": [], "part": [], "item": [], "at": [], "value": []}
            for a, name in enumerate(names):
                far = distance(mine[a], whole)
                able = np.flatnonzero((counts[a] > 0) & (mine[a] > whole))
                for k in able[np.argsort(-far[able], kind="stable")[: p.top]]:  # stable: ties by id
                    for column, x in zip(out.values(), (name, "term", terms[k], base + int(k), int(far[k])), strict=True):
                        column.append(x)
                sums = distance(mine[a + 1 :], mine[a]).sum(axis=1)
                for b, x in enumerate(sums.tolist(), a + 1):
                    for one, other in ((name, names[b]), (names[b], name)):
                        for column, y in zip(out.values(), (one, "pair", other.encode(), b, x), strict=True):
                            column.append(y)
            base += len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out["at"]), pa.string()), *(pa.array(c, t) for c, t in zip(out.values(), (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True))], names=["lang", *out])

    parts = max(spark.sparkContext.defaultParallelism, -(-counted.count() // p.rows))
    ranged = counted.where("length(term) > 0").repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    found = stored(ranged.select("lang", "source", "term", "n").mapInArrow(run, _PARTS), "parts")
    pair = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = [(lang, s) for lang, (v, _, names, _) in known.items() if not v for s in names]  # no kept terms: all distances are 0
    if bare:
        alone = spark.createDataFrame(bare, "lang string, source string")
        others = alone.withColumnsRenamed({"source": "item"}).withColumn("item", F.col("item").cast("binary"))
        pair = pair.unionByName(alone.join(others, "lang").where(F.col("source").cast("binary") != F.col("item")).select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    term = found.where("part = 'term'")
    term = term.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "at"))).where(F.col("rank") <= p.top)
    columns = lambda f, part: f.select("lang", "source", F.lit(part).alias("part"), F.col("item").cast("string").alias("item"), "value", "rank")
    return columns(pair, "pair").unionByName(columns(term, "term"))
