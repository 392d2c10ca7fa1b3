"""Merkle manifest of a dataset: a tree for each source, a root over all, and for every row a proof that can be folded again.

Method: rows are range-sorted by source and id, so that a partition holds consecutive leaves, and counts give every partition
its place in the tree.  A partition pushes its leaves on a stack with a list for each level, like the carries of a counter of
base ``fanout``: a full run becomes a node one level up.  Runs that begin or end in another partition cannot be closed there;
their nodes (under ``fanout`` on each side of a level) are emitted as peaks and merged by Spark, level by level.  The last run
of a level is hashed as it is, without padding.  For the proofs a partition builds its stretch again, and is given those few
runs that it shares with others.

Scale: texts are read once, to be hashed by built-in functions; the leaves, about 100 bytes a row, are shuffled three times.
A source of any size is spread over partitions, and a task holds one partition's leaves.  The sources' own tree is built by
the same code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchyard.llm.scratch import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PEAKS = "tree string, level int, idx long, size long, hash binary"
_SIDES = "array<struct<left:binary,right:binary>>"
_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_ORDER = ("tree", "doc_id", "name", "leaf", "r")


@dataclass(frozen=True)
class Manifest:
    """``fanout``: nodes in a run; ``rows``: leaves in a range partition; ``every``: the tampering test takes ids whose crc32 this divides."""

    fanout: int = 16
    rows: int = 65_536
    every: int = 5


def row_text(text: str = "text") -> Column:
    """The fields of a row, each as its byte count, a colon and its value, or ``-``; ``text`` is an expression for the last."""

    def field(value: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*[field(F.expr(text if c == "text" else c).cast("string")) for c in FIELDS])


def leaves(docs: DataFrame, p: Manifest) -> DataFrame:
    """tree, doc_id, name, leaf, changed (the leaf of a tampered row, else null), r: a stored table.

    ``tree`` is the source after an s, or empty for null, so that null comes first and is not ''.
    """
    digest = lambda text: F.unhex(F.sha2(row_text(text).cast("binary"), 256))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % p.every == 0
    found = docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("name"),
        digest("text").alias("leaf"), F.when(drawn, digest(lower)).alias("changed"), F.monotonically_increasing_id().alias("r"),
    )
    return stored(found, "leaves")


def _levels(total: int, fanout: int) -> int:
    """Levels above the leaves of a tree."""
    n = 0
    while total > 1:
        total, n = -(-total // fanout), n + 1
    return n


def _hash(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


@dataclass(frozen=True)
class Forest:
    """``indexed``: the leaves with part (partition) and row in it; ``segments``: part, tree, first (row), n, start (index in the tree), total; ``runs``: those over several partitions, with their nodes; ``tops``: tree, top."""

    indexed: DataFrame
    segments: DataFrame
    runs: DataFrame
    tops: DataFrame
    parts: int
    levels: int


def _dealt(forest_parts: int, infos: DataFrame, indexed: DataFrame) -> DataFrame:
    """Each partition's segments and leaves in order: a segment's row, then its leaves."""
    both = infos.withColumn("kind", F.lit(0)).unionByName(indexed.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(forest_parts, "part").sortWithinPartitions("part", "row", "kind")


def _peaks(dealt: DataFrame, fanout: int) -> DataFrame:
    """What a partition's stacks leave open at the ends of a segment, and the tops of trees that end in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[list[tuple[int, bytes]]] = []
        sizes: list[int] = []
        tree, at, total = None, 0, 0

        def begin(name: str, start: int, of: int) -> None:
            nonlocal tree, at, total
            tree, at, total = name, start, of
            sizes[:] = [of]
            while sizes[-1] > 1:
                sizes.append(-(-sizes[-1] // fanout))
            stack[:] = [[] for _ in sizes]

        def emit(level: int) -> None:
            out.extend((tree, level, i, sizes[level], bytes.fromhex(h.decode())) for i, h in stack[level])
            stack[level].clear()

        def push(level: int, i: int, node: bytes) -> None:
            stack[level].append((i, node))
            if (i + 1) % fanout == 0 and sizes[level] > 1:
                close(level)

        def close(level: int) -> None:
            pending = stack[level]
            if pending[0][0] % fanout:  # begun in another partition
                emit(level)
                return
            i, node = pending[0][0] // fanout, _hash([h for _, h in pending])
            pending.clear()
            push(level + 1, i, node)

        def end() -> None:
            for level, pending in enumerate(stack):
                if pending and at == total and sizes[level] > 1 and pending[-1][0] == sizes[level] - 1:
                    close(level)  # the short last run
                elif pending:
                    emit(level)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tree", "level", "idx", "size", "hash"])

        for batch in batches:
            for kind, name, start, of, leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    end()
                    begin(name, start, of)
                else:
                    push(0, at, leaf.hex().encode())
                    at += 1
            if out:
                yield flush()
        end()
        yield flush()

    return dealt.select("kind", "tree", "start", "total", "leaf").mapInArrow(run, _PEAKS)


def forest(rows: DataFrame, p: Manifest) -> Forest:
    """The trees of a stored table of leaves."""
    fanout = p.fanout
    parts = max(1, -(-rows.count() // p.rows))
    ranged = rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in _ORDER]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in _ORDER])
    at = F.monotonically_increasing_id()  # the partition's number, then the row's in it
    numbered = ranged.withColumn("at", at).select(F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "tree", "doc_id", "name", "leaf", "changed")
    indexed = stored(numbered, "indexed")
    segments = indexed.groupBy("part", "tree").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("tree")  # a row for each partition
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    segments = stored(segments.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(own).alias("total")), "segments")
    levels = _levels(segments.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0], fanout)

    peaks = stored(_peaks(_dealt(parts, segments.select("part", "row", "tree", "start", "total"), indexed.select("part", "row", "leaf")), fanout), "peaks")
    runs, made = [], peaks.where("false")
    tops = peaks.where("size = 1")
    text = F.concat_ws("", F.transform("kids", lambda k: F.lower(F.hex(k["hash"]))))
    for level in range(levels):
        nodes = peaks.where(F.col("level") == level).unionByName(made).where("size > 1")
        kids = F.array_sort(F.collect_list(F.struct("idx", "hash")))  # at most ``fanout``
        grouped = nodes.groupBy("tree", F.floor(F.col("idx") / fanout).alias("run"), "size").agg(kids.alias("kids"))
        merged = stored(grouped.select("tree", F.lit(level).alias("level"), "run", "size", F.transform("kids", lambda k: k["hash"]).alias("nodes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("hash")), f"runs-{level}")
        runs.append(merged.select("tree", "level", "run", "nodes"))
        made = merged.select("tree", F.lit(level + 1).alias("level"), F.col("run").alias("idx"), F.ceil(F.col("size") / fanout).alias("size"), "hash")
        tops = tops.unionByName(made.where("size = 1"))
    over = runs[0] if runs else peaks.select("tree", "level", F.col("idx").alias("run"), F.array("hash").alias("nodes")).where("false")
    for more in runs[1:]:
        over = over.unionByName(more)
    return Forest(indexed, segments, over, stored(tops.select("tree", F.col("hash").alias("top")), "tops"), parts, levels)


def _shared(f: Forest, fanout: int) -> DataFrame:
    """segments, with ``shared``: the runs of each level in which it begins or ends, where those are shared; two a level at most."""
    level = F.explode(F.sequence(F.lit(0), F.lit(max(f.levels - 1, 0)))).alias("level")
    span = F.pow(F.lit(float(fanout)), F.col("level") + 1).cast("long")
    ends = F.array_distinct(F.array(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n") - 1) / span)))
    asked = f.segments.select("part", "tree", "start", "n", level).select("part", "tree", "level", F.explode(ends).alias("run"))
    given = asked.join(f.runs, ["tree", "level", "run"]).groupBy("part", "tree").agg(F.collect_list(F.struct("level", "run", "nodes")).alias("shared"))
    return f.segments.join(given, ["part", "tree"], "left").select("part", "row", "tree", "start", "total", "shared")


def _paths(leaf_nodes: list[bytes], start: int, total: int, shared: dict[tuple[int, int], list[bytes]], fanout: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a segment, its siblings to the left and to the right on every level up to the top."""
    levels, size, base, nodes = [(start, leaf_nodes)], total, start, leaf_nodes
    tops = 0
    while size > 1:
        end = base + len(nodes)
        low, high = -(-base // fanout), -(-end // fanout) if end == size else end // fanout
        nodes = [_hash(nodes[r * fanout - base : (r + 1) * fanout - base]) for r in range(low, high)]
        base, size, tops = low, -(-size // fanout), tops + 1
        levels.append((base, nodes))

    def run_of(level: int, r: int) -> list[bytes]:
        if (level, r) in shared:
            return shared[level, r]
        first, some = levels[level]
        return some[r * fanout - first : (r + 1) * fanout - first]

    last: list[tuple[int, list[tuple[bytes, bytes]]]] = [(-1, [])] * (tops + 1)

    def above(level: int, i: int) -> list[tuple[bytes, bytes]]:
        """Sides of node ``i`` and of all above it; the latest of each level is kept."""
        if level == tops:
            return []
        if last[level][0] != i:
            kids, j = run_of(level, i // fanout), i % fanout
            last[level] = (i, [(b"".join(kids[:j]), b"".join(kids[j + 1 :])), *above(level + 1, i // fanout)])
        return last[level][1]

    for i in range(start, start + len(leaf_nodes)):
        yield above(0, i)


def _walked(dealt: DataFrame, columns: list[str], fanout: int, schema: str, each) -> DataFrame:  # noqa: ANN001
    """``each(info, row, path)`` for every leaf; rows are tuples of ``columns``, infos of all columns of their segment."""
    wanted = ["kind", "tree", "start", "total", "shared", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info: dict | None = None
        rows: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            shared = {(x["level"], x["run"]): [h.hex().encode() for h in x["nodes"]] for x in info["shared"] or []}
            paths = _paths([r["leaf"].hex().encode() for r in rows], info["start"], info["total"], shared, fanout)
            out: list[tuple] = []
            for row, path in zip(rows, paths, strict=True):
                out.append(each(info, row, path))
                if len(out) == 2048:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    yield from done()
                    info, rows = row, []
                else:
                    rows.append(row)
        yield from done()

    sides = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), _SIDES: sides}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return dealt.select(*wanted).mapInArrow(run, schema)


def manifest(docs: DataFrame, p: Manifest = Manifest()) -> DataFrame:
    """``docs`` (doc_id, source, lang, n_chars, text, ...) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    One row for each input row.  Leaves of a source ascend by doc_id, null first; rows of one doc_id by their leaf.  Repeated
    rows are leaves of their own.  Null and '' differ, as texts and as sources.  A null doc_id is never tampered with.  Texts
    of any length are hashed whole.  Other columns are ignored.  Empty input gives no rows.
    """
    spark, fanout = docs.sparkSession, p.fanout
    trees = forest(leaves(docs, p), p)
    named = trees.tops.select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("name"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("changed"), F.lit(0).cast("long").alias("r"))
    over = forest(stored(named, "subroots"), p)
    roots = over.tops.collect()  # one tree, or none
    if not roots:
        return spark.createDataFrame([], _PROOFS)
    root = bytes(roots[0].top).hex()

    def up(info: dict, row: dict, path: list) -> tuple:
        return row["name"], row["leaf"].hex(), [{"left": a, "right": b} for a, b in path]

    upper = _walked(_dealt(over.parts, _shared(over, fanout), over.indexed.select("part", "row", "name", "leaf")), ["name", "leaf"], fanout, f"name string, subroot string, upper {_SIDES}", up)
    upper = stored(upper.withColumnsRenamed({"name": "tree"}), "upper")

    def proof(info: dict, row: dict, path: list) -> tuple:
        if "sides" not in info:
            info["sides"] = [(x["left"], x["right"]) for x in info["upper"]]
        sides = hashlib.sha256()
        node = (row["changed"] or row["leaf"]).hex().encode()
        for left, right in path + info["sides"]:
            sides.update(left)
            sides.update(right)
            node = hashlib.sha256(left + node + right).hexdigest().encode()
        return row["doc_id"], row["leaf"].hex(), info["subroot"], root, sides.hexdigest(), node.decode(), node.decode() == root

    infos = _shared(trees, fanout).join(upper, "tree")
    return _walked(_dealt(trees.parts, infos, trees.indexed.select("part", "row", "doc_id", "leaf", "changed")), ["doc_id", "leaf", "changed", "subroot", "upper"], fanout, _PROOFS, proof)
