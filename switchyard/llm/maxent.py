"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Method: P(word | history) = P(class | history) * P(slot | class, previous word) * P(word | slot).  A word's class comes from its
ending, its slot (one of 4096 a class) from its hash.

* The class softmax has hashed features of the history: a bias, the previous word, the previous two, and skips over one
  and two words.  Its weights are trained by gradient steps on mini-batches in every partition at once; the partitions'
  weights are averaged, each feature by how often it was seen.
* The slot softmax has one feature for every (previous word, slot) that training texts hold twice or more, over the slots'
  own frequencies.  These weights grow with the corpus.  They are trained by gradient steps on counts, which never leave the
  executors; every context's normaliser is exact.
* Within a slot the only features are the words themselves, whose softmax is their relative frequency, smoothed by one.

Scale: keys are 64-bit hashes with counts, in sorted numpy blocks whose number follows the bytes of text, so a block is bounded.
A pair's block is a hash of the pair, so a frequent previous word is spread over many.  Pairs, contexts and words that each
hold one ``hot``-th of all tokens are broadcast, of which there can be but so many; all others meet their weights in a
join of blocks, whose results are added up for each text.  Nothing else of the corpus reaches the driver but one count for
each of the 65,536 slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.labelled import remainder
from switchyard.llm.scratch import stored
from switchyard.llm.text import kept, sliced, texts

END = b""  # no word is empty
SLOTS, CLASSES = 1 << 16, 16
WORDS, PAIRS, WEIGHTS, SPREAD, TEXT = range(5)  # kinds of blocks; SPREAD: pairs of frequent contexts, dealt by pair
_A, _B, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(SLOTS - 1)
_SEEN = "kind int, block int, salt int, keys binary, counts binary"
_BLOCK = "kind int, block int, keys binary, counts binary, values binary, more binary"


@dataclass(frozen=True)
class MaxEnt:
    """``rows``: hashed features of the class softmax; ``spread``: prior variance of a slot feature; ``text``: bytes of text for one block; ``hot``: a key with one ``hot``-th of all tokens is broadcast; ``flush``: tokens that a task counts at a time; rows of remainder ``held`` of ``folds`` are not learnt from."""

    rows: int = 1 << 16
    batch: int = 4096
    rate: float = 0.5
    spread: float = 2.0
    steps: int = 12
    text: int = 32 << 20
    hot: int = 1_000_000
    flush: int = 2_000_000
    chunk: int = 512
    fan: int = 64
    folds: int = 7
    held: int = 2


class Codes(dict):
    """A hash of each word with its slot in the low 16 bits, the class leading.  Bounded.  Two of ten million words share a hash with a probability of about 1e-4."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        group = 1 + xxhash.xxh3_64_intdigest(word[-3:]) % (CLASSES - 1) if word else 0
        value = xxhash.xxh3_64_intdigest(word) & ~0xF000 | group << 12
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def tokens(some: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens, each text closed by the end, and where the texts start."""
    split = [t.lower().split() for t in some]
    for words in split:
        words.append(END)
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = np.fromiter((c for words in split for c in map(codes.__getitem__, words)), dtype=np.uint64, count=int(sizes.sum()))
    return flat, np.cumsum(sizes) - sizes


def histories(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The word one, two and three places back; 0 before the start of a text."""
    n, place = len(codes), np.arange(len(codes))
    since = place - np.repeat(starts, np.diff(np.append(starts, n)))
    back = []
    for k in (1, 2, 3):
        before = np.zeros(n, dtype=np.uint64)
        before[k:] = codes[:-k] if n > k else codes[:0]
        before[since < k] = 0
        back.append(before)
    return back


def features(back: list[np.ndarray], rows: int) -> np.ndarray:
    """Feature rows (4, tokens) of each history: previous word, previous two, skip over one, skip over two."""
    a, b, c = (x * _A + np.uint64(k) for k, x in enumerate(back, 1))
    shift = np.uint64(64 - (rows.bit_length() - 1))
    return np.stack([((m ^ (m >> np.uint64(31))) * _B >> shift).astype(np.uint16 if rows <= SLOTS else np.uint32) for m in (a, a * _B + b, b, a * _B + c + np.uint64(7))])


def pairs_of(previous: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Keys of (previous word, slot): the context (previous word, class) is the leading 52 bits."""
    return (mixed(previous * _A + np.uint64(1)) & ~_LOW) | (codes & _LOW)


def class_logs(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probabilities (tokens, classes) of the class softmax."""
    z = bias + weights.take(at[0], axis=0, mode="clip")
    for rows in at[1:]:
        z += weights.take(rows, axis=0, mode="clip")
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z) @ np.ones(z.shape[1], dtype=z.dtype))[:, None]
    return z


class Trainer:
    """Gradient steps of the class softmax; a feature's step shrinks with the root of how often it was seen."""

    def __init__(self, p: MaxEnt):
        self.p, self.weights, self.seen = p, np.zeros((p.rows, CLASSES), dtype=np.float32), np.zeros(p.rows, dtype=np.float32)
        self.bias, self.tokens = np.zeros(CLASSES, dtype=np.float32), 0

    def learn(self, at: np.ndarray, target: np.ndarray) -> None:
        for k in range(0, len(target), self.p.batch):
            some, y = at[:, k : k + self.p.batch], target[k : k + self.p.batch]
            gradient = -np.exp(class_logs(self.weights, self.bias, some))
            gradient[np.arange(len(y)), y] += 1
            for rows in some:
                order = np.argsort(rows, kind="stable")
                ranked = rows[order]
                cut = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                touched, n = ranked[cut], np.diff(np.append(cut, len(ranked))).astype(np.float32)
                seen = self.seen[touched] + n
                self.seen[touched] = seen
                self.weights[touched] += np.add.reduceat(gradient.take(order, axis=0), cut, axis=0) * (self.p.rate / (n + np.sqrt(seen)))[:, None]
            self.tokens += len(y)
            self.bias += gradient.mean(axis=0) * self.p.rate / math.sqrt(1 + self.tokens / self.p.batch)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    cut = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, dtype=np.int64)
    return every[cut], np.add.reduceat(n, cut) if len(cut) else n


def _dealt(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, places of its entries) of every block that occurs."""
    if not len(block):
        return
    order = np.argsort(block, kind="stable")
    ranked = block[order]
    cuts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    for at, end in zip(cuts, [*cuts[1:], len(ranked)], strict=True):
        yield int(ranked[at]), order[at:end]


def block_of(kind: int, keys: np.ndarray, power: int) -> np.ndarray:
    """One of 2**power blocks: words by slot (2**16 at most), pairs by context, SPREAD ones by pair."""
    if kind == WORDS:
        return ((keys & _LOW) >> np.uint64(16 - min(power, 16))).astype(np.int32)
    x = mixed(keys >> np.uint64(12)) if kind == PAIRS else mixed(keys * _A)
    return (x >> np.uint64(64 - power)).astype(np.int32) if power else np.zeros(len(keys), dtype=np.int32)


def learnt(docs: DataFrame, p: MaxEnt, power: int) -> DataFrame:
    """One scan: blocks of word counts and of pair counts (by pair), and each task's class weights in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, trainer, held, waiting = kept("codes", Codes), Trainer(p), {WORDS: [], PAIRS: []}, 0
        salt = TaskContext.get().partitionId() // p.fan

        def rows(some: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*some, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "block", "salt", "keys", "counts"])

        def flush() -> pa.RecordBatch:
            out = []
            for kind, some in held.items():
                keys, n = np.unique(np.concatenate(some), return_counts=True)
                some.clear()
                for block, at in _dealt(block_of(kind if kind == WORDS else SPREAD, keys, power)):
                    out.append((kind, block, 0, keys[at].tobytes(), n[at].astype("<u4").tobytes()))
            return rows(out)

        for batch in sliced(batches, 0):
            flat, starts = tokens(texts(batch.column(0)), codes)
            back = histories(flat, starts)
            trainer.learn(features(back, p.rows), ((flat & _LOW) >> np.uint64(12)).astype(np.int64))
            held[WORDS].append(flat), held[PAIRS].append(pairs_of(back[0], flat))
            waiting += len(flat)
            if waiting >= p.flush:
                yield flush()
                waiting = 0
        if waiting:
            yield flush()
        if trainer.tokens:
            out = [(WEIGHTS, -1, salt, (trainer.bias * trainer.tokens).astype("<f4").tobytes(), np.array([trainer.tokens], "<f4").tobytes())]
            for k in range(0, p.rows, p.chunk):
                seen = trainer.seen[k : k + p.chunk]
                out.append((WEIGHTS, k // p.chunk, salt, (trainer.weights[k : k + p.chunk] * seen[:, None]).tobytes(), seen.tobytes()))
            yield rows(out)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, _SEEN)


def counted(rows: DataFrame, power: int = 0) -> DataFrame:
    """Blocks with their parts added up: words (``values``: tokens, ``more``: distinct words of each slot of the block), pairs seen twice or more (``once``: how many others there were), weights."""

    def add(group: pa.Table) -> pa.Table:
        kind, block, salt = (group[c][0].as_py() for c in ("kind", "block", "salt"))
        keys, counts = ([x.as_buffer() for c in group[name].chunks for x in c] for name in ("keys", "counts"))
        values = more = b""
        once = 0
        if kind == WEIGHTS:
            key, n = (sum(np.frombuffer(x, "<f4").astype(np.float64) for x in some).astype("<f4") for some in (keys, counts))
        else:
            key, n = _merged([np.frombuffer(x, np.uint64) for x in keys], [np.frombuffer(x, "<u4").astype(np.int64) for x in counts])
            if kind == WORDS:
                slot = (key & _LOW).astype(np.int64)
                some, at = np.unique(slot, return_inverse=True)
                values = np.stack([some, np.bincount(at, weights=n).astype(np.int64)]).tobytes()
                more = np.bincount(at).astype(np.int64).tobytes()
            else:
                once = int((n == 1).sum())
                key, n = key[n > 1], n[n > 1]
            n = n.astype("<i8")
        return pa.table({"kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "keys": pa.array([key.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "values": pa.array([values], pa.binary()), "more": pa.array([more], pa.binary()), "once": pa.array([once])})

    parts = rows.repartition(3 << power, "kind", "block", "salt") if power else rows
    return parts.groupBy("kind", "block", "salt").applyInArrow(add, "kind int, block int, salt int, keys binary, counts binary, values binary, more binary, once long")


def averaged(parts: DataFrame, p: MaxEnt) -> tuple[np.ndarray, np.ndarray]:
    """Class weights and bias, each averaged over tasks by how often it was seen.  Sums of ``fan`` parts are added in a tree."""
    parts, most = parts.where(F.col("kind") == WEIGHTS).select("kind", "block", "salt", "keys", "counts"), 1
    highest = parts.agg(F.coalesce(F.max("salt"), F.lit(0))).first()[0]
    while most <= highest:
        most *= p.fan
        parts = stored(counted(parts.withColumn("salt", F.floor(F.col("salt") / p.fan).cast("int"))).select("kind", "block", "salt", "keys", "counts"), "weights")
    weights, bias = np.zeros((p.rows, CLASSES), dtype=np.float32), np.zeros(CLASSES, dtype=np.float32)
    for r in parts.toLocalIterator():  # rows / chunk rows
        seen, total = np.frombuffer(r["counts"], "<f4"), np.frombuffer(r["keys"], "<f4").reshape(-1, CLASSES)
        mean = total / np.maximum(seen, 1)[:, None]
        if r.block < 0:
            bias = mean[0]
        else:
            weights[r.block * p.chunk : r.block * p.chunk + len(seen)] = mean
    return weights, bias


def slot_weights(context: np.ndarray, n: np.ndarray, base: np.ndarray, unseen: float, p: MaxEnt) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradient ascent on the slot softmax of sorted contexts: (starts of the contexts, weights, log normalisers, tokens of each context).

    ``n``: counts of the features; ``base``: the slots' own probabilities in their class; ``unseen``: tokens of a context
    beyond its features, for each feature.  Steps follow the curvature and are kept under 2.
    """
    start = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(context)))
    which, b = np.repeat(np.arange(len(start)), size), np.zeros(len(n))
    if not len(n):
        return start, b, b, b
    total = np.add.reduceat(n, start) + unseen * size
    rest = np.maximum(1 - np.add.reduceat(base, start), 1e-9)
    for _ in range(p.steps):
        e = base * np.exp(b)
        share = e / (rest + np.add.reduceat(e, start))[which]
        slope = n - total[which] * share - b / p.spread
        b += np.clip(slope / (total[which] * share * (1 - share) + 1 / p.spread), -2, 2)
    return start, b, np.log(rest + np.add.reduceat(base * np.exp(b), start)), total


def trained(counts: DataFrame, base: np.ndarray, unseen: float, least: float, p: MaxEnt, power: int) -> DataFrame:
    """Blocks of slot weights.  PAIRS: a context's pairs and normalisers (``more``, ``counts`` its key) in its block; SPREAD: pairs of contexts of ``least`` tokens or more, in the pair's block, with ``more`` marking pairs of ``least``; block -1: those contexts' normalisers."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                keys, n, out = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), "<i8"), []
                for block, at in _dealt(block_of(PAIRS, keys, power)):
                    out.append((block, keys[at].tobytes(), n[at].tobytes()))
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "keys", "counts"])

    def fit(group: pa.Table) -> pa.Table:
        keys, n = _merged(*([np.frombuffer(x.as_buffer(), t) for c in group[name].chunks for x in c] for name, t in (("keys", np.uint64), ("counts", "<i8"))))
        start, b, norm, total = slot_weights(keys >> np.uint64(12), n.astype(float), base[(keys & _LOW).astype(np.int64)], unseen, p)
        often = total >= least
        wide, out = np.repeat(often, np.diff(np.append(start, len(keys)))), []
        out.append((PAIRS, group["block"][0].as_py(), keys[~wide].tobytes(), (keys[start] >> np.uint64(12))[~often].tobytes(), b[~wide].astype("<f4").tobytes(), norm[~often].astype("<f4").tobytes()))
        out.append((SPREAD, -1, (keys[start] >> np.uint64(12))[often].tobytes(), b"", norm[often].astype("<f4").tobytes(), b""))
        some, weight, many = keys[wide], b[wide].astype("<f4"), n[wide] >= least
        for block, at in _dealt(block_of(SPREAD, some, power)):
            out.append((SPREAD, block, some[at].tobytes(), b"", weight[at].tobytes(), many[at].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["kind", "block", "keys", "counts", "values", "more"])

    return counts.where(F.col("kind") == PAIRS).select("keys", "counts").mapInArrow(deal, "block int, keys binary, counts binary").groupBy("block").applyInArrow(fit, _BLOCK)


def _frequent(blocks: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Words with ``least`` tokens or more, sorted, with their counts: at most ``hot`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                keys, n = np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys[n >= least]), pa.array(n[n >= least])], names=["key", "n"])

    got = blocks.where(F.col("kind") == WORDS).select("keys", "counts").mapInArrow(run, "key long, n long").toArrow()
    return _sorted(got["key"].to_numpy().view(np.uint64), got["n"].to_numpy())


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _spread(model: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Frequent pairs with their weights, frequent contexts with their normalisers: at most ``hot`` of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, values, more in zip(*(batch.column(k) for k in range(4)), strict=True):
                context, keys, values = block.as_py() < 0, np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(values.as_buffer(), "<f4")
                if not context:
                    many = np.frombuffer(more.as_buffer(), bool)
                    keys, values = keys[many], values[many]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), context)), pa.array(keys), pa.array(values)], names=["context", "key", "value"])

    got = model.where(F.col("kind") == SPREAD).select("block", "keys", "values", "more").mapInArrow(run, "context boolean, key long, value float").toArrow()
    context, keys, values = got["context"].to_numpy().astype(bool), got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()
    return _sorted(keys[~context], values[~context]), _sorted(keys[context], values[context])


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    at[table[at] != keys] = -1
    return at


@dataclass(frozen=True)
class Shared:
    """What every scoring task knows: bounded in size whatever the corpus."""

    weights: np.ndarray
    bias: np.ndarray
    of_slot: np.ndarray  # log10 of tokens + distinct words + 1 of each slot
    base: np.ndarray  # natural log of each slot's probability in its class
    words: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    total: float  # log10 of N + V + 1


_ASKED = "kind int, block int, first long, keys binary, owners binary, stats binary"
_FOUND = "first long, kind int, keys binary, owners binary, stats binary"
_RESULT = "doc_id long, n_tokens long, known long, base double, score double"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _lookups(docs: DataFrame, shared, p: MaxEnt, power: int) -> DataFrame:  # noqa: ANN001
    """One scan.  For each group of texts (the first has the number ``first``) a TEXT row with what the shared tables give (``keys``: ids, ``owners``: which are not null, ``stats``: tokens, known, base, score of each), and blocks of keys for what they do not (``owners``: places of their texts in the group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, s, part = kept("codes", Codes), Shared(*shared.value), TaskContext.get().partitionId()
        log_c = np.append(np.log10(s.words[1] + 1.0), 0.0)  # the last is for words that are looked up later
        weight, norm = np.append(s.pairs[1], 0.0), np.append(s.contexts[1], 0.0)
        first, n_texts, waiting, ids, stats, held = part << 33, 0, 0, [], [], {WORDS: [], PAIRS: [], SPREAD: []}

        def flush() -> pa.RecordBatch:
            out = []
            if ids:
                known = np.concatenate([np.asarray(x.is_valid()) for x in ids])
                out.append((TEXT, part, first, np.concatenate([np.asarray(x.fill_null(0)) for x in ids]).astype("<i8").tobytes(), known.tobytes(), np.concatenate(stats, axis=1).tobytes()))
            for kind, some in held.items():
                if some:
                    keys, owners = (np.concatenate(x) for x in zip(*some, strict=True))
                    out += [(kind, block, first, keys[at].tobytes(), owners[at].tobytes(), b"") for block, at in _dealt(block_of(kind, keys, power))]
                some.clear()
            ids.clear(), stats.clear()
            return _table(out, _ASKED)

        for batch in sliced(batches, 1):
            flat, starts = tokens(texts(batch.column(1)), codes)
            n, sizes = len(starts), np.diff(np.append(starts, len(flat)))
            owner = np.repeat(np.arange(n_texts, n_texts + n, dtype=np.uint32), sizes)
            slot = (flat & _LOW).astype(np.int64)
            back = histories(flat, starts)
            at, group = features(back, p.rows), slot >> 12
            chance = np.concatenate([class_logs(s.weights, s.bias, at[:, j : j + 8192])[np.arange(min(8192, len(flat) - j)), group[j : j + 8192]] for j in range(0, len(flat), 8192)])
            word = _found(s.words[0], flat)
            pair = pairs_of(back[0], flat)
            context, known = _found(s.contexts[0], pair >> np.uint64(12)), _found(s.pairs[0], pair)
            natural = chance + s.base[slot] - norm[context] + weight[known]
            total = lambda x: np.add.reduceat(x, starts)
            rare, cold, spread = word < 0, context < 0, (context >= 0) & (known < 0)
            for kind, keys, some in ((WORDS, flat, rare), (PAIRS, pair, cold), (SPREAD, pair, spread)):
                held[kind].append((keys[some], owner[some]))
            counts = total(log_c[word])
            ids.append(batch.column(0))
            stats.append(np.stack([sizes, total((~rare).astype(float)), counts - sizes * s.total, total(natural / math.log(10) - s.of_slot[slot]) + counts]))
            n_texts, waiting = n_texts + n, waiting + len(flat)
            if waiting >= p.flush:
                yield flush()
                first, n_texts, waiting = first + n_texts, 0, 0
        yield flush()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, _ASKED)


def _flat(table: pa.Table, column: str, dtype) -> np.ndarray:  # noqa: ANN001
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype) for part in table[column].chunks for x in part] or [np.zeros(0, dtype)])


def _resolved(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block: TEXT rows pass, keys meet their weights and are added up for each text."""
    if not left.num_rows or left["kind"][0].as_py() == TEXT:
        return left.select([x.split()[0] for x in _FOUND.split(", ")])
    kind, keys = left["kind"][0].as_py(), _flat(left, "keys", np.uint64)
    sizes = [len(x.as_buffer()) // 4 for part in left["owners"].chunks for x in part]
    text = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | _flat(left, "owners", "<u4").astype(np.uint64)
    if kind == WORDS:
        table, n = _sorted(_flat(right, "keys", np.uint64), _flat(right, "counts", "<i8"))
        at = _found(table, keys)
        value = np.append(np.log10(n + 1.0), 0.0)[at]
        values = [(at >= 0).astype(float), value, value]  # known, base, score
    else:
        table, b = _sorted(_flat(right, "keys", np.uint64), _flat(right, "values", "<f4"))
        value = np.append(b, 0.0)[_found(table, keys)]
        if kind == PAIRS:
            context, norm = _sorted(_flat(right, "counts", np.uint64), _flat(right, "more", "<f4"))
            value = value - np.append(norm, 0.0)[_found(context, keys >> np.uint64(12))]
        values = [value / math.log(10)]
    some, at = np.unique(text, return_inverse=True)
    stats = np.stack([np.bincount(at, weights=v, minlength=len(some)) for v in values])
    cut = np.searchsorted(some, np.arange(len(sizes) + 1, dtype=np.uint64) << np.uint64(32))
    firsts, owners = left["first"].to_pylist(), (some & np.uint64(0xFFFFFFFF)).astype("<u4")
    return pa.Table.from_batches([_table([(f, kind, b"", owners[i:j].tobytes(), stats[:, i:j].tobytes()) for f, i, j in zip(firsts, cut[:-1], cut[1:], strict=True)], _FOUND)])


def _summed(group: pa.Table) -> pa.Table:
    """One row for each text of a group."""
    rows = list(zip(*(group[c].to_pylist() for c in ("kind", "keys", "owners", "stats")), strict=True))
    ids, valid, stats = next((np.frombuffer(k, "<i8"), np.frombuffer(o, bool), np.frombuffer(x, float).reshape(4, -1).copy()) for kind, k, o, x in rows if kind == TEXT)
    for kind, _, owners, found in rows:
        if kind != TEXT:
            at = np.frombuffer(owners, "<u4")
            for row, more in zip((1, 2, 3) if kind == WORDS else (3,), np.frombuffer(found, float).reshape(-1, len(at)), strict=True):
                stats[row, at] += more  # a text occurs once in a block
    whole = [pa.array(stats[k].round().astype(np.int64)) for k in (0, 1)]
    return pa.table([pa.array(ids, mask=~valid), *whole, pa.array(stats[2]), pa.array(stats[3])], names=[x.split()[0] for x in _RESULT.split(", ")])


def fitted(docs: DataFrame, p: MaxEnt, power: int) -> tuple[DataFrame, DataFrame, Shared, int]:
    """Word blocks, slot-weight blocks, the shared tables and the number of training tokens."""
    train = docs.where(remainder(F.col("doc_id"), p.folds) != p.held)
    blocks = stored(counted(learnt(train, p, power), power), "counts")
    n_slot, v_slot = np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)
    for r in blocks.where(F.col("kind") == WORDS).select("values", "more").toLocalIterator():  # each slot is in one block
        slot, n = np.frombuffer(r["values"], np.int64).reshape(2, -1)
        n_slot[slot], v_slot[slot] = n, np.frombuffer(r["more"], np.int64)
    n_all, v_all = int(n_slot.sum()), int(v_slot.sum())
    of_class = n_slot.reshape(CLASSES, -1).sum(axis=1, keepdims=True)
    base = ((n_slot.reshape(CLASSES, -1) + 1) / (of_class + SLOTS // CLASSES)).ravel()
    width = F.length("keys") / 8
    single, several = blocks.where(F.col("kind") == PAIRS).agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum(width), F.lit(0.0))).first()
    least = max(n_all, 1) / p.hot
    model = stored(trained(blocks, base, single / max(several, 1), least, p, power), "slot-weights")
    pairs, contexts = _spread(model)
    shared = Shared(*averaged(blocks, p), np.log10(n_slot + v_slot + 1.0), np.log(base), _frequent(blocks, least), pairs, contexts, math.log10(n_all + v_all + 1))
    words = blocks.where(F.col("kind") == WORDS).select("kind", "block", "keys", "counts", F.lit(None).cast("binary").alias("values"), F.lit(None).cast("binary").alias("more"))
    return words, model.where("block >= 0"), shared, n_all


def scored(docs: DataFrame, p: MaxEnt = MaxEnt()) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's.  A null or empty text is the end alone.
    A null doc_id counts as the empty text for its fold; repeated rows each count and each give a row; other columns are
    ignored; with no training rows every count is 0; empty input gives an empty result.  Class weights are an average over
    tasks, so scores move a little with how the table is cut into partitions; counts and base scores do not.
    A text that the model learnt from counts among its own statistics and so scores higher than one held out: compare texts of
    one fold only.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0))).first()[0]
    power = max(size // p.text, 1).bit_length()
    words, model, tables, n_all = fitted(docs, p, power)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(tables, f.name) for f in fields(tables)))  # plain arrays: broadcasts are pickled by reference
    by = lambda frame: frame.repartition(3 << power, "kind", "block").groupBy("kind", "block")
    found = by(_lookups(docs, shared, p, power)).cogroup(by(words.unionByName(model))).applyInArrow(_resolved, _FOUND)
    sums = found.groupBy("first").applyInArrow(_summed, _RESULT)
    return sums.select(
        "doc_id", (remainder(F.col("doc_id"), p.folds) == p.held).alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
