"""Packing documents into token sequences along a space-filling curve.

Method: a document's token counts are hashed into a vector, projected to a few dimensions and given a Hilbert key; documents
are range-sorted by that key and packed one after the other, so neighbours on the curve share sequences.

Scale: texts are tokenized once and the ids written to the shared folder; Spark's range partitioning then samples only keys,
and the number of ranges follows the bytes of ids.
A partition packs its own stretch of the curve and holds at most one open sequence; its remainder is cut into powers of
two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.scratch import stored
from switchyard.llm.text import kept, sliced

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"


@dataclass(frozen=True)
class Packing:
    """``vocabulary``: the tokenizer's file.  Documents end with ``end_id``; vectors have ``buckets`` hashed entries, keys ``dims`` dimensions of ``bits`` bits; ``part``: bytes of ids in one range partition."""

    vocabulary: str
    length: int = 2048
    end_id: int = 1
    buckets: int = 512
    dims: int = 4
    bits: int = 8
    part: int = 32 << 20
    seed: int = 5


def binaries(data: bytes | pa.Buffer, bounds: np.ndarray) -> pa.BinaryArray:
    """The values between successive ``bounds`` of ``data``."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


class Encoder:
    """Token ids of whole texts, as little-endian 16-bit values.

    The tokenizer splits at white space and at the border of letters and other signs before it merges.  So texts are split at
    ASCII white space by Arrow, and only the distinct pieces of a slice that are not known yet are encoded: words of
    ``LETTERS``, which stay single letters when composed and lower-cased, all in one call, with the signs after them apart;
    any other piece by itself.  A text that holds the start of a special token's name is encoded whole; so is every text where
    a vocabulary splits ``PROBES`` otherwise.  At most ``limit`` pieces of up to 64 bytes are remembered, in two Arrow columns.
    """

    LETTERS = r"a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{45F}"
    PIECE = rf"^(?P<word>[{LETTERS}]+)(?P<signs>[!-/:-@\[-`{{-~]*)$"
    PROBES = ("The end. of, \u0130! SAH\u0130B\u0130. b\u00dd\u00e9\u0130| e\u0301. don't 12.5%?", "x\u0130y ab;cd a. .a \u00df! \ufb01? \u03a3\u03a3; a\u0345| \u65e5\u672c. \u01c5!", "\u00c9t\u00e9,### end.*** so' s!' \u039b\u03cc\u03b3\u03bf\u03c2;; \u0414\u0430``,")

    def __init__(self, vocabulary: str, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(vocabulary), limit
        known = self.tokenizer.get_vocab()
        if max(known.values()) >= 2**16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.ends = np.zeros(2**16, dtype=bool)
        for token, i in known.items():
            self.ends[i] = token.endswith("</w>")
        self.pieces, self.ids = pa.array([""], pa.string()), pa.array([b""], pa.binary())
        self.split = True
        self.split = self.encode([x.encode() for x in self.PROBES]) == self.direct(list(self.PROBES))

    def direct(self, some: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def words(self, some: pa.StringArray, step: int = 20_000) -> pa.BinaryArray:
        """Ids of each word, all of ``LETTERS``."""
        out = [pa.array([], pa.binary())]
        for at in range(0, len(some), step):
            part = some.slice(at, step).to_pylist()
            (raw,) = self.direct([" ".join(part)])
            ends = np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u2")]) + 1
            out.append(binaries(raw, np.append(0, ends * 2)) if len(ends) == len(part) else pa.array(self.direct(part), pa.binary()))
        return pa.concat_arrays(out)

    def learn(self, new: pa.StringArray) -> pa.BinaryArray:
        """Ids of each piece."""
        parts = pc.extract_regex(new, self.PIECE)
        plain = parts.is_valid()
        word, signs = (parts.field(k).filter(plain).dictionary_encode() for k in ("word", "signs"))
        after = pa.array(self.direct(signs.dictionary.to_pylist()), pa.binary())
        ids = pc.binary_join_element_wise(self.words(word.dictionary).take(word.indices), after.take(signs.indices), pa.scalar(b"", pa.binary()))
        rest = pa.array(self.direct(new.filter(pc.invert(plain)).to_pylist()), pa.binary())
        there = plain.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([ids, rest]).take(pa.array(np.where(there, np.cumsum(there) - 1, len(ids) + np.cumsum(~there) - 1)))

    def lookup(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """Ids of distinct pieces.  Where they would be too many to remember, only those of this slice are; long ones never are."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).copy()
        new = pieces.filter(pa.array(at < 0))
        if not len(new):
            return self.ids.take(pa.array(at))
        at[at < 0] = np.arange(len(self.pieces), len(self.pieces) + len(new))
        learnt = self.learn(new)
        found = pa.concat_arrays([self.ids, learnt]).take(pa.array(at))
        old, added = (len(self.pieces), (new, learnt)) if len(self.pieces) + len(new) <= self.limit else (0, (pieces, found))
        short = pc.less_equal(pc.binary_length(added[0]), 64)
        self.pieces, self.ids = (pa.concat_arrays([x.slice(0, old), y.filter(short).slice(0, self.limit - old)]) for x, y in zip((self.pieces, self.ids), added, strict=True))
        return found

    def encode_column(self, some: pa.StringArray) -> pa.BinaryArray:
        """Ids of each text; null is the empty text."""
        some = pc.fill_null(some, "")
        whole = pc.match_substring(some, "<|") if self.split else pa.array(np.ones(len(some), dtype=bool))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(whole, "", some)))
        pieces = lists.flatten().dictionary_encode()
        ids = self.lookup(pieces.dictionary).take(pieces.indices)
        sizes = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64))
        out = binaries(ids.buffers()[2] or b"", sizes[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))])
        if pc.any(whole).as_py():
            rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            out = pc.replace_with_mask(out, whole, pa.array(self.direct(some.take(pa.array(rows)).to_pylist()), pa.binary()))
        return out

    def encode(self, some: list[bytes]) -> list[bytes]:
        return self.encode_column(pa.array(some, pa.binary()).cast(pa.string())).to_pylist()


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (n, dims), by the transpose form of the curve (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), np.int64(1 << (bits - 1))
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), np.int64(1 << (bits - 1))
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def tokens(docs: DataFrame, p: Packing) -> DataFrame:
    """doc_id, curve (Hilbert key), n (number of ids), ids (16-bit, without the end id), r (the row's number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rng = kept(("encoder", p.vocabulary), lambda: Encoder(p.vocabulary)), np.random.default_rng(p.seed)
        place, axes = rng.integers(0, p.buckets, 2**16), rng.standard_normal((p.buckets, p.dims)).astype(np.float32)
        r = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, 1, 16 << 20, 5000):
            ids = encoder.encode_column(batch.column(1).cast(pa.string()))
            vectors = np.zeros((len(ids), p.buckets), dtype=np.float32)
            for row, raw in zip(vectors, ids, strict=True):
                row[:] = np.bincount(place[np.frombuffer(raw.as_buffer(), dtype="<u2")], minlength=p.buckets)
            vectors = np.sqrt(vectors)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            cells = np.clip((vectors @ axes) / 4 + 0.5, 0, 1 - 1e-6) * (1 << p.bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert(cells.astype(np.int64), p.bits)), pa.array(pc.binary_length(ids).to_numpy(zero_copy_only=False) // 2, pa.int64()), ids, pa.array(np.arange(r, r + len(ids)))], names=["doc_id", "curve", "n", "ids", "r"])
            r += len(ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, curve long, n long, ids binary, r long")


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve.

    Every id of every row lies in exactly one piece.  A null or empty text is the end id alone.  Repeated rows are packed
    each; a null doc_id stays null.  Other columns are ignored.  Empty input gives no pieces.  Sequences hold ``length``
    ids but for the last few of each partition, whose lengths are smaller powers of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence, fill, open_, rows = TaskContext.get().partitionId() << 33, 0, 0, [], []

        def put(piece: tuple, number: int, offset: int) -> None:
            doc, start, ids, total, curve = piece
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + number, offset, curve))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(8)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in sliced(batches, 2):
            for doc, curve, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.append(np.frombuffer(raw, dtype="<u2"), np.uint16(p.end_id))
                at = 0
                while at < len(ids):
                    take = min(p.length - fill, len(ids) - at)
                    open_.append((doc, at, ids[at : at + take], len(ids), curve))
                    fill, at = fill + take, at + take
                    if fill == p.length:
                        offset = 0
                        for piece in open_:
                            put(piece, sequence, offset)
                            offset += len(piece[2])
                        sequence, fill, open_ = sequence + 1, 0, []
            yield flush()
        while fill:
            room = 1 << (fill.bit_length() - 1)
            fill, offset = fill - room, 0
            while offset < room:
                doc, start, ids, total, curve = open_.pop(0)
                take = min(room - offset, len(ids))
                put((doc, start, ids[:take], total, curve), sequence, offset)
                if take < len(ids):
                    open_.insert(0, (doc, start + take, ids[take:], total, curve))
                offset += take
            sequence += 1
        yield flush()

    encoded = stored(tokens(docs, p), "tokens")
    size = encoded.agg(F.coalesce(F.sum(F.col("n") * 2 + 32), F.lit(0))).first()[0]
    parts = max(-(-size // p.part), docs.sparkSession.sparkContext.defaultParallelism)
    order = ["curve", "doc_id", "r"]  # rows of one id are apart by their number
    return encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "curve", "ids").mapInArrow(run, PIECES)
