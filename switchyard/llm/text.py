"""Word and shingle helpers that run inside tasks, on Arrow batches.

A word is a run of bytes other than ASCII space and 0x09-0x0D, which is what ``bytes.split()`` yields; ``bytes.lower()``
lower-cases A-Z alone.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class WordHashes(dict):
    """64-bit hashes by word.  Bounded: forgets everything once it holds ``limit`` words; long words are never kept."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """A bounded lookup table or the like that a worker process keeps from task to task, made on first use."""
    store = sys.__dict__.setdefault("_switchyard_kept", {})
    if key not in store:
        store.clear()  # one operator's table at a time
        store[key] = make()
    return store[key]


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``size`` bytes of a string or binary column (or one row) and at most ``rows`` rows."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(lengths):
            ends = np.cumsum(lengths[at : at + rows])
            take = max(1, int(np.searchsorted(ends, size, side="right")))
            yield batch.slice(at, take)
            at += take


def word_hashes(text: bytes, cache: WordHashes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _HALF)) * _MIX
    return values ^ (values >> _HALF)


def shingles(text: bytes, cache: WordHashes, width: int = 5) -> np.ndarray:
    """Hashes of all word shingles in order.  Fewer words than ``width``: the whole sequence is the one shingle."""
    hashes = word_hashes(text, cache)
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(width, n)
    out = hashes[: n - size + 1].copy()
    for k in range(1, size):
        out *= _MUL
        out += hashes[k : n - size + 1 + k]
    return mixed(out + np.uint64(size))


def shingle_set(text: bytes, cache: WordHashes, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingles(text, cache, width))


def binary_rows(column: pa.Array | pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    """A binary column whose values all have one length, as a matrix."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=dtype).reshape(-1, width)
