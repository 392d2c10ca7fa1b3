"""Statistics of whole texts, from one scan, for the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.text import WordHashes, kept, mixed, texts

SYMBOLS = b"#*$%&<>|"
_CONTINUED = bytes(range(0x80, 0xC0))
_WHITE = b" \t\n\r\x0b\x0c"
_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_ENDS = (b".", b"!", b"?", b'"', b"'", b":", b";")
_MUL = np.uint64(0x9E3779B97F4A7C15)
# Frequent function words of four languages.
STOPWORDS = frozenset(b"the of and to in is was for on with that it by at from de la el que en los las un una del y se les le des et du est pas sur der die und das von zu mit den ist ein eine im".split())
LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_adjacent", "n_upper", "n_letters", "n_digits", "n_pipes", "n_ended", "n_stop", "n_wide", "n_marks", "longest_line"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in LONGS)


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(text: bytes, cache: WordHashes) -> tuple[int, ...]:
    """The values of ``LONGS``.  A word in a window of eight that occurs twice or more counts as repeated, first ones included."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(LONGS)
    hashes = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=n)
    repeated = 0
    if n > 8:
        windows = hashes[: n - 7].copy()
        for k in range(1, 8):
            windows *= _MUL
            windows += hashes[k : n - 7 + k]
        _, inverse, counts = np.unique(mixed(windows), return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[inverse] > 1)
        if len(again):
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, again, 1)
            np.add.at(cover, again + 8, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = _without(text, _UPPER), _without(text, _LOWER)
    wide = len(text) - len(text.decode("utf-8", "replace")) if not text.isascii() else 0
    return (
        n, len(text) - _without(text, _CONTINUED) - _without(text, _WHITE), _without(text, SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
        len(np.unique(hashes)), int((hashes[1:] == hashes[:-1]).sum()), upper, upper + lower + wide, _without(text, _DIGITS), text.count(b"|"),
        sum(x.rstrip().endswith(_ENDS) for x in lines), sum(map(STOPWORDS.__contains__, words)), wide, _without(text, b"!?.,;:"), max(map(len, lines), default=0),
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``LONGS`` for each row; a null text is empty, whose values are all 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept("words", WordHashes)
        for batch in batches:
            rows = np.array([statistics(t, cache) for t in texts(batch.column(1))], dtype=np.int64).reshape(-1, len(LONGS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], names=["doc_id", *LONGS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
