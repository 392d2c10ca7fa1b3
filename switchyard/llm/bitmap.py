"""Bitmaps of hashes: fixed in size, so safe to broadcast.  They only keep rows out of an exact join that follows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(key: Column, bits: int) -> Column:
    """The bit of a 64-bit hash: its leading ``bits`` bits."""
    return F.shiftrightunsigned(key, 64 - bits)


def bitmap(keys: DataFrame, column: str, bits: int) -> bytes:
    """``2**bits`` bits with those of all ``keys`` set; at most ``2**bits / 32`` rows reach the driver."""
    at = keys.select(place(F.col(column), bits).alias("at"))
    words = at.select(F.shiftright("at", 5).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at % 32 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out, got = np.zeros(2 ** (bits - 5), dtype=np.uint32), words.toArrow()
    out[got["w"].to_numpy()] = got["m"].to_numpy().astype(np.uint32)
    return out.tobytes()


def held(packed: bytes, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` (64-bit hashes) have their bit set."""
    words = np.frombuffer(packed, dtype=np.uint32)
    at = keys.view(np.uint64) >> np.uint64(64 - (len(words).bit_length() + 4))
    return (words[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
