"""Membership filters of a fixed size, so that what is sent to every task never grows with the data.

A filter only says "perhaps" or "surely not"; every user joins what passes exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 15  # bits in one row of bitmap_construct_agg
BITS = 24  # 2 MB


def slots(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap_of(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bits of the leading bits of a 64-bit hash column; 2**bits / 8 bytes however many rows."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    parts = (
        df.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    width = 1 << (BUCKET_BITS - 3)
    for row in parts.collect():  # at most 2**(bits - 15) rows of 4 KB
        at = (row["bucket"] - 1) * width
        out[at:at + width] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return out


def maybe_in(bitmap: np.ndarray, tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    at = slots(tokens, bits)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
