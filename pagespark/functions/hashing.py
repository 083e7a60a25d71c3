"""Deterministic draws: a value depends on seed and key only, never on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 4294967296  # 2**32: eight hex digits of the digest


def hash_int(*parts: Column | str) -> Column:
    """First eight hex digits of md5 over the parts joined by ``|``, as BIGINT."""
    key = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts: Column | str) -> Column:
    """The same digest as a double in [0, 1)."""
    return hash_int(*parts) / F.lit(float(HASH_SPAN))


def hash_pick(size: Column | int, *parts: Column | str) -> Column:
    """A BIGINT in [0, size)."""
    n = F.lit(size) if isinstance(size, int) else size
    return (hash_int(*parts) % n).cast("bigint")
