"""Bounded samples of labelled rows, chosen by hash, so that the choice is uniform and repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column) -> Column:
    """crc32 of the key as text, mod 4; a missing key counts as empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4


def held_out(key: Column) -> Column:
    return fold(key) == 2


def bounded_sample(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """At most ``rows`` rows: those whose hashed doc_id is least."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return df.withColumn("_draw", draw).orderBy("_draw", "doc_id").limit(rows).drop("_draw")
