"""Cutting wide words in windows and putting their results together again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.functions.boxes import needs_split
from pagespark.functions.text import concat_ordered


def split_windows(df: DataFrame, width: Column, height: Column, window: int = 150, overlap: int = 0,
                  **rule) -> DataFrame:
    """One row per window (``chunk``, ``from_x``, ``to_x``); the last window is clipped,
    and a word that needs no split is one window."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and less than the window")
    step = window - overlap
    cut = needs_split(width, height, **rule)
    last = F.floor((width - 1) / step).cast("bigint")
    chunks = F.when(cut, F.sequence(F.lit(0).cast("bigint"), last)).otherwise(F.array(F.lit(0).cast("bigint")))
    start = F.col("chunk") * step
    return (
        df.withColumn("chunk", F.explode(chunks)).withColumn("from_x", start)
        .withColumn("to_x", F.when(cut, F.least(start + window - 1, width - 1)).otherwise(width - 1))
    )


def merge_texts(results: DataFrame, key: Sequence[str], chunk: str = "chunk", text: str = "text") -> DataFrame:
    """Texts of a word's windows, appended in window order."""
    return results.groupBy(*key).agg(concat_ordered([F.col(chunk)], F.col(text), "").alias(text))


def merge_scores(results: DataFrame, key: Sequence[str], name: str = "script", score: str = "score") -> DataFrame:
    """Sum of each score over a word's windows."""
    return results.groupBy(*key, name).agg(F.sum(score).alias(score))


MERGE_METHODS = {"append_text": merge_texts, "scores_sum": merge_scores}


def merge_chunks(results: DataFrame, key: Sequence[str], how: str, **args) -> DataFrame:
    if how not in MERGE_METHODS:
        raise ValueError(f"unknown merge method: {how}")
    return MERGE_METHODS[how](results, key, **args)
