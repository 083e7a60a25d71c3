"""Functions on score arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_steps(scores: Column) -> Column:
    """Per step of an array<array<double>>, the first class with the top score."""
    return F.transform(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("bigint"))


def argmax_first(scores: Sequence[tuple[str, Column]]) -> Column:
    """Name of the top score; the first in the given order wins a tie."""
    top = F.greatest(*(c for _, c in scores)) if len(scores) > 1 else scores[0][1]
    choice = F.lit(None).cast("string")
    for name, column in reversed(scores):
        choice = F.when(column == top, F.lit(name)).otherwise(choice)
    return choice


def first_by_priority(flags: Sequence[tuple[str, Column]]) -> Column:
    """First name in priority order whose flag is positive; null when none is."""
    return F.coalesce(*(F.when(column > 0, F.lit(name)) for name, column in flags))


def linear_score(vector: Column, weights: Column, bias: Column) -> Column:
    """Sigmoid of a dot product."""
    dot = F.aggregate(F.zip_with(vector, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return 1.0 / (1.0 + F.exp(-(dot + bias)))


def contrast_stretch_array(values: Column) -> Column:
    """Spread one channel's values over 0..255; a range under 1 counts as 1."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: (v - low) / F.greatest(high - low, F.lit(1.0)) * 255.0)
