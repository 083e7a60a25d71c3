"""Aggregations over boxes, samples, losses and readings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.functions.boxes import SIDES
from pagespark.functions.text import concat_ordered
from pagespark.operators.joins import GROWING
from pagespark.operators.pages import by_page, numbers, spans


def envelope(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Smallest box around the boxes of each group."""
    return df.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"),
                                 F.max("right").alias("right"), F.max("bottom").alias("bottom"), *more)


def concat_text(df: DataFrame, keys: Sequence[str], order: Sequence[str], separator: str, text: str = "text",
                *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(concat_ordered([F.col(c) for c in order], F.col(text), separator).alias(text), *more)


BAND_CELLS = 1 << 18  # cover counts held at once


def covered_area(left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray) -> int:
    """Pixels in at least one of some boxes. A line sweeps down over the distinct tops and
    bottoms and holds, for each interval between neighbouring box sides, how many boxes
    cover it. Many stops are counted at once as a band; the last counts of a band are the
    first of the next."""
    real = (left <= right) & (top <= bottom)
    left, top, right, bottom = left[real], top[real], right[real] + 1, bottom[real] + 1
    sides, stops = np.unique(np.concatenate((left, right))), np.unique(np.concatenate((top, bottom)))
    if not len(sides):
        return 0
    a, b = np.searchsorted(sides, left), np.searchsorted(sides, right)
    i, j = np.searchsorted(stops, top), np.searchsorted(stops, bottom)
    n, widths, heights = len(sides), np.diff(sides).astype(np.float64), np.diff(stops)
    at, side = np.concatenate((i, i, j, j)), np.concatenate((a, b, a, b))  # a box begins at its top and ends at its bottom
    change = np.repeat(np.array([1, -1, -1, 1]), len(left))
    order = np.argsort(at, kind="stable")
    at, side, change = at[order], side[order], change[order]
    held = np.zeros(n, dtype=np.int32)
    area, step = 0, max(BAND_CELLS // n, 1)
    for first in range(0, len(heights), step):
        rows = min(step, len(heights) - first)
        p, q = np.searchsorted(at, (first, first + rows))
        counts = np.bincount((at[p:q] - first) * n + side[p:q], change[p:q], minlength=rows * n).astype(np.int32).reshape(rows, n)
        counts[0] += held
        np.cumsum(counts, axis=0, out=counts)
        held = counts[-1].copy()
        lengths = (np.cumsum(counts, axis=1)[:, :-1] > 0) @ widths
        area += int(lengths.astype(np.int64).dot(heights[first:first + rows]))
    return area


def class_pixels(pages: DataFrame, boxes: DataFrame, page: Sequence[str], width: str = "w", height: str = "h") -> DataFrame:
    """Pixels of each page outside (``zeros``) and inside (``ones``) its boxes, overlaps
    counted once. Boxes move to their page's partition once and are swept there."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        columns = numbers(table, *SIDES)
        areas = [covered_area(*(c[a:b] for c in columns)) for a, b in spans(starts, table.num_rows)]
        return table.select(list(page)).take(pa.array(starts)).append_column("ones", pa.array(areas, pa.int64()))

    known = boxes.select(*page, *[F.col(c).cast("bigint").alias(c) for c in SIDES]).na.drop(subset=list(SIDES))
    covered = by_page(known, page, page, [], run, "ones bigint", keep=page)
    ones = F.coalesce("ones", F.lit(0)).cast("bigint")
    return pages.join(covered.hint(GROWING), list(page), "left").select(
        *page, (F.col(width) * F.col(height) - ones).alias("zeros"), ones.alias("ones"))


def class_balance(pixels: DataFrame, light: bool = False) -> DataFrame:
    """Sum over pages of each class's share of the page; ``light`` sums raw counts."""
    if light:
        return pixels.agg(F.sum("zeros").alias("class_0"), F.sum("ones").alias("class_1"))
    whole = F.col("zeros") + F.col("ones")
    return pixels.agg(F.sum(F.col("zeros") / whole).alias("class_0"), F.sum(F.col("ones") / whole).alias("class_1"))


def class_weights(balance: DataFrame, uniform: bool = False) -> DataFrame:
    """One less each class's relative frequency, or the same weight for both."""
    if uniform:
        return balance.select(F.lit(0.5).alias("weight_0"), F.lit(0.5).alias("weight_1"))
    whole = F.col("class_0") + F.col("class_1")
    return balance.select((1 - F.col("class_0") / whole).alias("weight_0"), (1 - F.col("class_1") / whole).alias("weight_1"))


def script_counts(labels: DataFrame, split: str, languages: Sequence[str]) -> DataFrame:
    """Samples per split and script."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("script"), F.col(n).alias("is")) for n in languages]))
    rows = labels.select(split, pairs.alias("p"))
    return rows.groupBy(split, F.col("p.script").alias("script")).agg(F.sum("p.is").cast("bigint").alias("samples"))


def corpus_weights(texts: DataFrame, corpus: str) -> DataFrame:
    """Share of all paragraphs each corpus holds."""
    counts = texts.groupBy(corpus).agg(F.count("*").alias("paragraphs"))
    whole = texts.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("weight", F.col("paragraphs") / whole)


def url_usage(df: DataFrame, url: str = "url") -> DataFrame:
    """Distinct addresses with how often each is used."""
    return df.groupBy(url).agg(F.count("*").alias("uses"))


def failure_report(files: DataFrame, sample: str = "sample") -> DataFrame:
    """Counts of files, empty files, samples and samples with an empty file."""
    per_sample = files.groupBy(sample).agg(F.count("*").alias("files"), F.count_if(F.col("length") == 0).alias("empty"))
    return per_sample.agg(
        F.sum("files").alias("files"), F.sum("empty").alias("empty_files"), F.count("*").alias("samples"),
        F.count_if(F.col("empty") > 0).alias("failed_samples"))


def view_sizes(views: DataFrame, name: str) -> DataFrame:
    return views.groupBy(name).agg(F.count("*").alias("size"))


def epoch_loss(batches: DataFrame, by: str = "samples") -> DataFrame:
    """Loss of an epoch: batch losses over samples, or over batches."""
    if by not in ("samples", "batches"):
        raise ValueError("by is 'samples' or 'batches'")
    per = F.sum("n") if by == "samples" else F.count("*")
    return batches.groupBy("run", "epoch").agg((F.sum("loss") / per).alias("loss"))


def compare_runs(runs: DataFrame) -> DataFrame:
    """Duration, parameter count and best loss side by side, one row per run."""
    return runs.groupBy("run").agg(
        F.max("duration").alias("duration"), F.max("num_parameters").alias("num_parameters"),
        F.min("val_loss").alias("best_val_loss"))


def compare_scores(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Model by metric table of each test set."""
    return scores.groupBy("test_set", "model").pivot("metric", list(metrics)).agg(F.first("value"))


def tall_words(words: DataFrame, line: Sequence[str], k: float = 1.75) -> DataFrame:
    """Words higher than ``k`` times the median height of their line."""
    height = F.col("bottom") - F.col("top") + 1
    usual = words.groupBy(*line).agg(F.median(height).alias("_usual"))
    return words.join(usual.hint(GROWING), list(line)).filter(height > k * F.col("_usual")).drop("_usual")


def words_per_page(words: DataFrame, page: Sequence[str]) -> DataFrame:
    return words.groupBy(*page).agg(F.count("*").alias("num_words"))


def recognition_scores(pairs: DataFrame, keys: Sequence[str], target: str = "target", predicted: str = "predicted") -> DataFrame:
    """Share of exact readings and character error rate, null where all targets are empty."""
    errors = F.sum(F.levenshtein(target, predicted))
    return pairs.groupBy(*keys).agg(
        F.avg((F.col(target) == F.col(predicted)).cast("double")).alias("exact"),
        F.try_divide(errors, F.sum(F.length(target))).alias("cer"))
