"""Whole-page jobs: from boxes, readings and scores to page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.functions.boxes import SIDES, Box, downscale_factor, scale_box, valid_box
from pagespark.functions.scores import argmax_steps
from pagespark.functions.text import concat_ordered, decode
from pagespark.operators.chunks import merge_texts
from pagespark.operators.joins import assign_first, attach_text, looked_up, pick_text
from pagespark.operators.lines import merge_same_row


def page_text(lines: DataFrame, page: Sequence[str], line: str) -> DataFrame:
    """Lines by vertical centre, one below the other."""
    order = [(F.col("top") + F.col("bottom")) / 2, F.col(line)]
    return lines.groupBy(*page).agg(concat_ordered(order, F.col("text"), "\n").alias("text"))


def assemble_lines(pages: DataFrame, words: DataFrame, texts: DataFrame, scripts: DataFrame | None, page: Sequence[str],
                   line: str, key: str = "tag", limit: int = 2000, only: str | None = None) -> DataFrame:
    """Lines of each page from words found on the downscaled page: boxes scaled back, words
    without extent left out of the text, each word with the reading its script chose. Readings and scripts
    that carry the page meet their words by page and key, so tables dealt out by a part of the page do not move."""
    paged = all(c in table.columns for c in page for table in (texts, scripts) if table is not None)
    own = [*page, key] if paged else [key]
    factors = pages.select(*page, downscale_factor(F.col("scale_w"), F.col("scale_h"), limit).alias("_factor"))
    scaled = looked_up(words, factors, page)
    box = scale_box(Box.of(), F.col("_factor"))
    found = scaled.select(*page, line, key, *box.columns())
    read = attach_text(found.filter(valid_box(Box.of())), pick_text(texts, scripts, own, only), own)
    order = [F.col("left"), F.col(key)]
    return read.groupBy(*page, line).agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        concat_ordered(order, F.col("text"), " ").alias("text"), F.count("*").alias("n_words"))


def assemble_pages(pages: DataFrame, words: DataFrame, texts: DataFrame, scripts: DataFrame | None, page: Sequence[str],
                   line: str, key: str = "tag", limit: int = 2000, only: str | None = None) -> DataFrame:
    """Page texts: words are put together to lines, lines to pages."""
    lines = assemble_lines(pages, words, texts, scripts, page, line, key, limit, only)
    order = [(F.col("top") + F.col("bottom")) / 2, F.col(line)]
    return lines.groupBy(*page).agg(
        F.count("*").alias("n_lines"), F.sum("n_words").alias("n_words"), concat_ordered(order, F.col("text"), "\n").alias("text"))


def decode_wide(windows: DataFrame, key: Sequence[str], charset: str, scores: str = "scores", mode: str = "collapse",
                classes: str | None = None) -> DataFrame:
    """Words read window by window: top class per step (or the given ``classes``), text of the
    classes, windows appended."""
    codes = F.col(classes) if classes else argmax_steps(F.col(scores))
    read = windows.select(*key, "chunk", decode(codes, charset, mode).alias("text"))
    return merge_texts(read, key)


def paragraph_text(lines: DataFrame, paragraphs: DataFrame, page: Sequence[str], line: str = "line_id", order: str = "par",
                   share: float = 0.8, same_row: float = 0.8) -> DataFrame:
    """Page text by given paragraphs: their lines joined row by row, then paragraph by
    paragraph, then the lines no paragraph took."""
    placed = assign_first(lines.select(*page, line, *SIDES, "text"), paragraphs, page, [*page, line], order, share)
    merged = merge_same_row(placed.filter(F.col(order).isNotNull()), [*page, order], line, same_row)
    told = merged.groupBy(*page, order).agg(concat_ordered([F.col("top"), F.col("row_group")], F.col("text"), " ").alias("text"))
    ordered = told.select(*page, F.lit(0).alias("_kind"), F.col(order).cast("bigint").alias("_at"), "text").unionByName(
        placed.filter(F.col(order).isNull()).select(*page, F.lit(1).alias("_kind"), F.col(line).cast("bigint").alias("_at"), "text"))
    return ordered.groupBy(*page).agg(concat_ordered([F.col("_kind"), F.col("_at")], F.col("text"), "\n").alias("text"))
