"""Layout of a page: columns, paragraphs, header and footer, reading order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespark.functions.boxes import SIDES, Box, overlap_1d
from pagespark.functions.text import concat_ordered
from pagespark.operators.folds import column_lines, paragraph_runs, reading_bands, rows_of
from pagespark.operators.joins import lines_in_paragraph
from pagespark.operators.pages import by_page, group_starts, numbers, spans
from pagespark.operators.suppress import resolve_overlaps
from pagespark.session import written

MARGIN = 15  # pixels between a header and the first line, or a footer and the last
BAND_SHARE = 0.45


def _move_to_band(placed: DataFrame, page: Sequence[str], role: str) -> DataFrame:
    """Lines of the body that share enough rows with the band of ``role`` join it."""
    on_page = Window.partitionBy(*page)
    own = (F.col("role") == role) & ~F.col("moved")
    top, bottom = F.min(F.when(own, F.col("top"))).over(on_page), F.max(F.when(own, F.col("bottom"))).over(on_page)
    banded = placed.withColumn("_top", top).withColumn("_bottom", bottom)
    shared = overlap_1d(F.col("top"), F.col("bottom"), F.col("_top"), F.col("_bottom"))
    level = shared >= F.lit(BAND_SHARE) * (F.col("_bottom") - F.col("_top") + 1)
    moves = (F.col("role") == "body") & F.coalesce(level, F.lit(False))
    return banded.withColumn("_moves", moves).withColumn("role", F.when(F.col("_moves"), role).otherwise(F.col("role"))).withColumn(
        "moved", F.col("moved") | F.col("_moves")).drop("_top", "_bottom", "_moves")


def headers_footers(lines: DataFrame, paragraphs: DataFrame | None, page: Sequence[str], line: str, compat: bool = False,
                    carried: Sequence[str] = ()) -> DataFrame:
    """Lines with their paragraph and role (header, footer, body). A paragraph of a single
    line near the first line's top is a header, near the last one's a footer; with
    ``compat`` any other single line is a footer. Body lines level with a band join it.
    Without ``paragraphs`` they are the page's columns, found and held against the lines in one look at
    the page. Lines move to their page's partition once; all counts and bands are windows there."""
    on_page = Window.partitionBy(*page)
    ended = lines.select(*page, line, *SIDES, *carried, F.min("top").over(on_page).alias("_first"), F.max("top").over(on_page).alias("_last"))
    if paragraphs is None:
        placed = column_lines(ended, page, line, [*carried, "_first", "_last"])
    else:
        inside = lines_in_paragraph(ended, paragraphs.select(*page, "par", *SIDES), page)
        placed = inside.select(*page, line, *SIDES, *carried, "_first", "_last", F.col("o_par").alias("par"), F.col("o_left").alias("par_left"))
    sized = placed.repartition(*page).withColumn("_n", F.count("*").over(Window.partitionBy(*page, "par")))
    single = F.col("_n") == 1
    at_foot = F.lit(True) if compat else F.col("_last") - F.col("top") <= MARGIN
    role = (F.when(single & (F.col("top") - F.col("_first") <= MARGIN), "header")
            .when(single & at_foot, "footer").otherwise("body"))
    marked = sized.withColumn("role", role).withColumn("moved", F.lit(False)).drop("_n", "_first", "_last")
    return _move_to_band(_move_to_band(marked, page, "header"), page, "footer")


def layout_blocks(lines: DataFrame, words: DataFrame, page: Sequence[str], line: str, key: str = "tag",
                  compat: bool = False) -> DataFrame:
    """Blocks of a page in reading order: ``rank``, ``role``, box and text. ``lines`` holds
    boxes and texts, ``words`` boxes and texts with the line they are in."""
    placed = written(headers_footers(lines, None, page, line, compat, ["text"]), "placed")

    body = placed.filter(F.col("role") == "body").select(*page, line, "par", "par_left")
    blocks = body_rows(words, body, page, line, key).groupBy(*page, "par", "par_left").agg(
        *_hull(), concat_ordered([F.col("top"), F.col("new_row")], F.col("text"), "\n").alias("text"))
    ranked = reading_bands(blocks, page, "par", ["par_left", "par"], [*SIDES, "text"])
    main = ranked.select(*page, F.lit("body").alias("role"), "rank", *SIDES, "text")

    edges = placed.filter(F.col("role") != "body").groupBy(*page, "role").agg(*_hull(), concat_ordered(
        [F.col("left"), F.col("moved"), F.col("par_left"), F.col("par"), F.col(line)], F.col("text"), "\n").alias("text"))
    last = F.when(F.col("role") == "footer", F.lit(1 << 40)).otherwise(F.lit((1 << 40) + 1))
    return main.unionByName(edges.select(*page, "role", last.alias("rank"), *SIDES, "text"))


def body_rows(words: DataFrame, body: DataFrame, page: Sequence[str], line: str, key: str) -> DataFrame:
    """Rows of each body paragraph, made anew of its words, with box and text. Words meet the paragraphs of their lines
    and are made rows in one look at their page, so they move once and what moves on is a row."""
    words = words.filter(F.col(line).isNotNull()).select(*page, line, key, *SIDES, "text")
    both = words.withColumn("_word", F.lit(True)).unionByName(
        body.select(*page, line, "par", "par_left").withColumn("_word", F.lit(False)), allowMissingColumns=True)
    group = ["_page", "par", "par_left"]

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        lines, is_word = table[line].to_pylist(), table["_word"].to_numpy()
        pars, lefts = table["par"].to_pylist(), table["par_left"].to_pylist()
        taken, par, par_left = [], [], []
        for start, end in spans(starts, table.num_rows):
            told: dict = {}
            for i in (start + np.flatnonzero(~is_word[start:end])).tolist():
                told.setdefault(lines[i], []).append((pars[i], lefts[i]))
            for i in (start + np.flatnonzero(is_word[start:end])).tolist():
                for p, left in told.get(lines[i], ()):
                    taken.append(i)
                    par.append(p)
                    par_left.append(left)
        page_no = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))[taken]
        placed = table.drop_columns(["par", "par_left", "_word"]).take(pa.array(taken, pa.int64()))
        for name, column in zip(group, (page_no, par, par_left)):
            placed = placed.append_column(name, pa.array(column, pa.int64()))
        placed = placed.take(pc.sort_indices(placed, [(c, "ascending") for c in dict.fromkeys([*group, "left", line, key])]))
        top, bottom = numbers(placed, "top", "bottom")
        row = np.zeros(placed.num_rows, dtype=np.int64)
        begins = group_starts(placed, group)
        for start, end in spans(begins, placed.num_rows):
            row[start:end] = rows_of(top[start:end], bottom[start:end])[0]
        owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, placed.num_rows)))
        order = np.lexsort((row, owner))  # stable: words of a row stay in their order
        placed = placed.append_column("new_row", pa.array(row)).take(pa.array(order))
        firsts = group_starts(placed, [*group, "new_row"])
        texts = placed["text"].to_pylist()
        joined = [" ".join(x for x in texts[a:b] if x is not None) for a, b in spans(firsts, placed.num_rows)]
        out = placed.select([*page, "par", "par_left", "new_row"]).take(pa.array(firsts, pa.int64()))
        for name, hull in zip(SIDES, (np.minimum, np.minimum, np.maximum, np.maximum)):
            (side,) = numbers(placed, name)
            out = out.append_column(name, pa.array(hull.reduceat(side, firsts) if len(firsts) else side))
        return out.append_column("text", pa.array(joined, pa.string()))

    added = ", ".join(["par bigint", "par_left bigint", "new_row bigint", *[f"{s} bigint" for s in SIDES], "text string"])
    return by_page(both, page, page, [], run, added, keep=page)


def _hull() -> list[Column]:
    return [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")]


def extract_layout(lines: DataFrame, words: DataFrame, page: Sequence[str], line: str, key: str = "tag",
                   as_text: bool = True, compat: bool = False) -> DataFrame:
    """Blocks in reading order, or the page text they make: body, footer, header."""
    blocks = layout_blocks(lines, words, page, line, key, compat)
    if not as_text:
        return blocks
    return blocks.groupBy(*page).agg(concat_ordered([F.col("rank")], F.col("text"), "\n").alias("text"))


def label_layout(words: DataFrame, page: Sequence[str], order: str, paragraph: str, compat: bool = False) -> DataFrame:
    """Paragraph boxes of a labelled page: runs in reading order, then freed of overlaps."""
    runs = paragraph_runs(words, page, order, paragraph, list(SIDES))
    kept = resolve_overlaps(runs, page, "run", order, compat)
    return kept.groupBy(*page, "par").agg(*_hull(), F.count("*").alias("words"), F.min(order).alias("first"))
