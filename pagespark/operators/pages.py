"""Arrow functions over whole pages, for choices that depend on earlier choices.

Spark sees to it that a page's rows lie in one partition, sorted; the function then sees
many whole pages at a time as numpy columns, so no page costs a call of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_starts(table: pa.Table, group: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new group begins; rows are sorted by group."""
    if table.num_rows == 0:
        return np.zeros(0, dtype=np.int64)
    changed = np.zeros(table.num_rows - 1, dtype=bool)
    for name in group:
        column = table[name].combine_chunks()
        after, before = column[1:], column[:-1]
        differ = pc.fill_null(pc.not_equal(after, before), False).to_numpy(zero_copy_only=False)
        nulls = pc.not_equal(pc.is_null(after), pc.is_null(before)).to_numpy(zero_copy_only=False)  # null equals null
        changed |= differ | nulls
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def spans(starts: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    ends = np.append(starts, rows).tolist()
    return zip(ends, ends[1:])


def by_page(df: DataFrame, page: Sequence[str], group: Sequence[str], order: Sequence[str],
            run: Callable[[pa.Table, np.ndarray], pa.Table], added: str = "", keep: Sequence[str] | None = None) -> DataFrame:
    """``run(table, starts)`` on tables of whole groups, sorted by group and order. It gives
    back a table of the kept columns and the ``added`` ones (a DDL list). ``group`` begins
    with the page, or with columns that tell pages apart. Rows are placed by a window over the page, so
    those that were dealt out by a part of the page's key already do not move."""
    kept = list(keep if keep is not None else df.columns)
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{c} {kind[c]}" for c in kept] + ([added] if added else []))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []  # one group's rows so far
        for batch in batches:
            if batch.num_rows == 0:
                continue
            before = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 0)
            last = int(group_starts(pa.Table.from_batches([before, batch]), group)[-1]) - before.num_rows
            if last >= 0 and (held or last):
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(max(last, 0)))
        if held:
            yield pa.Table.from_batches(held)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            yield from run(table.drop_columns(["_nth"]), group_starts(table, group)).to_batches()

    inside = [*[c for c in group if c not in page], *order] or list(page)
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*page).orderBy(*inside))).mapInArrow(mapped, schema)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]
