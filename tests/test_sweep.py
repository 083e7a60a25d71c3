"""Areas by plane sweep, and whole groups out of batches, against plain forms."""

from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagespark.operators import aggregates
from pagespark.operators.aggregates import class_pixels, covered_area
from pagespark.operators.pages import by_page

side = st.integers(-3, 30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(side, side, side, side), max_size=25), st.sampled_from([1, 40, aggregates.BAND_CELLS]))
def test_covered_area_equals_a_painted_grid(boxes, cells):
    grid = np.zeros((40, 40), dtype=bool)
    for left, top, right, bottom in boxes:
        grid[max(top + 5, 0):bottom + 6, left + 5:right + 6] |= True
    columns = [np.array([b[i] for b in boxes], dtype=np.int64) for i in range(4)]
    with mock.patch.object(aggregates, "BAND_CELLS", cells):
        assert covered_area(*columns) == grid.sum()


def test_a_tall_box_costs_no_more_than_a_flat_one():
    big = 10**9
    one = [np.array([v]) for v in (0, 0, big - 1, big - 1)]
    assert covered_area(*one) == big * big


def test_class_pixels_keeps_pages_without_boxes(spark):
    pages = spark.createDataFrame([(1, 10, 10), (2, 5, 4), (3, 7, 7)], "page bigint, w bigint, h bigint")
    boxes = spark.createDataFrame([(1, 0, 0, 4, 4), (1, 2, 2, 6, 6), (3, None, 0, 1, 1)],
                                  "page bigint, left bigint, top bigint, right bigint, bottom bigint")
    found = {r["page"]: (r["zeros"], r["ones"]) for r in class_pixels(pages, boxes, ["page"]).collect()}
    assert found == {1: (59, 41), 2: (20, 0), 3: (49, 0)}


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_whole_groups_whatever_the_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        df = spark.range(500).select((F.col("id") * 7919 % 23).alias("page"), F.when(F.col("id") % 9 > 0, F.col("id") % 3).alias("part"), "id")

        def sizes(table, starts):
            n = np.diff(np.append(starts, table.num_rows))
            return table.select(["page", "part"]).take(pa.array(starts)).append_column("n", pa.array(n, pa.int64()))

        got = by_page(df, ["page"], ["page", "part"], ["id"], sizes, "n bigint", keep=["page", "part"])
        want = df.groupBy("page", "part").agg(F.count("*").alias("n"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
