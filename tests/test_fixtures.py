"""The derived tables are the same in Spark and in SQL."""

import pytest

from compare import check, connect
from pagespark.fixtures.sql import CTES, with_tables
from pagespark.fixtures.tables import PAGE, Tables

FOLDER = "/root/testdata/sf0.001"
NAMES = ("words", "page_dims", "detections", "two_col", "fragments", "images", "paragraphs", "lines", "layout_rows", "samples",
         "emoji_samples", "files", "coverage", "source_words", "wide_words", "script_scores", "batches", "page_paths",
         "link_graph", "link_list", "used", "recognised")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    def build(session, folder):
        df = getattr(Tables(session, folder), name)
        for long, short in (("left", "l"), ("top", "t"), ("right", "r"), ("bottom", "b")):
            df = df.withColumnRenamed(long, short)
        return df.drop("page_id") if name == "samples" else df

    assert name in CTES
    assert check(spark, con, FOLDER, name, build, with_tables(f"SELECT * FROM {name}", name))[0] is None


def test_pages_are_bounded(spark):
    assert Tables(spark, FOLDER).words.groupBy(*PAGE).count().agg({"count": "max"}).first()[0] <= 720
