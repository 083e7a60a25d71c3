"""Every registered query runs; those with a SQL twin equal it."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import check, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)


def test_entry_has_a_stable_schema(spark):
    assert entry(spark).columns == ["doc_id", "page_no", "n_lines", "n_words", "text"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows = check(spark, con, FOLDER, name, QUERIES[name], TWINS.get(name))
    assert problem is None
    assert rows > 0
