"""Words of a document are dealt out once and then stay: what is keyed by document moves nothing again."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagespark.catalog.tables_q import layout_documents, page_documents, page_images
from pagespark.fixtures.tables import Tables, spread
from pagespark.operators.joins import looked_up
from pagespark.operators.lines import chain_heads

FOLDER = "/root/testdata/sf0.001"


def moved(df):
    """Exchanges of a plan other than the one that deals documents out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in re.findall(r"Exchange (.*)", plan) if "REPARTITION_BY_NUM" not in line]


@pytest.mark.parametrize("name", ["j9_merge_chunks", "p15_assemble_pages", "j11_pick_text", "p12_merge_fragments", "j8_recognition_samples", "p16_decode_wide"])
def test_words_stay_with_their_document(spark, name):
    assert moved(entry.queries()[name](spark, FOLDER)) == []


@pytest.fixture
def tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to send
    yield Tables(spark, FOLDER)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_page_documents_are_built_where_their_words_are(tables):
    assert moved(page_documents(tables)) == [] and moved(page_images(tables)) == [] and moved(layout_documents(tables)) == []


def test_partitions_grow_with_the_documents(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert spread(docs, "doc_id").rdd.getNumPartitions() == least
    assert spread(docs, "doc_id", per_part=20).rdd.getNumPartitions() == 50
    assert spread(docs, "doc_id", per_part=20).agg(F.count_distinct("doc_id")).first()[0] == 1000


@pytest.mark.parametrize("how, want", [("inner", [(1, "a", "x"), (1, "a", "x"), (2, "b", None)]),
                                       ("left", [(1, "a", "x"), (1, "a", "x"), (2, "b", None), (3, "c", None), (None, "d", None)])])
def test_lookup_is_a_join_by_key(spark, how, want):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (None, "d")], "id bigint, word string")
    known = spark.createDataFrame([(1, "x"), (2, None), (4, "y"), (None, "z")], "id bigint, text string")
    found = looked_up(rows, known, ["id"], how)
    assert found.columns == ["id", "word", "text"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64])
def test_chains_of_a_page_have_one_head(spark, n):
    edges = spark.createDataFrame([(p, i, i + 1) for p in (1, 2) for i in range(n)], "page bigint, a bigint, b bigint")
    found = {(r["page"], r["node"]): (r["head"], r["steps"]) for r in chain_heads(edges, ["page"], "a", "b").collect()}
    assert found == {(p, i): (0, i) for p in (1, 2) for i in range(1, n + 1)}


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_a_cycle_of_pieces_raises(spark, n):
    edges = spark.createDataFrame([(1, i, (i + 1) % n) for i in range(n)], "page bigint, a bigint, b bigint")
    with pytest.raises(Exception, match="cycle"):
        chain_heads(edges, ["page"], "a", "b").collect()


def test_score_rows_are_a_constant(spark):
    """No step's scores are put together row by row; the character set is that of all words."""
    t = Tables(spark, FOLDER)
    plan = t.char_scores.select("tag", "scores")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_repeat(") == 1  # the steps of a character, not its scores
    words = t.words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    assert t.charset == "".join(sorted(r["c"] for r in words))


@pytest.mark.parametrize("name", ["j13_script_labels", "j15_split_by_key"])
def test_samples_do_not_move(spark, tables, name):
    """Addresses are joined to documents, before the words of a document are rows."""
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate")]


def work(spark, name):
    """(exchanges apart from dealing documents out, folds over arrays, joins) of a query's plan."""
    done = entry.queries()[name](spark, FOLDER)
    plan = done._jdf.queryExecution()
    return len(moved(done)), plan.optimizedPlan().toString().count("aggregate("), plan.executedPlan().toString().count("Join ")


@pytest.mark.parametrize("name", ["p4_suppress", "p4_suppress_doubles"])
def test_boxes_of_a_page_are_paired_where_they_are(spark, tables, name):
    """Only a row a page moves; the one fold sets words in rows."""
    assert work(spark, name) == (1, 1, 0)


def test_boxes_without_a_page_or_a_key_stay(spark):
    from pagespark.operators.suppress import suppress_overlaps
    rows = [(1, "a", 0), (1, "b", 0), (None, "c", 0), (None, "d", 0), (2, None, 0), (2, "e", 0), (3, "f", None)]
    boxes = spark.createDataFrame(rows, "page bigint, tag string, left bigint").selectExpr(
        "*", "0L AS top", "9L AS right", "9L AS bottom")
    left = suppress_overlaps(boxes, ["page"], "tag")
    assert left.columns == boxes.columns
    assert sorted((r["tag"] or "") for r in left.collect()) == ["", "b", "c", "d", "e", "f"]


@pytest.mark.parametrize("name, moves", [("p2_split_sublines", 2), ("p2_split_sublines_loose", 1), ("p3_absorb_lines", 2),
                                         ("w4_paragraph_runs", 1), ("p14_label_layout", 2)])
def test_lines_and_runs_are_no_folds_over_arrays(spark, tables, name, moves):
    """The one fold sets words in rows."""
    assert work(spark, name) == (moves, 1, 0)


@pytest.mark.parametrize("name, moves, folds", [("p6_paragraph_boxes", 0, 1), ("p7_headers_footers", 1, 1), ("p7_headers_footers_compat", 1, 1),
                                                ("p10_extract_layout", 5, 2), ("p10_layout_blocks", 4, 2)])
def test_layout_looks_at_lines_once(spark, tables, name, moves, folds):
    """Folds: words set in rows, and bands of a page's blocks."""
    assert work(spark, name) == (moves, folds, 0)


def test_word_samples_meet_their_page_where_they_are(tables):
    from pagespark.catalog.tables_q import paged_samples, word_documents
    for df in (paged_samples(tables), word_documents(tables)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[:plan.index("Generate")] and "Join " not in plan[:plan.index("Generate")]


def test_an_image_tree_looks_at_the_words_once(tables):
    from pagespark.catalog.tables_q import image_tree
    plan = image_tree(tables)._jdf.queryExecution()
    assert moved(image_tree(tables)) == [] and plan.optimizedPlan().toString().count("aggregate(") == 1


def test_shards_are_written_from_written_rows(tables, monkeypatch):
    """Neither version of the shards joins samples and places again."""
    from pagespark.catalog import tables_q
    rows = []
    monkeypatch.setattr(tables_q.shards, "write_shards", lambda df, path: rows.append(df))
    monkeypatch.setattr(tables_q.shards, "read_shards", lambda *a: None)
    tables_q.s12_written(tables)
    assert len(rows) == 2 and all(moved(df) == [] and "Scan parquet" in df._jdf.queryExecution().executedPlan().toString() for df in rows)


@pytest.mark.parametrize("name", ["a5_script_counts", "j13_script_labels"])
def test_views_of_one_table_look_at_it_once(spark, tables, name):
    assert work(spark, name)[1] == 1


def test_labels_of_filters_are_labels_of_views(spark):
    from pagespark.operators.joins import script_labels, script_labels_of
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "z"), (None, "x"), ("d", None)], "file string, text string")
    keep = {"one": F.col("text").isin("x", "y"), "two": F.col("text") == "x", "none": F.col("text") == "q"}
    got = script_labels_of(rows, keep, "file")
    want = script_labels({n: rows.filter(k) for n, k in keep.items()}, "file")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_each_augmentation_is_drawn_once(spark):
    from pagespark.catalog.tables_q import AUGMENT
    plan = entry.queries()["n6_plan_augmentations"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == len(AUGMENT)
