"""What runs leave on disk, and how often rows move."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from pagespark.llm import jaccard as J
from pagespark.session import removed, scratch_root, written


def shuffle_files(spark):
    locals_ = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in locals_ for f in glob.glob(f"{d}/*/shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "few")
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert table.agg(F.sum("n")).first()[0] == 1000 == table.agg(F.sum("n")).first()[0]
    path = table._written_at.removeprefix("file:")
    assert os.path.isdir(path)
    removed(table)
    assert not os.path.exists(path)


def test_lists_of_one_component_are_compared_once(spark, monkeypatch):
    """40 lists of the same ten sets are one group of ten rows; a pair of a list meets in a group, not behind its place."""
    monkeypatch.setattr(J, "LIST_PIECE", 8)
    same = [(t, 1, c, 50, 5 + (t + c) % 30, 1 if c < 7 else c) for t in range(40) for c in range(10)]
    wide = [(100 + t, 2, 1000 + 7 * t + c, 60, t, 1000 + 7 * t + c) for t in range(30) for c in range(8)]
    large = [(500 + t, 3, 5000 + (t * 11 + c) % 200, 60, t, 3) for t in range(60) for c in range(16)]
    rows = same + wide + large
    short = spark.createDataFrame(rows, "token bigint, home bigint, cls bigint, n bigint, pos int, root bigint")
    got = J.joint_lists(short).collect()
    groups = {}
    for r in got:
        assert r["cls"] not in groups.setdefault((r["token"], r["i"], r["j"]), {})
        groups[r["token"], r["i"], r["j"]][r["cls"]] = r["pos"]
    assert sum(1 for r in got if r["cls"] < 1000) == 10 and len(got) < len(rows) - 380
    assert max(map(len, groups.values())) <= 4 * J.LIST_PIECE
    by_token = {}
    for token, _, cls, _, pos, _ in rows:
        by_token.setdefault(token, {})[cls] = pos
    for members in by_token.values():
        assert any(all(c in g and g[c] <= pos for c, pos in members.items()) for g in groups.values())


def test_near_copies_leave_few_tables(spark):
    rows = [(i, " ".join(f"w{(i // 2) * 50 + k}" for k in range(40))) for i in range(20)]
    folder = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = J.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"rows", "lists", "sets", "classes", "placed", "open", "near", "joint", "differences"}
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i // 2 * 2 for i in range(20)}


def test_rows_dealt_out_by_document_are_numbered_where_they_lie(spark):
    from pagespark.operators.order import global_ids
    from pagespark.sources.coco import coco_detection

    rows = [(d, p, k, 10 * k) for d in (3, 1, 2) for p in (1, 0) for k in range(3)] + [(None, 0, 0, 0), (1, None, 5, 1)]
    df = spark.createDataFrame(rows, "doc bigint, page bigint, k bigint, left bigint")
    whole = sorted(r[:3] for r in rows if None not in r[:2])
    want = {key: i + 2 for i, key in enumerate(whole)}  # groups without a whole key count, come first and have no rows
    for given, moved in ((df.repartition(6, "doc"), False), (df, True)):
        ids = global_ids(given, ["doc", "page"], ["k"])
        got = {(r["doc"], r["page"], r["k"]): r["id"] for r in ids.collect()}
        assert got == want
        plan = ids._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == moved
    box = df.select("doc", "page", F.col("k").cast("string").alias("tag"), "left", F.lit(0).alias("top"), F.col("left").alias("right"), F.lit(1).alias("bottom"))
    words = box.withColumn("word", F.lit("w")).repartition(6, "doc")
    pages = spark.createDataFrame([(1, 0, 5, 5), (1, 1, 5, 5), (3, 1, 5, 5), (3, 1, 5, 5)], "doc bigint, page bigint, h bigint, w bigint")  # one is there twice
    images, found = coco_detection(pages, words, box, ["doc", "page"], "tag", F.lit("f"))
    of_image = sorted((r["image_id"], r["category_id"], r["bbox"][0]) for r in found.collect())
    assert of_image == [(i, c, 10 * k) for i in (1, 2, 3, 4) for c in (1, 2) for k in range(3)]


@pytest.mark.parametrize("name", ["s1_read_word_samples", "s2_read_page_samples", "s3_read_layout_samples", "s4_read_light", "s5_list_images"])
def test_sample_files_are_there_a_part_at_a_time(spark, monkeypatch, name):
    import __spark_entry__
    from pagespark.catalog import tables_q

    there = []
    drop = tables_q.remove_folder

    def counted(session, path):
        there.append(sum(len(names) for _, _, names in os.walk(path.removeprefix("file:"))))
        drop(session, path)
        assert not os.path.exists(path.removeprefix("file:"))

    monkeypatch.setattr(tables_q, "remove_folder", counted)
    query = __spark_entry__.queries()[name]
    whole = sorted(map(str, query(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(tables_q, "ROUND_CHARS", 1 << 18)
    parts = sorted(map(str, query(spark, "/root/testdata/sf0.001").collect()))
    assert whole and parts == whole
    assert len(there) > 2 and sum(there[1:]) == there[0] and max(there[1:]) < 0.8 * there[0]


def test_executors_list_what_spark_lists(spark, tmp_path):
    from pagespark.sources.samples import list_files, read_documents

    for name in ("run 1/é/a.png", "run 1/b%c/data.json", "x/detection_data/data.json", "x/_gone/data.json", "x/.y/data.json", "x/k=_1/data.json", "x/empty.png", "_SUCCESS", "top.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if "empty" in name else f'{{"n": "{name}"}}')
    (tmp_path / "none").mkdir()
    for pattern in ("*", "data.json", "*.png"):
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(str(tmp_path))
        want = {(r["p"], r["length"]) for r in plain.select(F.col("_metadata.file_path").alias("p"), "length").collect()}
        listed = list_files(spark, str(tmp_path), pattern)
        assert {tuple(r) for r in listed.collect()} == want and len(want) >= 2
        assert not [f for f in listed.inputFiles() if "data.json" in f]  # the driver holds no names
    documents = read_documents(spark, f"file:{tmp_path}", "detection_data").collect()
    assert [(r["path"], r["value"]) for r in documents] == [(f"file:{tmp_path}/x/detection_data/data.json", '{"n": "x/detection_data/data.json"}')]
