"""Hand cases for box geometry, text, ids, splits, sources and charsets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagespark.functions import boxes as B
from pagespark.functions.boxes import Box
from pagespark.functions.text import Language, build_language, decode, encode, normalize
from pagespark.operators import graph, html, order as O, sampling as N, splits as S
from pagespark.operators.html import html_nodes, paragraph_of
from pagespark.operators.joins import box_join
from pagespark.session import scratch_path, scratch_root
from pagespark.sources import coco, samples as SRC, shards

BOX = "left bigint, top bigint, right bigint, bottom bigint"


def pair(spark, a, b):
    row = dict(zip([*B.SIDES, *("o_" + s for s in B.SIDES)], [*a, *b]))
    return spark.createDataFrame([row])


@pytest.mark.parametrize("a, b, v, h, common", [
    ((0, 0, 9, 9), (0, 0, 9, 9), 1.0, 1.0, 100),
    ((0, 0, 9, 9), (10, 0, 19, 9), 1.0, 0.0, 0),  # touching is not overlapping
    ((0, 0, 9, 9), (9, 9, 18, 18), 1 / 19, 1 / 19, 1),
    ((0, 0, 9, 9), (50, 5, 59, 14), 5 / 15, 0.0, 0),
])
def test_overlaps(spark, a, b, v, h, common):
    x, y = Box.of(), Box.of("o_")
    row = pair(spark, a, b).select(B.v_iou(x, y), B.h_iou(x, y), B.inter_area(x, y), B.v_iou(y, x), B.iou(x, y)).first()
    assert row[0] == pytest.approx(v) and row[1] == pytest.approx(h) and row[2] == common
    assert row[3] == row[0] and 0 <= row[4] <= 1


def test_disjoint_union_is_sum_of_lengths(spark):
    x = spark.range(1).select(B.union_1d(F.lit(0), F.lit(4), F.lit(10), F.lit(11))).first()[0]
    assert x == 7


@pytest.mark.parametrize("w, h, factor", [(1999, 10, 1), (2000, 10, 2), (3999, 1, 2), (4000, 1, 4), (10, 15999, 8), (16000, 3, 16)])
def test_downscale(spark, w, h, factor):
    assert spark.range(1).select(B.downscale_factor(F.lit(w), F.lit(h), 2000)).first()[0] == factor


@pytest.mark.parametrize("value, depth, side", [(1, 6, 64), (64, 6, 64), (65, 6, 96), (97, 6, 128), (5, 1, 5), (1, 1, 2)])
def test_pyramid(spark, value, depth, side):
    assert spark.range(1).select(B.pyramid_side(F.lit(value), depth)).first()[0] == side


def test_tiles_change_nothing(spark):
    import models as M
    rows = [(p, k, *b) for p in (1, 2) for k, b in M.random_boxes(p, 60)]
    df = spark.createDataFrame(rows, "page bigint, tag string, " + BOX)
    sets = []
    for tile in (None, (512, 48), (7, 11), (64, 64)):
        pairs = box_join(df, df, ["page"], F.col("tag") < F.col("o_tag"), tile).select("page", "tag", "o_tag").collect()
        assert len(pairs) == len(set(pairs))
        sets.append(set(pairs))
    want = {(p, a, b) for p in (1, 2) for a, x in M.random_boxes(p, 60) for b, y in M.random_boxes(p, 60) if a < b and M.shared(x, y)}
    assert all({tuple(r) for r in s} == want for s in sets)


def test_language(spark):
    lang = build_language("x", "abc", {"a": ["á", "à"], "d": ["ð"]})
    assert set(lang.accepting_charset) == set("abcdáàð")
    assert Language.from_json(lang.to_json()) == lang
    row = spark.range(1).select(normalize(F.lit("áxðb"), lang.mapping), normalize(F.lit("ßa"), {"ss": ["ß"]})).first()
    assert tuple(row) == ("axdb", "ssa")


def test_codes(spark):
    df = spark.createDataFrame([("hello",), ("",)], "w string")
    rows = df.select(encode(F.col("w"), "helo", 6).alias("c")).select(
        "c", decode(F.col("c"), "helo").alias("p"), decode(F.col("c"), "helo", "collapse").alias("k")).collect()
    assert rows[0].c == [0, 1, 2, 2, 3, 4] and rows[0].p == "hello" and rows[0].k == "helo"
    assert rows[1].c == [4] * 6 and rows[1].p == ""


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ids_are_dense_and_ordered(spark, parts):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g")).repartition(parts)
    assert all(r.x == r.id for r in O.numbered(df, ["x"]).collect())
    groups = {}
    for r in O.numbered_in(df, ["g"], ["x"]).collect():
        groups.setdefault(r.g, []).append((r.x, r.pos))
    assert all([p for _, p in sorted(v)] == list(range(len(v))) for v in groups.values())
    want = {g: {} for g in groups}
    for r in O.running_best(df, ["g"], ["x"], "x", "max").collect():
        want[r.g][r.x] = r.best
    assert all(best == x for rows in want.values() for x, best in rows.items())
    totals = O.running_total(df.withColumn("v", F.lit(2)), ["x"], "v").collect()
    assert all(r.before == 2 * r.x for r in totals)


def test_exact_split_is_exact(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    split = {r.k: r.split for r in S.exact_split(df, "k", 0.8).collect()}
    assert len(split) == 1003 and sum(s == "train" for s in split.values()) == 802
    assert split == {r.k: r.split for r in S.exact_split(df.repartition(5), "k", 0.8).collect()}


def test_dropping_one_by_one_gives_the_closed_form(spark):
    weights = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    left = dict(weights)
    for name in ("b", "a"):
        freed = left.pop(name)
        left = {k: v + freed / len(left) for k, v in left.items()}
    df = spark.createDataFrame(list(weights.items()), "item string, weight double")
    got = {r.item: r.weight for r in N.drop_and_share(df, F.col("item").isin("a", "b")).collect()}
    assert got == pytest.approx(left)


def test_crawl_depths(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (3, 4)], "src bigint, dst bigint")
    got = {r.page_id: r.depth for r in graph.crawl_frontier(df, 0, depth=2, breadth=5).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}


def test_dictionary_compat(spark):
    df = spark.createDataFrame([("s", 0, "ab\n"), ("s", 1, "a!"), ("s", 2, "ba"), ("s", 3, "")], "source string, pos bigint, word string")
    lang = build_language("x", "ab")
    words = lambda d: sorted(r.word for r in d.collect())
    assert words(N.load_dictionary(df, lang)) == ["ab", "ba"]
    assert words(N.load_dictionary(df, lang, compat=True)) == ["ab"]
    assert words(N.load_dictionary(df, None)) == ["a!", "ab", "ba"] and words(N.load_dictionary(df, None, compat=True)) == []


def make(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(content)


def test_sample_folders(spark, tmp_path):
    root = str(tmp_path)
    words = {"0.png": {"text": "hé", "image_size": [14, 40], "mask_file": "0_mask.png", "rotated": False, "direction": "ltr"},
             "1.png": {"text": "gone", "image_size": [14, 40], "rotated": None, "direction": "ltr"}}
    make(root, "run/5/recognition_data/data.json", json.dumps(words))
    for name in ("0.png", "0_mask.png"):
        make(root, f"run/5/recognition_data/{name}", "x")
    make(root, "run/6/recognition_data/data.json", "{broken")
    page = {"tags_to_text": {"a": "x", "b": "y"}, "tags_to_bounding_boxes_text": {"a": dict(left=1, top=2, right=3, bottom=4)},
            "image_size": [1080, 1920], "num_pixels_each_class": [10, 5], "url": "u", "background_changed": True, "perspective": None}
    make(root, "run/7/detection_data/data.json", json.dumps(page))
    make(root, "run/7/detection_data/image.jpg", "x")
    layout = {"paragraphs": [[dict(left=0, top=0, right=9, bottom=9), [["t", dict(left=1, top=1, right=2, bottom=2), "w"]]]]}
    make(root, "run/7/layout_data/data.json", json.dumps(layout))

    got = SRC.read_word_samples(spark, root).collect()
    assert [(r.file, r.text, r.h, r.w, r.rotated) for r in got] == [("0.png", "hé", 14, 40, False)]
    pages = SRC.read_page_samples(spark, root, ["run"])
    row = pages.first()
    assert (row.num_words, row.h, row.w, row.url, row.zeros, row.ones) == (2, 1080, 1920, "u", 10, 5) and row.image.endswith("image.jpg")
    assert [tuple(r)[1:] for r in SRC.page_boxes(pages, "tags_to_bounding_boxes_text").collect()] == [("a", "x", 1, 2, 3, 4)]
    word = SRC.read_layout_samples(spark, root).first()
    assert (word.paragraph, word.right, word.tag, word.word_box.left, word.text) == (0, 9, "t", 1, "w")
    light, images = SRC.read_light(spark, root)
    assert light.first().url == "u" and [os.path.basename(r.path) for r in images.collect()] == ["0.png"]
    assert SRC.list_images(spark, root).count() == 3


def test_exports(spark, tmp_path):
    path = str(tmp_path)
    lines = spark.createDataFrame([(i, f"line {i}\n") for i in range(10)], "n bigint, text string")
    sharded = shards.shard_corpus(lines, ["n"], parts=4)
    assert sorted((r.part, r.text) for r in sharded.collect()) == [(i // 3 + 1, f"line {i}") for i in range(10)]
    shards.write_corpus(sharded, path + "/corpus")
    assert spark.read.json(path + "/corpus").groupBy("part").count().count() == 4
    assert [b.count() for b in shards.iter_batches(lines, ["n"], size=4)] == [4, 4, 2]

    pages = spark.createDataFrame([(1, 100, 50), (2, 100, 50)], "page bigint, w bigint, h bigint")
    boxes = spark.createDataFrame([(1, "a", 0, 0, 9, 9, "x"), (2, "b", 1, 1, 5, 5, "y")], "page bigint, tag string, " + BOX + ", word string")
    images, rows = coco.coco_detection(pages, boxes, boxes.filter("page = 2").drop("word"), ["page"], "tag", F.lit("f.png"))
    assert [(r.id, r.image_id, r.category_id, r.bbox) for r in rows.orderBy("id").collect()] == [
        (1, 1, 1, [0, 0, 9, 9]), (2, 2, 1, [1, 1, 4, 4]), (3, 2, 2, [1, 1, 4, 4])]
    coco.write_coco(images, rows, ["page"], path + "/coco", coco.DETECTION_CATEGORIES)
    assert spark.read.json(path + "/coco/annotations").count() == 3
    document = json.loads(coco.coco_documents(images, rows, ["page"]).filter("page = 1").first().document)
    assert document["images"][0]["id"] == 1 and document["annotations"][0]["text"] == "x"


def session_like(master, named=None, current=None):
    from types import SimpleNamespace as Like
    return Like(conf=Like(get=lambda key, default: named if key == "spark.checkpoint.dir" else default),
                sparkContext=Like(master=master, getCheckpointDir=lambda: current))


def test_scratch_folder_is_the_one_the_session_names(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_root(session_like("spark://host", named="s3a://shared/tmp")) == "s3a://shared/tmp"
    assert scratch_root(session_like("spark://host", current="hdfs:/tmp/a")) == "hdfs:/tmp/a"
    with pytest.raises(RuntimeError):
        scratch_root(session_like("spark://host"))


def test_nearest_paragraph_element(spark):
    html = "<html><head><title>no</title></head><body><ul><li>a <b>b&nbsp;c</b></li></ul><dl>d</dl><div>e<script>x</script></div><p><i>f</i></p></body></html>"
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    got = [(r.word, r.pos, r.tag, r.paragraph_tag) for r in html_nodes(df).orderBy("pos").collect()]
    assert got == [("a", 0, "li", "li"), ("b", 1, "b", "li"), ("c", 2, "b", "li"), ("d", 3, "dl", "dl"), ("e", 4, "div", "div"), ("f", 5, "i", "p")]
    spans = {r.paragraph_tag: (r.words, r.first, r.last) for r in paragraph_of(df).collect()}
    assert spans == {"li": (3, 0, 2), "dl": (1, 3, 3), "div": (1, 4, 4), "p": (1, 5, 5)}


def test_text_of_form_elements_is_left_out(spark):
    page = "<body>one<select><option>two<option value='3'>three</option></select>four<textarea>five</textarea><input>six</body>"
    df = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    for words in (html.html_words(df), html.html_nodes(df)):
        assert [r.word for r in words.orderBy("pos").collect()] == ["one", "four", "six"]


def test_box_minus_keeps_the_part_before_or_else_after(spark):
    sides = "left int, top int, right int, bottom int, o_left int, o_top int, o_right int, o_bottom int"
    df = spark.createDataFrame([(0, 0, 9, 9, 4, 3, 6, 5), (4, 3, 9, 9, 4, 3, 6, 5), (0, 3, 9, 9, 4, 1, 6, 5)], sides)
    rest = B.box_minus(Box.of(), Box.of("o_"))
    assert [tuple(r) for r in df.select(*rest.sides).collect()] == [(0, 0, 3, 2), (7, 6, 9, 9), (0, 6, 3, 9)]


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_paragraph_fold_over_awkward_markup(spark, monkeypatch, chunk):
    monkeypatch.setattr(html, "FOLD_PIECES", chunk)
    page = ('<p>one</b> two<br/><a title="x>y</p>">three</a><script>var t="</p><li>";</script><custom/>four</P><LI>five<table><td>six'
            "</li>seven<style>p{}</style><!-- <p>no --> 1 < 2 <noscript>no<p>no</p></noscript><p>eight</dl></p></p>nine</body></html>ten<p")
    df = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "<p></p>")], "page_id bigint, html string")
    nodes = html.html_nodes(df)
    got = [(r.word, r.tag, r.paragraph_tag, r.paragraph) for r in nodes.orderBy("page_id", "pos").collect()]
    assert got == [
        ("one", "p", "p", 1), ("two", "p", "p", 1), ("three", "a", "p", 1), ("four", "p", "p", 1), ("five", "li", "li", 5), ("six", "td", "td", 7),
        ("seven", "body", "body", 0), ("1", "body", "body", 0), ("<", "body", "body", 0), ("2", "body", "body", 0), ("eight", "p", "p", 11),
        ("nine", "body", "body", 0), ("ten", "body", "body", 0), ("<", "body", "body", 0), ("p", "body", "body", 0)]
    assert [r.pos for r in nodes.orderBy("pos").collect()] == list(range(len(got)))
    assert "Python" not in nodes._jdf.queryExecution().executedPlan().toString()
