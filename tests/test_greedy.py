"""Order-dependent page operators against plain models, whatever the input order."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import models as M
from pagespark.functions.boxes import SIDES
from pagespark.operators import folds
from pagespark.operators.lines import merge_fragments
from pagespark.operators.suppress import link_lines, resolve_overlaps, suppress

PAGES = {p: M.random_boxes(p, 6 + 5 * p) for p in range(1, 7)}


def frame(spark, pages, parts, **columns):
    """(page, key, box) rows in random order over some partitions."""
    rows = [(p, key, *map(int, box), *(f(p, i, key) for f in columns.values()))
            for p, boxes in pages.items() for i, (key, box) in enumerate(boxes)]
    random.Random(parts).shuffle(rows)
    schema = "page bigint, tag string, " + ", ".join(f"{s} bigint" for s in SIDES) + "".join(f", {c} bigint" for c in columns)
    return spark.createDataFrame(rows, schema).repartition(parts)


def box_of(row):
    return tuple(row[s] for s in SIDES)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sublines(spark, parts):
    df = frame(spark, PAGES, parts, line=lambda p, i, k: i % 2)
    for threshold in (0.7, 0.1):
        got = defaultdict(list)
        for r in folds.split_sublines(df, ["page", "line"], threshold=threshold).collect():
            got[r.page, r.line, r.subline].append((r.place, r.tag))
        for p, boxes in PAGES.items():
            for line in (0, 1):
                want = M.sublines([b for i, b in enumerate(boxes) if i % 2 == line], threshold)
                assert [[k for k, _ in s] for s in want] == [
                    [k for _, k in sorted(got[p, line, n])] for n in range(len(want))]


def test_absorb(spark):
    df = frame(spark, PAGES, 3, line=lambda p, i, k: i // 3)
    got = defaultdict(list)
    for r in folds.absorb_lines(df, ["page"], "line").collect():
        got[r.page, r.new_line].append((r.place, r.tag))
    for p, boxes in PAGES.items():
        lines = defaultdict(list)
        for i, row in enumerate(boxes):
            lines[i // 3].append(row)
        want = M.absorbed(lines)
        assert [sorted(k for k, _ in w) for w in want] == [sorted(k for _, k in got[p, n]) for n in range(len(want))]


@pytest.mark.parametrize("parts", [1, 8])
def test_clusters_and_envelopes(spark, parts):
    df = frame(spark, PAGES, parts, line=lambda p, i, k: i)
    found = folds.x_clusters(df, ["page"], "line")
    got = defaultdict(list)
    for r in found.collect():
        got[r.page, r.cluster].append((r.place, r.line))
    boxes = defaultdict(dict)
    for r in folds.paragraph_boxes(df, found, ["page"]).collect():
        boxes[r.page][r.par] = box_of(r)
    for p, rows in PAGES.items():
        sides = [(b[0], b[2]) for _, b in rows]
        want = M.clusters(sides)
        assert want == [[i for _, i in sorted(got[p, n])] for n in range(len(want))]
        members = [[b for _, b in rows if (b[0], b[2]) in {sides[i] for i in group}] for group in want]
        ordered = sorted(range(len(want)), key=lambda n: (-M.area(M.hull(members[n])), -len(want[n]), n))
        assert M.swallowed([M.hull(members[n]) for n in ordered]) == [boxes[p][i] for i in sorted(boxes[p])]


def test_rerow(spark):
    df = frame(spark, PAGES, 3)
    got = defaultdict(list)
    for r in folds.rerow_words(df, ["page"], ["tag"]).collect():
        got[r.page, r.new_row].append((r.place, r.tag))
    for p, rows in PAGES.items():
        want = M.rerowed(rows)
        assert [[k for k, _ in row] for row in want] == [[k for _, k in sorted(got[p, n])] for n in range(len(want))]


def test_bands(spark):
    got = defaultdict(dict)
    for r in folds.reading_bands(frame(spark, PAGES, 3), ["page"], "tag", ["tag"]).collect():
        got[r.page][r["rank"]] = r.tag
    for p, rows in PAGES.items():
        assert M.bands(rows) == [got[p][i] for i in range(len(rows))]


def test_paragraph_runs(spark):
    rng = random.Random(5)
    pages = {1: list("ABAB"), 2: list("AABBC"), 3: [rng.choice("ABCDEFGH") for _ in range(12)]}
    rows = [(p, i, c) for p, cs in pages.items() for i, c in enumerate(cs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page bigint, place bigint, paragraph string")
    got = {(r.page, r.place): r.run for r in folds.paragraph_runs(df, ["page"], "place", "paragraph").collect()}
    for p, cs in pages.items():
        assert M.runs(cs) == [got[p, i] for i in range(len(cs))]
    assert M.runs(list("ABAB")) == [0, 0, 0, 3]


@pytest.mark.parametrize("threshold", [0.2, 0.5])
def test_suppress(spark, threshold):
    left = suppress(frame(spark, PAGES, 3), ["page"], "tag", ["size_based_nms"], {"intersection_thr": threshold}).collect()
    for p, rows in PAGES.items():
        assert M.suppressed(rows, threshold) == sorted(r.tag for r in left if r.page == p)


def test_suppress_methods_run_in_order(spark):
    df = frame(spark, PAGES, 3)
    params = {"intersection_thr": 0.3, "area_threshold": 200, "length_threshold": 6}
    left = suppress(df, ["page"], "tag", ["area_threshold", "length_threshold", "size_based_nms"], params).collect()
    for p, rows in PAGES.items():
        big = [(k, b) for k, b in rows if M.area(b) >= 200 and min(b[2] - b[0], b[3] - b[1]) + 1 >= 6]
        assert M.suppressed(big, 0.3) == sorted(r.tag for r in left if r.page == p)
    with pytest.raises(ValueError):
        suppress(df, ["page"], "tag", ["guess"], params)


@pytest.mark.parametrize("gap", [0, 20])
def test_link_lines(spark, gap):
    got = defaultdict(set)
    for r in link_lines(frame(spark, PAGES, 3), ["page"], gap=gap).collect():
        got[r.page, r.line].add(r.tag)
    for p, rows in PAGES.items():
        want = {frozenset(s) for s in M.linked(rows, gap)}
        assert want == {frozenset(s) for (page, _), s in got.items() if page == p}


@pytest.mark.parametrize("compat", [False, True])
def test_resolve_overlaps(spark, compat):
    df = frame(spark, PAGES, 3, source=lambda p, i, k: i // 4)
    got = defaultdict(list)
    for r in resolve_overlaps(df, ["page"], "source", "tag", compat).collect():
        got[r.page, r.par].append(r.tag)
    for p, rows in PAGES.items():
        want = M.resolved([rows[i:i + 4] for i in range(0, len(rows), 4)], compat)
        assert [sorted(k for k, _ in part) for part in want] == [sorted(got[p, n]) for n in range(len(want))]


def test_contained_paragraph_goes_only_as_intended(spark):
    rows = [(1, 0, "a", 0, 0, 99, 99), (1, 1, "b", 10, 10, 40, 40)]
    df = spark.createDataFrame(rows, "page bigint, source bigint, tag string, left bigint, top bigint, right bigint, bottom bigint")
    assert resolve_overlaps(df, ["page"], "source", "tag").count() == 1
    assert resolve_overlaps(df, ["page"], "source", "tag", compat=True).count() == 2


def test_merge_fragments_branches(spark):
    rows = [
        ("a", "ab", 0, 0, 10, 9), ("b", "cd", 10, 0, 20, 9), ("c", "ef", 20, 0, 30, 9),  # a chain
        ("x", "up", 50, 0, 60, 9), ("y", "level", 60, 0, 70, 9), ("z", "low", 60, 3, 70, 12),  # y fits x better than z
        ("q", "alone", 200, 0, 240, 9),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "page bigint, tag string, word string, left bigint, top bigint, right bigint, bottom bigint")
    got = {r.tag: (r.word, r.left, r.right, r.changed) for r in merge_fragments(df, ["page"]).collect()}
    assert got == {"c": ("abcdef", 0, 30, True), "y": ("uplevel", 50, 70, True), "z": ("low", 60, 70, False), "q": ("alone", 200, 240, False)}
