"""Copies, walks, fillings and language models that stay spread and bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespark.operators import graph, sampling, scripts, splits
from pagespark.operators.order import numbered


@pytest.mark.parametrize("rows, n", [(1, 0), (1, 1), (1, 1000), (3, 2), (3, 3), (7, 100), (5, 41)])
@pytest.mark.parametrize("piece", [4, 1 << 18])
def test_cycle_takes_rows_in_turn(spark, monkeypatch, rows, n, piece):
    monkeypatch.setattr(splits, "COPIES", piece)
    found = splits.cycle_to(spark.range(rows), F.lit(n).cast("bigint")).collect()
    assert sorted((r["slot"], r["id"]) for r in found) == [(i, i % rows) for i in range(n)]


def test_many_copies_of_one_row_run_in_many_tasks(spark):
    found = splits.cycle_to(spark.range(1), F.lit(10_000_000).cast("bigint"))
    parts = found.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 10_000_000 and len(parts) >= 8 and max(r["n"] for r in parts) < 3_000_000
    assert splits.cycle_to(spark.range(0), F.lit(5).cast("bigint")).count() == 0
    assert sorted(r["copy"] for r in splits.repeat_to(spark.range(1), F.lit(3)).collect()) == [0, 1, 2]


def test_walk_ranks_only_links_of_the_level(spark):
    links = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 5), (9, 0), (9, 1), (4, 0), (4, 0)], "src bigint, dst bigint")
    seen = {}
    for breadth in (1, 2, 9):
        picked = {}
        for r in graph.picked_links(links, breadth).collect():
            picked.setdefault(r["src"], []).append(r["dst"])
        level, want, d = [0], {0: 0}, 0
        while level and d < 4:
            d += 1
            level = sorted({x for p in level for x in picked.get(p, [])} - set(want))
            want |= dict.fromkeys(level, d)
        seen[breadth] = {r["page_id"]: r["depth"] for r in graph.crawl_frontier(links, 0, depth=4, breadth=breadth).collect()}
        assert seen[breadth] == want
    assert graph.crawl_frontier(links.limit(0), 7).collect() == [(7, 0)]


def test_filling_ends_and_takes_the_shortest_prefix(spark):
    slots = spark.createDataFrame([(1, 30), (2, 1), (3, None), (4, 2000)], "slot bigint, target bigint")
    corpus = spark.createDataFrame([("one two three",), ("a\tb <TABLE>",), ("",), (None,), ("four  five",)], "text string")
    corpus = numbered(corpus.withColumn("key", F.monotonically_increasing_id()), ["key"], "id").select("id", "text")
    found = {r["slot"]: r["text"] for r in sampling.fill_text(slots, "slot", "target", corpus).collect()}
    assert set(found) == {1, 2, 3, 4} and found[3] is None
    for slot, target in ((1, 30), (2, 1), (4, 2000)):
        assert len(found[slot]) >= target > len(found[slot].rsplit(" ", 1)[0]) - (" " not in found[slot]) * len(found[slot])
    none = sampling.fill_text(slots, "slot", "target", corpus.limit(0))
    assert {(r["slot"], r["text"]) for r in none.collect()} == {(i, None) for i in (1, 2, 3, 4)}


def test_prefix_lengths_with_markers_equal_the_cleaned_text(spark):
    random = np.random.default_rng(8)
    pool = ["{|", "|}", "x{|", "|}y", "", "a", "bcd", "{|\t|}\tz", "|}\n", "{|\t|}"]
    rows = [(i, [str(w) for w in random.choice(pool, int(random.integers(1, 12)))], int(random.integers(1, 25))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, words array<string>, target int")

    def brute(words, target):
        for k in range(1, len(words) + 1):
            if len(" ".join(words[:k]).replace("\n", " ").replace("\t", " ").replace("{| |} ", "")) >= target:
                return k

    for r in df.withColumn("k", sampling._reached(F.col("words"), F.col("target"))).collect():
        assert r["k"] == brute(r["words"], r["target"]), r


def test_language_model_is_bounded_and_sent_whole(spark):
    texts = spark.createDataFrame([(1, "abab"), (2, "cdcd"), (3, "zz")], "doc bigint, text string")
    counts = scripts.bigram_counts(texts, ["doc"])
    model = spark.createDataFrame([("x", "ab", 5), ("x", "ba", 4), ("y", "cd", 5), ("y", "dc", 4)], "lang string, gram string, n bigint")
    scores = scripts.language_scores(counts, "doc", model)
    best = {r["doc"]: max(r["scores"], key=lambda s: s["prob"])["lang"] for r in scores.collect()}
    assert best[1] == "x" and best[2] == "y"
    with pytest.raises(ValueError):
        scripts.language_scores(counts, "doc", model, most=3)
