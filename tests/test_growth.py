"""Steps whose work per word or letter must stay small, with the results of their plain forms."""

import pytest
from pyspark.sql import functions as F

from pagespark.operators import scripts

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_text_are_looked_up_in_place(spark, monkeypatch):
    monkeypatch.setattr(scripts, "PAIR_CHARS", 4)  # several runs of texts, one text longer than a run
    rows = [(1, "de", "aaab"), (2, "en", "abcabcab"), (3, "de", "b😀b"), (4, "fr", "x"), (5, "fr", ""), (6, "en", None),
            (7, None, "ab"), (8, "en", "zz😀"), (2, "en", "cc")]
    texts = spark.createDataFrame(rows, "doc bigint, lang string, text string").repartition(2)
    plain = scripts.bigram_counts(texts, ["lang"]).select("lang", "gram", "n")
    model = scripts.bigram_model(texts)
    assert sorted(map(str, model.collect())) == sorted(map(str, plain.collect()))
    known = model.filter("gram <> 'zz'")  # a pair the model does not hold
    counts = scripts.bigram_counts(texts, ["doc"])
    want = {r["doc"]: [(s["lang"], s["prob"]) for s in r["scores"]] for r in scripts.language_scores(counts, "doc", known).collect()}
    scored = scripts.text_language_scores(texts, "doc", known)
    got = {r["doc"]: [(s["lang"], s["prob"]) for s in r["scores"]] for r in scored.collect()}
    assert set(got) == set(want) == {1, 2, 3, 7, 8}
    for doc, scores in want.items():
        assert [x[0] for x in got[doc]] == [x[0] for x in scores]
        assert [x[1] for x in got[doc]] == pytest.approx([x[1] for x in scores])
    assert "Generate" not in plan_of(scored) and "Join" not in plan_of(scored)  # no row for a pair
    with pytest.raises(ValueError):
        scripts.text_language_scores(texts, "doc", model, most=3)


@pytest.mark.parametrize("most", [0, 100])  # members met by a merge join, and sent to every task
def test_drawn_words_do_not_move_the_slots(spark, most):
    from pagespark.functions.hashing import hash_pick, hash_unit
    from pagespark.operators import sampling

    members = spark.createDataFrame([("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), ("c", 0, "c0")], "source string, pos bigint, word string")
    weights = {"a": 0.5, "b": 0.25, "none": 0.25}
    words = spark.range(400).select((F.col("id") % 5).alias("page"), F.col("id").alias("place"), F.concat(F.lit("t"), "id").alias("tag"), F.lit("old").alias("word"))
    drawn = sampling.weighted_draw(words.select("tag"), ["tag"], weights, members, most=most)
    u = hash_unit("draw", F.col("tag"))
    source = F.when(u < 0.5 / 0.75, "a").otherwise("b")
    size = F.when(source == "a", 2).otherwise(1).cast("bigint")
    want = words.select("tag", source.alias("source"), F.concat(source, hash_pick(size, "draw#", F.col("tag")).cast("string")).alias("word"))
    assert sorted(map(tuple, drawn.select("tag", "source", "word").collect())) == sorted(map(tuple, want.collect()))
    replaced = sampling.replace_words(words, ["page"], ["place"], "tag", 0.3, weights, members, pool=3, most=most)
    rows = {r["tag"]: r for r in replaced.collect()}
    chosen = {r["tag"] for r in words.filter(hash_unit("replace", F.col("tag")) < 0.3).collect()}
    assert len(rows) == 400 and {t for t, r in rows.items() if r["replaced"]} == chosen
    for page in range(5):
        turns = sorted((r["place"], r["word"]) for r in rows.values() if r["page"] == page and r["replaced"])
        assert all(w == turns[i % 3][1] for i, (_, w) in enumerate(turns))
        assert all(r["word"] == "old" for r in rows.values() if r["page"] == page and not r["replaced"])
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (most == 0)
    assert plan_of(replaced).count("Join ") == 1  # words are not looked up again by their key


def test_coding_passes_over_padding_and_looks_through_one_text(spark):
    from pagespark.functions.text import decode, encode

    rows = [("hello",), ("",), ("lol!",), (None,), ("oo€😀",)]
    df = spark.createDataFrame(rows, "w string").select("w", encode(F.col("w"), "helo€😀", 6).alias("c"))
    got = df.select("w", "c", decode(F.col("c"), "helo€😀").alias("p"), decode(F.col("c"), "helo€😀", "collapse").alias("k")).collect()
    assert [(r["w"], r["c"], r["p"], r["k"]) for r in got] == [
        ("hello", [0, 1, 2, 2, 3, 6], "hello", "helo"), ("", [6] * 6, "", ""), ("lol!", [2, 3, 2, -1, 6, 6], "lol", "lol"),
        (None, None, None, None), ("oo€😀", [3, 3, 4, 5, 6, 6], "oo€😀", "o€😀")]
    blank_between = spark.sql("SELECT array(2L, 6L, 2L, 2L, 6L) AS c").select(decode(F.col("c"), "helo€😀", "collapse").alias("k"))
    assert blank_between.first()["k"] == "ll"  # a blank still parts equal letters
    plan = plan_of(df.select(decode(F.col("c"), "helo€😀")))
    assert "array_position" not in plan and "array_remove" in plan


def test_a_size_is_planned_once(spark):
    import __spark_entry__

    plan = plan_of(__spark_entry__.queries()["g8_resize_plan"](spark, FOLDER))
    assert plan.count("Generate explode(array(") == 1 and plan.index("Generate") < plan.index("Aggregate")  # a page, not a word, is told by method
    assert "48.0" not in plan  # words hold no plan of their own, they meet their size's


def test_a_saved_view_is_written_small(spark, tmp_path):
    from pagespark.sources.samples import load_view, save_view

    rows = spark.range(20000).select(F.concat(F.col("id"), F.lit("|4|11")).alias("tag"), F.concat(F.col("id"), F.lit("|4|11.png")).alias("file"), (F.col("id") % 2).alias("part"))
    save_view(rows, str(tmp_path / "view"), {"language": "french"}, ["part"])
    rows.write.partitionBy("part").option("compression", "snappy").parquet(str(tmp_path / "plain"))
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet"))
    assert size("view/rows") < 0.8 * size("plain")
    back, settings = load_view(spark, str(tmp_path / "view"))
    assert settings == {"language": "french"} and sorted(map(tuple, back.select("tag", "file", "part").collect())) == sorted(map(tuple, rows.collect()))


def test_texts_move_once_for_their_address(spark):
    from pagespark.fixtures.tables import Tables

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where there are many addresses
    try:
        plan = Tables(spark, FOLDER).samples._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(page_id" in x]
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ShuffledHashJoin [doc_id" in plan
    assert moved and all("text" not in x for x in moved)
