"""Derived tables, built with DataFrame operations from the given parquet tables.

A page is at most 60 rows of 12 words, so page-keyed groups hold at most 720
words (twice that in ``detections``) whatever the size of a document.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespark.functions.hashing import hash_int, hash_pick
from pagespark.functions.text import classes_of, concat_ordered

WORDS_PER_ROW = 12
ROWS_PER_PAGE = 60
PAGE_HEIGHT = 1240
DOCUMENTS_PER_PART = 1000  # some 400,000 words, which a task sorts in memory
PAGE = ("doc_id", "page_no")
LINE = ("doc_id", "page_no", "row_no")
SCRIPTS = ("latin", "german", "french", "spanish")


def tag_of(*columns: str) -> Column:
    return F.concat_ws("|", *columns)


def big(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("bigint")


def spread(df: DataFrame, key: str, per_part: int = DOCUMENTS_PER_PART) -> DataFrame:
    """Deal rows out by key, ``per_part`` to a partition but over all shuffle partitions at least: a few small splits
    may hold very many words, which neither the scan nor the size of the shuffle shows. What is grouped or joined by
    this key and others stays where it is, so a partition must not grow with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // per_part)), key)


class Tables:
    """Lazy access to the given and derived tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str, kept: Column | None = None):
        self.spark = spark
        self.folder = folder
        self.kept = kept  # which documents; all by default

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return table if self.kept is None or name != "documents" else table.filter(self.kept)

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.read("documents"), "doc_id")

    @cached_property
    def words(self) -> DataFrame:
        return self.placed(self.documents)

    def placed(self, documents: DataFrame, *carried: str) -> DataFrame:
        """Every word of every document set in rows and pages, with columns of the document. No shuffle:
        the row a line starts at is a fold over the line lengths of the one document."""
        parts = F.transform(F.split("text", "\n"), lambda line: F.filter(F.split(line, " "), lambda w: w != ""))
        rows_in = lambda ws: F.ceil(F.size(ws) / F.lit(float(WORDS_PER_ROW))).cast("bigint")
        start = F.struct(big(0).alias("next"), F.array().cast("array<bigint>").alias("firsts"))
        firsts = F.aggregate(
            "parts", start,
            lambda s, ws: F.struct(
                (s["next"] + rows_in(ws)).alias("next"), F.concat(s["firsts"], F.array(s["next"])).alias("firsts")
            ),
            lambda s: s["firsts"],
        )
        lines = (
            documents.select("doc_id", "lang", *carried, parts.alias("parts"))
            .select("doc_id", "lang", *carried, F.posexplode(F.arrays_zip("parts", firsts.alias("firsts"))).alias("line_no", "line"))
            .select("doc_id", "lang", *carried, "line_no", F.col("line.parts").alias("ws"), F.col("line.firsts").alias("first_row"))
        )
        words = lines.select("doc_id", "lang", *carried, "line_no", "first_row", "ws", F.posexplode("ws").alias("pos", "word"))
        row = F.floor(F.col("pos") / WORDS_PER_ROW).cast("int")
        in_row = F.col("pos") % WORDS_PER_ROW
        before = F.array_join(F.slice("ws", row * WORDS_PER_ROW + 1, in_row), " ")
        k = F.col("first_row") + row
        placed = words.select(
            "doc_id", "lang", *carried,
            big(F.floor(k / ROWS_PER_PAGE)).alias("page_no"), big(k % ROWS_PER_PAGE).alias("row_no"),
            big(F.col("line_no")).alias("line_no"), big(F.col("pos")).alias("pos"),
            tag_of("doc_id", "line_no", "pos").alias("tag"), "word",
            big(F.least(F.size("ws") - row * WORDS_PER_ROW, F.lit(WORDS_PER_ROW))).alias("row_len"),
            big(10 * (F.length(before) + F.when(in_row > 0, 1).otherwise(0))).alias("left"),
        )
        top = 20 * F.col("row_no") + hash_pick(5, "j", F.col("tag"))
        return placed.select(
            "*", top.alias("top"),
            (F.col("left") + 10 * F.length("word") - 1).cast("bigint").alias("right"), (top + 13).alias("bottom"),
        )

    @cached_property
    def page_dims(self) -> DataFrame:
        return (
            self.words.groupBy(*PAGE).agg((F.max("right") + 1).alias("w"))
            .select(
                *PAGE, "w", big(PAGE_HEIGHT).alias("h"),
                (300 + hash_pick(9000, "s", tag_of(*PAGE))).alias("scale_w"),
                (300 + hash_pick(9000, "t", tag_of(*PAGE))).alias("scale_h"),
            )
        )

    @cached_property
    def detections(self) -> DataFrame:
        """Words, a fifth of them doubled by a slightly larger copy."""
        copies = F.when(hash_pick(5, "d", F.col("tag")) == 0, F.array(big(0), big(1))).otherwise(F.array(big(0)))
        k = F.col("k")
        return self.words.withColumn("k", F.explode(copies)).select(
            *PAGE, "row_no", "tag", "k", "word",
            (F.col("left") + 2 * k).alias("left"), (F.col("top") + k).alias("top"),
            (F.col("right") + 3 * k).alias("right"), (F.col("bottom") + 2 * k).alias("bottom"),
        )

    @cached_property
    def two_col(self) -> DataFrame:
        """Words of which half the documents set their lower rows as a second column."""
        moved = (hash_pick(2, "c", F.col("doc_id")) == 1) & (F.col("row_no") >= 30)
        dx, dy = F.when(moved, 6000).otherwise(0), F.when(moved, 600).otherwise(0)
        return self.words.select(
            *PAGE, "row_no", "tag", "word",
            (F.col("left") + dx).alias("left"), (F.col("top") - dy).alias("top"),
            (F.col("right") + dx).alias("right"), (F.col("bottom") - dy).alias("bottom"),
        )

    @cached_property
    def fragments(self) -> DataFrame:
        """Words, some cut in two pieces that share an edge."""
        cut = (F.length("word") >= 6) & (hash_pick(4, "f", F.col("tag")) == 0)
        half = F.floor(F.length("word") / 2).cast("int")
        edge = F.col("left") + 10 * half
        piece = lambda no, text, left, right: F.struct(
            big(no).alias("piece"), text.alias("word"), big(left).alias("left"), big(right).alias("right"))
        pieces = F.when(
            cut,
            F.array(piece(0, F.col("word").substr(F.lit(1), half), F.col("left"), edge),
                    piece(1, F.col("word").substr(half + 1, F.length("word")), edge, F.col("right"))),
        ).otherwise(F.array(piece(0, F.col("word"), F.col("left"), F.col("right"))))
        return (
            self.words.select(*PAGE, "row_no", "tag", "top", "bottom", F.explode(pieces).alias("p"))
            .select(*PAGE, "row_no", F.col("tag").alias("source"), tag_of("tag", "p.piece").alias("tag"),
                    "p.word", "p.left", "top", "p.right", "bottom")
        )

    @cached_property
    def images(self) -> DataFrame:
        """Three picture boxes per page."""
        i = F.col("i")
        draw = lambda salt, n: hash_pick(n, salt, tag_of(*PAGE, "i"))
        boxes = self.words.select(*PAGE).distinct().withColumn("i", F.explode(F.array(big(0), big(1), big(2))))
        left, top = draw("il", 2000), draw("it", 1200)
        return boxes.select(
            *PAGE, tag_of("doc_id", "page_no", "i").alias("tag"), left.alias("left"), top.alias("top"),
            (left + 19 + draw("iw", 200)).alias("right"), (top + 19 + draw("ih", 200)).alias("bottom"),
        )

    @cached_property
    def paragraphs(self) -> DataFrame:
        """Envelopes of five rows each; every third reaches into the row below."""
        par = big(F.floor(F.col("row_no") / 5))
        boxes = self.words.groupBy(*PAGE, par.alias("par")).agg(
            F.min("left").alias("left"), F.min("top").alias("top"),
            F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        )
        reach = F.when(F.col("par") % 3 == 2, 22).otherwise(0)
        return boxes.withColumn("bottom", (F.col("bottom") + reach).cast("bigint"))

    @cached_property
    def line_words(self) -> DataFrame:
        """Words with the line piece they belong to: a third of the rows are two pieces."""
        cut = hash_pick(3, "l", tag_of(*LINE)) == 0
        half = F.floor(F.col("row_len") / 2)
        piece = F.when(cut & (F.col("row_len") >= 2) & (F.col("pos") % WORDS_PER_ROW >= half), 1).otherwise(0)
        return self.words.withColumn("piece", big(piece))

    @cached_property
    def lines(self) -> DataFrame:
        order = [F.col("left"), F.col("tag")]
        return self.line_words.groupBy(*LINE, "piece").agg(
            F.min("left").alias("left"), F.min("top").alias("top"),
            F.max("right").alias("right"), F.max("bottom").alias("bottom"),
            concat_ordered(order, F.col("word"), " ").alias("text"),
        ).withColumn("line_id", F.col("row_no") * 2 + F.col("piece"))

    @cached_property
    def layout_rows(self) -> DataFrame:
        """Pages, paragraphs and words as one table of levels 2, 3 and 5."""
        nothing = F.lit(None).cast("string")
        size = [(F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height")]
        pages = self.page_dims.select(
            *PAGE, big(2).alias("level"), big(0).alias("block_num"), big(0).alias("par_num"), big(0).alias("left"),
            big(0).alias("top"), F.col("w").alias("width"), F.col("h").alias("height"), nothing.alias("text"))
        pars = self.paragraphs.select(
            *PAGE, big(3).alias("level"), big(0).alias("block_num"), F.col("par").alias("par_num"), "left", "top",
            *size, nothing.alias("text"))
        text = F.when(hash_pick(4, "b", F.col("tag")) == 0, F.lit("  ")).otherwise(F.col("word"))
        words = self.words.select(
            *PAGE, big(5).alias("level"), big(0).alias("block_num"), big(F.floor(F.col("row_no") / 5)).alias("par_num"),
            "left", "top", *size, text.alias("text"))
        return pages.unionByName(pars).unionByName(words)

    @cached_property
    def samples(self) -> DataFrame:
        """Word samples with direction, rotation flag, size and the url they came from, which a document's
        words have in common: it is joined to the documents' ids and comes to the texts where they are dealt out, so
        texts move once, however many addresses there are."""
        turned = hash_pick(20, "o", F.col("tag"))
        urls = self.read("pages").select("page_id", "url")
        count = self.read("pages").agg(F.count("*").alias("n")).scalar()
        page = F.col("doc_id") % count
        addresses = self.read("documents").select("doc_id").distinct().withColumn("page_id", page).join(urls, "page_id", "left")
        documents = self.documents.withColumn("page_id", page).join(
            addresses.select("doc_id", "url").hint("shuffle_hash"), "doc_id", "left")
        return (
            self.placed(documents, "page_id", "url").select(
                "page_id", "doc_id", "lang", "tag", F.col("word").alias("text"),
                F.when(hash_pick(10, "r", F.col("tag")) == 0, "rtl").otherwise("ltr").alias("direction"),
                F.when(turned == 1, True).when(turned == 2, None).otherwise(False).alias("rotated"),
                big(14).alias("h"), big(10 * F.length("word")).alias("w"),
                F.concat(F.col("tag"), F.lit(".png")).alias("file"),
                F.concat(F.col("tag"), F.lit("_mask.png")).alias("mask"), "url",
            )
        )

    @cached_property
    def emoji_samples(self) -> DataFrame:
        face = F.when(hash_pick(50, "e", F.col("tag")) == 0, F.lit("\U0001F600")).otherwise(F.lit(""))
        return self.words.select(*PAGE, "tag", F.concat("word", face).alias("text"))

    @cached_property
    def files(self) -> DataFrame:
        names = F.array(*map(F.lit, ("data.json", "image.png", "mask.png")))
        h = hash_int("z", tag_of("sample", "file"))
        return (
            self.read("documents").select(F.col("doc_id").alias("sample"), F.explode(names).alias("file"))
            .withColumn("length", big(F.when(h % 50 == 0, 0).otherwise(1 + h % 1000)))
        )

    @cached_property
    def coverage(self) -> DataFrame:
        chars = F.array_distinct(F.split("text", ""))
        return (
            self.documents.filter(F.length("text") > 0)
            .select(F.col("doc_id").alias("item"), F.explode(chars).alias("char"))
            .select("item", "char")
        )

    @cached_property
    def source_words(self) -> DataFrame:
        """Distinct words of each language, one row per (source, word)."""
        return self.words.select(F.col("lang").alias("source"), "word").distinct()

    @cached_property
    def wide_words(self) -> DataFrame:
        return self.words.select(
            *PAGE, "tag", "word", big(14).alias("h"),
            (10 * F.length("word") * (1 + hash_pick(40, "w", F.col("tag")))).cast("bigint").alias("w"))

    @cached_property
    def charset(self) -> str:
        """Every character of the words, in code point order; bounded by Unicode itself. Words are all of a
        text but its blanks and line ends, so the characters are told by document."""
        found = self.documents.select(F.explode(F.array_distinct(F.split("text", ""))).alias("c"))
        chars = found.filter(~F.col("c").isin("", " ", "\n")).distinct().collect()
        return "".join(sorted(r["c"] for r in chars))

    @cached_property
    def char_scores(self) -> DataFrame:
        """Recogniser scores of every word: per character one or two steps, a blank step
        between equal characters, a class for each character of the texts and the blank last."""
        charset = self.charset
        blank = len(charset)
        words = self.words.select(*PAGE, "tag", "word", F.split("word", "").alias("chars"))
        steps = F.flatten(F.transform("chars", lambda c, i: F.concat(
            F.when((i > 0) & (c == F.get("chars", i - 1)), F.array(big(blank))).otherwise(F.array().cast("array<bigint>")),
            F.array_repeat(F.array_position(classes_of(charset), c) - 1, 1 + hash_pick(2, "q", F.col("tag"), i.cast("string")).cast("int")),
        )))
        every = [[0.9 if i == k else 0.01 for i in range(blank + 1)] for k in range(blank + 1)]
        rows = F.from_json(F.lit(json.dumps(every)), "array<array<double>>")  # a constant: a step's scores are not built anew
        return words.select(*PAGE, "tag", "word", F.transform(steps, lambda k: F.get(rows, k.cast("int"))).alias("scores"))

    @cached_property
    def script_scores(self) -> DataFrame:
        """Four script scores per word, long form."""
        names = F.array(*map(F.lit, SCRIPTS))
        return (
            self.words.select(*PAGE, "tag", F.explode(names).alias("script"))
            .withColumn("score", hash_pick(100, "x", F.col("tag"), F.col("script")) / F.lit(100.0))
        )

    @cached_property
    def batches(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_type").alias("run"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint").alias("epoch"),
            F.col("event_id").alias("batch"), F.col("value").alias("loss"),
            (1 + hash_pick(8, "n", F.col("event_id"))).alias("n"))

    @cached_property
    def series(self) -> DataFrame:
        """Losses of each run in time order, before epochs are numbered."""
        return self.read("events").select(
            F.col("event_type").alias("run"), "ts", "event_id", F.col("value").alias("val_loss"),
            (F.col("value") * 0.9).alias("train_loss"))

    @cached_property
    def page_paths(self) -> DataFrame:
        """Offline file paths made from the page addresses."""
        tail = F.regexp_replace("url", r"^https?://", "")
        kind = hash_pick(6, "k", F.col("page_id"))
        name = (F.when(kind == 0, F.lit("index.html")).when(kind == 1, F.lit("index.htm"))
                .when(kind == 2, F.lit("about.html")).when(kind == 3, F.lit("a/index.html"))
                .when(kind == 4, F.lit("a/b/c/index.html")).otherwise(F.lit("logo.png")))
        host = F.regexp_extract(tail, r"^([^/?#]*)", 1)
        flat = hash_pick(3, "y", F.col("page_id")) == 0
        path = F.concat_ws("/", F.when(~flat, host), name)
        return self.read("pages").select("page_id", F.regexp_extract(host, r"([a-z]+)$", 1).alias("kind"), path.alias("path"))

    @cached_property
    def link_graph(self) -> DataFrame:
        count = self.read("pages").agg(F.count("*").alias("n")).scalar()
        return (
            self.read("pages").select(F.col("page_id").alias("src"), F.explode(F.sequence(big(0), big(4))).alias("k"))
            .select("src", ((F.col("src") * 7 + F.col("k") * 13 + 1) % count).alias("dst"), "k")
        )

    @cached_property
    def link_list(self) -> DataFrame:
        """Page addresses in order, every tenth once more at the end."""
        pages = self.read("pages")
        count = pages.agg(F.count("*").alias("n")).scalar()
        again = pages.filter(F.col("page_id") % 10 == 0)
        return pages.select(F.col("page_id").alias("pos"), "url").unionByName(
            again.select((F.col("page_id") + count).alias("pos"), "url"))

    @cached_property
    def used(self) -> DataFrame:
        return self.read("pages").filter(hash_pick(3, "u", F.col("url")) == 0).select("url")

    @cached_property
    def recognised(self) -> DataFrame:
        """Words with a recogniser's reading that errs now and then."""
        h = hash_int("p", F.col("tag"))
        cut = F.when(h % 7 == 0, F.expr("substr(word, 1, length(word) - 1)")).otherwise(F.col("word"))
        return self.words.select(*PAGE, "row_no", "tag", F.col("word").alias("target"),
                                 F.when(h % 11 == 0, F.translate(cut, "e", "c")).otherwise(cut).alias("predicted"))
