"""Walks over page links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagespark.functions.hashing import hash_int, hash_pick
from pagespark.session import written

SALTS = 64


def picked_links(links: DataFrame, breadth: int, seed: str = "walk") -> DataFrame:
    """The links a walk would follow from each page: the first ``breadth`` by hash. Pages
    are cut in salted pieces first, so a page with very many links is no single task."""
    ranked = links.select("src", "dst").distinct().withColumn("_hash", hash_int(seed, F.col("src"), F.col("dst"))).withColumn(
        "_salt", hash_pick(SALTS, "salt", F.col("dst")))
    piece = Window.partitionBy("src", "_salt").orderBy("_hash", "dst")
    whole = Window.partitionBy("src").orderBy("_hash", "dst")
    few = ranked.withColumn("_r", F.row_number().over(piece)).filter(F.col("_r") <= breadth)
    return few.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= breadth).select("src", "dst")


def crawl_frontier(links: DataFrame, start: int, depth: int = 14, breadth: int = 2, seed: str = "walk") -> DataFrame:
    """Pages reached from ``start`` with the depth at which each is first met.

    All levels together hold fewer than ``breadth ** (depth + 1)`` pages whatever the size
    of the link table. Only the links of a level's pages are ranked: the level, small by
    that bound, is sent to the links and they are filtered where they lie. Each level is
    written before the next is begun, so its joins are planned from the size it has.
    """
    spark = links.sparkSession
    links = written(links.select("src", "dst"), "links")
    seen = spark.range(1).select(F.lit(start).cast("bigint").alias("page_id"), F.lit(0).cast("bigint").alias("depth"))
    level = seen.select("page_id")
    for d in range(1, depth + 1):
        own = links.join(F.broadcast(level.withColumnRenamed("page_id", "src")), "src", "left_semi")
        step = picked_links(own, breadth, seed).select(F.col("dst").alias("page_id")).distinct()
        level = written(step.join(seen.select("page_id"), "page_id", "left_anti"), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level.withColumn("depth", F.lit(d).cast("bigint")))
    return seen
