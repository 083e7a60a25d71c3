"""Train and validation splits, combining datasets, repeating them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagespark.functions.hashing import HASH_SPAN, hash_int, hash_unit
from pagespark.operators.filters import clean_failures
from pagespark.operators.order import numbered, row_total

BUCKETS = 65536


def hash_split(key: Column, share: float, seed: str = "split") -> Column:
    """``train`` or ``val`` as a function of seed and key: rows of one key (all pages of
    one address) stay together, wherever and whenever they are read."""
    return F.when(hash_unit(seed, key) < share, "train").otherwise("val")


def exact_split(df: DataFrame, key: str, share: float, seed: str = "split") -> DataFrame:
    """Exactly ``floor(share * N)`` rows for training, drawn without replacement; ``key``
    is unique. Rows rank by hash. Bucket counts (at most 65536 rows) tell which bucket
    the cut falls in, and only that bucket's rows are ranked one by one, by range."""
    rows = df.withColumn("_hash", hash_int(seed, F.col(key))).withColumn(
        "_bucket", F.floor(F.col("_hash") / (HASH_SPAN // BUCKETS)))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_bucket"))
    cut = F.floor(F.lit(share) * F.sum("_n").over(Window.partitionBy()))
    plan = counts.select("_bucket", (upto - F.col("_n")).alias("_smaller"), upto.alias("_upto"), cut.alias("_cut"))
    placed = rows.join(F.broadcast(plan), "_bucket")
    whole = placed.filter((F.col("_upto") <= F.col("_cut")) | (F.col("_smaller") >= F.col("_cut")))
    shared = placed.filter((F.col("_upto") > F.col("_cut")) & (F.col("_smaller") < F.col("_cut")))
    shared = numbered(shared, ["_hash", key], "_rank")
    split = lambda trained: F.when(trained, "train").otherwise("val")
    done = whole.withColumn("split", split(F.col("_upto") <= F.col("_cut"))).unionByName(
        shared.withColumn("split", split(F.col("_smaller") + F.col("_rank") < F.col("_cut"))).drop("_rank"))
    return done.drop("_hash", "_bucket", "_smaller", "_upto", "_cut")


def validation_rest(df: DataFrame, train: DataFrame, key: Sequence[str]) -> DataFrame:
    """All that is not in the training set."""
    return df.join(train.select(*key), list(key), "left_anti")


def combine_datasets(datasets: dict[str, DataFrame], sample: str, files: DataFrame | None = None,
                     split_key: str | None = None, share: float = 0.8, seed: str = "split") -> DataFrame:
    """One set of samples from several: those with empty files left out, renumbered in
    order of dataset and sample, split by the key (or by sample)."""
    whole = None
    for name, df in datasets.items():
        part = df.withColumn("dataset", F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    if files is not None:
        good = clean_failures(files, sample).select(sample).distinct()
        whole = whole.join(good, sample, "left_semi")
    ids = numbered(whole, ["dataset", sample], "combined_id")
    return ids.withColumn("split", hash_split(F.col(split_key or sample), share, seed))


COPIES = 1 << 18  # of a row that one task makes together


def _copied(df: DataFrame, copies: Column, column: str) -> DataFrame:
    """Each row ``copies`` times, numbered from 0. Up to COPIES of them are made where the row lies; more are
    made by pieces, which are dealt out over all tasks first, so that one row may have any number."""
    pieces = F.ceil(copies / F.lit(COPIES)).cast("bigint")
    sized = df.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    few = sized.filter(F.col("_copies") <= COPIES).withColumn("_piece", F.lit(0).cast("bigint"))
    many = sized.filter(F.col("_copies") > COPIES).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = few.unionByName(many.repartition(parts))
    first = F.col("_piece") * COPIES
    turns = F.sequence(first, F.least(first + COPIES, F.col("_copies")) - 1)
    return whole.withColumn(column, F.explode(turns)).drop("_copies", "_piece")


def cycle_to(df: DataFrame, n: Column, position: str = "id") -> DataFrame:
    """Rows of a numbered set taken in turn until there are ``n``: a row's copies stand at its
    place and then each time the whole set has passed."""
    total = row_total(df)
    copies = F.ceil((n - F.col(position)) / total.cast("double")).cast("bigint")
    exact = F.when(F.col(position) + (copies - 1) * total >= n, copies - 1).when(F.col(position) + copies * total < n, copies + 1).otherwise(copies)
    turned = _copied(df.withColumn("_n", exact), F.col("_n"), "_turn").drop("_n")
    return turned.withColumn("slot", F.col(position) + F.col("_turn") * total).drop("_turn")


def repeat_to(df: DataFrame, n: Column) -> DataFrame:
    """Whole copies of a set until it is at least ``n`` rows long."""
    copies = F.greatest(F.ceil(n / row_total(df)), F.lit(1)).cast("bigint")
    return _copied(df, copies, "copy")
