"""Run records: best and latest epochs, configuration grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.operators.order import running_best


def best_epochs(epochs: DataFrame, metric: str = "val_loss", mode: str = "min") -> DataFrame:
    """Flags each epoch that is the best of its run so far; a tie counts as new best."""
    best = running_best(epochs, ["run"], ["epoch"], metric, mode, "best_so_far")
    return best.withColumn("is_best", F.col(metric) == F.col("best_so_far"))


def final_best(epochs: DataFrame, metric: str = "val_loss", mode: str = "min") -> DataFrame:
    """The epoch each run would be restored from: the last one that was a new best."""
    best = F.min if mode == "min" else F.max
    pick = F.col(metric) if mode == "min" else -F.col(metric)
    return epochs.groupBy("run").agg(
        best(metric).alias(metric), F.min_by("epoch", F.struct(pick, -F.col("epoch"))).alias("best_epoch"))


def resume_state(epochs: DataFrame, num_epochs: int) -> DataFrame:
    """Latest epoch of each run with its losses, and how many are left."""
    last = epochs.groupBy("run").agg(F.max_by(F.struct("epoch", "train_loss", "val_loss"), "epoch").alias("s"))
    return last.select("run", F.col("s.epoch").alias("current_epoch"), "s.train_loss", "s.val_loss",
                       F.greatest(F.lit(num_epochs) - (F.col("s.epoch") + 1), F.lit(0)).alias("epochs_left"))


def config_grid(names: DataFrame, name: str, options: Mapping[str, Sequence[str]], encoders: Sequence[str] = ("encoder", "decoder"),
                position: str = "position") -> DataFrame:
    """Every combination of the options for each name. The position encoding varies only
    where one of the encoders is a transformer; elsewhere it is ``const``. Each row makes
    its combinations itself."""
    grid = names
    for column, values in options.items():
        choice = F.array(*(F.lit(v) for v in values))
        if column == position:
            varied = F.lit(False)
            for encoder in encoders:
                varied = varied | (F.col(encoder) == "transformer")
            choice = F.when(varied, choice).otherwise(F.array(F.lit("const")))
        grid = grid.withColumn(column, F.explode(choice))
    return grid.withColumn("run", F.concat_ws("_", name, *options))
