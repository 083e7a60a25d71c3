"""Row and group filters on samples, pages and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.functions.text import Language, accepts, accepts_language, max_length, no_emoji, normalize


def select_datasets(df: DataFrame, kind: str = "all", part: str | None = None, name: str = "name") -> DataFrame:
    """Datasets by tokens of their name: ``real``, ``synthetic`` or ``all``; archives
    never count; ``part`` is another token the name must hold (train, val)."""
    lower = F.lower(name)
    keep = ~lower.contains(".zip")
    if kind == "real":
        keep = keep & lower.contains("real")
    elif kind == "synthetic":
        keep = keep & ~lower.contains("real")
    elif kind != "all":
        raise ValueError(f"unknown dataset kind: {kind}")
    return df.filter(keep & lower.contains(part)) if part else df.filter(keep)


def pages_without_emoji(words: DataFrame, page: Sequence[str], text: str = "text") -> DataFrame:
    """Words of the pages none of whose words has an emoji."""
    marked = words.filter(~no_emoji(F.col(text))).select(*page).distinct()
    return words.join(marked, list(page), "left_anti")


def same_direction(column: Column, language: Language) -> Column:
    return column == language.direction


def unrotated(column: Column) -> Column:
    return ~F.coalesce(column, F.lit(False))


def sample_view(df: DataFrame, language: Language | None = None, ignore_direction: bool = False,
                max_len: int | None = None, allow_emoji: bool = False, scores: str | None = None) -> DataFrame:
    """The samples a recogniser trains on, spelled as its language spells them."""
    text = F.col("text")
    keep = max_length(text, max_len)
    if not allow_emoji:
        keep = keep & no_emoji(text)
    if language is None:
        return df.filter(keep)
    if not ignore_direction:
        keep = keep & same_direction(F.col("direction"), language)
    keep = keep & accepts(text, language.accepting_charset)
    if language.detection is not None:
        if scores is None:
            raise ValueError("a language with detection needs a column of language scores")
        keep = keep & accepts_language(F.col(scores), language.detection, language.detection_threshold)
    return df.filter(keep).withColumn("text", normalize(text, language.mapping))


def restyle_eligible(height: Column, width: Column, background_changed: Column, clean_only: bool = True) -> Column:
    big_enough = (height > 7) & (width > 7)
    return big_enough & ~background_changed if clean_only else big_enough


def stable_pages(before: DataFrame, after: DataFrame, page: str, position: str, values: Sequence[str],
                 changed_share: DataFrame | None = None, threshold: float = 0.05) -> DataFrame:
    """Pages whose words and boxes are the same in both snapshots. ``changed_share``
    (page, share) adds the rule that less than ``threshold`` of the picture changed."""
    a = before.select(page, position, F.struct(*values).alias("a"))
    b = after.select(page, position, F.struct(*values).alias("b"))
    same = a.join(b, [page, position], "full_outer").groupBy(page).agg(
        F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))
    kept = same.filter("same").select(page)
    if changed_share is None:
        return kept
    return kept.join(changed_share.filter(F.col("share") < threshold), page, "left_semi")


def failed_samples(files: DataFrame, sample: str = "sample", label_file: str | None = None) -> DataFrame:
    """Samples with an empty file, or without the named label file."""
    flags = files.groupBy(sample).agg(
        F.bool_or(F.col("length") == 0).alias("empty"),
        F.bool_or(F.col("file") == label_file).alias("labelled") if label_file else F.lit(True).alias("labelled"))
    return flags.filter(F.col("empty") | ~F.col("labelled")).select(sample)


def clean_failures(files: DataFrame, sample: str = "sample", label_file: str | None = None) -> DataFrame:
    """Files of the samples that did not fail."""
    return files.join(failed_samples(files, sample, label_file), sample, "left_anti")


def drop_empty_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("length") > 0)


def charset_union(charsets: Sequence[DataFrame], char: str = "char") -> DataFrame:
    """Characters of any of the charsets, each once."""
    whole = charsets[0].select(char)
    for charset in charsets[1:]:
        whole = whole.unionByName(charset.select(char))
    return whole.distinct()
