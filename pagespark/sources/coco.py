"""COCO exports of pages and paragraphs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.functions.boxes import Box
from pagespark.operators.order import global_ids, numbered

# Category ids and names, and the one capture date the format carries.
DETECTION_CATEGORIES = [{"id": 1, "name": "word", "supercategory": "text"}, {"id": 2, "name": "image", "supercategory": "figure"}]
LAYOUT_CATEGORIES = [{"id": 1, "name": "paragraph", "supercategory": "text"}]
DATE_CAPTURED = "2013-11-18 02:53:27"


def _bbox(box: Box) -> Column:
    return F.array(box.left, box.top, box.right - box.left, box.bottom - box.top)


def _segmentation(box: Box) -> Column:
    return F.array(F.array(box.left, box.top, box.left, box.bottom, box.right, box.bottom, box.right, box.top))


def coco_images(pages: DataFrame, page: Sequence[str], file_name: Column) -> DataFrame:
    """Image entries numbered from 1 in page order."""
    named = pages.select(*page, file_name.alias("file_name"), F.col("h").alias("height"), F.col("w").alias("width"),
                         F.lit(DATE_CAPTURED).alias("date_captured"))
    return numbered(named, list(page), "id", start=1)


def _annotations(boxes: DataFrame, images: DataFrame, page: Sequence[str], order: Sequence[str]) -> DataFrame:
    listed = images.groupBy(*page).agg(F.collect_list("id").alias("_images"))  # a page stands once, as a rule
    ids = global_ids(boxes, page, order, "id", start=1, known=listed)
    box = Box.of()
    return ids.withColumn("image_id", F.explode("_images")).select(
        *page, "id", "image_id", "category_id", _segmentation(box).alias("segmentation"), _bbox(box).alias("bbox"), "text")


def coco_detection(pages: DataFrame, words: DataFrame, pictures: DataFrame, page: Sequence[str], order: str,
                   file_name: Column) -> tuple[DataFrame, DataFrame]:
    """(images, annotations): on each page the words, then the pictures, ids running on."""
    sides = ["left", "top", "right", "bottom"]
    rows = words.select(*page, F.lit(1).alias("category_id"), F.col(order).alias("_order"), *sides, F.col("word").alias("text"))
    more = pictures.select(*page, F.lit(2).alias("category_id"), F.col(order).alias("_order"), *sides,
                           F.lit(None).cast("string").alias("text"))
    images = coco_images(pages, page, file_name)
    return images, _annotations(rows.unionByName(more), images, page, ["category_id", "_order"])


def coco_layout(pages: DataFrame, paragraphs: DataFrame, page: Sequence[str], order: str,
                file_name: Column) -> tuple[DataFrame, DataFrame]:
    rows = paragraphs.select(*page, F.lit(1).alias("category_id"), F.col(order).alias("_order"),
                             "left", "top", "right", "bottom", F.lit(None).cast("string").alias("text"))
    images = coco_images(pages, page, file_name)
    return images, _annotations(rows, images, page, ["_order"]).drop("text")


def write_coco(images: DataFrame, annotations: DataFrame, page: Sequence[str], path: str, categories: list[dict]) -> None:
    """Images and annotations as JSON lines in parts, categories as one small file."""
    images.drop(*page).write.json(f"{path}/images")
    annotations.drop(*page).write.json(f"{path}/annotations")
    spark = images.sparkSession
    rows = [(json.dumps(c),) for c in categories]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(f"{path}/categories")


def coco_documents(images: DataFrame, annotations: DataFrame, page: Sequence[str]) -> DataFrame:
    """One COCO document per page; a page bounds how many entries it holds."""
    entry = F.struct("id", "image_id", "category_id", "segmentation", "bbox", *(["text"] if "text" in annotations.columns else []))
    per_page = annotations.groupBy(*page).agg(F.array_sort(F.collect_list(entry)).alias("annotations"))
    image = F.array(F.struct("id", "file_name", "height", "width", "date_captured"))
    return images.join(per_page, list(page), "left").select(
        *page, F.to_json(F.struct(image.alias("images"), F.coalesce("annotations", F.array()).alias("annotations"))).alias("document"))
