"""Column functions over file names and label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def coco_number(path: Column) -> Column:
    """The number after the last underscore."""
    return F.regexp_extract(path, r"_0*(\d+)\.[^_]*$", 1).cast("long")


def coco_file(number: Column, split: str = "train2014", extension: str = ".pth") -> Column:
    return F.format_string(f"COCO_{split}_%012d{extension}", number)


def image_name(kind: str) -> Column:
    """The name by which a set's images are looked up: VOC sets by file name, COCO by number."""
    return F.col("filename") if kind.startswith("VOC") else coco_file(F.col("image_id"))
