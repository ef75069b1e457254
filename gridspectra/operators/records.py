"""Small operators over records: token splits, lists of records against records of lists, matchings in configuration text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_qkv(tokens: DataFrame, dim: int, which: str = "k") -> DataFrame:
    """Queries, keys or values of each patch from a token's projections laid side by side (image_id, token, qkv); token 0 stands for the image and goes."""
    own = F.slice("qkv", 1 + dim * "qkv".index(which), dim)
    return tokens.where("token > 0").select("image_id", (F.col("token") - 1).cast("int").alias("patch"), own.alias(which))


def total_boxes(records: DataFrame, boxes: str = "bboxes") -> DataFrame:
    """Boxes of all records together; null and empty lists have none."""
    return records.agg(F.coalesce(F.sum(F.when(F.col(boxes).isNotNull(), F.size(boxes)).otherwise(0)), F.lit(0)).cast("long").alias("n"))


def to_lists(rows: DataFrame, order: str, *names: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One record of lists in place of rows, by keys, in the order of a column."""
    held = F.array_sort(F.collect_list(F.struct(order, *names)))
    field = lambda n: F.transform("rows", lambda x: x[n]).alias(n)
    return rows.groupBy(*keys).agg(held.alias("rows")).select(*keys, *map(field, names))


def to_rows(record: DataFrame, *names: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a record of lists: place and one value of each list."""
    return record.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("place", "row")).select(*keys, "place", *[F.col("row")[n].alias(n) for n in names])


def parse_matching(text: Column) -> Column:
    """Pairs (pred, target) of a matching written as nested lists, [[0, 3], [1, 2]], or as pairs in round brackets; anything else is an error."""
    plain = F.translate(text, "()", "[]")
    pairs = F.from_json(plain, "array<array<int>>")
    sound = pairs.isNotNull() & F.forall(pairs, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(pairs, lambda p: F.struct(p[0].alias("pred"), p[1].alias("target")))).otherwise(F.raise_error(F.concat(F.lit("no matching: "), text)).cast("array<struct<pred:int,target:int>>"))
