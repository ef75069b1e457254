"""Derived inputs over the driver's tables (FIXTURES.md): an "image" is 100 vectors in a 10 x 10 patch grid.

Every function takes (spark, sf_dir) and returns a DataFrame; SQL has the same tables as named queries for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    patch = F.pmod("vec_id", F.lit(100)).cast("int")
    return e.select(
        F.floor(F.col("vec_id") / 100).cast("int").alias("image_id"), patch.alias("patch"), F.floor(patch / 10).cast("int").alias("r"), (patch % 10).alias("c"), "vec_id", "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("k"), *[F.element_at("embedding", i).cast("double").alias(f"e{i}") for i in (1, 2, 3)],
    )


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("vec_id") % 11 == 0, 255).otherwise(F.col("label"))
    pred = F.when(F.col("vec_id") % 5 == 0, (F.col("label") + F.col("vec_id")) % 10).otherwise((F.col("label") * 3 + 2) % 10)
    return feat(spark, sf_dir).select("image_id", "r", "c", target.cast("int").alias("target"), pred.cast("int").alias("pred"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat(spark, sf_dir).select("image_id", "r", "c", ((F.col("e1") + 1) / 2).alias("soft"), (F.col("e1") > 0).alias("pred"), (F.col("e2") > 0).alias("target"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat(spark, sf_dir).select("image_id", "r", "c", (2 * (F.col("e1") > 0).cast("int") + (F.col("e2") > 0).cast("int")).alias("label"))


def blk(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 17 == 0, 0).otherwise((1 + 2 * F.floor(F.col("r") / 5) + F.floor(F.col("c") / 5)).cast("int"))
    return feat(spark, sf_dir).select("image_id", "r", "c", label.alias("label"))


def gtb(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [(16 * F.min("c")).alias("x1"), (16 * F.min("r")).alias("y1"), (16 * (F.max("c") + 1)).alias("x2"), (16 * (F.max("r") + 1)).alias("y2")]
    return feat(spark, sf_dir).groupBy("image_id", F.col("label").alias("cls")).agg(*box)


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = feat(spark, sf_dir).where("label = image_id % 10")
    sides = [(16 * F.min("c") + 32).alias("x1"), (16 * F.min("r")).alias("y1"), F.least(16 * (F.max("c") + 1) + 32, F.lit(160)).alias("x2"), (16 * (F.max("r") + 1) - 48).alias("y2")]
    return own.groupBy("image_id").agg(*sides)


def att(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat(spark, sf_dir).select("image_id", "patch", "r", "c", (F.col("e3") * F.col("e3")).alias("w"))


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat(spark, sf_dir).select("vec_id", "label", F.posexplode(F.slice("k", 1, 10)).alias("class", "score"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (300 + F.col("o_orderkey") % 201).cast("int").alias("h"), (300 + F.col("o_custkey") % 201).cast("int").alias("w"), F.when(F.col("o_orderkey") % 2 == 0, 16).otherwise(8).alias("p"))


def voc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations as the XML has them: all leaves are strings."""
    s = lambda c: F.col(c).cast("string")
    flag = lambda n: F.when(F.col("cls") % n == 0, "1").otherwise("0")
    obj = F.struct(F.concat(F.lit("class"), s("cls")).alias("name"), flag(3).alias("truncated"), flag(4).alias("difficult"), F.struct(s("x1").alias("xmin"), s("y1").alias("ymin"), s("x2").alias("xmax"), s("y2").alias("ymax")).alias("bndbox"))
    return gtb(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(obj)).alias("object")).select("image_id", F.format_string("%06d.jpg", "image_id").alias("filename"), "object")


def coco(spark: SparkSession, sf_dir: str) -> DataFrame:
    bbox = F.array(F.col("x1") + 0.5, F.col("y1") + 0.5, (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double"))
    return gtb(spark, sf_dir).select(F.col("image_id").cast("long").alias("image_id"), (F.col("cls") == 9).cast("int").alias("iscrowd"), F.col("cls").alias("category_id"), bbox.alias("bbox"))


SQL = """
feat as (select (vec_id // 100)::int as image_id, (vec_id % 100)::int as patch, ((vec_id % 100) // 10)::int as r, (vec_id % 10)::int as c, vec_id, label,
  embedding::double[] as k, embedding[1]::double as e1, embedding[2]::double as e2, embedding[3]::double as e3 from embeddings),
pix as (select image_id, r, c, (case when vec_id % 11 = 0 then 255 else label end)::int as target, (case when vec_id % 5 = 0 then (label + vec_id) % 10 else (label * 3 + 2) % 10 end)::int as pred from feat),
bin as (select image_id, r, c, (e1 + 1) / 2 as soft, e1 > 0 as pred, e2 > 0 as target from feat),
seg as (select image_id, r, c, 2 * (e1 > 0)::int + (e2 > 0)::int as label from feat),
blk as (select image_id, r, c, (case when vec_id % 17 = 0 then 0 else 1 + 2 * (r // 5) + c // 5 end)::int as label from feat),
gtb as (select image_id, label as cls, 16 * min(c) as x1, 16 * min(r) as y1, 16 * (max(c) + 1) as x2, 16 * (max(r) + 1) as y2 from feat group by image_id, label),
box as (select image_id, 16 * min(c) + 32 as x1, 16 * min(r) as y1, least(16 * (max(c) + 1) + 32, 160) as x2, 16 * (max(r) + 1) - 48 as y2 from feat where label = image_id % 10 group by image_id),
att as (select image_id, patch, r, c, e3 * e3 as w from feat),
score as (select vec_id, label, i - 1 as class, k[i] as score from feat, (select unnest(range(1, 11)) as i)),
grid as (select o_orderkey as id, (300 + o_orderkey % 201)::int as h, (300 + o_custkey % 201)::int as w, (case when o_orderkey % 2 = 0 then 16 else 8 end)::int as p from orders)
"""
