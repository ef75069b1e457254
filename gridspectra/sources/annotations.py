"""Ground truth from VOC and COCO annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspectra.functions.boxes import from_corner
from gridspectra.functions.names import coco_number
from gridspectra.sources.files import write_json

VOC_SCHEMA = "filename string, object array<struct<name:string,truncated:string,difficult:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
COCO_SCHEMA = "images array<struct<id:long,file_name:string,height:int,width:int>>, annotations array<struct<id:long,image_id:long,iscrowd:int,category_id:int,bbox:array<double>>>, categories array<struct<id:int,name:string>>"


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    """Annotation XML files; all leaves stay strings. image_id is the file name without its extension, null where an annotation names no file."""
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path)
    return rows.withColumn("image_id", F.regexp_replace("filename", r"\.[^.]*$", ""))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One annotation row per box."""
    return spark.read.schema(COCO_SCHEMA).json(path, multiLine=True).select(F.inline("annotations"))


def is_hard(o):
    return (o["truncated"] == "1") | (o["difficult"] == "1")


def voc_boxes(annotations: DataFrame, remove_hards: bool = False) -> DataFrame:
    """Boxes with minima counted from 0; maxima stay, as far sides."""
    kept = F.filter("object", lambda o: ~is_hard(o)) if remove_hards else F.col("object")
    b = lambda n, k=0: (F.col(f"bndbox.{n}").cast("int") - k)
    return annotations.select("image_id", F.inline(kept)).select("image_id", "name", b("xmin", 1).alias("x1"), b("ymin", 1).alias("y1"), b("xmax").alias("x2"), b("ymax").alias("y2"))


def hard_images(annotations: DataFrame) -> DataFrame:
    """Images all of whose objects are truncated or difficult; also those without objects."""
    return annotations.where(F.forall("object", is_hard)).select("image_id", "filename")


def coco_boxes(annotations: DataFrame, remove_crowds: bool = True) -> DataFrame:
    kept = annotations.where("iscrowd <> 1") if remove_crowds else annotations
    x1, y1, x2, y2 = from_corner(*(F.element_at("bbox", i) for i in (1, 2, 3, 4)))
    return kept.select("image_id", "category_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def coco_subset(names: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of the images whose files are listed (name); a listed image without any has an empty list."""
    wanted = names.select(coco_number(F.col("name")).alias("image_id")).distinct()
    lists = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("category_id", "iscrowd", "bbox"))).alias("boxes"))
    return wanted.join(lists, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(lists.schema["boxes"].dataType)))


def coco_selection(names: DataFrame, coco: DataFrame) -> dict[str, DataFrame]:
    """The parts of a whole COCO file (COCO_SCHEMA) for the listed images (place, name): images and annotations, each with the place of
    its image in the list, and all categories. An image that is listed twice is there twice, as in the list; one that the file lacks has no rows.
    """
    wanted = names.select("place", coco_number(F.col("name")).alias("image_id"))
    images = coco.select(F.inline("images")).withColumnRenamed("id", "image_id")
    return {
        "images": wanted.join(images, "image_id").select("place", F.col("image_id").alias("id"), "file_name", "height", "width"),
        "annotations": wanted.join(coco.select(F.inline("annotations")), "image_id").select("place", "id", "image_id", "iscrowd", "category_id", "bbox"),
        "categories": coco.select(F.inline("categories")),
    }


def write_coco_selection(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as a folder of JSON lines below `path`, in the order of the list; annotations of an image go by id."""
    for name, part in parts.items():
        ordered = part.orderBy("place", "id").drop("place") if "place" in part.columns else part.orderBy("id")
        write_json(ordered, f"{path.rstrip('/')}/{name}")


GT = {"VOC07": voc_boxes, "VOC12": voc_boxes, "COCO20k": coco_boxes}


def ground_truth(kind: str, annotations: DataFrame, **options) -> DataFrame:
    """Boxes by name of the data set."""
    if kind not in GT:
        raise ValueError(f"unknown data set {kind}")
    return GT[kind](annotations, **options)
