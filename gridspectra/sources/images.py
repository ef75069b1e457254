"""Color images: files to pixels, by the reader that Spark has for JPEG, PNG, GIF and BMP."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspectra.functions.names import stem

from .files import pair_by_key

PIXELS = "image_id string, r int, c int, red int, green int, blue int"


def images(spark: SparkSession, path: str, names: DataFrame | None = None, drop_broken: bool = False) -> DataFrame:
    """Decoded images of a folder or of one file: image_id (stem), h, w, channels, data (rows of blue, green, red and, if there, alpha).

    With `names` (name, with or without extension), only these, and a name without a file is an error. Files that cannot be decoded
    are an error unless they are to be dropped.
    """
    found = spark.read.format("image").option("dropInvalid", "true" if drop_broken else "false").load(path).select("image.*")
    sound = F.when(F.col("nChannels") > 0, F.col("nChannels")).otherwise(F.raise_error(F.concat(F.lit("no image: "), "origin")).cast("int"))
    own = found.select(stem(F.col("origin")).alias("image_id"), F.col("height").alias("h"), F.col("width").alias("w"), sound.alias("channels"), "data")
    if names is None:
        return own
    wanted = names.select(stem(F.col("name")).alias("image_id")).distinct()
    return pair_by_key(wanted, own.join(wanted, "image_id", "left_semi"), "image_id")


def pixels(decoded: DataFrame) -> DataFrame:
    """PIXELS of decoded images; gray ones have three equal channels, alpha is left out. One image at a time is taken apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, h, w, n, data in batch.itertuples(index=False):
                p = np.frombuffer(bytes(data), np.uint8).reshape(h, w, n).astype(np.int32)
                blue, green, red = (p[:, :, min(i, n - 1)].ravel() for i in range(3))
                r, c = np.indices((h, w), dtype=np.int32)
                yield pd.DataFrame({"image_id": name, "r": r.ravel(), "c": c.ravel(), "red": red, "green": green, "blue": blue})

    return decoded.select("image_id", "h", "w", "channels", "data").mapInPandas(run, PIXELS)


def low_resolution(decoded: DataFrame, to: tuple[int, int]) -> DataFrame:
    """Patches (image_id, patch, r, c, e1, e2, e3) of images at a grid of `to`: each an area-weighted triangle mean of its pixels, in [0, 1].

    An image is scaled down by a triangle as wide as two target cells, so no pixel is passed over; it is scaled up bilinearly.
    """

    def weights(n: int, m: int) -> np.ndarray:
        wide = max(n / m, 1.0)
        at = (np.arange(m) + 0.5) * (n / m)
        x = np.maximum(1 - np.abs((np.arange(n)[None, :] + 0.5 - at[:, None]) / wide), 0.0)
        return x / x.sum(axis=1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, c = (x.ravel() for x in np.indices(to, dtype=np.int32))
        for batch in batches:
            for name, h, w, n, data in batch.itertuples(index=False):
                p = np.frombuffer(bytes(data), np.uint8).reshape(h, w, n)
                low = np.einsum("ai,bj,ijk->abk", weights(h, to[0]), weights(w, to[1]), p[:, :, : min(n, 3)].astype(np.float64), optimize=True)
                low = np.rint(low).reshape(len(r), -1) / 255.0
                e3, e2, e1 = (low[:, min(i, low.shape[1] - 1)] for i in range(3))
                yield pd.DataFrame({"image_id": name, "patch": r * to[1] + c, "r": r, "c": c, "e1": e1, "e2": e2, "e3": e3})

    return decoded.select("image_id", "h", "w", "channels", "data").mapInPandas(run, "image_id string, patch int, r int, c int, e1 double, e2 double, e3 double")
