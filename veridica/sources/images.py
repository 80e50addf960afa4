"""Image files as rows: decoded by Spark's own reader, reduced to small grey pictures and average hashes, met with labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifest import IMAGE_GLOB
from ..schema import STAGE_NAMES


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to the root, height, width, channels, data, fault): every image file under ``root``, decoded in the JVM.

    ``data`` holds rows of pixels, blue first, in one byte a channel. A file that is no image has fault "undecodable" and nulls.
    """
    base = "/" + root.rstrip("/").split("://")[-1].split(":")[-1].strip("/") + "/"
    read = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(root)
    fine = F.col("image.height") > 0
    known = [F.when(fine, F.col(f"image.{c}")).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    path = F.url_decode(F.replace(F.substring_index("image.origin", base, -1), F.lit("+"), F.lit("%2B")))
    return read.select(path.alias("path"), *known, F.when(~fine, "undecodable").alias("fault"))


def reduction(size: int, to: int) -> np.ndarray:
    """(to, size): the weights of a triangle filter as wide as the reduction, in units of 2**-22, as imaging libraries take them."""
    scale = size / to
    reach = max(scale, 1.0)
    out = np.zeros((to, size), dtype=np.int64)
    for k in range(to):
        centre = (k + 0.5) * scale
        low, high = max(int(centre - reach + 0.5), 0), min(int(centre + reach + 0.5), size)
        w = np.maximum(1 - np.abs((np.arange(low, high) - centre + 0.5) / reach), 0)
        out[k, low:high] = (w / w.sum() * (1 << 22) + 0.5).astype(np.int64)
    return out


def small_grey(data: bytes, height: int, width: int, channels: int, size: int = 8) -> np.ndarray:
    """(size, size) grey values: luma by the usual weights, reduced along rows and then along columns, rounded after each."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.int64)
    grey = x[..., 0] if channels == 1 else (x[..., 2] * 19595 + x[..., 1] * 38470 + x[..., 0] * 7471 + 0x8000) >> 16
    half = 1 << 21
    rows = np.clip((grey @ reduction(width, size).T + half) >> 22, 0, 255)
    return np.clip((reduction(height, size) @ rows + half) >> 22, 0, 255)


def image_hashes(images: DataFrame) -> DataFrame:
    """(path, h, fault): the average hash of ``read_images``' rows, 64 bits of which the first is the highest; null with a fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for data, height, width, channels in zip(*(b.column(c).to_pylist() for c in ("data", "height", "width", "channels")), strict=True):
                if data is None:
                    found.append(None)
                    continue
                x = small_grey(data, height, width, channels).ravel()
                found.append(int.from_bytes(np.packbits(64 * x > x.sum()).tobytes(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.int64()), b.column("fault")], ["path", "h", "fault"])

    return images.mapInArrow(run, "path string, h long, fault string")


def labelled_images(manifest: DataFrame, images: DataFrame, path: str = "image_path", stage: str = "macro_stage", strict: bool = True) -> DataFrame:
    """``manifest`` with label (the stage's number) and the pixels of its file. A missing or undecodable file or an unknown stage
    fails the job; without ``strict`` it is told in ``fault``."""
    names = F.array(*map(F.lit, STAGE_NAMES))
    label = F.nullif(F.array_position(names, F.col(stage)), F.lit(0)) - 1
    met = manifest.join(images.withColumn("_there", F.lit(True)).withColumnRenamed("path", path), path, "left")
    fault = F.when(F.col("_there").isNull(), "missing").otherwise(F.coalesce("fault", F.when(label.isNull(), "unknown stage")))
    out = met.withColumn("label", label.cast("int")).withColumn("fault", fault).drop("_there")
    if strict:
        out = out.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(" ", "fault", path)).cast("string")))
    return out
