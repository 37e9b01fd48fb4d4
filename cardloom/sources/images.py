"""Pictures as rows: files, their decoding, and where records go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
PATTERN = "*.{" + ",".join(e for x in EXTENSIONS for e in (x, x.upper())) + "}"


def image_files(spark: SparkSession, *paths: str) -> DataFrame:
    """``path``, ``source`` (its last part), ``length``, ``content`` of picture files; folders are not searched below."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(list(paths))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("source"), "length", "content")


def decoded_images(spark: SparkSession, *paths: str) -> DataFrame:
    """Blue-green-red pictures, with an ``error`` instead of an exception where one can't be decoded."""
    images = spark.read.format("image").option("dropInvalid", "false").load(list(paths))
    bad = (F.col("image.height") < 1) | F.col("image.data").isNull()
    return images.select(F.col("image.origin").alias("path"), "image", F.when(bad, "the file could not be decoded").alias("error"))


def write_json(records: DataFrame, path: str) -> None:
    records.write.option("ignoreNullFields", "false").json(path)
