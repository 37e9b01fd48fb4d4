"""Card records as a stream: picture files as they arrive, each read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cardloom.config import Settings
from cardloom.models import Models
from cardloom.operators import extract
from cardloom.sources.decoding import with_images
from cardloom.sources.images import PATTERN

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def picture_stream(spark: SparkSession, folder: str, files_at_a_time: int = 1000) -> DataFrame:
    """``path``, ``image`` and ``error`` of pictures that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", files_at_a_time).load(folder)
    return with_images(files, "content", "path").select("path", "image", "error")


def record_stream(pictures: DataFrame, models: Models, settings: Settings, as_of: Column, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Records of a stream of pictures to Parquet files: no state, and after a restart none is lost or written twice, as the checkpoint and the files' log say what was done."""
    records = extract.extract(pictures, models, settings, as_of, card="path")
    return records.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger or {"availableNow": True}).start(out)
