"""Detectors as table functions: one picture to its boxes, used from SQL by LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import kernels
from cardloom.models import Detector, loaded

BOXES = "ord int, cls string, confidence double, x1 double, y1 double, x2 double, y2 double"


def register_detector(spark: SparkSession, name: str, load: Callable[[], Detector], least: float = 0.0) -> None:
    """Make a detector a table function of a picture (Spark's struct): its boxes of at least that confidence, in the order of their report; a null picture has none.

    ``SELECT p.path, b.* FROM pictures p, LATERAL name(p.image) b``. The model is loaded once in each worker.
    """

    class Boxes:
        def eval(self, image: Row) -> Iterator[tuple]:
            if image is None or image["data"] is None:
                return
            shape = (image["height"], image["width"], image["nChannels"])
            picture = kernels.to_bgr(np.frombuffer(image["data"], np.uint8).reshape(shape))
            for k, (cls, confidence, *box) in enumerate(b for b in loaded(name, load)(picture) if b[1] >= least):
                yield k, str(cls), float(confidence), *map(float, box)

    spark.udtf.register(name, F.udtf(Boxes, returnType=BOXES))
