"""Pictures read into rows of RGB pixels, upright by their EXIF orientation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facematch.functions.images import orientation, oriented

#: Bytes of a file that are looked at for its orientation.
HEAD = 1 << 16
PIXELS = "path string, width int, height int, pixels binary, err string"


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def decode_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, width, height, pixels (RGB, row by row) and err of the files or folders at paths.

    A file that is no picture the JVM can read has null pixels and an err. Spark leaves out files
    whose name begins with a dot or an underscore. Grey pictures get three equal channels, and the
    fourth of four is left out.
    """
    read = spark.read.format("image").option("dropInvalid", False).load(paths).select("image.*")
    heads = spark.read.format("binaryFile").load(paths).select(_plain(F.col("path")).alias("path"), F.substring("content", 1, HEAD).alias("head"))
    both = read.withColumn("path", _plain(F.col("origin"))).drop("origin", "mode").join(heads, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["width"] <= 0 or r["height"] <= 0:
                    row = r["path"], None, None, None, "no picture that can be read"
                else:
                    bgr = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                    rgb = bgr[..., 2::-1] if r["nChannels"] >= 3 else np.repeat(bgr[..., :1], 3, 2)
                    rgb = oriented(rgb, orientation(r["head"]))
                    row = r["path"], rgb.shape[1], rgb.shape[0], rgb.tobytes(), None
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["path", "width", "height", "pixels", "err"])

    return both.mapInArrow(run, PIXELS)
