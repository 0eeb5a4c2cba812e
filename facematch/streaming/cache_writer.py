"""Face vectors that arrive as files are upserted into the cache, batch by batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from facematch.operators.cache import SCHEMA, FaceCacheTable


def write_cache(spark: SparkSession, arriving: str, cache: str, checkpoint: str, files: int = 200, every: str | None = None):
    """A running query; with ``every`` (such as "1 second") it goes on, else it ends when all files are in.

    Of a path that comes twice in a batch the later one wins: by the file's time, then its name, then
    the row's place in it. A batch that is run again gives the same cache; nothing is dropped.
    """
    table = FaceCacheTable(spark, cache)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(arriving)
    later = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("later")
    writer = stream.select("path", "hash", "embeddings", later).writeStream.foreachBatch(lambda df, _: table.upsert(df, "later")).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
