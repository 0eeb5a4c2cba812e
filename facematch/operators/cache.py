"""The cache of face vectors, keyed by path and fresh by hash."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, hash string, faces_count int, embeddings array<array<float>>"


def _little_endian(n: Column) -> Column:
    """The eight bytes of a long, the lowest first."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(n), 16, "0"), F.lit("(..)"))
    return F.unhex(F.concat_ws("", F.reverse(pairs)))


def file_hash(path: Column, size: Column, mtime_ns: Column) -> Column:
    """Hex SHA-1 of the path's UTF-8 bytes, the size and the time, eight bytes each, lowest first."""
    return F.sha1(F.concat(F.encode(path, "utf-8"), _little_endian(size), _little_endian(mtime_ns)))


def lookup(current: DataFrame, cache: DataFrame) -> DataFrame:
    """current (path, hash) with what the cache has for the same path and hash, null columns on a miss."""
    return current.join(cache, ["path", "hash"], "left")


def state(current: DataFrame, cache: DataFrame) -> DataFrame:
    """current with state: hit, stale (another hash) or miss."""
    held = cache.select("path", F.col("hash").alias("_held"))
    found = F.when(F.col("_held").isNull(), "miss").when(F.col("_held") == F.col("hash"), "hit").otherwise("stale")
    return current.join(held, "path", "left").withColumn("state", found).drop("_held")


def misses(current: DataFrame, cache: DataFrame) -> DataFrame:
    return current.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def upserted(cache: DataFrame, items: DataFrame, order: str = "seq") -> DataFrame:
    """The cache after items (path, hash, ..., order), the one of highest order (a number or a struct) for each path."""
    own = cache.columns
    kind = items.schema[order].dataType
    every = cache.withColumn(order, F.lit(None).cast(kind)).unionByName(items.select(*own, order))
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.col(order).desc_nulls_last()))
    return every.withColumn("_n", last).where("_n = 1").select(*own)


class FaceCacheTable:
    """A cache in a folder, its rows in BUCKETS by the hash of their path.

    An upsert writes the buckets that it touches anew, and then a numbered list of where all buckets
    are. The highest list that is whole counts, so readers see all of an upsert or nothing of it, and
    a writer that dies leaves the table as it was. Of two writers at once the second tries again on
    what the first one left. Buckets that the last two lists don't name are deleted.
    """

    BUCKETS, KEPT = 64, 2

    def __init__(self, spark: SparkSession, folder: str):
        if not folder:
            raise ValueError("a cache needs a folder")
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self._path("lists").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def _list(self, name: str) -> dict[str, str] | None:
        """The buckets that a list names, by number; None for one that isn't whole."""
        stream = self.fs.open(self._path(f"lists/{name}"))
        try:
            text = self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
        finally:
            stream.close()
        try:
            return json.loads(bytes(text))
        except ValueError:
            return None

    def _current(self) -> tuple[int, dict[str, str]]:
        """The highest number that is taken, and the buckets that count."""
        names = [x for x in self._names("lists") if x.isdigit()]
        for name in reversed(names):
            if (found := self._list(name)) is not None:
                return int(names[-1]), found
        return (int(names[-1]) if names else 0), {}

    def _rows(self, places) -> DataFrame:
        paths = [f"{self.folder}/{p}" for p in places]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        return self._rows(sorted(self._current()[1].values()))

    def lookup(self, current: DataFrame) -> DataFrame:
        return lookup(current, self.read())

    def state(self, current: DataFrame) -> DataFrame:
        return state(current, self.read())

    def misses(self, current: DataFrame) -> DataFrame:
        return misses(current, self.read())

    def upsert(self, items: DataFrame, order: str = "seq") -> None:
        """items: path, hash, embeddings, and ``order`` where a path may come twice: the highest wins. Photos without a face are cached too."""
        if order not in items.columns:
            items = items.withColumn(order, F.lit(0).cast("long"))
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.BUCKETS)).cast("int")
        items = items.withColumns({"faces_count": F.size("embeddings"), "bucket": bucket})
        touched = [r.bucket for r in items.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        while touched:
            number, places = self._current()
            folder = f"rows/{uuid.uuid4().hex}"
            new = upserted(self._rows([places[str(b)] for b in touched if str(b) in places]), items, order)
            new.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}")
            if self._put(number + 1, places | {str(b): f"{folder}/bucket={b}" for b in touched}):
                break
        self.vacuum()

    def _put(self, number: int, places: dict[str, str]) -> bool:
        """Writes a list under its number; False if another writer has taken it."""
        try:
            stream = self.fs.create(self._path(f"lists/{number:012d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        try:
            stream.write(json.dumps(places).encode())
        finally:
            stream.close()
        return True

    def vacuum(self) -> None:
        """Deletes the lists before the last KEPT ones, and the buckets that only they name. Readers of those must be done."""
        whole = [(x, found) for x in self._names("lists") if x.isdigit() and (found := self._list(x)) is not None]
        kept = {p for _, found in whole[-self.KEPT :] for p in found.values()}
        gone = {p for _, found in whole[: -self.KEPT] for p in found.values()} - kept
        for name in [*gone, *(f"lists/{x}" for x, _ in whole[: -self.KEPT])]:
            self.fs.delete(self._path(name), True)
