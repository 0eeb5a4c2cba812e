"""Filters and orderings of file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facematch.functions.paths import EXTENSIONS, basename, components, dirname, extension, matches_glob
from facematch.shared import shared_dir


def wanted_extension(path: Column, extensions=()) -> Column:
    return F.lower(extension(basename(path))).isin(*(extensions or EXTENSIONS))


def skipped_folder(path: Column, root: str, names=(), globs=()) -> Column:
    """Whether the root or a folder below it bears one of the names (whatever the case) or fits one of the patterns."""
    every = F.concat(F.array(F.lit(root.rstrip("/").rsplit("/", 1)[-1])), components(path, root))
    low = [n.lower() for n in names]
    return F.exists(every, lambda c: (F.lower(c).isin(*low) if low else F.lit(False)) | matches_glob(c, globs))


def scan(listing: DataFrame, root: str, extensions=(), skip_dirs=(), skip_dir_globs=(), skip_files=()) -> DataFrame:
    """listing (path, ...) without what a walk would leave out, in the order of the paths' bytes."""
    path = F.col("path")
    keep = wanted_extension(path, extensions) & ~skipped_folder(path, root, skip_dirs, skip_dir_globs) & ~matches_glob(basename(path), skip_files)
    return listing.where(keep).withColumns({"basename": basename(path), "ext": F.lower(extension(basename(path)))}).orderBy("path")


def dir_transitions(listing: DataFrame) -> DataFrame:
    """The paths whose folder is another than that of the path before, in the order of paths.

    Paths are dealt by ranges; a range's first path is held against the last one of the range
    before, so no task sees all. The ranges are drawn once, which is why they are kept.
    """
    shared_dir(listing.sparkSession)
    rows = listing.select("path", dirname(F.col("path")).alias("dir")).repartitionByRange("path").withColumn("part", F.spark_partition_id()).checkpoint()
    ends = rows.groupBy("part").agg(F.max(F.struct("path", "dir")).alias("end"))  # a row for each range
    before = ends.select("part", F.lag("end.dir").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("old"))
    own = F.lag("dir").over(Window.partitionBy("part").orderBy("path"))
    first = F.row_number().over(Window.partitionBy("part").orderBy("path")) == 1
    marked = rows.withColumns({"prev": own, "first": first}).join(before, "part").withColumn("prev", F.when(F.col("first"), F.col("old")).otherwise(F.col("prev")))
    return marked.where(F.col("prev").isNull() | (F.col("prev") != F.col("dir"))).select("path", "dir")
