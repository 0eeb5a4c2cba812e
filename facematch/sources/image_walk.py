"""A data source that walks a folder tree of images: spark.read.format("image_walk").load(root)."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from facematch.functions.paths import EXTENSIONS, glob_regex, parse_list


def _fits(name: str, patterns) -> bool:
    import re

    return any(re.match(r, name) or re.match(r, name.lower()) for r in patterns)


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class ImageWalkReader(DataSourceReader):
    """One partition for the files of the root and one for each folder in it; skipped folders aren't entered.

    Unreadable entries are left out, links to folders aren't followed, and hidden names count.
    """

    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        given = parse_list(options.get("extensions", ""))
        self.extensions = {(x if x.startswith(".") else "." + x).lower() for x in given} or set(EXTENSIONS)
        self.names = {x.lower() for x in parse_list(options.get("skipDirs", ""))}
        self.globs = [r for x in parse_list(options.get("skipDirGlobs", "")) if (r := glob_regex(x))]
        self.files = [r for x in parse_list(options.get("skipFiles", "")) if (r := glob_regex(x))]
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is no folder")

    def skipped(self, name: str) -> bool:
        return name.lower() in self.names or _fits(name, self.globs)

    def partitions(self):
        if self.skipped(os.path.basename(self.root)):
            return [_Part("", False)]
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not self.skipped(e.name))
        return [_Part(self.root, False), *(_Part(p, True) for p in below)]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.folder:
            return
        for folder, below, names in os.walk(partition.folder):
            below[:] = [d for d in below if partition.deep and not self.skipped(d)]
            for name in names:
                ext = os.path.splitext("x" + name)[1].lower()
                if ext not in self.extensions or _fits(name, self.files):
                    continue
                try:
                    stat = os.stat(path := os.path.join(folder, name))
                except OSError:
                    continue
                yield path, name, ext, stat.st_size, stat.st_mtime_ns


class ImageWalk(DataSource):
    @classmethod
    def name(cls):
        return "image_walk"

    def schema(self):
        return "path string, basename string, ext string, size long, mtime_ns long"

    def reader(self, schema):
        return ImageWalkReader(self.options)


def scan_images(spark: SparkSession, root: str, extensions=(), skip_dirs=(), skip_dir_globs=(), skip_files=()) -> DataFrame:
    """path, basename, ext, size and mtime_ns of the images below root, in the order of paths."""
    spark.dataSource.register(ImageWalk)
    options = {"extensions": extensions, "skipDirs": skip_dirs, "skipDirGlobs": skip_dir_globs, "skipFiles": skip_files}
    reader = spark.read.format("image_walk").options(**{k: ",".join(v) for k, v in options.items()})
    return reader.load(root).orderBy("path")
