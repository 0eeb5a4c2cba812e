"""The whole search: a person's vectors, an archive's faces from the cache or fresh, the matches, and their copies."""

from __future__ import annotations

import os
import shutil
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facematch.config import Config
from facematch.embedder import Embedder, extract_faces
from facematch.functions.paths import basename, extension, parse_list, relative
from facematch.log import logger
from facematch.operators import matching
from facematch.operators.cache import FaceCacheTable, file_hash
from facematch.sources.image_walk import scan_images
from facematch.sources.images import decode_images

FACE = "path string, face_index int, embedding array<float>"


@dataclass
class Persona:
    """A person: persona_idx, path, face_index and embedding of the references, how many selfies they are of, and the paths that failed."""

    references: DataFrame
    selfies: int
    faces: int
    skipped: list[str]


def load_persona(spark: SparkSession, folder: str, make: Callable[[], Embedder], debug_dir: str | None = None) -> Persona:
    """The person whose selfies are in a folder; a folder without pictures is an error.

    Selfies aren't brought to another size. Those that can't be read or embedded are skipped. The
    faces of a person are few: they are collected, and held by the driver.
    """
    paths = [r.path for r in scan_images(spark, folder).select("path").collect()]
    if not paths:
        raise ValueError(f"no selfie images in {folder}")
    found = extract_faces(decode_images(spark, paths), make, debug=debug_dir is not None, salted=True).collect()
    good = {r.path: r.faces for r in found if r.err is None}
    rows = [(p, i, f.embedding) for p in sorted(good) for i, f in enumerate(good[p])]
    if debug_dir:
        root = os.path.abspath(folder)
        os.makedirs(os.path.join(debug_dir, "persona"), exist_ok=True)
        for p in good:
            stem = os.path.splitext(os.path.relpath(p, root))[0]
            for f in good[p]:
                write_crop(f.aligned, os.path.join(debug_dir, "persona", f"{stem}_face{f.face_index}.png"))
    if not rows:
        logger().warning("persona: no faces in %d selfies of %s", len(paths), folder)
    references = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"persona_idx int, {FACE}")
    return Persona(references, len(good), len(rows), sorted(set(paths) - set(good)))


def archive(spark: SparkSession, cfg: Config) -> DataFrame:
    """path and hash of the pictures to be searched."""
    skip_dirs, skip_files, extensions = (parse_list(x) for x in (cfg.dir_skip, cfg.skip_files, cfg.extensions))
    rows = scan_images(spark, cfg.search_dir, extensions, skip_dirs, (), skip_files)
    return rows.select("path", file_hash(F.col("path"), F.col("size"), F.col("mtime_ns")).alias("hash"))


def embedded(spark: SparkSession, listing: DataFrame, make: Callable[[], Embedder], cache: FaceCacheTable | None, most: int, debug: bool = False) -> DataFrame:
    """path, hash, err and faces of listing (path, hash): those that the cache has fresh, and the others embedded now.

    What is embedded goes to the cache. Debugging needs pictures, so it passes by the cache. Paths of
    the pictures to be read are held by the driver, as Spark's file index holds them.
    """
    held = None if debug or cache is None else cache.read().select("path", "hash", "embeddings")
    todo = listing if held is None else listing.join(held, ["path", "hash"], "left_anti")
    paths = [r.path for r in todo.select("path").collect()]
    kind = "path string, hash string, err string, faces array<struct<face_index:int,embedding:array<float>,aligned:binary>>"
    out = spark.createDataFrame([], kind)
    if paths:
        made = extract_faces(decode_images(spark, paths), make, most, debug).select("path", "err", F.transform("faces", lambda f: F.struct(f["face_index"], f["embedding"], f["aligned"])).alias("faces"))
        # A file whose name Spark's reader leaves out is no picture that can be read.
        fresh = todo.join(made, "path", "left").withColumn("err", F.when(F.col("faces").isNull() & F.col("err").isNull(), "not read").otherwise(F.col("err")))
        if held is not None:
            fresh = fresh.persist()
            cache.upsert(fresh.where("err is null").select("path", "hash", F.transform("faces", lambda f: f["embedding"]).alias("embeddings")))
        out = out.unionByName(fresh)
    if held is not None:
        faces = F.transform("embeddings", lambda v, i: F.struct(i.alias("face_index"), v.alias("embedding"), F.lit(None).cast("binary").alias("aligned")))
        out = out.unionByName(listing.join(held, ["path", "hash"]).select("path", "hash", F.lit(None).cast("string").alias("err"), faces.alias("faces")))
    return out


def outcomes(found: DataFrame, persona: DataFrame, theta: float) -> DataFrame:
    """path, matched, err and, of a match, the first face that matches and its distance, for each row of found (path, err, faces)."""
    faces = found.where("err is null").select("path", F.inline("faces")).select("path", "face_index", "embedding")
    matched = matching.match_photos(faces, persona, theta, "path").where("matched").select("path", "matched", "first_match_face", "first_match_dist")
    return found.select("path", "err").join(matched, "path", "left").select("path", F.coalesce("matched", F.lit(False)).alias("matched"), "err", "first_match_face", "first_match_dist")


def copy_file(src: str, dst: str) -> None:
    """The bytes of a file, over what is there; its folders are made."""
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    shutil.copyfile(src, dst)


def copy_matches(found: DataFrame, root: str, out: str, copy: Callable[[str, str], None] = copy_file) -> DataFrame:
    """path, dst and err of each matched row of found (path, matched), after ``copy(path, dst)`` ran on an executor.

    dst is the path below root, under out; a path outside of root goes by its base name. A copy that
    fails is told by err, and no other suffers. Copying again gives the same files.
    """
    rows = found.where("matched").select("path", F.concat(F.lit(out.rstrip("/") + "/"), relative(F.col("path"), root)).alias("dst"))

    def run(batches):
        for df in batches:
            errs = []
            for src, dst in zip(df["path"], df["dst"], strict=True):
                try:
                    copy(src, dst)
                    errs.append(None)
                except OSError as e:
                    errs.append(str(e))
            yield df.assign(err=errs)

    return rows.mapInPandas(run, "path string, dst string, err string")


def write_crop(pixels: bytes | None, path: str, size: int = 112) -> bool:
    """An aligned face (RGB bytes) as a PNG file; nothing for a face without a picture."""
    if pixels is None:
        return False
    lines = b"".join(b"\0" + pixels[3 * size * y : 3 * size * (y + 1)] for y in range(size))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
    return True


def save_crops(found: DataFrame, persona: DataFrame, theta: float, root: str, debug_dir: str) -> DataFrame:
    """path and name of the crops written for the faces of found (path, faces) that match: <place below root>_face<n>_dist<d>.png."""
    faces = found.where("err is null").select("path", F.inline("faces"))
    best = matching.with_best(faces, persona).where((F.col("best.dist") <= matching.threshold(theta)) & F.col("aligned").isNotNull())
    below = relative(F.col("path"), root)
    stem = F.substring(below, F.lit(1), F.length(below) - F.length(extension(basename(below))))
    rows = best.select("path", F.concat(F.lit(debug_dir.rstrip("/") + "/"), stem, F.format_string("_face%d_dist%.3f.png", "face_index", "best.dist")).alias("name"), "aligned")

    def run(batches):
        for df in batches:
            for pixels, name in zip(df["aligned"], df["name"], strict=True):
                write_crop(pixels, name)
            yield df[["path", "name"]]

    return rows.mapInPandas(run, "path string, name string")


def find_person(spark: SparkSession, cfg: Config, make: Callable[[], Embedder], copy: Callable[[str, str], None] = copy_file) -> dict[str, int]:
    """Finds the person of cfg in its archive and copies the matches; the counters of the run.

    Without a single reference the archive isn't read, and the counters are 0.
    """
    log = logger()
    debug_dir = os.path.join(os.path.abspath(cfg.output_dir), "debug") if cfg.debug else None
    persona = load_persona(spark, cfg.persona_dir, make, debug_dir)
    log.info("persona ready", extra={"fields": {"selfies": persona.selfies, "faces": persona.faces, "skipped": len(persona.skipped)}})
    if persona.skipped:
        log.warning("persona: skipped selfies", extra={"fields": {"paths": persona.skipped}})
    none = {"scanned": 0, "matched": 0, "errors": 0, "skipped": 0}
    if not persona.faces:
        log.warning("no persona faces; the archive is left alone")
        return none
    cache = FaceCacheTable(spark, cfg.cache_path) if cfg.cache_path and not cfg.debug else None
    found = embedded(spark, archive(spark, cfg), make, cache, cfg.target_dimension, cfg.debug).persist()
    try:
        rows = outcomes(found, persona.references, cfg.threshold).persist()
        root, out = os.path.abspath(cfg.search_dir), os.path.abspath(cfg.output_dir)
        for r in copy_matches(rows, root, out, copy).toLocalIterator():
            if r.err is None:
                log.info("match copied", extra={"fields": {"src": r.path, "dst": r.dst}})
            else:
                log.error("copy failed", extra={"fields": {"src": r.path, "dst": r.dst, "err": r.err}})
        if debug_dir:
            save_crops(found, persona.references, cfg.threshold, root, debug_dir).count()
        stats = matching.run_stats(rows.withColumn("cancelled", F.lit(False))).first().asDict()
        rows.unpersist()
    finally:
        found.unpersist()
    log.info("done", extra={"fields": stats})
    return none | stats
