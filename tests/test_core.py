import logging
import os
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from facematch import assets, config, log
from facematch.functions import pixels
from facematch.functions.paths import glob_regex, matches_glob, relative
from facematch.functions.vectors import Nearest, best_match, cosine_distance, l2_normalize
from facematch.operators import cache, detection, geometry, matching
from facematch.plans import fixtures
from facematch.plans.catalog import ORACLES, QUERIES
from facematch.sources.image_walk import scan_images

SF = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted(tuple("-" if r[c] is None else f"{r[c] + 0.0:.5g}" if isinstance(r[c], float) else str(r[c]) for c in columns) for r in df)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = con.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert rows([dict(zip(names, map(plain, r))) for r in answer.fetchall()], columns) == rows([r.asDict() for r in df.collect()], columns)


def test_all_components_and_landmarks(spark):
    """Those that the queries l2_normalize and decode_landmarks don't show."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", l2_normalize(F.col("embedding")).alias("n")).collect()
    for r in e:
        v = np.array(r.embedding, np.float64)
        assert len(r.n) == len(v) and np.allclose(r.n, v / np.sqrt(v @ v), atol=1e-6)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{SF}/lineitem.parquet')")
    xy = ", ".join(f"lx{i}, ly{i}" for i in range(5))
    want = con.execute(f"WITH {fixtures.RAW_SQL} SELECT image, line, {xy} FROM decoded").fetchall()
    rows = detection.decode_landmarks(fixtures.raw(spark, SF)).select("image", "line", "landmarks").collect()
    got = [(r.image, r.line, *(z for p in r.landmarks for z in (p["x"], p["y"]))) for r in rows]
    in_order = lambda found: np.array(sorted(tuple(round(float(z), 3) + 0.0 for z in r) for r in found))
    assert len(got) == len(want) and np.allclose(in_order(got), in_order(want), atol=2e-3)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_distance_edges(spark):
    f = lambda *v: F.array(*map(F.lit, v)).cast("array<float>")
    none = F.array().cast("array<float>")
    got = spark.range(1).select(cosine_distance(f(2.0, 0.0), f(2.0, 0.0)).alias("a"), cosine_distance(f(1.0, 0.0), f(1.0, 0.0, 0.0)).alias("b"), cosine_distance(none, none).alias("c")).first()
    assert tuple(got) == (-3.0, 1.0, 1.0)


def test_best_match_edges(spark):
    refs = spark.createDataFrame([(0, [float("nan"), 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "persona_idx int, embedding array<float>")
    faces = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [-1.0, 0.0])], "photo_id int, face_index int, embedding array<float>")
    got = {(r.photo_id, r.face_index): tuple(r.best) for r in matching.with_best(faces, refs).collect()}
    assert got == {(1, 0): (0.5, 1), (1, 1): (1.0, -1), (2, 0): (1.0, -1)}
    every = {r.photo_id: r.matched for r in matching.match_photos(faces, refs, 1.0).collect()}
    assert every == {1: True, 2: True}
    empty = {tuple(r.best) for r in matching.with_best(faces, refs.limit(0)).collect()}
    assert empty == {(1.0, -1)}


def test_repeated_faces_stay_with_many_references(spark, monkeypatch):
    refs = spark.createDataFrame([(i, [0.1 * i, 0.5]) for i in range(5)], "persona_idx int, embedding array<float>")
    faces = spark.createDataFrame([(1, 0, [1.0, 0.0])] * 3 + [(2, 0, [0.0, 1.0])], "photo_id int, face_index int, embedding array<float>")
    found = lambda: sorted(matching.match_photos(faces, refs, 0.65).select("photo_id", "n_faces", "best_idx").collect())
    few = found()
    monkeypatch.setattr(matching, "BLOCK", 2)
    assert found() == few and [r.n_faces for r in few] == [3, 1]


def test_first_match_is_not_the_best(spark):
    refs = spark.createDataFrame([(0, [1.0])], "persona_idx int, embedding array<float>")
    faces = spark.createDataFrame([(1, 0, [0.4]), (1, 1, [0.8])], "photo_id int, face_index int, embedding array<float>")
    r = matching.match_photos(faces, refs, 0.65).first()
    assert (r.first_match_face, round(r.first_match_dist, 3), round(r.best_dist, 3)) == (0, 0.6, 0.2)


def test_nms_only_kept_boxes_suppress(spark):
    boxes = spark.createDataFrame([(1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.8, 4.0, 0.0, 14.0, 10.0), (1, 2, 0.7, 8.0, 0.0, 18.0, 10.0), (1, 3, 0.9, 20.0, 0.0, 30.0, 10.0)], "k int, i int, s double, x1 double, y1 double, x2 double, y2 double")
    assert [r.i for r in detection.nms(boxes, "k", "s", ["i"]).orderBy("rank").collect()] == [0, 3, 2]


def test_affine(spark):
    points = F.array(*(F.struct(F.lit(2 * x + 3).alias("x"), F.lit(2 * y - 1).alias("y")) for x, y in geometry.TEMPLATE))
    m = geometry.with_affine(spark.range(1), points).first().m
    assert np.allclose(m, [0.5, 0, -1.5, 0, 0.5, 0.5], atol=1e-6)
    same = F.array(*(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")) for _ in range(5)))
    assert geometry.with_affine(spark.range(1), same).first().m is None


def test_file_hash_bytes(spark):
    import hashlib

    data = [("/a/ü.jpg", 200, 1700000000123456789), ("/a/b.jpg", 5, -1)]
    df = spark.createDataFrame(data, "path string, size long, t long")
    got = [r.h for r in df.select(cache.file_hash(F.col("path"), F.col("size"), F.col("t")).alias("h")).collect()]
    assert got == [hashlib.sha1(p.encode() + s.to_bytes(8, "little", signed=True) + t.to_bytes(8, "little", signed=True)).hexdigest() for p, s, t in data]


def test_cache_table(spark, tmp_path):
    table = cache.FaceCacheTable(spark, str(tmp_path / "cache"))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", "1", [[0.5]], 0), ("a", "2", [[0.25]], 1), ("b", "1", [], 0)], "path string, hash string, embeddings array<array<float>>, seq long"))
    table.upsert(spark.createDataFrame([("b", "3", [])], "path string, hash string, embeddings array<array<float>>"))
    assert sorted((r.path, r.hash, r.faces_count) for r in table.read().collect()) == [("a", "2", 1), ("b", "3", 0)]
    with pytest.raises(ValueError):
        cache.FaceCacheTable(spark, "")


def test_codec():
    faces = [np.arange(512) * 0.01, (512 - np.arange(512)) * -0.001]
    blob = pixels.encode(faces)
    assert all(np.array_equal(a, np.float32(b)) for a, b in zip(pixels.decode(blob, 2), faces, strict=True))
    assert pixels.encode([]) == b"" and pixels.decode(b"", 0) == []
    for bad in ((blob[:-4], 2), (b"x", 0), (b"", -1)):
        with pytest.raises(ValueError):
            pixels.decode(*bad)


def test_pixels():
    image = np.random.default_rng(0).integers(0, 256, (20, 30, 3), np.uint8)
    assert np.array_equal(pixels.resize_bilinear(image, 30, 20), image)
    assert np.array_equal(pixels.align_face(image, (1, 0, 0, 0, 1, 0), 20), image[:, :20])
    assert pixels.resize_bilinear(image[:1, :1], 4, 4).shape == (4, 4, 3)
    with pytest.raises(ValueError):
        pixels.align_face(image, (0, 0, 0, 0, 0, 0))
    a, b = pixels.stub_vector(image, "p"), pixels.stub_vector(image, "q")
    assert abs(np.linalg.norm(a) - 1) < 1e-5 and not np.array_equal(a, b)


def test_walk(spark, tmp_path):
    for p in ("a.JPG", "b.txt", ".jpg", "x/c.png", "Skip/d.jpg", "x/.h/_e.webp", "x/._f.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1234")
    got = [os.path.relpath(r.path, tmp_path) for r in scan_images(spark, str(tmp_path), skip_dirs=["skip"], skip_files=["._*"]).collect()]
    assert got == sorted([".jpg", "a.JPG", "x/.h/_e.webp", "x/c.png"])
    assert scan_images(spark, str(tmp_path), skip_dirs=[tmp_path.name.upper()]).count() == 0


def test_globs_and_paths(spark):
    assert glob_regex("[") is None
    df = spark.createDataFrame([("a.tmp",), ("A.TMP",)], "n string")
    assert [r[0] for r in df.select(matches_glob(F.col("n"), ["*.tmp"])).collect()] == [True, True]
    assert [r[0] for r in df.select(matches_glob(F.col("n"), ["*.TMP", "["])).collect()] == [False, True]
    paths = spark.createDataFrame([("/r/a/x.jpg",), ("/other/x.jpg",), ("/r/..y/x.jpg",)], "p string")
    assert [r[0] for r in paths.select(relative(F.col("p"), "/r")).collect()] == ["a/x.jpg", "x.jpg", "x.jpg"]


def test_config(tmp_path):
    ini = tmp_path / "c.ini"
    ini.write_text("[paths]\ndir_search = /photos ; here\n[pipeline]\nthreshold = 0.7\nworkers = 0\n")
    c = config.load(["--threshold", "0.6"], str(ini))
    assert (c.search_dir, c.threshold, c.workers) == ("/photos", 0.6, 8)
    for bad in ({"threshold": 2.0001}, {"threshold": 0}, {"det_threshold": 0}, {"output_dir": ""}):
        with pytest.raises(ValueError):
            config.Config(**bad)
    assert config.Config(threshold=2, nms_iou=1).threshold == 2
    with pytest.raises(OSError):
        config.load([], str(tmp_path / "none.ini"))


def test_log():
    record = logging.LogRecord("x", logging.WARNING, "", 0, "hello", (), None)
    record.fields = {"a": 1, "g": {"b": 2}}
    assert log.Formatter().format(record).endswith("WARNING hello a=1 g.b=2")
    assert "\x1b[" in log.Formatter(True).format(record)
    assert [log.parse_level(x) for x in ("debug", " WARN ", "bogus", "")] == [10, 30, 20, 20]
    assert log.use_colour("always") and not log.use_colour("never")


def test_assets(tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_bytes(b"\x08\x06" + b"x" * 100)
    bad.write_bytes(b"<html>")
    dst = tmp_path / "m" / "model"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "model.tmp").write_bytes(b"left over")
    assert assets.ensure(str(dst), bad.as_uri(), [good.as_uri()], 50, b"\x08\x06")
    assert not assets.ensure(str(dst), "", (), 50, b"\x08\x06")
    assert dst.read_bytes() == good.read_bytes() and os.listdir(tmp_path / "m") == ["model"]
    with pytest.raises(OSError):
        assets.ensure(str(tmp_path / "no"), bad.as_uri(), (), 50)


def test_stream_into_cache(spark, tmp_path):
    from facematch.streaming.cache_writer import write_cache

    arriving, folder = str(tmp_path / "in"), str(tmp_path / "cache")
    rows = [("a", "1", 1, [[0.5]]), ("b", "1", 0, [])]
    spark.createDataFrame(rows, cache.SCHEMA).coalesce(1).write.parquet(arriving)
    write_cache(spark, arriving, folder, str(tmp_path / "ck")).awaitTermination(60)
    spark.createDataFrame([("a", "2", 1, [[0.25]])], cache.SCHEMA).coalesce(1).write.mode("append").parquet(arriving)
    write_cache(spark, arriving, folder, str(tmp_path / "ck")).awaitTermination(60)
    got = cache.FaceCacheTable(spark, folder).read().collect()
    assert sorted((r.path, r.hash, r.faces_count) for r in got) == [("a", "2", 1), ("b", "1", 0)]


def test_best_match_equals_plain_distances(spark, monkeypatch):
    """All kinds of vectors, in one piece and in several, against distances worked out number by number."""
    rng, bad = np.random.default_rng(5), float("nan")
    some = rng.normal(size=(60, 8)).astype(np.float32) / 3
    odd = [None, [], [0.0] * 8, [0.5] * 3, [bad] * 8, [None, *[0.5] * 7], [float("inf"), *[0.5] * 7], [1e-9] * 8, [3e38] * 8, [5e-9] * 8]
    odd = [x and [None if v is None else float(np.float32(v)) for v in x] for x in odd]
    refs = [*some[:40].tolist(), *odd, *some[:5].tolist(), (some[3] * np.float32(1 + 1e-7)).tolist()]
    probes = [*some.tolist(), *odd, [0.0, *[1.0] * 7]]

    def plain(x):
        found = [(1.0, 1 << 30)]
        for i, y in enumerate(refs):
            if x and y and len(x) == len(y) and None not in x and None not in y:
                dot = 0.0
                for a, b in zip(x, y, strict=True):
                    dot += a * b
                found += [(1.0 - dot, i)] * (1.0 - dot < 1.0)
        dist, i = min(found)
        return dist, -1 if i == 1 << 30 else i

    persona = spark.createDataFrame(list(enumerate(refs)), "persona_idx int, embedding array<float>")
    faces = spark.createDataFrame(list(enumerate(probes)), "photo_id int, embedding array<float>")
    want = {i: plain(x) for i, x in enumerate(probes)}
    found = lambda: {r.photo_id: tuple(r.best) for r in matching.with_best(faces, persona).collect()}
    assert found() == want
    monkeypatch.setattr(matching, "BLOCK", 7)
    assert found() == want
    monkeypatch.setattr(matching, "MOST_BROADCAST", 20)
    assert found() == want


def test_many_references_in_little_time(spark):
    """5000 references: no row for a pair, and no expression over all references beside each face."""
    e = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.sin(F.col("id") * 1.7 + k * F.col("id") * 0.31).cast("float"))
    persona = spark.range(5000).select(F.col("id").alias("persona_idx"), e.alias("embedding"))
    faces = spark.range(5000, 25000).select(F.col("id").alias("photo_id"), e.alias("embedding"))
    best = matching.with_best(faces, persona)
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(best._jdf.queryExecution().toString().replace("(", " ").split())
    began = time.perf_counter()
    assert best.where("best.idx >= 0").count() == 20000
    assert time.perf_counter() - began < 60


def test_many_references_are_prepared_once_a_worker(spark):
    """Tasks are as many as cores ask for, not as partitions of a shuffle, and don't each prepare the references."""
    e = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.sin(F.col("id") * 1.7 + k * F.col("id") * 0.31).cast("float"))
    persona = spark.range(matching.BLOCK + 1).select(F.col("id").alias("persona_idx"), e.alias("embedding"))
    faces = spark.range(5000, 6000).select(F.expr("id div 4").alias("photo_id"), F.expr("cast(id % 4 as int)").alias("face_index"), e.alias("embedding"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        best = matching.with_best(faces, persona)
        assert best.rdd.getNumPartitions() <= matching.TASKS * spark.sparkContext.defaultParallelism
        assert matching.match_photos(faces, persona, 0.65).count() == 250
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sent = spark.sparkContext.broadcast((np.arange(2), pa.array([[0.5, 0.0], [0.0, 0.5]])))
    assert matching._nearest(sent, "once", 7) is matching._nearest(sent, "once", 7)
    for k in range(2 * matching.MOST_HELD):
        matching._nearest(sent, str(k), 7)
    assert len(matching._held) <= matching.MOST_HELD


def test_products_of_floats_find_what_doubles_do():
    """References that floats can't tell apart, few and many of them, and lengths that floats can't hold."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16))
    close = (base[:3, None] * (1 + 1e-7 * rng.normal(size=(3, 200, 16)))).reshape(-1, 16)
    for refs in (base, np.concatenate([base, close]), base * 1e30, base * 1e-30, base.astype(np.float32)):
        for probes in (base / np.linalg.norm(base, axis=1)[:, None], base[:3] * 1e20, base[:3] * 1e-6):
            many = pa.array(probes.astype(refs.dtype).tolist(), pa.list_(pa.from_numpy_dtype(refs.dtype)))
            dist, idx = Nearest(np.arange(len(refs)), pa.array(refs.tolist(), many.type), 100).of(many)
            for x, d, i in zip(probes.astype(refs.dtype).astype(float), dist, idx, strict=True):
                dots = np.zeros(len(refs))
                for k in range(16):
                    dots = dots + x[k] * refs[:, k].astype(float)
                least = (1.0 - dots).min()
                assert (d, i) == ((least, (1.0 - dots).argmin()) if least < 1 else (1.0, -1))
