import os
import struct
import zlib

import numpy as np
import pytest

from facematch import assets, config, embedder, log, search
from facematch.functions import images, pixels
from facematch.operators import cache, detection
from facematch.sources.images import decode_images


def png(path, image):
    """A PNG file of an image, h x w x 3 or h x w."""
    h, w = image.shape[:2]
    image = image.reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    kind = 2 if image.shape[1] == 3 * w else 0
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in image))) + chunk(b"IEND", b""))


def noise(seed, h=40, w=60):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)


def test_decode_images(spark, tmp_path):
    png(tmp_path / "a.png", noise(1))
    png(tmp_path / "grey.png", noise(2)[..., 0].copy())
    (tmp_path / "bad.png").write_bytes(b"no picture")
    got = {os.path.basename(r.path): r for r in decode_images(spark, [str(tmp_path / x) for x in ("a.png", "grey.png", "bad.png")]).collect()}
    assert np.array_equal(np.frombuffer(got["a.png"].pixels, np.uint8).reshape(40, 60, 3), noise(1)) and got["a.png"].path == str(tmp_path / "a.png")
    assert np.array_equal(np.frombuffer(got["grey.png"].pixels, np.uint8).reshape(40, 60, 3), np.repeat(noise(2)[..., :1], 3, 2))
    assert got["bad.png"].pixels is None and got["bad.png"].err


def exif(value, order="<"):
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, 1) + (struct.pack(order + "HHIHH", 0x0112, 3, 1, value, 0))
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_orientation():
    assert [images.orientation(exif(v, o)) for v in range(1, 9) for o in "<>"] == [v for v in range(1, 9) for _ in "<>"]
    assert [images.orientation(x) for x in (b"", b"\xff\xd8", b"\x89PNG", exif(6)[:30], exif(77))] == [1] * 5
    x = np.arange(6).reshape(2, 3, 1)
    want = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.transpose(1, 0, 2), 6: np.rot90(x, -1), 7: np.rot90(x, -1)[::-1][:, ::1], 8: np.rot90(x, 1)}
    want[7] = x[::-1, ::-1].transpose(1, 0, 2)
    for how, y in want.items():
        assert np.array_equal(images.oriented(x, how), y), how


def test_fit():
    assert images.fitted(4000, 3000, 1280) == (1280, 960) and images.fitted(3001, 4000, 1280) == (960, 1280)
    assert images.fitted(1280, 5, 1280) == (1280, 5) and images.fitted(5000, 1, 100) == (100, 1) and images.fitted(1333, 999, 1000) == (1000, 749)
    flat = np.full((30, 50, 3), 77, np.uint8)
    assert np.array_equal(images.fit_pixels(flat, 20), np.full((12, 20, 3), 77, np.uint8))
    assert images.fit_pixels(flat, 50) is flat


def test_tensors():
    x = noise(3, 4, 5)
    d, r = pixels.detector_tensor(x), pixels.recogniser_tensor(x)
    assert d.shape == r.shape == (3, 4, 5) and d.dtype == r.dtype == np.float32
    assert d[0, 1, 2] == float(x[1, 2, 2]) - 104 and d[2, 1, 2] == float(x[1, 2, 0]) - 123 and abs(r[1, 3, 4] - (x[3, 4, 1] / 127.5 - 1)) < 1e-6


def test_resize_against_a_plain_loop():
    x, out = noise(4, 7, 9), np.zeros((5, 4, 3), int)
    for j in range(5):
        for i in range(4):
            sx, sy = (i + 0.5) * 9 / 4 - 0.5, (j + 0.5) * 7 / 5 - 0.5
            x0, y0 = min(max(int(np.floor(sx)), 0), 7), min(max(int(np.floor(sy)), 0), 5)
            a, b = sx - x0, sy - y0
            for c in range(3):
                p = lambda u, v: float(x[v, u, c]) * 257  # noqa: B023, E731
                value = (p(x0, y0) * (1 - a) + p(x0 + 1, y0) * a) * (1 - b) + (p(x0, y0 + 1) * (1 - a) + p(x0 + 1, y0 + 1) * a) * b
                out[j, i, c] = int(min(max(value, 0), 65535)) // 256
    assert np.array_equal(pixels.resize_bilinear(x, 4, 5), out)


class Fake:
    """A detector that finds the given anchors, and a recogniser that tells the mean of its input."""

    def __init__(self, size=640, whole=True):
        n = [2 * (size // s) ** 2 for s in (8, 16, 32)]
        self.scores, self.boxes, self.marks = [[np.zeros((k, *w), np.float32) for k in n] for w in ((), (4,), (10,))]
        self.whole = whole

    def put(self, group, i, score, spread=0.2, box=(0, 0, 0, 0)):
        self.scores[group][i], self.boxes[group][i] = score, box
        points = ((-spread, -spread), (spread, -spread), (0, 0.02), (-spread, spread), (spread, spread))
        self.marks[group][i] = np.array(points, np.float32).ravel()

    def detector(self, tensor):
        assert tensor.shape == (1, 3, 640, 640)
        if not self.whole:
            return [*self.scores, *self.boxes, *self.marks]
        score = np.concatenate(self.scores)
        return [np.stack([1 - score, score], 1)[None], np.concatenate(self.boxes)[None], np.concatenate(self.marks)[None]]

    def recogniser(self, tensor):
        return [np.stack([np.r_[t.mean(), 1.0, np.zeros(510)] for t in tensor]).astype(np.float32)]


@pytest.mark.parametrize("whole", [True, False])
def test_extract_with_fake_sessions(whole):
    fake = Fake(whole=whole)
    fake.put(2, 2 * (20 * 5 + 5), 0.9)  # 256 pixels wide
    fake.put(2, 2 * (20 * 5 + 6), 0.8)  # overlaps the first too much
    fake.put(2, 2 * (20 * 14 + 14) + 0, 0.7, spread=0.0)  # its points lie on a line
    fake.put(2, 2 * (20 * 14 + 4), 0.6)
    fake.put(0, 5, 0.95)  # too small
    fake.put(1, 2 * (40 * 20 + 35) + 1, 0.4)  # not sure enough
    fake.put(2, 2 * (20 * 5 + 14), 0.85, spread=0.9)  # points outside of the box
    made = embedder.OnnxEmbedder(fake.detector, fake.recogniser, baked=True, batch=2)
    image = noise(5, 640, 640)
    boxes = made.detect(image)
    assert [round(s, 2) for *_, s in boxes] == [0.9, 0.7, 0.6]
    found, seen = made.faces(image), []
    assert [f.index for f in found] == [0, 2] and all(abs(np.linalg.norm(f.embedding) - 1) < 1e-6 for f in found)
    assert found[0].aligned.shape == (112, 112, 3) and found[0].box == tuple(int(c) for c in boxes[0][0])
    assert len(made.extract_with_debug(image, "p", lambda path, f: seen.append((path, f.index)))) == 2 and seen == [("p", 0), ("p", 2)]
    one = embedder.OnnxEmbedder(fake.detector, fake.recogniser, baked=True, batch=1).extract(image)
    assert np.allclose(one, [f.embedding for f in found])


def test_decoding_equals_the_tables(spark):
    """The arrays' decoding and suppression against the column expressions."""
    draw, rows, groups = np.random.default_rng(6), [], []
    for s in (8, 16, 32):
        n = 2 * (640 // s) ** 2
        score = np.where(draw.random(n) < 60 / n, draw.integers(50, 100, n) / 100, 0.1).astype(np.float32)
        delta, raw = draw.normal(0, 0.8, (n, 4)).astype(np.float32), draw.normal(0, 0.15, (n, 10)).astype(np.float32)
        groups.append((s, score, delta, raw))
        rows += [(1, s, i, float(score[i]), *map(float, delta[i]), 900.0, 700.0, [(float(a), float(b)) for a, b in raw[i].reshape(5, 2)]) for i in np.flatnonzero(score >= 0.5).tolist()]
    df = spark.createDataFrame(rows, "image int, stride int, anchor_idx int, score double, dx double, dy double, dw double, dh double, width double, height double, lm array<struct<x:double,y:double>>")
    kept = detection.nms(detection.quality_faces(df), "image", "score", ["stride", "anchor_idx"]).orderBy("rank").collect()
    mine = embedder.decode_faces(groups, 900, 700, 0.5, 0.4, True)
    assert len(mine) > 20 and np.allclose([[r.x1, r.y1, r.x2, r.y2] for r in kept], [b for b, *_ in mine], atol=0.01)


def test_helpers():
    assert [embedder.det_size(n, s) for n, s in ((6400, 8), (400, 32), (0, 8), (9, 0))] == [640, 640, 0, 0]
    assert [assets.percent(*x) for x in ((1, 3), (5, 5), (3, 0))] == ["33.3%", "100.0%", ""]
    with pytest.raises(ValueError):
        embedder.affine(np.ones((5, 2)))
    known = embedder.PrecomputedEmbedder({"a": [[1.0, 0.0]]})
    assert known.extract(noise(1), "a")[0].tolist() == [1.0, 0.0] and known.extract(noise(1), "b") == []


def ini(tmp_path, **more):
    text = f"[paths]\npersona_dir = {tmp_path}/me\ndir_search = {tmp_path}/all\ndir_finded = {tmp_path}/out\ndir_skip = Skip\n[pipeline]\ncache_path = {tmp_path}/cache\nthreshold = 0.05\n"
    (tmp_path / "c.ini").write_text(text + "".join(f"{k} = {v}\n" for k, v in more.items()))
    return str(tmp_path / "c.ini")


def test_search_copies_matches_and_fills_the_cache(spark, tmp_path):
    png(tmp_path / "me/a.png", noise(1))
    (tmp_path / "me/b.png").write_bytes(b"bad")
    for name, seed in (("x/one.png", 1), ("x/two.png", 2), ("Skip/three.png", 1)):
        png(tmp_path / "all" / name, noise(seed))
    (tmp_path / "all/bad.png").write_bytes(b"bad")

    class Plain(embedder.StubEmbedder):  # the same picture is the same face, wherever it lies
        def faces(self, image, salt=""):
            return super().faces(image, "")

    cfg = config.load([], ini(tmp_path))
    persona = search.load_persona(spark, cfg.persona_dir, Plain)
    assert (persona.selfies, persona.faces, persona.skipped) == (1, 1, [f"{tmp_path}/me/b.png"])
    for _ in range(2):  # the second time from the cache
        stats = search.find_person(spark, cfg, Plain)
        assert stats == {"scanned": 2, "matched": 1, "errors": 1, "skipped": 0}
    assert (tmp_path / "out/x/one.png").read_bytes() == (tmp_path / "all/x/one.png").read_bytes()
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.png")) == ["one.png"]
    held = cache.FaceCacheTable(spark, cfg.cache_path).read()
    assert sorted((os.path.basename(r.path), r.faces_count) for r in held.collect()) == [("one.png", 1), ("two.png", 1)]
    fresh = spark.createDataFrame([("p", True), ("q", False)], "path string, matched boolean")

    def broken(src, dst):
        raise OSError("full")

    assert [(r.dst, r.err) for r in search.copy_matches(fresh, "/r", "/out", broken).collect()] == [("/out/p", "full")]


def test_search_without_faces_or_selfies(spark, tmp_path):
    class Blind(embedder.StubEmbedder):
        def faces(self, image, salt=""):
            return []

    png(tmp_path / "me/a.png", noise(1))
    cfg = config.load([], ini(tmp_path))
    assert search.find_person(spark, cfg, Blind) == {"scanned": 0, "matched": 0, "errors": 0, "skipped": 0}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        search.load_persona(spark, str(tmp_path / "none"), Blind)


def test_debug_crops(spark, tmp_path):
    crop = noise(9, 112, 112)

    class Cropped(embedder.StubEmbedder):
        def faces(self, image, salt=""):
            f = super().faces(image, "")[0]
            return [embedder.Face(f.embedding, f.box, crop, f.score, 3)]

    png(tmp_path / "me/a.png", noise(1))
    png(tmp_path / "all/x/one.png", noise(1))
    png(tmp_path / "all/x/two.png", noise(2))
    search.find_person(spark, config.load(["--debug"], ini(tmp_path)), Cropped)
    made = sorted(os.path.relpath(p, tmp_path / "out/debug") for p in (tmp_path / "out/debug").rglob("*.png"))
    assert made == ["persona/a_face3.png", "x/one_face3_dist-0.000.png"] or made == ["persona/a_face3.png", "x/one_face3_dist0.000.png"]
    back = decode_images(spark, [str(tmp_path / "out/debug/persona/a_face3.png")]).first()
    assert np.array_equal(np.frombuffer(back.pixels, np.uint8).reshape(112, 112, 3), crop)
    assert not os.path.exists(tmp_path / "cache")


def test_settings(tmp_path, monkeypatch):
    path = ini(tmp_path, workers="many", io_workers=3)
    with open(path, "a") as f:
        f.write("[ml]\nlandmark_variance_baked = false\nauto_download = true\n[other]\ndebug = true\n")
    c = config.load(["--persona", "/p", "--no-download", "--coreml", "--arc-batch-size", "4"], path)
    assert (c.persona_dir, c.workers, c.io_workers, c.landmark_variance_baked, c.auto_download, c.coreml, c.arc_batch_size, c.debug) == ("/p", 8, 3, False, False, True, 4, False)
    assert c.config_path == path and "threshold=0.05" in c.summary()
    for bad in (["--threshold", "0"], ["--threshold", "x"]):
        with pytest.raises((ValueError, SystemExit)):
            config.load(bad, path)
    monkeypatch.chdir(tmp_path)
    with pytest.raises(OSError):
        config.load([])
    os.rename(path, tmp_path / "config.ini")
    assert config.load([]).search_dir == f"{tmp_path}/all"
    assert isinstance(embedder.make_embedder(c)[0], embedder.StubEmbedder) and embedder.make_embedder(c)[1] == "stub"


def test_models_and_log(tmp_path, capsys):
    import sys

    good = tmp_path / "good"
    good.write_bytes(assets.MAGIC + b"x" * (5 << 20))
    cfg = config.Config(detector_model=str(tmp_path / "d"), embedder_model=str(tmp_path / "e"), detector_model_url=good.as_uri(), embedder_model_url=(tmp_path / "none").as_uri())
    log.set_up("info", "never", sys.stderr)
    assets.ensure_models(cfg)
    assert (tmp_path / "d").exists() and not (tmp_path / "e").exists() and "recognizer model not fetched" in capsys.readouterr().err
    assets.ensure_models(config.Config(detector_model=str(tmp_path / "f"), auto_download=False))
    assert "download is off" in capsys.readouterr().err
    assert embedder.make_embedder(config.Config(detector_model=str(good), embedder_model=str(good)))[1] == "stub"  # no models inside
    tell = assets.Progress("x", 10, 0.0)
    tell.add(5)
    assert "pct=50.0%" in capsys.readouterr().err


def test_cache_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    schema = "path string, hash string, embeddings array<array<float>>"
    table = cache.FaceCacheTable(spark, str(tmp_path / "c"))
    table.upsert(spark.createDataFrame([("a", "1", []), ("b", "1", [])], schema))
    (tmp_path / "c/lists/000000000002").write_text('{"1": "rows/ha')  # a list that isn't whole
    read = lambda: sorted((r.path, r.hash) for r in table.read().collect())
    assert read() == [("a", "1"), ("b", "1")]
    table.upsert(spark.createDataFrame([("b", "2", [])], schema))
    assert read() == [("a", "1"), ("b", "2")] and (tmp_path / "c/lists/000000000003").exists()
    monkeypatch.setattr(cache.FaceCacheTable, "_put", lambda *_: (_ for _ in ()).throw(RuntimeError("dies")))
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([("a", "3", [])], schema))
    assert read() == [("a", "1"), ("b", "2")]
    monkeypatch.undo()
    for i in range(4):
        table.upsert(spark.createDataFrame([("a", str(10 + i), [])], schema))
    assert read() == [("a", "13"), ("b", "2")] and len([x for x in os.listdir(tmp_path / "c/lists") if x.isdigit()]) <= 3


def test_later_row_of_a_batch_wins(spark, tmp_path):
    from facematch.streaming.cache_writer import write_cache

    rows = [("a", str(i), 1, [[0.5]]) for i in range(9)] + [("b", "x", 0, [])]
    spark.createDataFrame(rows, cache.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    write_cache(spark, str(tmp_path / "in"), str(tmp_path / "c"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted((r.path, r.hash) for r in cache.FaceCacheTable(spark, str(tmp_path / "c")).read().collect()) == [("a", "8"), ("b", "x")]
