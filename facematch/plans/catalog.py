"""The queries of the library, by name, and the SQL that they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facematch.assets import valid_bytes
from facematch.embedder import StubEmbedder, extract_faces
from facematch.functions import pixels
from facematch.functions.paths import basename, parse_extensions, relative
from facematch.functions.vectors import cosine_distance, l2_normalize
from facematch.operators import cache, detection, geometry, listing, matching
from facematch.operators.cache import FaceCacheTable
from facematch.plans import fixtures as fx
from facematch.shared import shared_dir
from facematch.streaming.cache_writer import write_cache

THETA = 0.65
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _r(c, alias=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(alias or c)


T = f"({THETA}::FLOAT)::DOUBLE"
PHOTOS = f"""SELECT photo_id, count(*) AS n_faces, bool_or(dist <= {T}) AS matched, min(face_index) FILTER (dist <= {T}) AS first_match_face,
 round(arg_min(dist, face_index) FILTER (dist <= {T}), 6) AS first_match_dist, round(min(dist), 6) AS best_dist,
 arg_min(idx, (dist, CASE WHEN idx < 0 THEN 1073741824 ELSE idx END)) AS best_idx FROM best GROUP BY photo_id"""


def photos(spark, sf_dir):
    return matching.match_photos(fx.faces(spark, sf_dir), fx.persona(spark, sf_dir), THETA)


@query("find_person", f"WITH {fx.BEST_SQL} {PHOTOS}")
def find_person(spark, sf_dir):
    return photos(spark, sf_dir).withColumns({"first_match_dist": _r("first_match_dist"), "best_dist": _r("best_dist")})


@query("match_any", f"WITH {fx.BEST_SQL}, p AS ({PHOTOS}) SELECT photo_id FROM p WHERE matched")
def match_any(spark, sf_dir):
    return photos(spark, sf_dir).where("matched").select("photo_id")


@query("match_none", f"WITH {fx.BEST_SQL}, p AS ({PHOTOS}) SELECT photo_id FROM p WHERE NOT matched")
def match_none(spark, sf_dir):
    return photos(spark, sf_dir).where("not matched").select("photo_id")


@query("first_match", f"WITH {fx.BEST_SQL}, p AS ({PHOTOS}) SELECT photo_id, first_match_face, first_match_dist FROM p WHERE matched")
def first_match(spark, sf_dir):
    return photos(spark, sf_dir).where("matched").select("photo_id", "first_match_face", _r("first_match_dist"))


@query("best_match", f"WITH {fx.BEST_SQL} SELECT vec_id, round(dist, 6) AS dist, idx FROM best")
def best_match(spark, sf_dir):
    return matching.with_best(fx.faces(spark, sf_dir), fx.persona(spark, sf_dir)).select("vec_id", _r("best.dist", "dist"), F.col("best.idx").alias("idx"))


@query("pairwise_distance", f"WITH {fx.BEST_SQL} SELECT vec_id, persona_idx, round(d, 6) AS dist FROM pairs")
def pairwise_distance(spark, sf_dir):
    return matching.pairwise(fx.faces(spark, sf_dir).select("vec_id", "embedding"), fx.persona(spark, sf_dir)).select("vec_id", "persona_idx", _r("dist"))


@query("cosine_distance", "SELECT a.vec_id, round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id").select("vec_id", _r(cosine_distance(F.col("embedding"), F.col("b")), "dist"))


@query("cosine_sentinel", "SELECT vec_id, 1.0::DOUBLE AS longer, 1.0::DOUBLE AS none FROM embeddings")
def cosine_sentinel(spark, sf_dir):
    v, empty = F.col("embedding"), F.array().cast("array<float>")
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", cosine_distance(v, F.slice(v, 1, 8)).alias("longer"), cosine_distance(empty, empty).alias("none"))


@query("l2_normalize", "SELECT vec_id, i, round((embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))), 3) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: x * 3) AS embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def normalized(spark, sf_dir):
    v = F.transform("embedding", lambda x: (x * F.lit(3).cast("float")).cast("float"))
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(v).alias("n"))
    return rows.select("vec_id", F.posexplode("n").alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("v").cast("double"), 3).alias("v"))


@query("persona_flatten", f"WITH {fx.PERSONA_SQL} SELECT persona_idx, vec_id FROM persona")
def persona_flatten(spark, sf_dir):
    return fx.persona(spark, sf_dir).select(F.col("persona_idx").cast("long"), "vec_id")


@query("persona_stats", f"WITH {fx.PERSONA_SQL} SELECT count(DISTINCT vec_id // 4) AS selfies, count(*) AS faces FROM persona")
def persona_stats(spark, sf_dir):
    return fx.persona(spark, sf_dir).agg(F.countDistinct(F.expr("vec_id div 4")).alias("selfies"), F.count("*").alias("faces"))


@query("run_stats", "SELECT count(*) FILTER (event_id % 13 <> 0 AND event_id % 7 <> 0) AS scanned, count(*) FILTER (event_id % 13 <> 0 AND event_id % 7 <> 0 AND value > 50) AS matched, count(*) FILTER (event_id % 13 <> 0 AND event_id % 7 = 0) AS errors, count(*) FILTER (event_id % 13 = 0) AS skipped FROM events")
def run_stats(spark, sf_dir):
    return matching.run_stats(fx.table(spark, sf_dir, "events").selectExpr("value > 50 as matched", "if(event_id % 7 = 0, 'bad', null) as err", "event_id % 13 = 0 as cancelled"))


EXT = "regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp)$')"
SKIP = "contains(lower(path), '/skip me/')"


@query("scan_images", f"WITH {fx.LISTING_SQL} SELECT path, size, mtime_ns FROM listing WHERE {EXT} AND NOT {SKIP} AND NOT regexp_matches(path, '/\\._[^/]*$')")
def scan_images(spark, sf_dir):
    return listing.scan(fx.listing(spark, sf_dir), "/archive", skip_dirs=["skip me"], skip_files=["._*"]).select("path", "size", "mtime_ns")


@query("filter_extension", f"WITH {fx.LISTING_SQL} SELECT path FROM listing WHERE {EXT}")
def filter_extension(spark, sf_dir):
    return fx.listing(spark, sf_dir).where(listing.wanted_extension(F.col("path"))).select("path")


@query("parse_extensions", "SELECT DISTINCT source, list_aggregate(list_transform(list_filter(list_transform(string_split(' ' || source || ', .' || upper(lang) || ',,png', ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: lower(CASE WHEN starts_with(x, '.') THEN x ELSE '.' || x END)), 'string_agg', ',') AS exts FROM documents")
def parsed(spark, sf_dir):
    text = F.concat(F.lit(" "), "source", F.lit(", ."), F.upper("lang"), F.lit(",,png"))
    return fx.table(spark, sf_dir, "documents").select("source", F.concat_ws(",", parse_extensions(text)).alias("exts")).distinct()


@query("filter_skip_dirs", f"WITH {fx.LISTING_SQL} SELECT path FROM listing WHERE NOT {SKIP}")
def filter_skip_dirs(spark, sf_dir):
    return fx.listing(spark, sf_dir).where(~listing.skipped_folder(F.col("path"), "/archive", ["SKIP me"])).select("path")


@query("filter_skip_dir_globs", f"WITH {fx.LISTING_SQL} SELECT path FROM listing WHERE NOT regexp_matches(path, '^/archive/(.*/)?(_[^/]*|src1[0-4])/')")
def filter_skip_dir_globs(spark, sf_dir):
    return fx.listing(spark, sf_dir).where(~listing.skipped_folder(F.col("path"), "/archive", globs=["_*", "src1[0-4]"])).select("path")


@query("filter_skip_files", f"WITH {fx.LISTING_SQL} SELECT path FROM listing WHERE NOT regexp_matches(path, '/\\._[^/]*$') AND NOT regexp_matches(path, '\\.jpe?g$')")
def filter_skip_files(spark, sf_dir):
    return fx.listing(spark, sf_dir).where(~listing.matches_glob(basename(F.col("path")), ["._*", "*.TMP", "[", "*.jpg"]) & ~F.col("path").rlike("\\.jpeg$")).select("path")


@query("match_output_paths", f"WITH {fx.LISTING_SQL} SELECT path, CASE WHEN starts_with(path, '/archive/src1/') THEN '/out/' || substr(path, 15) ELSE '/out/' || regexp_extract(path, '[^/]*$') END AS dst FROM listing")
def match_output_paths(spark, sf_dir):
    return fx.listing(spark, sf_dir).select("path", F.concat(F.lit("/out/"), relative(F.col("path"), "/archive/src1")).alias("dst"))


@query("dir_transitions", f"WITH {fx.LISTING_SQL}, d AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM listing), l AS (SELECT *, lag(dir) OVER (ORDER BY path) AS prev FROM d) SELECT path, dir FROM l WHERE prev IS NULL OR prev <> dir")
def dir_transitions(spark, sf_dir):
    return listing.dir_transitions(fx.listing(spark, sf_dir))


@query("debug_crop_names", f"WITH {fx.BEST_SQL} SELECT vec_id, printf('debug/photo%d_face%d_dist%.3f.jpg', photo_id, face_index, dist) AS name FROM best WHERE dist <= {T}")
def debug_crop_names(spark, sf_dir):
    best = matching.with_best(fx.faces(spark, sf_dir), fx.persona(spark, sf_dir)).where(F.col("best.dist") <= matching.threshold(THETA))
    return best.select("vec_id", F.format_string("debug/photo%d_face%d_dist%.3f.jpg", "photo_id", "face_index", "best.dist").alias("name"))


@query("persona_crop_names", f"WITH {fx.PERSONA_SQL} SELECT vec_id, printf('debug/persona/selfie%d_face%d.jpg', vec_id // 4, vec_id % 4) AS name FROM persona")
def persona_crop_names(spark, sf_dir):
    return fx.persona(spark, sf_dir).select("vec_id", F.format_string("debug/persona/selfie%d_face%d.jpg", F.expr("vec_id div 4"), F.col("vec_id") % 4).alias("name"))


@query("cache_lookup", f"WITH {fx.CACHE_SQL} SELECT h.path, c.faces_count FROM hashed h LEFT JOIN cached c ON h.path = c.path AND h.hash = c.hash")
def cache_lookup(spark, sf_dir):
    return cache.lookup(fx.hashed(spark, sf_dir), fx.cache(spark, sf_dir)).select("path", "faces_count")


@query("cache_state", f"WITH {fx.CACHE_SQL} SELECT h.path, CASE WHEN c.path IS NULL THEN 'miss' WHEN c.hash = h.hash THEN 'hit' ELSE 'stale' END AS state FROM hashed h LEFT JOIN cached c ON h.path = c.path")
def cache_state(spark, sf_dir):
    return cache.state(fx.hashed(spark, sf_dir), fx.cache(spark, sf_dir)).select("path", "state")


@query("cache_miss", f"WITH {fx.CACHE_SQL} SELECT path FROM hashed h WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.path = h.path AND c.hash = h.hash)")
def cache_miss(spark, sf_dir):
    return cache.misses(fx.hashed(spark, sf_dir), fx.cache(spark, sf_dir)).select("path")


@query("cache_upsert", f"""WITH {fx.CACHE_SQL}, items AS (SELECT path, hash, 7 AS faces_count, doc_id AS seq FROM hashed WHERE doc_id % 3 = 0 UNION ALL SELECT path, 'newer', 8, doc_id + 1 FROM hashed WHERE doc_id % 6 = 0),
every AS (SELECT *, -1 AS seq FROM cached UNION ALL SELECT * FROM items) SELECT path, hash, faces_count FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS n FROM every) WHERE n = 1""")
def cache_upsert(spark, sf_dir):
    h = fx.hashed(spark, sf_dir)
    items = h.where("doc_id % 3 = 0").selectExpr("path", "hash", "7 as faces_count", "doc_id as seq").union(h.where("doc_id % 6 = 0").selectExpr("path", "'newer'", "8", "doc_id + 1"))
    return cache.upserted(fx.cache(spark, sf_dir), items)


LE = "unhex(list_aggregate(list_transform(range(7, -1, -1), lambda i: substr(lpad(hex({0}), 16, '0'), i * 2 + 1, 2)), 'string_agg', ''))"


@query("file_hash", f"WITH {fx.LISTING_SQL} SELECT path, sha1(encode(path) || {LE.format('size')} || {LE.format('mtime_ns')}) AS hash FROM listing")
def file_hash(spark, sf_dir):
    return fx.listing(spark, sf_dir).select("path", cache.file_hash(F.col("path"), F.col("size"), F.col("mtime_ns")).alias("hash"))


@query("codec_roundtrip", f"WITH {fx.FACES_SQL} SELECT photo_id, (count(*) * 64 * 4)::INT AS n_bytes, true AS same FROM faces GROUP BY photo_id")
def codec_roundtrip(spark, sf_dir):
    rows = fx.faces(spark, sf_dir).groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("face_index", "embedding"))).alias("x")).select("photo_id", F.col("x.embedding").alias("faces"))
    coded = rows.withColumn("blob", pixels.encode_udf(64)("faces"))
    return coded.select("photo_id", F.length("blob").alias("n_bytes"), (pixels.decode_udf(64)("blob", F.size("faces")) == F.col("faces")).alias("same"))


@query("stub_embed", f"WITH {fx.LISTING_SQL} SELECT path, 512 AS dim, 1.0::DOUBLE AS norm2 FROM listing")
def stub_embed(spark, sf_dir):
    return fx.listing(spark, sf_dir).select("path", pixels.stub_udf()("path").alias("v")).select("path", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("norm2"))


@query("extract_faces", f"""WITH {fx.LISTING_SQL} SELECT path, doc_id % 13 = 0 AS failed, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 1 END AS n_faces, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE [0, 0, 8, 6] END::INT[] AS box FROM listing""")
def extracted(spark, sf_dir):
    """Pictures made of the listing's numbers through the stub embedder; every thirteenth can't be read, and says so."""
    pictures = _pictures(spark, sf_dir, 8, 6).join(fx.listing(spark, sf_dir), "doc_id")
    images = pictures.select("path", F.lit(8).alias("width"), F.lit(6).alias("height"), "pixels", F.when(F.col("doc_id") % 13 == 0, "unreadable").alias("err"))
    found = extract_faces(images, StubEmbedder, 1280)
    box = F.col("faces")[0]
    return found.select("path", F.col("err").isNotNull().alias("failed"), F.when(F.col("err").isNull(), F.size("faces")).otherwise(0).alias("n_faces"), F.when(F.col("err").isNull(), F.array(box["x1"], box["y1"], box["x2"], box["y2"])).alias("box"))


@query("cache_batching", f"""WITH {fx.CACHE_SQL} SELECT path, hash, faces_count FROM cached""")
def cache_batching(spark, sf_dir):
    """The cache's rows, arriving in four files as stale ones and then fresh ones, through the streaming writer."""
    folder = f"{shared_dir(spark).rstrip('/')}/cache-batching-{uuid.uuid4().hex}"
    rows = fx.cache(spark, sf_dir)
    vectors = F.transform(F.expr("if(faces_count = 0, array(), sequence(1, faces_count))"), lambda i: F.array(i.cast("float"))).alias("embeddings")
    fresh = rows.select("path", "hash", "faces_count", vectors)
    for part in (fresh.withColumn("hash", F.lit("older")), fresh):
        part.repartition(2).write.mode("append").parquet(f"{folder}/in")
        write_cache(spark, f"{folder}/in", f"{folder}/cache", f"{folder}/seen", 1).awaitTermination()
    return FaceCacheTable(spark, f"{folder}/cache").read().select("path", "hash", "faces_count")


@query("fit_dimensions", "WITH o AS (SELECT o_orderkey, 1 + o_custkey % 4000 AS w, 1 + o_orderkey % 3000 AS h FROM orders) SELECT o_orderkey, CASE WHEN greatest(w, h) <= 1280 THEN w WHEN w > h THEN 1280 ELSE greatest(1, floor(1280 * (w::DOUBLE / h))) END::INT AS width, CASE WHEN greatest(w, h) <= 1280 THEN h WHEN w > h THEN greatest(1, floor(1280 / (w::DOUBLE / h))) ELSE 1280 END::INT AS height FROM o")
def fit_dimensions(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", geometry.fit(1 + F.col("o_custkey") % 4000, 1 + F.col("o_orderkey") % 3000, 1280).alias("d")).select("o_orderkey", "d.*")


def _sampled(sx: str, sy: str, w: int, h: int) -> str:
    """SQL for a bilinear sample of channel c of the picture of doc_id, w by h, at sx, sy."""
    px = lambda x, y: f"(((doc_id * 7 + {x} * 31 + {y} * 17 + c * 5) % 256) * 257)"
    x0, y0 = f"least(greatest(floor({sx}), 0), {w - 2})", f"least(greatest(floor({sy}), 0), {h - 2})"
    fx_, fy_ = f"({sx} - {x0})", f"({sy} - {y0})"
    row = lambda y: f"({px(x0, y)} * (1 - {fx_}) + {px(f'({x0} + 1)', y)} * {fx_})"
    return f"floor(least(greatest({row(y0)} * (1 - {fy_}) + {row(f'({y0} + 1)')} * {fy_}, 0), 65535) / 256)::INT"


def _pictures(spark, sf_dir, width: int, height: int):
    """doc_id and the pixels (RGB bytes) of a picture for each document."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", pixels.pattern_udf(width, height)("doc_id").alias("pixels"))


def _channels(df, width: int, height: int):
    """doc_id, x, y, c and v of each byte of pixels."""
    at = df.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(width * height * 3)), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("int"))).alias("i", "v"))
    return at.select("doc_id", F.expr(f"i div 3 % {width}").cast("int").alias("x"), F.expr(f"i div {3 * width}").cast("int").alias("y"), (F.col("i") % 3).cast("int").alias("c"), "v")


GRID = "(SELECT doc_id, x, y, c FROM documents, (SELECT unnest(range(0, {0}))::INT AS x), (SELECT unnest(range(0, {1}))::INT AS y), (SELECT unnest(range(0, 3))::INT AS c))"


@query("resize_bilinear", f"SELECT doc_id, x, y, c, {_sampled('((x + 0.5::DOUBLE) * 7 / 4 - 0.5)', '((y + 0.5::DOUBLE) * 5 / 3 - 0.5)', 7, 5)} AS v FROM {GRID.format(4, 3)}")
def resize_bilinear(spark, sf_dir):
    return _channels(_pictures(spark, sf_dir, 7, 5).withColumn("pixels", pixels.resize_udf(7, 5, 4, 3)("pixels")), 4, 3)


@query("align_face", f"SELECT doc_id, x, y, c, {_sampled('((0.5::DOUBLE * (x - 1) - 0.25 * (y - 2)) / 0.3125)', '((0.5::DOUBLE * (y - 2) + 0.25 * (x - 1)) / 0.3125)', 12, 9)} AS v FROM {GRID.format(4, 4)}")
def align_face(spark, sf_dir):
    return _channels(_pictures(spark, sf_dir, 12, 9).withColumn("pixels", pixels.align_udf(12, 9, (0.5, 0.25, 1.0, -0.25, 0.5, 2.0), 4)("pixels")), 4, 4)


@query("fit_pixels", "SELECT doc_id, 14 AS width, 10 AS height, true AS near FROM documents")
def fit_pixels(spark, sf_dir):
    """A smooth picture of 21 by 15 keeps its values when brought down to 14: each is near the slope's."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", pixels.fit_udf(21, 15, 14)("doc_id").alias("r")).select("doc_id", "r.*")


@query("asset_validity", "SELECT doc_id, octet_length(encode(text)) >= 300 AND octet_length(encode(text)) > 0 AND left(text, 1) = upper(left(text, 1)) AS fine FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[A-Za-z]')")
def asset_validity(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").where("text rlike '^[A-Za-z]'")
    return docs.select("doc_id", valid_bytes(F.encode("text", "utf-8"), 300, F.encode(F.upper(F.substring("text", 1, 1)), "utf-8")).alias("fine"))


@query("prior_boxes", """SELECT s AS stride, i AS anchor_idx, ((i // 2) % (640 // s) + 0.5) * s / 640 AS cx, ((i // 2) // (640 // s) + 0.5) * s / 640 AS cy, (s * s // 4 * (1 + i % 2)) / 640.0::DOUBLE AS sx, (s * s // 4 * (1 + i % 2)) / 640.0::DOUBLE AS sy
FROM (SELECT s, unnest(range(0, 2 * (640 // s) * (640 // s))) AS i FROM (SELECT unnest([8, 16, 32]) AS s))""")
def prior_boxes(spark, sf_dir):
    return detection.prior_boxes(spark)


@query("split_concat", "SELECT i AS anchor_idx, (CASE WHEN i < 12800 THEN 8 WHEN i < 16000 THEN 16 ELSE 32 END) AS stride, i - (CASE WHEN i < 12800 THEN 0 WHEN i < 16000 THEN 12800 ELSE 16000 END) AS local_idx, score FROM (SELECT (l_partkey * 7 + l_orderkey) % 16800 AS i, [1 - l_discount, l_discount][2] AS score FROM lineitem)")
def split_concat(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("(l_partkey * 7 + l_orderkey) % 16800 as anchor_idx", "array(1 - l_discount, l_discount) as conf")
    return detection.split_concat(rows).select("anchor_idx", "stride", "local_idx", F.col("conf")[1].alias("score"))


BOX = "round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2"


def _box():
    return [F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")]


@query("decode_boxes", f"WITH {fx.RAW_SQL} SELECT image, line, {BOX} FROM decoded")
def decode_boxes(spark, sf_dir):
    return detection.decode_boxes(fx.raw(spark, sf_dir)).select("image", "line", *_box())


PLAIN = ", ".join(f"round((cx + ({x} + (pk % 7 - 3) * 0.15::DOUBLE) * 0.1 * edge) * 1280, 4) AS plain_x{i}, round((cy + ({y} + (sk % 5 - 2) * 0.1::DOUBLE) * 0.1 * edge) * 960, 4) AS plain_y{i}" for i, (x, y) in enumerate(fx.LANDMARKS))
BAKED = ", ".join(f"round(l{k}{i}, 4) AS {k}{i}" for i in range(5) for k in "xy")


@query("decode_landmarks", f"WITH {fx.RAW_SQL} SELECT image, line, {BAKED}, {PLAIN} FROM decoded")
def decode_landmarks(spark, sf_dir):
    both = detection.decode_landmarks(detection.decode_landmarks(fx.raw(spark, sf_dir)).withColumnRenamed("landmarks", "baked"), baked=False)
    points = [F.round(F.col(of)[i][k], 4).alias(f"{name}{k}{i}") for of, name in (("baked", ""), ("landmarks", "plain_")) for i in range(5) for k in "xy"]
    return both.select("image", "line", *points)


@query("det_score_filter", f"WITH {fx.RAW_SQL} SELECT image, line FROM raw WHERE score >= 0.5")
def det_score_filter(spark, sf_dir):
    return fx.raw(spark, sf_dir).where("score >= 0.5").select("image", "line")


INSIDE = " AND ".join(f"lx{i} BETWEEN x1 - w * 0.1 AND x2 + w * 0.1 AND ly{i} BETWEEN y1 - h * 0.1 AND y2 + h * 0.1" for i in range(5))


@query("det_quality_filter", f"WITH {fx.RAW_SQL} SELECT image, line FROM decoded WHERE score >= 0.5 AND x2 - x1 >= 50 AND y2 - y1 >= 50 AND (x2 - x1) / (y2 - y1) BETWEEN 0.5 AND 2.0 AND {INSIDE}")
def det_quality_filter(spark, sf_dir):
    return detection.quality_faces(fx.raw(spark, sf_dir)).select("image", "line")


IOU = "(CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1) THEN (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) ELSE 0 END)::FLOAT"


@query("iou_pairs", f"WITH {fx.BOXES_SQL} SELECT a.k, a.i, b.i AS j, round({IOU.format(a='a', b='b')}::DOUBLE, 5) AS iou FROM boxes a JOIN boxes b ON a.k = b.k AND a.i < b.i")
def iou_pairs(spark, sf_dir):
    b = fx.boxes(spark, sf_dir)
    one, two = b.select("k", "i", F.struct("x1", "y1", "x2", "y2").alias("a")), b.select("k", F.col("i").alias("j"), F.struct("x1", "y1", "x2", "y2").alias("b"))
    return one.join(two, "k").where("i < j").select("k", "i", "j", F.round(detection.iou(F.col("a"), F.col("b")).cast("double"), 5).alias("iou"))


@query("nms", f"""WITH {fx.BOXES_SQL}, l AS (SELECT k, list({{'s': -s, 'i': i, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY -s, i, p, x1, y1, x2, y2) AS b FROM boxes GROUP BY k),
kept AS (SELECT k, list_reduce(list_transform(b, lambda f: [f]), lambda kept, a: CASE WHEN len(list_filter(kept, lambda q: {IOU.format(a='q', b='a[1]')} > 0.4::FLOAT)) > 0 THEN kept ELSE list_concat(kept, a) END) AS b FROM l)
SELECT k, u.i AS i FROM (SELECT k, unnest(b) AS u FROM kept)""")
def nms(spark, sf_dir):
    return detection.nms(fx.boxes(spark, sf_dir), "k", "s", ["i", "p"]).select("k", "i")


@query("topn_candidates", f"WITH {fx.RAW_SQL} SELECT image, stride, anchor_idx, score, rank FROM (SELECT image, stride, anchor_idx, score, row_number() OVER (PARTITION BY image ORDER BY score DESC, stride, anchor_idx) AS rank FROM raw) WHERE rank <= 3")
def topn_candidates(spark, sf_dir):
    return detection.top_candidates(fx.raw(spark, sf_dir), "image", 3).select("image", "stride", "anchor_idx", "score", "rank")


@query("stride_stats", f"WITH {fx.RAW_SQL} SELECT stride, greatest(max(score), 0) AS max_score, count(*) FILTER (score >= 0.5) AS n_over FROM raw GROUP BY stride")
def stride_stats(spark, sf_dir):
    return detection.stride_stats(fx.raw(spark, sf_dir)).select("stride", "max_score", "n_over")


@query("stride_first_hit", f"WITH {fx.RAW_SQL} SELECT stride, arg_min(anchor_idx, (anchor_idx, score)) FILTER (score >= 0.5) AS anchor_idx, arg_min(score, (anchor_idx, score)) FILTER (score >= 0.5) AS score FROM raw GROUP BY stride")
def stride_first_hit(spark, sf_dir):
    return detection.stride_stats(fx.raw(spark, sf_dir)).select("stride", "first.*")


def _affine_sql() -> str:
    xs, ys = [f"(t{i}x + l_quantity * {i % 3} )" for i in range(5)], [f"(t{i}y + (l_partkey % 17) * {(i + 1) % 2})" for i in range(5)]
    pts = ", ".join(f"{x!r}::DOUBLE AS t{i}x, {y!r}::DOUBLE AS t{i}y" for i, (x, y) in enumerate(geometry.TEMPLATE))
    s = lambda terms: "(" + " + ".join(terms) + ")"
    cols = f"{s(xs)} AS sx, {s(ys)} AS sy, {s([f'{x}*{x}' for x in xs])} AS sxx, {s([f'{x}*{y}' for x, y in zip(xs, ys, strict=True)])} AS sxy, {s([f'{y}*{y}' for y in ys])} AS syy, " + ", ".join(f"{s([f'{x}*t{i}{k}' for i, x in enumerate(xs)])} AS p{k}, {s([f'{y}*t{i}{k}' for i, y in enumerate(ys)])} AS q{k}, {s([f't{i}{k}' for i in range(5)])} AS r{k}" for k in "xy")
    det = lambda a, b, c, d, e, f, g, h, i: f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"
    whole = det("sxx", "sxy", "sx", "sxy", "syy", "sy", "sx", "sy", "5")
    out = []
    for k, names in (("x", "abc"), ("y", "def")):
        p, q, r = f"p{k}", f"q{k}", f"r{k}"
        out += [f"round({d} / {whole}, 4) AS {n}" for d, n in zip((det(p, "sxy", "sx", q, "syy", "sy", r, "sy", "5"), det("sxx", p, "sx", "sxy", q, "sy", "sx", r, "5"), det("sxx", "sxy", p, "sxy", "syy", q, "sx", "sy", r)), names, strict=True)]
    return f"WITH b AS (SELECT l_orderkey, l_linenumber, {cols} FROM (SELECT *, {pts} FROM lineitem)) SELECT l_orderkey, l_linenumber, {', '.join(out)} FROM b"


@query("solve_affine", _affine_sql())
def solve_affine(spark, sf_dir):
    pts = F.array(*(F.struct((F.lit(x) + F.col("l_quantity") * (i % 3)).alias("x"), (F.lit(y) + (F.col("l_partkey") % 17) * ((i + 1) % 2)).alias("y")) for i, (x, y) in enumerate(geometry.TEMPLATE)))
    out = geometry.with_affine(fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), pts)
    return out.select("l_orderkey", "l_linenumber", *(F.round(F.col("m")[c], 4).alias(c) for c in "abcdef"))
