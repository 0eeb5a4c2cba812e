"""Inputs of the queries, derived from the supplied tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persona(spark, sf_dir):
    """The person's references; a person has few, so one task numbers them."""
    rows = table(spark, sf_dir, "embeddings").where("label = 0 and vec_id % 2 = 0").select("vec_id", "embedding")
    return rows.agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("x")).select(F.posexplode("x").alias("persona_idx", "x")).select("persona_idx", "x.*")


def faces(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("not (label = 0 and vec_id % 2 = 0)")
    return rows.select(F.expr("vec_id div 4").alias("photo_id"), (F.col("vec_id") % 4).cast("int").alias("face_index"), "vec_id", "embedding")


PERSONA_SQL = "persona AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS persona_idx, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label = 0 AND vec_id % 2 = 0)"
FACES_SQL = "faces AS (SELECT vec_id // 4 AS photo_id, vec_id % 4 AS face_index, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE NOT (label = 0 AND vec_id % 2 = 0))"
BEST_SQL = f"""{PERSONA_SQL}, {FACES_SQL},
pairs AS (SELECT photo_id, face_index, f.vec_id, persona_idx, 1 - list_inner_product(f.e, p.e) AS d FROM faces f CROSS JOIN persona p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY photo_id, face_index ORDER BY d, persona_idx) AS rn FROM pairs),
best AS (SELECT photo_id, face_index, vec_id, CASE WHEN d < 1 THEN d ELSE 1.0 END AS dist, CASE WHEN d < 1 THEN persona_idx ELSE -1 END AS idx FROM ranked WHERE rn = 1)"""

LISTING = """doc_id, concat('/archive/', case doc_id % 11 when 3 then 'Skip Me/' when 5 then '_under/' else '' end, source, '/', lang, '/',
 case doc_id % 7 when 1 then '._' else '' end, 'img', doc_id,
 case doc_id % 6 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png' when 3 then '.webp' when 4 then '.tmp' else '.txt' end) as path,
 n_chars as size, 1700000000000000000 + doc_id * 1000000007 as mtime_ns"""
LISTING_SQL = f"listing AS (SELECT {LISTING} FROM documents)"


def listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(*_split(LISTING))


def _split(items: str) -> list[str]:
    """The top-level items of a select list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(items):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(items[at:i])
            at = i + 1
    return [*out, items[at:]]


def hashed(spark, sf_dir):
    return listing(spark, sf_dir).selectExpr("doc_id", "path", "md5(concat(path, cast(size as string))) as hash")


def cache(spark, sf_dir):
    return hashed(spark, sf_dir).where("doc_id % 5 <> 0").selectExpr("path", "if(doc_id % 4 = 0, 'stale', hash) as hash", "cast(doc_id % 3 as int) as faces_count")


CACHE_SQL = f"""{LISTING_SQL}, hashed AS (SELECT doc_id, path, md5(path || size) AS hash FROM listing),
cached AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'stale' ELSE hash END AS hash, (doc_id % 3)::INT AS faces_count FROM hashed WHERE doc_id % 5 <> 0)"""

BOXES = """l_orderkey as k, l_linenumber as i, l_partkey as p, l_discount * 10 as s,
 cast(l_partkey % 200 as double) as x1, cast(l_suppkey % 100 as double) as y1,
 cast(l_partkey % 200 as double) + 60 + l_quantity as x2, cast(l_suppkey % 100 as double) + 60 + l_quantity as y2"""
BOXES_SQL = f"boxes AS (SELECT {BOXES} FROM lineitem)"


def boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(BOXES))


STRIDE = "(case l_partkey % 3 when 0 then 8 when 1 then 16 else 32 end)"
RAW = f"""l_orderkey as image, l_linenumber as line, {STRIDE} as stride,
 (l_partkey + cast(7 * l_quantity as bigint)) % (case l_partkey % 3 when 0 then 12800 when 1 then 3200 else 800 end) as anchor_idx,
 l_discount * 10 as score, (l_quantity - 25) / 25 as dx, (l_tax * 100 - 4) / 4 as dy, (l_quantity - 25) / 8 as dw, cast(l_partkey % 9 - 4 as double) as dh,
 1280.0 as width, 960.0 as height, l_partkey as pk, l_suppkey as sk"""
LANDMARKS = ((-0.2, -0.2), (0.2, -0.2), (0.0, 0.0), (-0.15, 0.2), (0.15, 0.2))


def raw(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_split(RAW)).withColumns({"width": F.lit(1280.0), "height": F.lit(960.0)})
    point = lambda x, y: F.struct((F.lit(x) + (F.col("pk") % 7 - 3) * 0.15).alias("x"), (F.lit(y) + (F.col("sk") % 5 - 2) * 0.1).alias("y"))
    return rows.withColumn("lm", F.array(*(point(x, y) for x, y in LANDMARKS)))


#: raw, then cx, cy, sx, sy of the anchor, then the box and its landmarks (baked and not) in pixels.
RAW_SQL = f"""raw AS (SELECT {RAW} FROM lineitem),
anchored AS (SELECT *, ((anchor_idx // 2) % (640 // stride) + 0.5) * stride / 640 AS cx, ((anchor_idx // 2) // (640 // stride) + 0.5) * stride / 640 AS cy,
 (stride * stride // 4 * (1 + anchor_idx % 2)) / 640.0::DOUBLE AS edge FROM raw),
centred AS (SELECT *, (cx + dx * 0.1 * edge) * 1280 AS px, (cy + dy * 0.1 * edge) * 960 AS py, edge * exp(dw * 0.2) * 1280 AS w, edge * exp(dh * 0.2) * 960 AS h FROM anchored),
decoded AS (SELECT *, px - w / 2 AS x1, py - h / 2 AS y1, px + w / 2 AS x2, py + h / 2 AS y2,
 {", ".join(f"(cx + ({x} + (pk % 7 - 3) * 0.15::DOUBLE) * edge) * 1280 AS lx{i}, (cy + ({y} + (sk % 5 - 2) * 0.1::DOUBLE) * edge) * 960 AS ly{i}" for i, (x, y) in enumerate(LANDMARKS))} FROM centred)"""
