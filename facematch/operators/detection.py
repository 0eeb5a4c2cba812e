"""Face-detector output to faces: anchors, decoding, quality, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed: anchor sizes by stride, variances, least face edge, landmark margin.
ANCHORS = {8: (16, 32), 16: (64, 128), 32: (256, 512)}
CENTRE_VARIANCE, SIZE_VARIANCE, MIN_FACE, MARGIN = 0.1, 0.2, 50, 0.1


def anchor(stride: Column, idx: Column, size: int = 640) -> dict[str, Column]:
    """cx, cy, sx, sy in 0..1 of an anchor by its number in its stride: rows, then columns, then sizes."""
    n = F.floor(F.lit(size) / stride)
    cell = F.floor(idx / 2)
    edge = F.lit(None)
    for s, (a, b) in ANCHORS.items():
        edge = F.when(stride == s, F.when(idx % 2 == 0, a).otherwise(b)).otherwise(edge)
    return {"cx": (cell % n + 0.5) * stride / size, "cy": (F.floor(cell / n) + 0.5) * stride / size, "sx": edge / size, "sy": edge / size}


def prior_boxes(spark: SparkSession, size: int = 640, strides=tuple(ANCHORS)) -> DataFrame:
    """All anchors (stride, anchor_idx, cx, cy, sx, sy); strides without anchors give none."""
    known = [s for s in strides if s in ANCHORS]
    base = spark.range(1).select(F.explode(F.array(*map(F.lit, known)) if known else F.array().cast("array<int>")).alias("stride"))
    n = F.floor(F.lit(size) / F.col("stride"))
    rows = base.where(n > 0).select("stride", F.explode(F.sequence(F.lit(0).cast("long"), 2 * n * n - 1)).alias("anchor_idx"))
    return rows.withColumns(anchor(F.col("stride"), F.col("anchor_idx"), size))


def split_concat(raw: DataFrame, size: int = 640) -> DataFrame:
    """raw (anchor_idx over all strides) with stride and the number within it."""
    stride, local, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in ANCHORS:
        n = 2 * (size // s) ** 2
        inside = (F.col("anchor_idx") >= at) & (F.col("anchor_idx") < at + n)
        stride, local = F.when(inside, s).otherwise(stride), F.when(inside, F.col("anchor_idx") - at).otherwise(local)
        at += n
    return raw.withColumns({"stride": stride, "local_idx": local}).where("stride is not null")


def decode_boxes(raw: DataFrame, size: int = 640) -> DataFrame:
    """raw (stride, anchor_idx, dx, dy, dw, dh, width, height) with x1, y1, x2, y2 in pixels of the image.

    The box is exploded from an array of one, so that conditions on it don't work it out again.
    """
    a = anchor(F.col("stride"), F.col("anchor_idx"), size)
    cx = (a["cx"] + F.col("dx") * CENTRE_VARIANCE * a["sx"]) * F.col("width")
    cy = (a["cy"] + F.col("dy") * CENTRE_VARIANCE * a["sy"]) * F.col("height")
    w = a["sx"] * F.exp(F.col("dw") * SIZE_VARIANCE) * F.col("width")
    h = a["sy"] * F.exp(F.col("dh") * SIZE_VARIANCE) * F.col("height")
    sized = raw.select("*", cx.alias("_cx"), cy.alias("_cy"), w.alias("_w"), h.alias("_h"))
    box = F.struct(*((F.col(f"_c{k}") + s * F.col(f"_{e}") / 2).alias(f"{k}{i}") for i, s in ((1, -1), (2, 1)) for k, e in (("x", "w"), ("y", "h"))))
    return sized.select(*raw.columns, F.inline(F.array(box)))


def decode_landmarks(raw: DataFrame, baked: bool = True, size: int = 640) -> DataFrame:
    """raw (with lm, five raw struct(x, y)) with landmarks in pixels; baked: the model has applied the variance."""
    a = anchor(F.col("stride"), F.col("anchor_idx"), size)
    k = 1.0 if baked else CENTRE_VARIANCE
    with_anchor = raw.withColumns({f"_{x}": a[x] for x in ("cx", "cy", "sx", "sy")})
    place = lambda p, i, edge: (F.col(f"_c{i}") + p[i] * k * F.col(f"_s{i}")) * F.col(edge)
    points = [F.struct(place(F.col("lm")[j], "x", "width").alias("x"), place(F.col("lm")[j], "y", "height").alias("y")) for j in range(5)]
    return with_anchor.select(*raw.columns, F.inline(F.array(F.struct(F.array(*points).alias("landmarks")))))


def quality(with_landmarks: bool = True) -> Column:
    """Faces of MIN_FACE pixels an edge, no more than twice as wide as high or the reverse, their landmarks inside but for a margin."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    fine = (w >= MIN_FACE) & (h >= MIN_FACE) & F.when(h > 0, (w / h).between(0.5, 2.0)).otherwise(False)
    if not with_landmarks:
        return fine
    for i in range(5):  # five plain conditions, as lambdas aren't compiled
        p = F.col("landmarks")[i]
        fine = fine & p["x"].between(F.col("x1") - w * MARGIN, F.col("x2") + w * MARGIN) & p["y"].between(F.col("y1") - h * MARGIN, F.col("y2") + h * MARGIN)
    return fine


def quality_faces(raw: DataFrame, least: float = 0.5, baked: bool = True, size: int = 640) -> DataFrame:
    """raw (see ``decode_boxes`` and ``decode_landmarks``, and score) of ``least`` or more with boxes and landmarks, where ``quality`` holds.

    Boxes that fail on their own go before any landmark is decoded.
    """
    boxes = decode_boxes(raw.where(F.col("score") >= least), size).where(quality(False))
    return decode_landmarks(boxes, baked, size).where(quality())


def iou(a, b) -> Column:
    """Intersection over union of two boxes, a float; 0 where they only touch or don't."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.when((w > 0) & (h > 0), w * h / (area(a) + area(b) - w * h)).otherwise(0.0).cast("float")


def nms(boxes: DataFrame, key: str, score: str, order: list[str], most: float = 0.4) -> DataFrame:
    """The boxes (x1, y1, x2, y2) of each image that no better kept box overlaps by more than ``most``.

    Better: a higher score, and of equal ones the first by ``order``. An image has as many boxes
    as its detector has anchors at most, so an image's boxes fit a row.
    """
    corners = ("x1", "y1", "x2", "y2")
    box = F.struct((-F.col(score)).alias("s"), *order, *(c for c in corners if c not in order))
    every = boxes.groupBy(key).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    none = F.array().cast(every.schema["boxes"].dataType)
    limit = F.lit(most).cast("float")
    kept = F.aggregate("boxes", none, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > limit), kept).otherwise(F.array_append(kept, b)))
    return every.select(key, F.posexplode(kept).alias("rank", "b")).select(key, "rank", "b.*").withColumn(score, -F.col("s")).drop("s")


def top_candidates(raw: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n anchors of highest score of each image, the first ones of equal score."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "stride", "anchor_idx")
    return raw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def stride_stats(raw: DataFrame, least: float = 0.5) -> DataFrame:
    """Of each stride the highest score (0 at least), the anchors of ``least`` or more, and the first of them."""
    over = F.col("score") >= least
    return raw.groupBy("stride").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("max_score"), F.count_if(over).alias("n_over"), F.min(F.when(over, F.struct("anchor_idx", "score"))).alias("first"))
