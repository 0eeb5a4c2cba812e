"""Quality classifier: a linear SVM over naive Bayes features (Wang and Manning 2012).

A text's n-gram indicators are hashed to ``BUCKETS``; each is scaled by its class log-count
ratio, the scaled vector has unit length, and a hinge-loss model is fitted by dual coordinate
descent (Hsieh et al. 2008). A sigmoid fitted to out-of-fold margins gives the score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facematch.llm.common import documents, held_out, with_columns

BUCKETS = 1 << 18
#: The fit uses at most this many labelled texts, those with the least hash of their id, of this many bytes at most.
MAX_TRAIN, MAX_TRAIN_BYTES = 6000, 1 << 16
C, EPOCHS, FOLDS, SMOOTH, MIX = 1.0, 12, 3, 1.0, 0.25
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes by class: A capitals, a other letters, 0 digits, white space and signs as they are.
_CLASSES = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 0x80 else 48 if 48 <= b < 58 else 32 if b in b"\t\r\x0b\x0c" else b for b in range(256))


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MIX
    return (h ^ (h >> np.uint64(31))) * _MIX >> np.uint64(64 - 18)


def _windows(flags: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(flags) - n + 1, np.uint64)
    for i in range(n):
        out = out << np.uint64(1) | flags[i : len(flags) - n + 1 + i].astype(np.uint64)
    return out


def features(text: bytes | None) -> np.ndarray:
    """Sorted buckets of the n-grams that a text has: words and pairs of words, triples of byte
    classes, and runs of eight marks that tell whether a word equals the one before it and
    whether a pair of words has come before. Null counts as empty; an empty text has one bucket,
    of the n-gram that stands for the text's ends."""
    text = text or b""
    words = text.split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    parts = [_bucket(np.zeros(1, np.uint64), 1), _bucket(h, 2)]
    if len(h) > 1:
        pairs = h[:-1] * _MIX + h[1:]
        parts.append(_bucket(pairs, 3))
        same = h[1:] == h[:-1]
        order = np.argsort(pairs, kind="stable")
        old = np.zeros(len(pairs), bool)
        old[order[1:]] = pairs[order[1:]] == pairs[order[:-1]]
        for flags, salt in ((same, 4), (old, 5)):
            if len(flags) >= 8:
                parts.append(_bucket(np.flatnonzero(np.bincount(_windows(flags, 8).astype(np.int64), minlength=256)).astype(np.uint64), salt))
    c = np.frombuffer(text.translate(_CLASSES), np.uint8)
    if len(c) > 2:
        code = c.astype(np.int32)
        code = (code[:-2] << 14 | code[1:-1] << 7 | code[2:] & 127) & 0x1FFFFF  # signs and classes are ASCII
        seen = np.zeros(1 << 21, bool) if len(code) > 1 << 16 else None
        if seen is not None:
            seen[code] = True
        parts.append(_bucket((np.flatnonzero(seen) if seen is not None else np.unique(code)).astype(np.uint64), 6))
    return np.unique(np.concatenate(parts)).astype(np.int32)


def _counts(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How many texts of class 0 and 1 have each bucket."""
    counts = np.zeros((2, BUCKETS))
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0), x] += 1
    return counts


def scaled(ratio: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The log-count ratios of a text's buckets, as a vector of unit length."""
    v = ratio[x]
    return v / max(np.sqrt(v @ v), 1e-12)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by bucket, bias and dual variables (0 to cost, by row) that minimise the hinge loss, by dual coordinate descent.

    The bias is the weight of a constant feature. Rows are unit vectors: buckets and values.
    """
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in draw.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), cost[i])  # the vector and the constant have length 1 each
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[x] += d * v
                bias += d
                alpha[i] = new
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return w, bias, alpha


def trained(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and log-count ratios by bucket, and bias.

    The weights of the scaled features are mixed with their mean magnitude, as published: all of the
    mean would be naive Bayes, all of the weights the support vector machine. Both classes cost alike.
    """
    counts = _counts(rows, y)
    smooth = counts + SMOOTH
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    pos, neg = (y > 0).sum(), (y < 0).sum()
    cost = np.where(y > 0, C * max(1.0, neg / max(1, pos)), C * max(1.0, pos / max(1, neg)))
    w, bias, _ = descend(rows, [scaled(ratio, x) for x in rows], y, cost)
    seen = counts.any(0)
    mean = np.abs(w).sum() / max(1, seen.sum())
    return np.where(seen, (1 - MIX) * mean + MIX * w, 0.0), ratio, MIX * bias


def margins(model, rows: list[np.ndarray]) -> np.ndarray:
    w, ratio, bias = model
    return np.array([w[x] @ scaled(ratio, x) + bias for x in rows], np.float64)


def sigmoid(m: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the score sigmoid(a * margin + b), by Newton's steps on the log loss with Platt's targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = m.std() or 1.0
    a, b = 1.0 / spread, np.log((pos + 1) / (neg + 1))
    for _ in range(50):
        p = sigmoid(m, a, b)
        g = np.array([((p - t) * m).sum() + 1e-6 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        hess = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        size = max(1.0, abs(step[0]) * spread / 2, abs(step[1]) / 2)
        a, b = max(1e-6, a - step[0] / size), b - step[1] / size
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: list[int]):
    """(model, a, b), or the constant score of the only class seen (0.5 if there is no label)."""
    y = np.where(np.array(labels, int) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return None, 0.0, 0.5 if not len(y) else float(y[0] > 0)
    fold = np.arange(len(y)) % FOLDS
    out = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        if own.any() and len(set(y[~own].tolist())) == 2:
            model = trained([rows[i] for i in np.flatnonzero(~own)], y[~own])
            out[own] = margins(model, [rows[i] for i in np.flatnonzero(own)])
    return (trained(rows, y), *calibrate(out, y))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], list[int]]:
    """Features and labels of the bounded sample. Ids with labels that contradict are left out; of an id's texts the one that hashes least counts."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    ids = ids.where(~held_out(F.col("doc_id"), 5, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN).select("doc_id", "y")
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(ids), "doc_id")
    least = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("doc_id", "y", "least.text")  # MAX_TRAIN rows at most

    def work(xs):
        return [pa.array([features(x).tobytes() for x in xs], pa.binary())]

    got = with_columns(least, "text", work, [("x", T.BinaryType())]).select("doc_id", "y", "x").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["x"])))
    return [np.frombuffer(r["x"], np.int32) for r in got], [r["y"] for r in got]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs, from its whole text.

    Null and empty texts get the score of a text without words. Repeated rows are scored alike.
    Without labels every score is 0.5; with one class only, that class. Other columns of docs and
    labels, whatever their names, are not looked at. An empty table gives an empty result. The fit
    is on MAX_TRAIN labelled texts of MAX_TRAIN_BYTES at most; the model, three arrays of BUCKETS
    numbers, is broadcast.
    """
    model, a, b = fit(*training_rows(docs, labels))
    sent = docs.sparkSession.sparkContext.broadcast((None if model is None else (model[0].astype(np.float32), model[1].astype(np.float32), model[2]), a, b))

    def work(texts):
        model, a, b = sent.value
        if model is None:
            return [pa.array([b] * len(texts), pa.float64())]
        return [pa.array(sigmoid(margins(model, [features(x) for x in texts]), a, b), pa.float64())]

    only = docs.select("doc_id", "text")
    out = with_columns(only, "text", work, [("score", T.DoubleType())])
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see ``score``."""
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
