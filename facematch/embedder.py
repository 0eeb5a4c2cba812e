"""Embedders: from a picture to the vectors of its faces."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facematch.functions.images import fit_pixels
from facematch.functions.pixels import align_face, detector_tensor, normalized, recogniser_tensor, resize_bilinear, stub_vector
from facematch.log import logger
from facematch.operators.detection import ANCHORS, CENTRE_VARIANCE, MARGIN, MIN_FACE, SIZE_VARIANCE
from facematch.operators.geometry import TEMPLATE

FACE = 112


@dataclass
class Face:
    """A face: its unit vector, its box in whole pixels, the aligned picture, the detector's score and its number among the detections."""

    embedding: np.ndarray
    box: tuple[int, int, int, int]
    aligned: np.ndarray | None
    score: float
    index: int


class Embedder(ABC):
    """What turns pictures into faces. One lives in each Python worker; ``close`` ends it."""

    @abstractmethod
    def faces(self, image: np.ndarray, salt: str = "") -> list[Face]:
        """The faces of an image (h x w x 3, uint8), in the order of their scores."""

    def extract(self, image: np.ndarray, salt: str = "") -> list[np.ndarray]:
        return [f.embedding for f in self.faces(image, salt)]

    def extract_with_debug(self, image: np.ndarray, path: str, sink: Callable[[str, Face], None] | None) -> list[np.ndarray]:
        """The vectors, after the sink has seen every face with its path."""
        found = self.faces(image, "")
        for f in found:
            if sink:
                sink(path, f)
        return [f.embedding for f in found]

    def close(self) -> None:
        """Nothing to end here."""


class StubEmbedder(Embedder):
    """One face for each picture, its vector made of its pixels; for trying things out."""

    def faces(self, image, salt=""):
        h, w = image.shape[:2]
        return [Face(stub_vector(image, salt), (0, 0, w, h), None, 1.0, 0)]


class PrecomputedEmbedder(Embedder):
    """The vectors that a path is known to have, by its salt; none for other paths."""

    def __init__(self, known: dict[str, list[list[float]]]):
        self.known = known

    def faces(self, image, salt=""):
        return [Face(np.asarray(v, np.float32), (0, 0, 0, 0), None, 1.0, i) for i, v in enumerate(self.known.get(salt, ()))]


def det_size(cells: int, stride: int) -> int:
    """The edge of the detector's input, from the cells and the stride of one output group; 0 for an empty one."""
    return int(np.sqrt(cells)) * stride if cells > 0 and stride > 0 else 0


def split_groups(scores: np.ndarray, boxes: np.ndarray, landmarks: np.ndarray, size: int) -> list[tuple]:
    """(stride, scores, boxes, landmarks) by stride, of outputs over all anchors; the second of two score channels counts."""
    scores, at, out = scores.reshape(-1, 2)[:, 1], 0, []
    for stride in ANCHORS:
        n = 2 * (size // stride) ** 2
        out.append((stride, scores[at : at + n], boxes.reshape(-1, 4)[at : at + n], landmarks.reshape(-1, 10)[at : at + n]))
        at += n
    return out


def decode_faces(groups: list[tuple], width: int, height: int, least: float, most_overlap: float, baked: bool) -> list[tuple]:
    """(box, landmarks, score) of the faces of one image, best first, after the quality rules and suppression.

    The same rules as ``operators.detection`` has for tables, in floats, over one image's arrays.
    """
    boxes, marks, probs = [np.zeros((0, 4), np.float32)], [np.zeros((0, 5, 2), np.float32)], [np.zeros(0, np.float32)]
    for stride, score, delta, raw in groups:
        if stride not in ANCHORS or not len(score):
            continue
        size = det_size(len(score) // 2, stride)
        n = size // stride
        cell, edge = np.arange(len(score)) // 2, np.tile(np.array(ANCHORS[stride], np.float32), len(score) // 2) / np.float32(size)
        centre = np.stack([(cell % n + 0.5) * stride / size, (cell // n + 0.5) * stride / size], 1).astype(np.float32)
        hit = score >= np.float32(least)
        centre, edge, score, delta, raw = centre[hit], edge[hit, None], score[hit], delta[hit], raw[hit].reshape(-1, 5, 2)
        whole = np.array([width, height], np.float32)
        mid = (centre + delta[:, :2] * np.float32(CENTRE_VARIANCE) * edge) * whole
        half = edge * np.exp(delta[:, 2:] * np.float32(SIZE_VARIANCE)) * whole / 2
        boxes.append(np.concatenate([mid - half, mid + half], 1))
        marks.append((centre[:, None] + raw * np.float32(1 if baked else CENTRE_VARIANCE) * edge[:, None]) * whole)
        probs.append(score)
    box, mark, prob = np.concatenate(boxes), np.concatenate(marks), np.concatenate(probs)
    span = box[:, 2:] - box[:, :2]
    fine = (span >= MIN_FACE).all(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        aspect = span[:, 0] / span[:, 1]
    fine &= (aspect >= 0.5) & (aspect <= 2.0)
    room = (span * np.float32(MARGIN))[:, None]
    fine &= ((mark >= box[:, None, :2] - room) & (mark <= box[:, None, 2:] + room)).all((1, 2))
    box, mark, prob = box[fine], mark[fine], prob[fine]
    order = np.argsort(-prob, kind="stable")  # equal scores stay by stride and anchor
    box, mark, prob = box[order], mark[order], prob[order]
    kept: list[int] = []
    for i in range(len(box)):
        if kept:
            w = np.minimum(box[kept, 2], box[i, 2]).astype(float) - np.maximum(box[kept, 0], box[i, 0])
            h = np.minimum(box[kept, 3], box[i, 3]).astype(float) - np.maximum(box[kept, 1], box[i, 1])
            area = lambda b: (b[..., 2].astype(float) - b[..., 0]) * (b[..., 3].astype(float) - b[..., 1])
            both = np.where((w > 0) & (h > 0), w * h, 0.0)
            if (np.float32(1) * (both / (area(box[kept]) + area(box[i]) - both)).astype(np.float32) > np.float32(most_overlap)).any():
                continue
        kept.append(i)
    return [(box[i], mark[i], float(prob[i])) for i in kept]


def affine(points: np.ndarray) -> tuple[float, ...]:
    """a to f of the least-squares map from five points to the template; an error if they lie on a line."""
    x = np.column_stack([np.asarray(points, float), np.ones(5)])
    gram = x.T @ x
    if abs(np.linalg.det(gram)) < 1e-9:
        raise ValueError("the points lie on a line")
    return tuple(np.linalg.solve(gram, x.T @ np.array(TEMPLATE)).T.ravel().tolist())


class OnnxEmbedder(Embedder):
    """A detector and a recogniser. Each is a callable from its input tensor to the list of its output arrays:
    the detector's outputs are three over all anchors, or nine: scores, boxes and landmarks of each stride in turn."""

    def __init__(self, detector, recogniser, size: int = 640, least: float = 0.5, most_overlap: float = 0.4, baked: bool | None = None, batch: int = 1):
        self.detector, self.recogniser, self.size = detector, recogniser, size
        self.least, self.most_overlap, self.baked, self.batch = least, most_overlap, baked, max(1, batch)

    def detect(self, image: np.ndarray) -> list[tuple]:
        outputs = self.detector(detector_tensor(resize_bilinear(image, self.size, self.size))[None])
        whole = len(outputs) == 3
        if whole:
            groups = split_groups(*outputs, self.size)
        else:
            groups = [(s, outputs[i].reshape(-1), outputs[i + 3].reshape(-1, 4), outputs[i + 6].reshape(-1, 10)) for i, s in enumerate(ANCHORS)]
        baked = not whole if self.baked is None else self.baked
        return decode_faces(groups, image.shape[1], image.shape[0], self.least, self.most_overlap, baked)

    def faces(self, image, salt=""):
        aligned = []
        for i, (box, marks, score) in enumerate(self.detect(image)):
            try:
                aligned.append((i, box, score, align_face(image, affine(marks))))
            except ValueError:  # points on a line: no face, so it is left out
                continue
        out = []
        for at in range(0, len(aligned), self.batch):
            part = aligned[at : at + self.batch]
            vectors = np.asarray(self.recogniser(np.stack([recogniser_tensor(x) for *_, x in part]))[0]).reshape(len(part), -1)
            out += [Face(normalized(v.astype(np.float32)), tuple(int(c) for c in box), face, score, i) for (i, box, score, face), v in zip(part, vectors, strict=True)]
        return out


def session(path: str, outputs: list[str] | None = None, threads: int = 1):
    """A model file as a callable, by the ONNX runtime."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    run = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    name = run.get_inputs()[0].name
    return lambda tensor: run.run(outputs, {name: tensor})


def make_embedder(cfg) -> tuple[Embedder, str]:
    """The embedder that the settings ask for, and its name: models if both files are there and load, else the stub, with a warning."""
    for path in (cfg.detector_model, cfg.embedder_model):
        if not path or not os.path.exists(path):
            logger().warning("model missing, falling back to stub: %s", path or "(not set)")
            return StubEmbedder(), "stub"
    try:
        strides = [f"{name}_{s}" for name in (cfg.detector_scores, cfg.detector_boxes, cfg.detector_landm) for s in ANCHORS] if cfg.detector_format == "split" else None
        models = session(cfg.detector_model, strides), session(cfg.embedder_model, [cfg.embedder_output] if cfg.embedder_output else None)
    except Exception as e:  # whatever the runtime says of a bad file or a missing output
        logger().error("models don't load, falling back to stub: %s", e)
        return StubEmbedder(), "stub"
    return OnnxEmbedder(*models, cfg.det_input_size, cfg.det_threshold, cfg.nms_iou, cfg.landmark_variance_baked, cfg.arc_batch_size), "onnx"


FACES = "array<struct<face_index:int,embedding:array<float>,score:float,x1:int,y1:int,x2:int,y2:int,aligned:binary>>"


def extract_faces(images: DataFrame, make: Callable[[], Embedder], most: int | None = None, debug: bool = False, salted: bool = False) -> DataFrame:
    """path, err and faces of images (path, width, height, pixels, err).

    ``make`` builds the embedder, once for each task. Images are brought down to ``most`` on the
    longer edge first, if given. A picture that can't be read or embedded has an err and null faces;
    one without faces an empty list. The aligned pictures (RGB bytes) come only with ``debug``.
    face_index is the detection's number; a face that can't be aligned is left out.
    """
    kind = pa.list_(pa.struct([("face_index", pa.int32()), ("embedding", pa.list_(pa.float32())), ("score", pa.float32()), *((c, pa.int32()) for c in ("x1", "y1", "x2", "y2")), ("aligned", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        try:
            for batch in batches:
                for row in batch.to_pylist():  # a row is a picture of some MB
                    err, found = row["err"], None
                    if err is None:
                        try:
                            image = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], 3)
                            image = image if most is None else fit_pixels(image, most)
                            found = [{"face_index": f.index, "embedding": f.embedding.tolist(), "score": f.score, **dict(zip(("x1", "y1", "x2", "y2"), f.box, strict=True)), "aligned": f.aligned.tobytes() if debug and f.aligned is not None else None} for f in embedder.faces(image, row["path"] if salted else "")]
                        except Exception as e:  # one picture's failure is its own
                            err = f"{type(e).__name__}: {e}"
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]], pa.string()), pa.array([err], pa.string()), pa.array([found], kind)], names=["path", "err", "faces"])
        finally:
            embedder.close()

    return images.select("path", "width", "height", "pixels", "err").mapInArrow(run, f"path string, err string, faces {FACES}")
