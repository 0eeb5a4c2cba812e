"""What needs bytes or pixels: the vector codec, resizing, alignment and the stub embedder, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from facematch.functions.images import fit_pixels

DIM = 512


def encode(faces, dim: int = DIM) -> bytes:
    """Vectors as little-endian floats, one after the other; a vector of another length is an error."""
    x = [np.asarray(v, "<f4") for v in (faces if faces is not None else [])]
    if any(len(v) != dim for v in x):
        raise ValueError(f"a vector must have {dim} numbers")
    return b"".join(v.tobytes() for v in x)


def decode(blob: bytes, count: int, dim: int = DIM) -> list[np.ndarray]:
    """The vectors of a blob; count and length must agree."""
    if count < 0 or len(blob) != count * dim * 4:
        raise ValueError(f"{len(blob)} bytes don't hold {count} vectors of {dim}")
    return list(np.frombuffer(blob, "<f4").reshape(count, dim)) if count else []


def encode_udf(dim: int = DIM):
    @F.pandas_udf("binary")
    def run(faces: pd.Series) -> pd.Series:
        return faces.map(lambda x: encode(x, dim))

    return run


def decode_udf(dim: int = DIM):
    @F.pandas_udf("array<array<float>>")
    def run(blob: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([[v.tolist() for v in decode(b, int(n), dim)] for b, n in zip(blob, count, strict=True)])

    return run


def _sample(image: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Bilinear samples of image (h x w x 3, uint8): base pixels are held inside, the fraction isn't."""
    h, w = image.shape[:2]
    x0, y0 = (np.clip(np.floor(v), 0, max(n - 2, 0)).astype(np.int64) for v, n in ((xs, w), (ys, h)))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (xs - x0)[..., None], (ys - y0)[..., None]
    p = image.astype(np.float64) * 257
    top, low = p[y0, x0] * (1 - fx) + p[y0, x1] * fx, p[y1, x0] * (1 - fx) + p[y1, x1] * fx
    return (np.clip(top * (1 - fy) + low * fy, 0, 65535).astype(np.int64) // 256).astype(np.uint8)


def resize_bilinear(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """image (h x w x 3) at another size; the aspect isn't kept."""
    h, w = image.shape[:2]
    xs, ys = np.meshgrid((np.arange(width) + 0.5) * w / width - 0.5, (np.arange(height) + 0.5) * h / height - 0.5)
    return _sample(image, xs, ys)


def align_face(image: np.ndarray, m, size: int = 112) -> np.ndarray:
    """The aligned face, by the map m (a..f) from image to face; an error if it can't be inverted."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    if det == 0:
        raise ValueError("the map is singular")
    x, y = np.meshgrid(np.arange(size) - c, np.arange(size) - f)
    return _sample(image, (e * x - b * y) / det, (a * y - d * x) / det)


def detector_tensor(image: np.ndarray) -> np.ndarray:
    """3 x h x w floats, blue first, less the fixed means."""
    return image[..., ::-1].transpose(2, 0, 1).astype(np.float32) - np.array([104, 117, 123], np.float32)[:, None, None]


def recogniser_tensor(image: np.ndarray) -> np.ndarray:
    """3 x h x w floats from -1 to 1, blue first."""
    return image[..., ::-1].transpose(2, 0, 1).astype(np.float32) / np.float32(127.5) - 1


def normalized(v: np.ndarray) -> np.ndarray:
    total = float((v.astype(np.float64) ** 2).sum())
    return v if not total else (v * np.float32(1 / np.sqrt(total))).astype(np.float32)


def stub_vector(image: np.ndarray, salt: str = "", dim: int = DIM) -> np.ndarray:
    """A unit vector that an image (h x w x 3, uint8) and a salt decide: the centre pixel, then a stream
    of the 64-bit generator that FNV-1a of salt, size and sampled pixels starts."""
    h, w = image.shape[:2]
    step = max(1, w // 64)
    sampled = (image[::step, ::step].astype("<u2") * 257).tobytes()
    seed, whole = 0xCBF29CE484222325, (1 << 64) - 1
    for byte in salt.encode() + w.to_bytes(8, "little") + h.to_bytes(8, "little") + sampled:
        seed = (seed ^ byte) * 0x100000001B3 & whole
    v = np.zeros(dim, np.float32)
    v[:3] = image[h // 2, w // 2].astype(np.float32) / 255
    for i in range(3, dim):
        seed = (seed * 6364136223846793005 + 1442695040888963407) & whole
        v[i] = np.int32((seed >> 32) - (1 << 32 if seed >> 63 else 0)) / np.float32(1 << 31)
    return normalized(v)


def pattern(key: int, width: int, height: int) -> np.ndarray:
    """A picture that a number decides, for trying things out."""
    y, x, c = np.meshgrid(np.arange(height), np.arange(width), np.arange(3), indexing="ij")
    return ((key * 7 + x * 31 + y * 17 + c * 5) % 256).astype(np.uint8)


def _of_bytes(width: int, height: int, work):
    """A function of columns from the bytes of pictures of one size to the bytes of what ``work`` makes of them."""

    @F.pandas_udf("binary")
    def run(blob: pd.Series) -> pd.Series:
        return blob.map(lambda b: None if b is None else work(np.frombuffer(b, np.uint8).reshape(height, width, 3)).tobytes())

    return run


def pattern_udf(width: int, height: int):
    @F.pandas_udf("binary")
    def run(key: pd.Series) -> pd.Series:
        return key.map(lambda k: pattern(int(k), width, height).tobytes())

    return run


def resize_udf(width: int, height: int, to_width: int, to_height: int):
    return _of_bytes(width, height, lambda x: resize_bilinear(x, to_width, to_height))


def align_udf(width: int, height: int, m, size: int):
    return _of_bytes(width, height, lambda x: align_face(x, m, size))


def fit_udf(width: int, height: int, most: int):
    """width, height and whether all pixels are near those of the slope that the picture is, but for its edge."""

    @F.pandas_udf("width int, height int, near boolean")
    def run(key: pd.Series) -> pd.DataFrame:
        y, x = np.meshgrid(np.arange(height), np.arange(width), indexing="ij")
        rows = []
        for k in key:
            image = np.repeat((40 + int(k) % 20 + 6 * x + 4 * y)[..., None], 3, 2).astype(np.uint8)
            small = fit_pixels(image, most)
            v, u = np.meshgrid((np.arange(small.shape[0]) + 0.5) * height / small.shape[0] - 0.5, (np.arange(small.shape[1]) + 0.5) * width / small.shape[1] - 0.5, indexing="ij")
            gap = np.abs(small[..., 0] - (40 + int(k) % 20 + 6 * u + 4 * v))[2:-2, 2:-2]
            rows.append((small.shape[1], small.shape[0], bool((gap <= 1.1).all())))
        return pd.DataFrame(rows, columns=["width", "height", "near"])

    return run


def stub_udf(dim: int = DIM):
    """The stub vector of a grey pixel, salted with the path."""

    @F.pandas_udf("array<float>")
    def run(path: pd.Series) -> pd.Series:
        pixel = np.full((1, 1, 3), 128, np.uint8)
        return path.map(lambda p: stub_vector(pixel, p, dim).tolist())

    return run
