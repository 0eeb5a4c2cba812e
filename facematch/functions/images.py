"""Pictures as numpy arrays (h x w x 3, uint8): orientation by EXIF, and fitting to a longest edge."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed: the EXIF tag of the orientation.
ORIENTATION = 0x0112


def orientation(head: bytes) -> int:
    """The EXIF orientation (1 to 8) that the first bytes of a JPEG file hold; 1 where there is none or it is damaged."""
    try:
        if head[:2] != b"\xff\xd8":
            return 1
        at = 2
        while head[at] == 0xFF and head[at + 1] not in (0xDA, 0xD9):
            size = struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4 : at + 2 + size]
            if head[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
                return _tag(body[6:])
            at += 2 + size
    except (IndexError, struct.error):
        pass
    return 1


def _tag(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order:
        return 1
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    for i in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * i)
        if tag == ORIENTATION and kind == 3:
            return value if 1 <= value <= 8 else 1
    return 1


def oriented(image: np.ndarray, how: int) -> np.ndarray:
    """The image turned and mirrored as an EXIF orientation says."""
    if how in (5, 6, 7, 8):
        image = image.transpose(1, 0, 2)
    if how in (2, 3, 6, 7):
        image = image[:, ::-1]
    if how in (3, 4, 7, 8):
        image = image[::-1]
    return np.ascontiguousarray(image)


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    """Width and height brought down to ``most`` on the longer edge, the shorter one cut to a whole number, 1 at least; smaller ones stay."""
    if max(width, height) <= most:
        return width, height
    ratio = width / height
    return (most, max(1, int(most / ratio))) if ratio > 1 else (max(1, int(most * ratio)), most)


def _kernel(x: np.ndarray) -> np.ndarray:
    """The cubic of Catmull and Rom."""
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))


def _resampled(image: np.ndarray, size: int) -> np.ndarray:
    """image with its rows brought to another number; the kernel is as wide as the step where that is over 1."""
    n = len(image)
    step = n / size
    scale = max(1.0, step)
    centre = (np.arange(size) + 0.5) * step - 0.5
    reach = int(np.ceil(2 * scale))
    out, total = np.zeros((size, *image.shape[1:])), np.zeros(size)
    first = np.ceil(centre - reach).astype(int)
    for k in range(2 * reach + 1):
        at = first + k
        w = np.where((at >= 0) & (at < n) & (at <= centre + reach), _kernel((at - centre) / scale), 0.0)
        out += w[:, None, None] * image[np.clip(at, 0, n - 1)]
        total += w
    return np.clip(np.floor(out / total[:, None, None] + 0.5), 0, 255).astype(np.uint8)


def fit_pixels(image: np.ndarray, most: int) -> np.ndarray:
    """The image brought down to ``most`` on its longer edge by a cubic filter, columns first; a smaller one stays."""
    width, height = fitted(image.shape[1], image.shape[0], most)
    if (height, width) == image.shape[:2]:
        return image
    return _resampled(_resampled(image.transpose(1, 0, 2), width).transpose(1, 0, 2), height)
