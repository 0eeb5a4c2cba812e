"""Model files: fetched once, checked, and put in place whole."""

from __future__ import annotations

import os
import time
import urllib.request

from pyspark.sql import Column
from pyspark.sql import functions as F

from facematch.log import logger

#: Fixed: how a model file begins, and how large a detector and a recogniser are at least.
MAGIC, DETECTOR_BYTES, RECOGNISER_BYTES = b"\x08\x06", 1 << 20, 5 << 20


def valid_bytes(content: Column, min_bytes: int, magic: Column) -> Column:
    """Whether a file's content is large enough and begins as it should."""
    return (F.octet_length(content) >= min_bytes) & F.startswith(content, magic)


def valid(path: str, min_bytes: int = 0, magic: bytes = b"") -> bool:
    """Whether a file is there, large enough and begins as it should; anything else in its place is an error."""
    if not os.path.lexists(path):
        return False
    if not os.path.isfile(path):
        raise ValueError(f"{path} is no regular file")
    with open(path, "rb") as f:
        return os.path.getsize(path) >= min_bytes and f.read(len(magic)) == magic


def percent(written: int, total: int) -> str:
    """How much has come, with one decimal; nothing where the total isn't known."""
    return f"{100 * written / total:.1f}%" if total > 0 else ""


class Progress:
    """Tells the log how much of a file has come, every few seconds at most."""

    def __init__(self, name: str, total: int, every: float = 3.0):
        self.name, self.total, self.every, self.written, self.told = name, total, every, 0, time.monotonic()

    def add(self, n: int) -> None:
        self.written += n
        if time.monotonic() - self.told >= self.every:
            self.told = time.monotonic()
            logger().info("downloading", extra={"fields": {"asset": self.name, "bytes": self.written, **({"total": self.total, "pct": percent(self.written, self.total)} if self.total > 0 else {})}})


def ensure(path: str, primary: str, mirrors=(), min_bytes: int = 0, magic: bytes = b"", timeout: float = 60) -> bool:
    """Fetches path from the first address that gives a valid file; False if it was valid already."""
    if valid(path, min_bytes, magic):
        return False
    tmp, errors = f"{path}.tmp", []
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    for url in filter(None, (primary, *mirrors)):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer, open(tmp, "wb") as f:
                progress = Progress(os.path.basename(path), int(answer.headers.get("Content-Length") or 0))
                while block := answer.read(1 << 16):
                    f.write(block)
                    progress.add(len(block))
            if not valid(tmp, min_bytes, magic):
                raise ValueError("the file is too small or begins otherwise")
            os.replace(tmp, path)
            return True
        except (OSError, ValueError) as e:
            errors.append(f"{url}: {e}")
        finally:
            if os.path.exists(tmp):
                os.remove(tmp)
    raise OSError("; ".join(errors) or "no address")


def ensure_models(cfg) -> None:
    """Fetches the models of the settings that are missing; what fails is logged, and the stub may take over."""
    for kind, path, url, least in (("detector", cfg.detector_model, cfg.detector_model_url, DETECTOR_BYTES), ("recognizer", cfg.embedder_model, cfg.embedder_model_url, RECOGNISER_BYTES)):
        if not path:
            continue
        if not cfg.auto_download or not url:
            if not os.path.exists(path):
                logger().warning("%s model missing and %s: %s", kind, "no address set" if cfg.auto_download else "download is off", path)
            continue
        try:
            ensure(path, url, (), least, MAGIC)
        except (OSError, ValueError) as e:
            logger().error("%s model not fetched: %s", kind, e)
