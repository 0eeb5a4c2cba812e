"""One-line log records, coloured where the output is a terminal."""

from __future__ import annotations

import logging
import os
import sys

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "warning": logging.WARNING, "error": logging.ERROR, "err": logging.ERROR}
COLOURS = {logging.DEBUG: 36, logging.INFO: 32, logging.WARNING: 33, logging.ERROR: 31}


def parse_level(text: str) -> int:
    """A level by name, info if there is none of that name."""
    return LEVELS.get(text.strip().lower(), logging.INFO)


def use_colour(mode: str, stream=sys.stderr) -> bool:
    mode = mode.strip().lower()
    return mode == "always" or mode != "never" and not os.environ.get("NO_COLOR") and getattr(stream, "isatty", lambda: False)()


class Formatter(logging.Formatter):
    """Time, level, message, then key=value of the record's ``fields``; groups join names by dots."""

    def __init__(self, colour: bool = False):
        super().__init__()
        self.colour = colour

    def format(self, record: logging.LogRecord) -> str:
        def flat(items, prefix=""):
            for k, v in items.items():
                yield from flat(v, f"{prefix}{k}.") if isinstance(v, dict) else [f"{prefix}{k}={v}"]

        level = record.levelname
        if self.colour:
            level = f"\x1b[{COLOURS.get(record.levelno, 0)}m{level}\x1b[0m"
        return " ".join([self.formatTime(record, "%H:%M:%S"), level, record.getMessage(), *flat(getattr(record, "fields", {}))])


def logger() -> logging.Logger:
    return logging.getLogger("facematch")


def set_up(level: str = "info", colour: str = "auto", stream=sys.stderr) -> logging.Logger:
    """The library's logger, writing to stream from ``level`` on."""
    handler = logging.StreamHandler(stream)
    handler.setFormatter(Formatter(use_colour(colour, stream)))
    out = logger()
    out.handlers[:] = [handler]
    out.setLevel(parse_level(level))
    return out
