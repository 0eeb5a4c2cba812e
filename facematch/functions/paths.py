"""Path algebra as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the extensions taken where none are given.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(name: Column) -> Column:
    """From the last dot on, the dot included; empty without one."""
    return F.regexp_extract(name, "\\.[^.]*$", 0)


def parse_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parse_extensions(text: Column) -> Column:
    """The extensions of a comma-separated list: trimmed, lower-case, each with its dot."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.lower(F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x))))


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for a shell pattern (*, ?, [..], backslash); None if it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif c == "[":
            m = re.compile(r"\[(\^?)((?:\\.|[^\\\]])+)\]").match(pattern, i)
            if not m:
                return None
            out.append("[" + m[1] + re.sub(r"(?<!\\)([\[&~])", r"\\\1", m[2]) + "]")
            i = m.end() - 1
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_glob(name: Column, patterns) -> Column:
    """Whether a pattern fits the name or its lower case; patterns keep their case, malformed ones never fit."""
    found = F.lit(False)
    for p in patterns:
        if (r := glob_regex(p)) is not None:
            found = found | name.rlike(r) | F.lower(name).rlike(r)
    return found


def relative(path: Column, root: str) -> Column:
    """path below root; the base name for a path outside of it, or one whose relative form begins with two dots."""
    root = root.rstrip("/") + "/"
    below = F.substring(path, len(root) + 1, 1 << 30)
    return F.when(path.startswith(root) & ~below.startswith(".."), below).otherwise(basename(path))


def components(path: Column, root: str) -> Column:
    """Names of the folders between root and the file."""
    parts = F.split(F.substring(path, len(root.rstrip("/")) + 2, 1 << 30), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
