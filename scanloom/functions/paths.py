"""Column helpers for slash-separated paths."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parts_of(path: Column) -> Column:
    return F.split(path, "/", -1)


def suffix_of(path: Column) -> Column:
    """Last suffix with its dot, or ``""``: ``.min.js`` gives ``.js``, ``.env`` gives ``""``."""
    return F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1)


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``, or NULL when it is not below it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path)))


def glob_regex(pattern: str) -> str:
    """Shell glob to an anchored regex that Java and RE2 both read."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def globs_regex(patterns: Iterable[str]) -> str:
    """One alternation for many globs, so a path is tested once."""
    return "|".join(glob_regex(p) for p in patterns)
