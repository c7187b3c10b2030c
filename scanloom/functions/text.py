"""Column helpers for text that has lines: splitting, indent, masking, replacing.

Everything here is a built-in Spark expression; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.arrays import let

# The line ends Python's str.splitlines() knows.
LINE_BREAK_CLASS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_BREAK = r"\r\n|" + LINE_BREAK_CLASS
_AFTER_BREAK = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"

# str.strip() without arguments, for the blanks that occur in source files.
BLANKS = " \t\n\r\x0b\x0c"

# Each line of a numbered text starts with MARK_OPEN <number> MARK_CLOSE. Both
# are private-use characters; any that the text itself holds are swapped for
# PLACEHOLDER first, so that a mark can be trusted.
MARK_OPEN = "\ue000"
MARK_CLOSE = "\ue001"
PLACEHOLDER = "\ufffd"
MARK = f"{MARK_OPEN}\\d+{MARK_CLOSE}"


def splitlines(text: Column) -> Column:
    """Lines of a text without their ends, as ``str.splitlines()`` gives them."""
    body = (
        F.when(text.endswith("\r\n"), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(F.right(text, F.lit(1)).rlike(LINE_BREAK_CLASS), F.substring(text, F.lit(1), F.length(text) - 1))
        .otherwise(text)
    )
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def splitlines_keep(text: Column) -> Column:
    """Lines with their ends kept; joined with ``""`` they give the text back."""
    return F.filter(F.split(text, _AFTER_BREAK, -1), lambda line: line != "")


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(BLANKS))


def indent_of(line: Column) -> Column:
    """The blanks a line starts with."""
    return F.regexp_extract(line, r"^(\s*)", 1)


def first_piece(line: Column, sep: str = "=") -> Column:
    """``line.split(sep)[0].strip()``"""
    return strip(F.substring_index(line, sep, 1))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """``text.replace(old, new, 1)`` for a literal, non-empty ``old``."""
    return let(
        F.struct(F.instr(text, old).alias("at"), F.length(old).alias("n")),
        lambda o: F.when(
            o["at"] > 0,
            F.concat(
                F.substring(text, F.lit(1), o["at"] - 1), new, F.substring(text, o["at"] + o["n"], F.length(text))
            ),
        ).otherwise(text),
    )


def without_marks(line: Column) -> Column:
    """A line whose private-use signs cannot be taken for marks."""
    swapped = F.replace(F.replace(line, F.lit(MARK_OPEN), F.lit(PLACEHOLDER)), F.lit(MARK_CLOSE), F.lit(PLACEHOLDER))
    return F.when(line.contains(MARK_OPEN) | line.contains(MARK_CLOSE), swapped).otherwise(line)


def numbered(lines: Column) -> Column:
    """Lines joined by newlines, each led by a mark with its 1-based number.

    A regex can then cross lines, drop text, and still tell on which line a
    match starts, with no window and no shuffle.
    """
    return F.array_join(
        F.transform(
            lines,
            lambda line, i: F.concat(F.lit(MARK_OPEN), (i + 1).cast("string"), F.lit(MARK_CLOSE), without_marks(line)),
        ),
        "\n",
    )


def numbered_pieces(text: Column) -> Column:
    """A numbered text cut at its marks: array<struct<line:int, text:string>>."""
    return F.transform(
        F.filter(F.split(text, MARK_OPEN, -1), lambda p: p != ""),
        lambda p: F.struct(
            F.substring_index(p, MARK_CLOSE, 1).cast("int").alias("line"),
            F.rtrim(F.substring_index(p, MARK_CLOSE, -1), F.lit("\n")).alias("text"),
        ),
    )


# --- strings ---------------------------------------------------------------
# Loops are possessive: Java runs those without recursion, so long strings are safe.

_STRINGS = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"


def empty_strings(code: Column) -> Column:
    """Python code whose one-line string literals are replaced by ``""``."""
    return F.regexp_replace(code, _STRINGS, '""')
