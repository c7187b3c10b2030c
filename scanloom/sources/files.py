"""Sources: source trees, text tables, lines, and .env.example names.

A *files* table has the columns ``project_id, path, content, length``; ``path``
is relative to the project and uses slashes, ``length`` is in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import paths, text
from scanloom.functions.arrays import let, with_fields
from scanloom.functions.lexer import lex

MAX_FILE_SIZE = 1_048_576


def read_tree(
    spark: SparkSession,
    root: str,
    *,
    project_id: str | None = None,
    max_size: int | None = MAX_FILE_SIZE,
    glob: str | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Files below ``root`` (or the one file given) as a files table.

    ``project_id`` names the one project below ``root``; without it the first
    path part is the project. The size test reaches the file listing, so files
    that are too large are never opened. ``glob`` filters on the file name.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    if max_size is not None:
        raw = raw.filter(F.col("length") <= max_size)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", "^(?:[a-z0-9]+:)?/*", "/")
    rel = F.coalesce(paths.relative_to(rel, "/" + base.split(":", 1)[-1].lstrip("/")), paths.name_of(F.col("path")))
    raw = raw.withColumn("path", rel)
    if project_id is None:
        raw = raw.withColumn("project_id", F.substring_index("path", "/", 1)).withColumn(
            "path", F.regexp_replace("path", "^[^/]*/", "")
        )
    else:
        raw = raw.withColumn("project_id", F.lit(project_id))
    return decode(raw, lenient=lenient)


def decode(raw: DataFrame, *, lenient: bool = False) -> DataFrame:
    """Binary ``content`` to text. Invalid UTF-8 drops the file, or only its bad bytes."""
    if lenient:
        # A bad byte becomes U+FFFD, which is then taken out, as decoding with errors ignored does.
        valid = F.make_valid_utf8(F.col("content").cast("string"))
        raw = raw.withColumn("content", F.replace(valid, F.lit("\ufffd"), F.lit("")))
    else:
        raw = raw.filter(F.is_valid_utf8(F.col("content").cast("string"))).withColumn(
            "content", F.col("content").cast("string")
        )
    return raw.select("project_id", "path", "content", "length")


#: Steps at which a file fails: there is no content, it is no UTF-8, its brackets or quotes do not close.
READ, DECODE, PARSE = "read", "decode", "parse"


def decode_all(raw: DataFrame) -> DataFrame:
    """All files, also those that fail: ``project_id, path, content, length, failed``.

    ``failed`` names the step, NULL where the file can be scanned. A file that is not
    read or decoded has no ``content``; a Python file that does not parse keeps it.
    """
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    broken = paths.name_of(F.col("path")).rlike(PY_GLOB) & ~closes(F.col("content"), "py")
    failed = F.when(F.col("_raw").isNull(), READ).when(F.col("content").isNull(), DECODE).when(broken, PARSE)
    rows = raw.withColumn("_raw", F.col("content")).withColumn("content", decoded)
    return with_fields(rows, F.struct(failed.alias("failed"))).select("project_id", "path", "content", "length", "failed")


def closes(content: Column, lang: str) -> Column:
    """Whether all quotes and brackets of a text in Python (``py``) or a script (``js``) close; no more of its grammar is looked at."""

    def even(code: Column) -> Column:
        n = lambda sign: F.length(code) - F.length(F.translate(code, sign, ""))
        pairs = [n(a) == n(b) for a, b in ("()", "[]", "{}")]
        return pairs[0] & pairs[1] & pairs[2] & ~code.rlike("[\"'`]")

    bare = lex(text.numbered(text.splitlines(content)), lang)["bare"]
    return let(F.replace(bare, F.lit('""'), F.lit("")), even)


def from_table(table: DataFrame, *, project: Column, path: Column, content: Column) -> DataFrame:
    """Any table with a text column as a files table."""
    return table.select(
        project.cast("string").alias("project_id"),
        path.cast("string").alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("length"),
    )


PY_GLOB = r"\.py$"
JS_GLOB = r"\.[jt]s[^/]*$"


def glob_python(files: DataFrame) -> DataFrame:
    """``*.py``"""
    return files.filter(paths.name_of(F.col("path")).rlike(PY_GLOB))


def glob_scripts(files: DataFrame) -> DataFrame:
    """``*.[jt]s*``, which takes .json, .jsx and .tsx too."""
    return files.filter(paths.name_of(F.col("path")).rlike(JS_GLOB))


def lines(files: DataFrame, *keep: str, content: str = "content") -> DataFrame:
    """One row per line: the ``keep`` columns, 1-based ``line_no``, ``line``."""
    keep = keep or ("project_id", "path")
    return files.select(*keep, F.posexplode(text.splitlines(F.col(content))).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line"
    )


def is_env_line(line: Column) -> Column:
    """A line that sets a name: it has ``=`` and is no comment."""
    return line.contains("=") & ~text.lstrip(line).startswith("#")


def env_names(files: DataFrame, *, root_only: bool = True) -> DataFrame:
    """Names set in ``.env.example``: ``project_id, path, line_no, name``.

    Learning reads the file at the project root only; the style check reads
    every file of that name.
    """
    is_env = F.col("path") == ".env.example" if root_only else paths.name_of(F.col("path")) == ".env.example"
    return (
        lines(files.filter(is_env))
        .filter(is_env_line(F.col("line")))
        .select("project_id", "path", "line_no", text.first_piece(F.col("line")).alias("name"))
    )
