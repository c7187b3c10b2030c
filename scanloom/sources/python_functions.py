"""The function table of Python files: native on columns, or exact by parsing.

Columns: ``line`` (of ``def``), ``name, is_async, indent, decorators, params,
returns, has_docstring, context, file_indented``. ``context[0]`` is the ``def``
line and ``context[k]`` the line ``k`` above it.

*native* finds headers by one regex per file and stays inside the JVM. It does
not see syntax errors, so a file that does not parse still gives its functions; it
gives decorators and return types as written (blanks squeezed), and counts brackets
in a header to a depth of ``DEPTH``. *exact* parses each file in an Arrow worker and
gives nothing for a file that does not parse.
"""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import text
from scanloom.functions.arrays import let, with_fields
from scanloom.functions.lexer import lex
from scanloom.functions.text import MARK, MARK_CLOSE, MARK_OPEN

LOOKBACK = 4
#: Nested brackets in a header; a regex needs a bound, and this is far above what is written.
DEPTH = 16

FUNCTION_FIELDS = (
    "line int, name string, is_async boolean, indent int, decorators array<string>, params array<string>, "
    "returns string, has_docstring boolean, context array<string>"
)

_W = rf"(?:\s|{MARK}|\\(?=\r?\n))*+"
_STR = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'" + r"|[\"']"


def _brackets(depth: int) -> str:
    inner = f"|{_brackets(depth - 1)}" if depth else ""
    return rf"\((?:[^()\"']++|{_STR}{inner})*+\)"


def _squares(depth: int) -> str:
    inner = f"|{_squares(depth - 1)}" if depth else ""
    return rf"\[(?:[^\[\]]++{inner})*+\]"


_PAREN = _brackets(DEPTH - 1)
_DECORATOR = rf"{MARK}[ \t]*+@[^\n(]*+(?:{_PAREN}[^\n(]*+)*+\n"
_BLANK = rf"{MARK}[ \t\r]*+\n"
HEADER = (
    rf"((?:{_DECORATOR})*+)"  # 1 decorators
    rf"{MARK_OPEN}(\d+){MARK_CLOSE}([ \t]*+)"  # 2 line, 3 indent
    rf"(async[ \t]++)?def[ \t]++(\w++)(?:\[[^\]\n]*+\])?{_W}"  # 4 async, 5 name
    rf"({_PAREN}){_W}"  # 6 parameters
    rf"(?:->{_W}((?:[^:\n\[]++|{_squares(DEPTH - 1)})*+))?{_W}:"  # 7 return type
    rf"({_W}[rRuU]?[\"'])?"  # 8 docstring
)


def _squeeze(col: Column) -> Column:
    out = text.strip(F.regexp_replace(col, rf"(?:\s|{MARK})+", " "))
    return F.regexp_replace(F.regexp_replace(out, r"([(\[{]) ", "$1"), r",? ([)\]}])", "$1")


def _parameters(col: Column) -> Column:
    """Top-level parameters of a bracketed list; the signs ``*`` and ``/`` are none."""
    flat = F.regexp_replace(text.empty_strings(F.substring(col, F.lit(2), F.length(col) - 2)), MARK, "")
    for _ in range(DEPTH):
        flat = F.regexp_replace(flat, r"[(\[{][^()\[\]{}]*+[)\]}]", "")
    flat = F.regexp_replace(flat, r"\blambda\b[^:]*+:", "lambda:")  # its parameters are none of the function's
    return F.filter(
        F.transform(F.split(flat, ",", -1), text.strip), lambda p: (p != "") & (p != "*") & (p != "/")
    )


def functions_in(lines: Column, code: Column, *, lookback: int = LOOKBACK) -> Column:
    """Native function array of a file.

    ``lines`` are its lines; ``code`` is its numbered text without comments.
    """
    part = lambda h, k: F.regexp_extract(h, HEADER, k)

    def describe(h: Column) -> Column:
        line = part(h, 2).cast("int")
        return F.struct(
            line.alias("line"),
            part(h, 5).alias("name"),
            (part(h, 4) != "").alias("is_async"),
            F.length(part(h, 3)).alias("indent"),
            F.transform(
                let(F.split(part(h, 1), rf"{MARK}[ \t]*@", -1), lambda d: F.slice(d, F.lit(2), F.size(d))), _squeeze
            ).alias("decorators"),
            _parameters(part(h, 6)).alias("params"),
            F.nullif(_squeeze(part(h, 7)), F.lit("")).alias("returns"),
            (part(h, 8) != "").alias("has_docstring"),
            F.reverse(
                F.slice(lines, F.greatest(line - lookback, F.lit(1)), F.least(line, F.lit(lookback + 1)))
            ).alias("context"),
        )

    # Without blank lines, so that a long run of them is not tried from each of its lines.
    solid = F.regexp_replace(code, _BLANK, "")
    return F.transform(F.regexp_extract_all(solid, F.lit(HEADER), F.lit(0)), describe)


def with_lines(files: DataFrame, content: str = "content", is_code: Column | None = None) -> DataFrame:
    """Adds ``_lines`` and ``_code`` (numbered, without Python comments, strings on one line); NULL unless ``is_code``."""
    rows = files.withColumn("_lines", text.splitlines(F.col(content)))
    code = F.concat(lex(text.numbered(F.col("_lines")), "py")["code"], F.lit("\n"))
    return with_fields(rows, F.struct((code if is_code is None else F.when(is_code, code)).alias("_code")))


def may_define(content: Column) -> Column:
    return content.contains("def ") | content.contains("def\t")


def is_indented(content: Column) -> Column:
    """The first line of code is indented, so the file as a whole does not parse."""
    return content.rlike(r"\A(?:[ \t]*+(?:#[^\n]*+)?\r?\n)*+[ \t]+[^\s#]")


def function_table(files: DataFrame, *, method: str = "native", lookback: int = LOOKBACK) -> DataFrame:
    """``project_id, path, file_indented`` and one row per function of each Python file given."""
    if method == "exact":
        return _exact(files, lookback)
    if method != "native":
        raise ValueError(f"method is native or exact, not {method!r}")
    return (
        with_lines(files.filter(may_define(F.col("content"))).select("project_id", "path", "content"))
        .withColumn("file_indented", is_indented(F.col("content")))
        .withColumn("_f", F.explode(functions_in(F.col("_lines"), F.col("_code"), lookback=lookback)))
        .select("project_id", "path", "file_indented", "_f.*")
    )


def _parse(content: str, lookback: int) -> list[dict]:
    """Functions of one file; empty if it does not parse."""
    source = textwrap.dedent(content) if content[:1] in (" ", "\t") else content
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = content.splitlines()
    out = []
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) or node.lineno > len(lines):
            continue
        a = node.args
        named = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs]
        named += [a.kwarg] if a.kwarg else []
        out.append(
            {
                "line": node.lineno,
                "name": node.name,
                "is_async": isinstance(node, ast.AsyncFunctionDef),
                "indent": node.col_offset,
                "decorators": [ast.unparse(d) for d in node.decorator_list],
                "params": [ast.unparse(p) for p in named],
                "returns": ast.unparse(node.returns) if node.returns else None,
                "has_docstring": ast.get_docstring(node) is not None,
                "context": lines[max(node.lineno - 1 - lookback, 0) : node.lineno][::-1],
            }
        )
    return out


def _exact(files: DataFrame, lookback: int) -> DataFrame:
    names = ["project_id", "path", "file_indented"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                {"project_id": p, "path": q, "file_indented": bool(i), **f}
                for p, q, i, c in batch.itertuples(index=False)
                for f in _parse(c, lookback)
            ]
            if rows:
                yield pd.DataFrame(rows)

    source = files.filter(may_define(F.col("content"))).select(
        "project_id", "path", is_indented(F.col("content")).alias("file_indented"), "content"
    )
    return source.mapInPandas(
        run, f"project_id string, path string, file_indented boolean, {FUNCTION_FIELDS}"
    ).select(*names, *[f.strip().split(" ")[0] for f in FUNCTION_FIELDS.split(", ")])
