"""Secret detection: one pass over each text, no join and no shuffle to find them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.patterns import (
    ASSIGN_HINT,
    GENERIC_JS,
    GENERIC_PY,
    SECRET_PATTERNS,
    TOKEN_PATTERNS,
    SecretPattern,
)
from scanloom.operators.filters import is_safe_value, lang_of

_CUT, _CUT_IN_TEXT = "\ufdd0", "\ufdd1"  # noncharacters; the first stands where a match starts


def may_hold(content: Column, pattern: SecretPattern) -> Column:
    """Cheap test that is true for every text the pattern matches."""
    if pattern.hint == ASSIGN_HINT:
        return content.contains("=") & content.rlike(ASSIGN_HINT)
    return content.contains(pattern.hint)


def may_hold_any(content: Column, patterns: list[SecretPattern]) -> Column:
    out = F.lit(False)
    for p in patterns:
        if p.hint != ASSIGN_HINT:
            out = out | content.contains(p.hint)
    if any(p.hint == ASSIGN_HINT for p in patterns):
        out = out | (content.contains("=") & content.rlike(ASSIGN_HINT))
    return out


def count_matches(content: Column, pattern: SecretPattern) -> Column:
    return F.when(may_hold(content, pattern), F.regexp_count(content, F.lit(pattern.regex))).otherwise(0)


def count_secrets(content: Column, patterns: list[SecretPattern] | None = None) -> Column:
    """Number of matches of all patterns in a text."""
    out = F.lit(0)
    for p in patterns or SECRET_PATTERNS:
        out = out + count_matches(content, p)
    return out


def has_secret(content: Column, patterns: list[SecretPattern] | None = None) -> Column:
    out = F.lit(False)
    for p in patterns or SECRET_PATTERNS:
        out = out | (may_hold(content, p) & content.rlike(p.regex))
    return out


def _is_generic(pattern: SecretPattern) -> bool:
    return pattern.hint == ASSIGN_HINT


def _matches(content: Column, pattern: SecretPattern, safe_lang: str | None) -> Column:
    """array<struct<type, line, match, name, value>> of one pattern.

    Lines come from a second pass that puts a sign where each match starts;
    cutting that text at newlines tells the line of the i-th match. Both passes
    are linear in the text, however many matches there are.
    """
    rx = pattern.regex
    # One inside the text itself would be counted as a match start.
    signed = F.regexp_replace(F.replace(content, F.lit(_CUT), F.lit(_CUT_IN_TEXT)), rx, _CUT + "$0")
    line_nos = F.flatten(
        F.transform(
            F.split(signed, "\n", -1),
            lambda line, i: F.array_repeat(i + 1, F.length(line) - F.length(F.replace(line, F.lit(_CUT), F.lit("")))),
        )
    )
    found = F.arrays_zip(F.regexp_extract_all(content, F.lit(rx), F.lit(0)).alias("match"), line_nos.alias("line"))
    generic = _is_generic(pattern)
    out = F.transform(
        found,
        lambda m: F.struct(
            F.lit(pattern.type).alias("type"),
            m["line"].cast("int").alias("line"),
            m["match"].alias("match"),
            (F.regexp_extract(m["match"], rx, 1) if generic else F.lit(None).cast("string")).alias("name"),
            (F.regexp_extract(m["match"], rx, 2) if generic else m["match"]).alias("value"),
        ),
    )
    if safe_lang is not None:
        out = F.filter(out, lambda m: ~is_safe_value(m["value"], m["match"], safe_lang))
    empty = F.array().cast("array<struct<type:string,line:int,match:string,name:string,value:string>>")
    return F.when(may_hold(content, pattern), out).otherwise(empty)


def secrets_in(content: Column, patterns: list[SecretPattern] | None = None, *, safe_lang: str | None = None) -> Column:
    """All matches of a text as one array. Matches may cross lines; ``line`` is where they start."""
    return F.concat(*[_matches(content, p, safe_lang) for p in patterns or SECRET_PATTERNS])


def find_secrets(table: DataFrame, content: str = "content", *, patterns: list[SecretPattern] | None = None) -> DataFrame:
    """One row per match: all columns of ``table`` but the text, and ``type, line, match, name, value``.

    Works on any table with a text column, streams included. Texts that cannot
    match are dropped before the regexes run.
    """
    patterns = patterns or SECRET_PATTERNS
    col = F.col(content)
    keep = [c for c in table.columns if c != content]
    return (
        table.filter(may_hold_any(col, patterns))
        .select(*keep, F.explode(secrets_in(col, patterns)).alias("_m"))
        .select(*keep, "_m.*")
    )


def find_file_secrets(files: DataFrame, *, skip_safe: bool = True) -> DataFrame:
    """Secrets of a files table, each language with its own patterns, in one scan.

    ``skip_safe`` leaves out values that are read from the environment already.
    """
    lang, content = F.col("lang"), F.col("content")
    generic = lambda p, family: secrets_in(content, [p], safe_lang=family if skip_safe else None)
    found = F.concat(
        secrets_in(content, TOKEN_PATTERNS),
        F.when(lang == "py", generic(GENERIC_PY, "py")).otherwise(generic(GENERIC_JS, "js")),
    )
    return (
        files.withColumn("lang", lang_of(F.col("path")))
        .filter(lang.isin("py", "js") & may_hold_any(content, SECRET_PATTERNS))
        .select("project_id", "path", "lang", F.explode(found).alias("_m"))
        .select("project_id", "path", "lang", "_m.*")
    )


def count_by_type(secrets: DataFrame, *keys: str) -> DataFrame:
    """Matches per type and key; ``keys`` default to the project."""
    keys = keys or ("project_id",)
    return secrets.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("n_secrets"))


def rollup_by_type(secrets: DataFrame, *keys: str) -> DataFrame:
    """As ``count_by_type`` with subtotals; a NULL key stands for all."""
    keys = keys or ("project_id",)
    return secrets.rollup(*keys, "type").agg(F.count(F.lit(1)).alias("n_secrets"))
