"""Filters and predicates on files, findings and hunks.

Path and size tests use only ``path`` and ``length``. Apply them before
anything that reads ``content``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import paths, severity
from scanloom.plans.joins import join_lookup
from scanloom.sources.files import MAX_FILE_SIZE

# Folders, suffixes, globs and extensions of the default scan and
# of the wider configurable exclusion.
EXCLUDED_DIRS = [
    "venv", ".venv", "node_modules", ".next", "__pycache__", ".git",
    "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", "coverage",
]
EXCLUDED_SUFFIXES = [
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe", ".bin", ".dat",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2",
    ".ttf", ".eot", ".map", ".min.js", ".min.css",
]
CONFIG_DIRS = [*EXCLUDED_DIRS, "target", ".gradle", "env"]
LOCK_FILES = [
    "poetry.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "Cargo.lock", "go.sum", "composer.lock", "Gemfile.lock",
]
CONFIG_SUFFIXES = [*EXCLUDED_SUFFIXES, ".lock", *LOCK_FILES]
CONFIG_GLOBS = [
    "*.min.js", "*.min.css", "*.bundle.js", "*.bundle.css",
    "*.generated.*", "*.auto.*", "*.generated.ts", "*.generated.tsx",
    "*.d.ts", "*.map", "*.lock", "*.pb.go", "*.pb.cc", "*.pb.h",
]
SERVER_DIRS = ["app/api", "pages/api", "actions", "server-actions", "lib/actions"]
SCRIPT_SUFFIXES = [".js", ".ts", ".jsx", ".tsx"]


def in_folder(path: Column, folders: Iterable[str]) -> Column:
    """Any part of the path is one of ``folders``."""
    return F.arrays_overlap(paths.parts_of(path), F.array(*[F.lit(d) for d in folders]))


def has_suffix(path: Column, suffixes: Iterable[str]) -> Column:
    """The last suffix is one of ``suffixes`` (so ``.min.js`` in the list never matches)."""
    return paths.suffix_of(path).isin(list(suffixes))


def too_large(length: Column, limit: int = MAX_FILE_SIZE) -> Column:
    return length > limit


def scannable(files: DataFrame, *, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Default scan: drops excluded folders, suffixes and sizes."""
    path = F.col("path")
    return files.filter(
        ~in_folder(path, EXCLUDED_DIRS) & ~has_suffix(path, EXCLUDED_SUFFIXES) & ~too_large(F.col("length"), max_size)
    )


def skipped(files: DataFrame, *, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """``project_id, path, length, reason``: what ``scannable`` leaves out, and files without readable text.

    A file with several reasons has the first of: folder, suffix, size, encoding.
    """
    path = F.col("path")
    reason = (
        F.when(in_folder(path, EXCLUDED_DIRS), "excluded folder")
        .when(has_suffix(path, EXCLUDED_SUFFIXES), "excluded suffix")
        .when(too_large(F.col("length"), max_size), F.format_string("larger than %d bytes", F.lit(max_size)))
        .when(F.col("content").isNull(), "not readable as UTF-8")
    )
    return files.select("project_id", "path", "length", reason.alias("reason")).where("reason is not null")


def below_root(files: DataFrame, root: str) -> DataFrame:
    """Files below ``root``, with the path made relative to it."""
    return files.withColumn("path", paths.relative_to(F.col("path"), root)).filter(F.col("path").isNotNull())


@dataclass(frozen=True)
class Exclusion:
    """What a project leaves out of its scan."""

    directories: list[str] = field(default_factory=lambda: list(CONFIG_DIRS))
    suffixes: list[str] = field(default_factory=lambda: list(CONFIG_SUFFIXES))
    globs: list[str] = field(default_factory=lambda: list(CONFIG_GLOBS))
    max_size: int = MAX_FILE_SIZE
    whole_path: bool = True  # globs see the whole path as well as the name

    def matches(self, path: Column, length: Column) -> Column:
        out = in_folder(path, self.directories) | has_suffix(path, self.suffixes) | too_large(length, self.max_size)
        if self.globs:
            rx = paths.globs_regex(self.globs)
            out = out | paths.name_of(path).rlike(rx)
            if self.whole_path:
                out = out | path.rlike(rx)
        return out


def not_excluded(files: DataFrame, exclusion: Exclusion | None = None) -> DataFrame:
    return files.filter(~(exclusion or Exclusion()).matches(F.col("path"), F.col("length")))


def lang_of(path: Column) -> Column:
    """``py``, ``js``, ``env`` or NULL where no check applies."""
    return (
        F.when(paths.suffix_of(path) == ".py", "py")
        .when(has_suffix(path, SCRIPT_SUFFIXES), "js")
        .when(paths.name_of(path) == ".env.example", "env")
    )


def is_server_file(path: Column, content: Column) -> Column:
    """Below a server folder, or a script that holds ``"use server"`` in either quote."""
    folder = "^(" + "|".join(SERVER_DIRS) + ")(/|$)"
    marked = content.contains('"use server"') | content.contains("'use server'")
    return path.rlike(folder) | (has_suffix(path, SCRIPT_SUFFIXES) & marked)


def is_safe_value(value: Column, match: Column, lang: str) -> Column:
    """The value is read from the environment already."""
    if lang == "py":
        value = F.trim(value)
        return value.startswith("os.getenv(") | value.startswith("os.environ[") | value.startswith("os.environ.get(")
    return match.contains("process.env")


def severe(findings: DataFrame, threshold: str = "low") -> DataFrame:
    """Findings at or above a level of either scale."""
    return findings.filter(severity.at_least(F.col("severity"), threshold))


def without_rules(findings: DataFrame, excluded: Iterable[str] | DataFrame) -> DataFrame:
    """Findings whose ``rule_id`` is not excluded; a list stays in the filter, a table is anti-joined."""
    if isinstance(excluded, DataFrame):
        out = excluded.where("rule_id is not null").select("rule_id").distinct().withColumn("_out", F.lit(True))
        rest = [c for c in findings.columns if c != "rule_id"]
        return join_lookup(findings, out, ["rule_id"], "left", salt_on=rest).where("_out is null").select(*findings.columns)
    excluded = list(excluded)
    return findings.filter(~F.col("rule_id").isin(excluded) | F.col("rule_id").isNull()) if excluded else findings


@dataclass(frozen=True)
class DiffNoise:
    """Switches for the files a diff review leaves out."""

    lockfiles: bool = True
    minified: bool = True
    assets: bool = True
    generated: bool = True

    def matches(self, path: Column) -> Column:
        name = paths.name_of(path)
        globs: list[str] = []
        if self.lockfiles:
            globs += ["*.lock", *LOCK_FILES]
        if self.minified:
            globs += [g for g in CONFIG_GLOBS if ".min." in g or ".bundle." in g]
        if self.assets:
            globs += [f"*{s}" for s in EXCLUDED_SUFFIXES if ".min." not in s and s != ".map"]
        if self.generated:
            globs += [g for g in CONFIG_GLOBS if ".generated." in g or ".auto." in g or g in _GENERATED]
        return name.rlike(paths.globs_regex(globs)) if globs else F.lit(False)


_GENERATED = ["*.d.ts", "*.map", "*.pb.go", "*.pb.cc", "*.pb.h"]


def without_noise(hunks: DataFrame, noise: DiffNoise | None = None) -> DataFrame:
    return hunks.filter(~(noise or DiffNoise()).matches(F.col("file_path")))


def is_added(line: Column) -> Column:
    """An added line of a diff; the ``+++`` header is none."""
    return line.startswith("+") & ~line.startswith("+++")
