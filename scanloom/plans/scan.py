"""A whole scan: files to issues, findings and rewritten text.

The learning pass gives one row per project; it is joined to the files by size
(see ``plans.joins``), after which everything stays in the row of its file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators import gate, issues, learning, rewrite
from scanloom.operators.filters import scannable
from scanloom.plans.joins import join_lookup
from scanloom.sources.files import decode_all, env_names


def with_learned(files: DataFrame, learned: DataFrame | None = None, *, method: str = "native") -> DataFrame:
    """Files with the habits of their project: ``auth_decorator, token_handler, env_style``."""
    summary = learning.summarise(learned if learned is not None else learning.learn(files, method=method))
    return join_lookup(files, summary, ["project_id"], salt_on=["path"])


def flag(files: DataFrame, *, learned: DataFrame | None = None, **options) -> DataFrame:
    """Scannable files with their learned columns and ``issues``."""
    files = scannable(files)
    return issues.with_issues(with_learned(files, learned), **options)


def _issues(files: DataFrame, learned: DataFrame | None, options: dict) -> DataFrame:
    """Issues with the habits of their project. What is joined are the narrow rows of candidates, not the files."""
    files = scannable(files)
    summary = learning.summarise(learned if learned is not None else learning.learn(files))
    found = join_lookup(issues.issue_candidates(files, **options), summary, ["project_id"], salt_on=["path", "line"])
    return issues.confirmed(found, env_check=options.get("env_check", "mode"))


def scan(files: DataFrame, *, learned: DataFrame | None = None, **options) -> DataFrame:
    """Issue table of a files table: ``project_id, path, line, issue_type``."""
    return _issues(files, learned, options).select("project_id", "path", "line", "issue_type")


def findings(files: DataFrame, *, learned: DataFrame | None = None, **options) -> DataFrame:
    """Findings with their suggestions."""
    found = _issues(files, learned, options)
    columns = ["project_id", "path", "auth_decorator", "token_handler", "env_style", "line", "issue_type"]
    return issues.to_findings(issues.suggest_improvement(found.select(*columns)))


def exit_status(raw: DataFrame, *, learned: DataFrame | None = None, **options) -> DataFrame:
    """``project_id, n_findings, exit_status`` from files as they are read (binary ``content``).

    A project with a file that cannot be read, decoded or parsed has status 2; its other
    files are scanned all the same.
    """
    told = decode_all(raw)
    whole = told.filter(F.col("failed").isNull()).drop("failed")
    failed = told.filter(F.col("failed").isNotNull())
    return gate.exit_status(raw, findings(whole, learned=learned, **options), failed)


@dataclass
class FixedTree:
    files: DataFrame  # each file with fixed_content, modified, fixes, vars, issues, improved_content, improved
    env: DataFrame  # new text of each root .env.example that changes


def fix(files: DataFrame, *, improve: bool = True, **options) -> FixedTree:
    """Secrets out, then checks on the fixed text, then improvements of it.

    Learning sees the files as they came; checks see the fixed text, so a line
    number moves by one where an import was added.
    """
    clean = scannable(files)
    redacted = rewrite.redact_secrets(with_learned(clean, options.pop("learned", None)))
    flagged = issues.with_issues(redacted, "fixed_content", **options)
    if improve:
        flagged = rewrite.apply_improvements(flagged, "fixed_content")
    else:
        flagged = flagged.withColumn("improved_content", F.col("fixed_content")).withColumn("improved", F.lit(False))
    env_files = clean.filter(F.col("path") == ".env.example")
    return FixedTree(flagged, rewrite.upsert_env(redacted, env_files, env_names(clean)))
