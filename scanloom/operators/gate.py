"""Summaries and the gate: counts, risk score, approval and status per project or pull request.

Counting comes first in each of them, so what reaches the shuffle is one partial
row per group and task, however large a group is.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import paths, severity
from scanloom.functions.severity import FINDING_LEVELS, WEIGHTS
from scanloom.operators.filters import severe, without_rules

# The limits of the gate and the groups of categories.
MAX_RISK, MAX_CHANGED_LINES, RISK_CAP = 0.35, 400, 1.0
QUALITY = ["maintainability", "performance", "clean-code"]
TOP_FINDINGS, TOP_FIXES = 10, 5
LANGUAGE_SUFFIXES = {"python": [".py"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx"]}
CLEAN, FINDINGS, ERROR = 0, 1, 2


def count_by_severity(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings per severity in order of gravity; unknown severities are left out."""
    keys = keys or ("project_id",)
    rank = severity.rank(F.col("severity")).alias("severity_rank")
    return (
        findings.select(*keys, "severity", rank)
        .filter(F.col("severity_rank").isNotNull())
        .groupBy(*keys, "severity", "severity_rank")
        .agg(F.count(F.lit(1)).alias("n_findings"))
    )


def distinct_rules(findings: DataFrame) -> DataFrame:
    """Sorted rule ids per project."""
    return (
        findings.select("project_id", "rule_id")
        .distinct()
        .groupBy("project_id")
        .agg(F.sort_array(F.collect_list("rule_id")).alias("rule_ids"))
    )


def scan_summary(fixed_files: DataFrame) -> DataFrame:
    """Per project: files, files with issues, fixes, improvements, all-clear.

    A file with a fix and an issue counts once.
    """
    touched = F.col("modified") | (F.size("issues") > 0)
    return fixed_files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(touched).alias("files_with_issues"),
        F.sum("fixes").alias("fixes"),
        F.sum(F.when(F.col("improved"), F.size("issues")).otherwise(0)).alias("improvements"),
        (F.count_if(touched) == 0).alias("all_clear"),
    )


def severity_by_category(findings: DataFrame, key: str = "pr_id") -> DataFrame:
    """Counts behind the checks of a review comment."""
    s, c = F.col("severity"), F.col("category")
    return findings.groupBy(key).agg(
        F.count_if((c == "security") & (s == "ERROR")).alias("security_errors"),
        F.count_if((c == "security") & (s == "WARNING")).alias("security_warnings"),
        F.count_if(c == "security").alias("security"),
        F.count_if(c.isin(QUALITY)).alias("quality"),
        F.count_if(c == "testing").alias("testing"),
        F.coalesce(F.bool_or(F.lower("file").contains("test")), F.lit(False)).alias("touches_tests"),
        F.count_if(s == "ERROR").alias("errors"),
        F.count(F.lit(1)).alias("n_findings"),
        *[
            F.count_if(severity.finding_level(s) == level).alias(f"n_{level}")
            for level in FINDING_LEVELS
        ],
    )


def pivot_categories(findings: DataFrame, key: str = "pr_id") -> DataFrame:
    """Severity by category as a table with one column per severity."""
    return findings.groupBy(key, "category").pivot("severity", ["ERROR", "WARNING", "INFO"]).agg(F.count(F.lit(1)))


def tests_check(testing: Column, touches_tests: Column) -> Column:
    """``gaps``, ``none`` (no file of the findings names a test) or NULL."""
    return F.when(testing > 0, "gaps").when(~touches_tests, "none")


@dataclass(frozen=True)
class GateSettings:
    """What a review counts and when it approves."""

    threshold: str = "info"  # findings below this level of either scale are left out
    languages: tuple[str, ...] = ()  # python, typescript, javascript; empty: all
    excluded_rules: tuple[str, ...] = ()
    require_tests: bool = False  # a change that touches no test file is not approved
    max_risk: float = MAX_RISK
    max_changed: int = MAX_CHANGED_LINES
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def of_languages(self, hunks: DataFrame) -> DataFrame:
        """Hunks of files in one of the languages."""
        if not self.languages:
            return hunks
        unknown = set(self.languages) - set(LANGUAGE_SUFFIXES)
        if unknown:
            raise ValueError(f"languages are {sorted(LANGUAGE_SUFFIXES)}, not {sorted(unknown)}")
        suffixes = [s for x in self.languages for s in LANGUAGE_SUFFIXES[x]]
        return hunks.filter(paths.suffix_of(F.col("file_path")).isin(suffixes))

    def counted(self, findings: DataFrame) -> DataFrame:
        """Findings that are grave enough and of no excluded rule."""
        return without_rules(severe(findings, self.threshold), self.excluded_rules)


def risk_score(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Sum of the weights of all findings, at most 1; a level without a weight counts nothing.

    The original names a score, its weights and its limit and gives no formula;
    this is ours. Counts are multiplied, so the order of rows does not matter.
    """
    total = F.lit(0.0)
    for level in FINDING_LEVELS:
        total = total + F.col(f"n_{level}") * F.lit(float(weights.get(level, 0.0)))
    return F.round(F.least(F.lit(RISK_CAP), total), 4)


def gate(
    findings: DataFrame,
    changes: DataFrame,
    *,
    key: str = "pr_id",
    max_risk: float = MAX_RISK,
    max_changed: int = MAX_CHANGED_LINES,
    weights: Mapping[str, float] = WEIGHTS,
    require_tests: bool = False,
) -> DataFrame:
    """One row per pull request of ``changes`` (``key, changed_lines``), with or without findings.

    ``status`` is PASS when approvable, FAIL on any ERROR, else WARNING.
    ``exit_status`` is that of the gate step: 1 on high severity. With
    ``require_tests`` the column ``has_tests`` of ``changes`` must be true for approval.
    """
    counts = severity_by_category(findings, key)
    numbers = [c for c in counts.columns if c not in (key, "touches_tests")]
    rows = (
        changes.select(key, "changed_lines", *(["has_tests"] if require_tests else []))
        .join(counts, key, "left")
        .na.fill(0, numbers)
        .na.fill({"touches_tests": False})
    )
    # A change of unknown size is not approvable.
    small = F.coalesce(F.col("changed_lines") <= max_changed, F.lit(False))
    approvable = (F.col("risk_score") <= max_risk) & (F.col("errors") == 0) & small
    if require_tests:
        approvable = approvable & F.coalesce(F.col("has_tests"), F.lit(False))
    return (
        rows.withColumn("risk_score", risk_score(weights))
        .withColumn("auto_approvable", approvable)
        .withColumn("status", F.when(F.col("auto_approvable"), "PASS").when(F.col("errors") > 0, "FAIL").otherwise("WARNING"))
        .withColumn("test_check", tests_check(F.col("testing"), F.col("touches_tests")))
        .withColumn("exit_status", F.when(F.col("errors") > 0, 1).otherwise(0))
    )


def exit_status(projects: DataFrame, findings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per project: 2 on an error, 1 with findings, 0 when clean."""
    counts = findings.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_findings"))
    out = projects.select("project_id").distinct().join(counts, "project_id", "left").na.fill(0, ["n_findings"])
    if errors is not None:
        failed = errors.select("project_id").distinct().withColumn("_failed", F.lit(True))
        out = out.join(failed, "project_id", "left")
    else:
        out = out.withColumn("_failed", F.lit(None).cast("boolean"))
    status = F.when(F.col("_failed"), ERROR).when(F.col("n_findings") > 0, FINDINGS).otherwise(CLEAN)
    return out.withColumn("exit_status", status).drop("_failed")


def top_n(rows: DataFrame, n: int, key: str, *order: Column) -> DataFrame:
    """First ``n`` rows per key in the order given, with ``rank``.

    Spark keeps at most ``n`` rows per key and task before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_findings(findings: DataFrame, n: int = TOP_FINDINGS, key: str = "pr_id") -> DataFrame:
    """Gravest first; then by category, file, message."""
    order = [severity.rank(F.col("severity")).asc_nulls_last(), F.col("category"), F.col("file"), F.col("message")]
    return top_n(findings, n, key, *order)


def top_fixes(fixes: DataFrame, n: int = TOP_FIXES, key: str = "pr_id") -> DataFrame:
    return top_n(fixes, n, key, F.col("action"), F.col("description"))
