"""A review of diffs: hunks, noise out, secrets and line rules on added lines, gate, comment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import text
from scanloom.functions.arrays import let
from scanloom.functions.patterns import patterns_for
from scanloom.operators import gate, rewrite, rules, secrets
from scanloom.operators.filters import DiffNoise, lang_of, without_noise
from scanloom.operators.gate import GateSettings
from scanloom.operators.reports import review_comment
from scanloom.session import cut_lineage
from scanloom.sources import diffs as diff_source

SECRET_RULE, SECRET_MESSAGE = "secret-detection", "Hardcoded secret detected"
FIX_ACTION = "Read the secret from the environment"


@dataclass
class Review:
    findings: DataFrame  # pr_id, file, line, severity, category, message, rule_id
    gate: DataFrame  # one row per pull request
    comments: DataFrame  # pr_id, comment
    fixes: DataFrame  # pr_id, file, line, action, description, or what was given


def _hits(family: str) -> Column:
    """Rules that one added line matches; a secret counts as one more rule."""
    found = rules.line_rule_hits(F.col("line"), F.col("_code"), F.col("_bare"), family, F.col("lang") == "ts")
    secret = secrets.has_secret(F.col("line"), patterns_for(family))
    return F.when(secret, F.array_append(found, F.lit(SECRET_RULE))).otherwise(found)


def _masked_new_side(family: str) -> Column:
    """The lines of ``_new``: as they are, without comments, without strings."""
    raw = F.transform("_new", lambda x: F.substring(x["line"], F.lit(2), F.length(x["line"])))
    return let(raw, lambda r: rules.masked_lines(r, family))


def review_findings(hunks: DataFrame) -> DataFrame:
    """Secrets and line rules on the added lines of hunks, in one pass (``diff_id`` is the pull request)."""
    return _findings(_added_hits(hunks))


def _findings(hits: DataFrame) -> DataFrame:
    """Findings from ``_added_hits``."""
    found = rules.rule_findings(hits, F.broadcast(_review_rules(hits.sparkSession)))
    return found.select(F.col("project_id").alias("pr_id"), "file", "line", "severity", "category", "message", "rule_id")


def _added_hits(hunks: DataFrame) -> DataFrame:
    """``project_id, path, line, rule_key, content``: rules that added lines match, with the text of a line that holds a secret.

    Rules and fixes look at files of the same languages.
    """
    by_family = lambda f: F.when(F.col("lang") == "py", f("py")).otherwise(f("js"))
    shown = hunks.filter(~F.col("is_binary") & (F.col("additions") > 0)).withColumn("lang", rules.rule_lang(F.col("file_path"))).filter(F.col("lang").isNotNull())
    # The new side of a hunk is lexed as a whole, so that a string or comment of several lines is one.
    added = (
        shown.withColumn("_new", diff_source.new_lines(F.col("lines"), F.col("new_start")))
        .withColumn("_masked", by_family(_masked_new_side))
        .select("diff_id", "file_path", "lang", F.explode(F.arrays_zip("_new", "_masked")).alias("_l"))
        .filter(diff_source.is_added(F.col("_l._new.line")))
        .select(
            "diff_id", "file_path", "lang", F.col("_l._new.line_no").alias("line_no"),
            F.col("_l._masked.raw").alias("line"), F.col("_l._masked.text").alias("_code"), F.col("_l._masked.bare").alias("_bare"),
        )
    )
    hits = added.select(
        F.col("diff_id").alias("project_id"),
        F.col("file_path").alias("path"),
        F.col("line_no").alias("line"),
        F.col("line").alias("content"),
        F.explode(by_family(_hits)).alias("rule_key"),
    )
    return hits.withColumn("content", F.when(F.col("rule_key") == SECRET_RULE, F.col("content")))


def review_fixes(hunks: DataFrame) -> DataFrame:
    """``pr_id, file, line, action, description``: a fix for each added line that holds a secret.

    The line is redacted by itself; the description shows where it stands and what it becomes.
    """
    family = lang_of(F.col("file_path"))
    added = F.filter(
        diff_source.added_in(F.struct("lines", "new_start", "is_binary")),
        lambda x: F.when(family == "py", secrets.has_secret(x["line"], patterns_for("py"))).otherwise(secrets.has_secret(x["line"], patterns_for("js"))),
    )
    lines = (
        hunks.filter(family.isin("py", "js"))
        .select("diff_id", "file_path", F.explode(added).alias("_l"))
        .select(
            F.col("diff_id").alias("pr_id"), F.col("file_path").alias("path"), F.col("_l.line_no").alias("line"),
            F.substring(F.col("_l.line"), F.lit(2), F.length("_l.line")).alias("content"),
        )
    )
    return _fixes(lines)


def _fixes(lines: DataFrame) -> DataFrame:
    """Fixes of lines with secrets (``pr_id, path, line, content``)."""
    fixed = rewrite.redact_lines(lines).filter(F.col("fixes") > 0)
    place = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"))
    return fixed.select(
        "pr_id", F.col("path").alias("file"), "line", F.lit(FIX_ACTION).alias("action"),
        F.concat(place, F.lit(" becomes `"), text.strip(F.col("fixed_content")), F.lit("`")).alias("description"),
    )


def _review_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules and the secret check: 95 rows."""
    table = rules.rule_table(spark).select("rule_key", "rule_id", "message", "severity", "category")
    secret = (SECRET_RULE, SECRET_RULE, SECRET_MESSAGE, "ERROR", "security")
    return table.union(spark.createDataFrame([secret], table.schema))


def review(
    diffs: DataFrame,
    *,
    noise: DiffNoise | None = None,
    fixes: DataFrame | None = None,
    settings: GateSettings | None = None,
) -> Review:
    """Findings, gate, fixes and comment for each diff (``diff_id, text``).

    Hits are written once, as the gate, the comment and the fixes all read them, so hunks are
    parsed once. ``fixes``
    (``pr_id, action, description``) take the place of those found on added lines.
    """
    settings = settings or GateSettings()
    source = diffs.select("diff_id", "text")
    hunks = settings.of_languages(without_noise(diff_source.parse(source), noise))
    hits = cut_lineage(_added_hits(hunks))
    findings = settings.counted(_findings(hits))
    changes = source.select(
        F.col("diff_id").alias("pr_id"),
        diff_source.changed_lines(F.col("text")).alias("changed_lines"),
        diff_source.touches_tests(F.col("text")).alias("has_tests"),
    )
    gated = gate.gate(
        findings, changes, max_risk=settings.max_risk, max_changed=settings.max_changed, weights=settings.weights, require_tests=settings.require_tests
    )
    if fixes is None:
        secret = hits.filter(F.col("rule_key") == SECRET_RULE)
        fixes = _fixes(secret.select(F.col("project_id").alias("pr_id"), "path", "line", "content"))
    return Review(findings, gated, review_comment(gated, findings, fixes), fixes)

