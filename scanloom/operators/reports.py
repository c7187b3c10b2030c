"""Reports as text: findings and diffs as JSON, SARIF or Markdown, and the review comment.

Findings of a project go through ``collect_in_parts``: one document for a
project of ordinary size, several with a ``part`` number for a huge one. The
documents of a project follow each other in the order of its findings and hold all
of them; the rules of a SARIF document and the counts in Markdown headings are
those of the whole project in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.arrays import let, with_fields
from scanloom.functions.severity import FINDING_LEVELS
from scanloom.operators.gate import top_findings, top_fixes
from scanloom.plans.grouping import ITEMS_PER_PART, collect_in_parts
from scanloom.plans.joins import join_lookup
from scanloom.sources.diffs import added_in, added_lines, diff_totals, hunks_in_row, truncated

TOOL_NAME, TOOL_VERSION = "scanloom", "0.2.0"

# The SARIF frame, default texts, headings and signs.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
NO_ISSUES = "✅ No issues found."
SEVERITY_SIGNS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "ℹ️"}
RULE_FORMAT = "SL%04d"
ADDED_NAME, ADDED_SHORT = "Added Line", "A new line was added"
ADDED_FULL = "A line was added to the codebase, which may introduce security issues or changes in behavior."
FINDING_ITEMS = ["file", "line", "message", "severity", "rule_id", "level"]


def _named(**cols: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in cols.items()])


def _sarif(results: Column, rules: Column) -> Column:
    driver = _named(name=F.lit(TOOL_NAME), version=F.lit(TOOL_VERSION), rules=rules)
    run = _named(tool=_named(driver=driver), results=results)
    return F.to_json(
        F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs"))
    )


def _location(uri: Column, line: Column) -> Column:
    region = _named(startLine=line, startColumn=F.lit(1))
    return F.array(_named(physicalLocation=_named(artifactLocation=_named(uri=uri), region=region)))


def _or(col: Column, default) -> Column:
    return F.coalesce(col, F.lit(default))


def _findings_json(items: Column, counts: Column, ids: Column) -> Column:
    return F.to_json(_named(findings=items))


def _findings_sarif(items: Column, counts: Column, ids: Column) -> Column:
    results = F.transform(
        items,
        lambda f: _named(
            ruleId=_or(f["rule_id"], RULE_FORMAT % 1),
            level=_or(f["level"], "warning"),
            message=_named(text=_or(f["message"], "Finding")),
            locations=_location(_or(f["file"], "unknown"), _or(f["line"], 1)),
        ),
    )
    rules = F.transform(
        ids,
        lambda i: _named(
            id=i,
            name=i,
            shortDescription=_named(text=F.lit("Security finding")),
            defaultConfiguration=_named(level=F.lit("warning")),
        ),
    )
    return _sarif(results, rules)


def _findings_markdown(items: Column, counts: Column, ids: Column) -> Column:
    blocks = []
    for level in FINDING_LEVELS:
        of_level = F.filter(items, lambda f: _or(f["severity"], "low") == level)  # noqa: B023
        head = F.concat(
            F.lit(f"### {SEVERITY_SIGNS[level]} {level.capitalize()} ("), counts[level].cast("string"), F.lit(")\n")
        )
        points = F.transform(
            of_level,
            lambda f: F.concat(
                F.lit("- **"),
                _or(f["file"], "unknown"),
                F.lit(":"),
                _or(f["line"].cast("string"), "?"),
                F.lit("** - "),
                _or(f["message"], "No message"),
                F.lit(" (`"),
                _or(f["rule_id"], "unknown"),
                F.lit("`)"),
            ),
        )
        blocks.append(F.when(F.size(of_level) > 0, F.concat(head, F.array_join(points, "\n"), F.lit("\n"))))
    return F.when(F.size(items) == 0, NO_ISSUES).otherwise(
        F.array_join(F.concat(F.array(F.lit("## Security Findings\n")), F.array_compact(F.array(*blocks))), "\n")
    )


def _findings_by_file(items: Column, counts: Column, ids: Column) -> Column:
    """A heading for each file; items come in the order of their files, so one look back tells where the next begins."""

    def point(f: Column, i: Column) -> Column:
        file = _or(f["file"], "unknown")
        head = F.concat(F.lit("### "), file, F.lit("\n\n"))
        begins = (i == 0) | (file != _or(F.get(items, i - 1)["file"], "unknown"))
        line = F.concat(
            F.lit("- Line "), _or(f["line"].cast("string"), "?"), F.lit(" ["), _or(f["severity"], "low"), F.lit("] "),
            _or(f["message"], "No message"), F.lit(" (`"), _or(f["rule_id"], "unknown"), F.lit("`)"),
        )
        return F.concat(F.when(begins & (i > 0), "\n").otherwise(""), F.when(begins, head).otherwise(""), line)

    body = F.array_join(F.transform(items, point), "\n")
    return F.when(F.size(items) == 0, NO_ISSUES).otherwise(F.concat(F.lit("## Security Findings\n\n"), body, F.lit("\n")))


_FINDING_FORMATS = {
    "files": _findings_by_file,
    "markdown": _findings_markdown,
    "md": _findings_markdown,
    "json": _findings_json,
    "sarif": _findings_sarif,
}


def _pick(formats: dict, name: str):
    found = formats.get(name.lower())
    if found is None:
        raise ValueError(f"Unsupported format: {name}. Supported: markdown, json, sarif")
    return found


def findings_report(
    findings: DataFrame,
    format: str = "markdown",
    *,
    projects: DataFrame | None = None,
    max_items: int = ITEMS_PER_PART,
) -> DataFrame:
    """``project_id, part, parts, report``. Findings are ordered by file, line and message.

    The format is ``markdown`` by severity, ``files`` (Markdown by file), ``json`` or ``sarif``.

    With ``projects`` (``project_id``) clean projects get a report too.
    """
    render = _pick(_FINDING_FORMATS, format)
    if "level" not in findings.columns:
        findings = findings.withColumn("level", F.lit(None).cast("string"))
    rows = findings.withColumn("line", F.col("line").cast("int"))
    grouped = collect_in_parts(rows, ["project_id"], FINDING_ITEMS, max_items=max_items)
    of_level = lambda level: F.count(F.when(_or(F.col("severity"), "low") == level, 1)).alias(level)
    whole = rows.groupBy("project_id").agg(
        F.array_sort(F.collect_set(_or(F.col("rule_id"), RULE_FORMAT % 1))).alias("_ids"),
        *[of_level(level) for level in FINDING_LEVELS],
    )
    whole = whole.select("project_id", "_ids", F.struct(*FINDING_LEVELS).alias("_counts"))
    grouped = join_lookup(grouped, whole, ["project_id"], "left", salt_on=["part"])
    if projects is not None:
        none = F.array().cast(dict(grouped.dtypes)["items"])
        grouped = (
            _all_projects(projects, grouped)
            .withColumn("part", F.coalesce("part", F.lit(0)))
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("items", F.coalesce("items", none))
        )
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    report = render(F.col("items"), F.col("_counts"), ids).alias("report")
    return grouped.select("project_id", "part", "parts", report)


def _all_projects(projects: DataFrame, grouped: DataFrame) -> DataFrame:
    every = projects.select(F.col("project_id").alias("_every")).distinct()
    same = F.col("_every").eqNullSafe(F.col("project_id"))
    return every.join(grouped, same, "left").drop("project_id").withColumnRenamed("_every", "project_id")


# --- diffs: one document per diff, which was one row of text to begin with --------


def _diff_files(hunks: DataFrame) -> DataFrame:
    item = F.struct(
        "file_no", "hunk_no", "file_path", "old_file", "new_file", "diff_type", "additions", "deletions", "lines",
        "is_binary", "old_start", "old_count", "new_start", "new_count",
    )
    files = hunks.groupBy("diff_id").agg(F.sort_array(F.collect_list(item)).alias("files"))
    return files.join(diff_totals(hunks), "diff_id")


def _with_truncation(hunks: DataFrame) -> DataFrame:
    """Totals and files; ``is_truncated, truncation_reason`` come from ``hunks`` if it has them."""
    out = _diff_files(hunks)
    if "is_truncated" not in hunks.columns:
        return out.withColumn("is_truncated", F.lit(False)).withColumn("truncation_reason", F.lit(None).cast("string"))
    flags = hunks.groupBy("diff_id").agg(
        F.bool_or("is_truncated").alias("is_truncated"), F.max("truncation_reason").alias("truncation_reason")
    )
    return out.join(flags, "diff_id")


def _in_row(diffs: DataFrame, max_size: int | None, strategy: str) -> DataFrame:
    """What ``_with_truncation`` gives, from whole diffs and without moving them."""
    def shown(whole: Column) -> Column:
        if max_size is not None:
            return truncated(whole, max_size=max_size, strategy=strategy)
        return _named(text=whole, is_truncated=F.lit(False), truncation_reason=F.lit(None).cast("string"))

    rows = with_fields(diffs.select("diff_id", F.col("text").alias("_whole")), let(F.col("_whole"), shown)).drop("_whole")
    rows = hunks_in_row(rows).where(F.size("files") > 0)
    total = lambda field: F.aggregate("files", F.lit(0).cast("long"), lambda s, h: s + h[field])
    return rows.withColumns({
        "total_additions": total("additions"),
        "total_deletions": total("deletions"),
        "total_files": F.size(F.array_distinct(F.filter(F.transform("files", lambda h: h["file_path"]), lambda x: x.isNotNull()))).cast("long"),
    })


def _diff_json(rows: DataFrame) -> DataFrame:
    files = F.transform(
        "files",
        lambda h: _named(
            file=F.coalesce(h["new_file"], h["old_file"]),
            old_file=h["old_file"],
            new_file=h["new_file"],
            diff_type=h["diff_type"],
            additions=h["additions"],
            deletions=h["deletions"],
            lines=h["lines"],
            is_binary=h["is_binary"],
        ),
    )
    whole = F.struct(
        "total_files", "total_additions", "total_deletions", "is_truncated", "truncation_reason", files.alias("files")
    )
    return rows.select("diff_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def diff_hunks_json(hunks: DataFrame) -> DataFrame:
    """Totals and hunks with their line ranges as JSON."""
    files = F.transform(
        "files",
        lambda h: F.struct(
            *[
                h[c].alias(c)
                for c in (
                    "file_path", "old_start", "old_count", "new_start", "new_count", "diff_type", "additions",
                    "deletions", "lines", "is_binary", "old_file", "new_file",
                )
            ]
        ),
    )
    whole = F.struct("total_files", "total_additions", "total_deletions", files.alias("files"))
    return _diff_files(hunks).select("diff_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def added_line_results(hunks: DataFrame) -> DataFrame:
    """One row per SARIF result of a diff: ``diff_id, rule_no, rule_id, uri, line_no, message``.

    Lines are numbered in the new file; marks and deleted lines do not count.
    """
    return added_lines(hunks).select(
        "diff_id",
        "rule_no",
        F.format_string(RULE_FORMAT, F.col("rule_no")).alias("rule_id"),
        F.col("file_path").alias("uri"),
        "line_no",
        F.concat(F.lit("Added line: "), F.trim(F.col("line"), F.lit(" \t\r"))).alias("message"),
    )


def _diff_sarif(rows: DataFrame) -> DataFrame:
    lines = F.flatten(
        F.transform("files", lambda h: F.transform(added_in(h), lambda x: _named(uri=h["file_path"], line_no=x["line_no"], line=x["line"])))
    )
    numbered = F.transform(
        lines,
        lambda x, i: _named(
            rule_id=F.format_string(RULE_FORMAT, i + 1),
            uri=x["uri"],
            line_no=x["line_no"],
            message=F.concat(F.lit("Added line: "), F.trim(F.substring(x["line"], F.lit(2), F.length(x["line"])), F.lit(" \t\r"))),
        ),
    )
    every = with_fields(rows, F.struct(numbered.alias("r")))
    found = F.transform(
        "r",
        lambda x: _named(
            ruleId=x["rule_id"],
            level=F.lit("warning"),
            message=_named(text=x["message"]),
            locations=_location(x["uri"], x["line_no"]),
        ),
    )
    rules = F.transform(
        "r",
        lambda x: _named(
            id=x["rule_id"],
            name=F.lit(ADDED_NAME),
            shortDescription=_named(text=F.lit(ADDED_SHORT)),
            fullDescription=_named(text=F.lit(ADDED_FULL)),
            defaultConfiguration=_named(level=F.lit("warning")),
        ),
    )
    return every.select("diff_id", _sarif(found, rules).alias("report"))


def _diff_markdown(rows: DataFrame) -> DataFrame:
    note = F.when(
        F.col("is_truncated"), F.concat(F.lit("> ⚠️ **Diff Truncated**: "), F.col("truncation_reason"), F.lit("\n"))
    )
    summary = F.format_string(
        "**Summary**: %d files, +%d -%d\n", F.col("total_files"), F.col("total_additions"), F.col("total_deletions")
    )
    name = lambda h: F.coalesce(h["new_file"], h["old_file"])
    blocks = F.transform(
        "files",
        lambda h: F.when(
            h["is_binary"], F.concat(F.lit("### "), name(h), F.lit(" (binary)\n*Binary file changed*"))
        ).otherwise(
            F.concat(
                F.lit("### "),
                name(h),
                F.lit("\n\n```diff\n"),
                F.array_join(F.concat(h["lines"], F.array(F.lit("```"))), "\n"),
                F.lit("\n"),
            )
        ),
    )
    text = F.array_join(F.concat(F.array_compact(F.array(note, summary)), blocks), "\n")
    return rows.select("diff_id", text.alias("report"))


_DIFF_FORMATS = {"markdown": _diff_markdown, "json": _diff_json, "sarif": _diff_sarif}


def diff_report(hunks: DataFrame, format: str = "markdown") -> DataFrame:
    """``diff_id, report``: hunks of each diff as Markdown, JSON or SARIF."""
    return _pick(_DIFF_FORMATS, format)(_with_truncation(hunks))


def report_of_diffs(
    diffs: DataFrame, format: str = "markdown", *, max_size: int | None = None, strategy: str = "head"
) -> DataFrame:
    """``diff_id, report`` of each diff (``diff_id, text``) that changes a file, with no shuffle.

    With ``max_size`` a longer diff is cut by the strategy first, and its report says so.
    """
    return _pick(_DIFF_FORMATS, format)(_in_row(diffs, max_size, strategy))



# --- review comment ---------------------------------------------------------------


def review_comment(
    gated: DataFrame,
    findings: DataFrame,
    fixes: DataFrame | None = None,
    *,
    title: str = "Code review",
    footer: str | None = None,
) -> DataFrame:
    """``pr_id, comment``: status, risk, checks, top findings and top fixes as Markdown."""
    tops = (
        top_findings(findings)
        .groupBy("pr_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "severity", "category", "message"))).alias("tops"))
    )
    rows = gated.join(tops, "pr_id", "left")
    if fixes is None:
        rows = rows.withColumn("fixes", F.lit(None).cast("array<struct<rank:int,action:string,description:string>>"))
    else:
        best = (
            top_fixes(fixes)
            .groupBy("pr_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "action", "description"))).alias("fixes"))
        )
        rows = rows.join(best, "pr_id", "left")
    checks = F.array(
        F.when(
            F.col("security") > 0,
            F.format_string("- Security: %d errors, %d warnings", F.col("security_errors"), F.col("security_warnings")),
        ),
        F.when(F.col("quality") > 0, F.format_string("- Quality: %d suggestions", F.col("quality"))),
        F.when(F.col("test_check") == "gaps", "- Test Coverage: gaps detected").when(
            F.col("test_check") == "none", "- Test Coverage: no tests in changes"
        ),
    )
    head = F.concat(
        F.lit(f"## {title} "),
        F.col("status"),
        F.lit("\n\n**Risk Score:** "),
        F.col("risk_score").cast("string"),
        F.lit(" | **Auto-Approvable:** "),
        F.when(F.col("auto_approvable"), "Yes").otherwise("No"),
        F.lit("\n\n### Checks"),
    )
    found = F.transform(
        "tops",
        lambda t: F.concat(F.lit("- ["), t["severity"], F.lit("] "), t["category"], F.lit(": "), t["message"]),
    )
    fixed = F.transform(
        "fixes", lambda t: F.concat(F.lit("- **"), t["action"], F.lit("**: "), t["description"])
    )
    section = lambda name, col, points: F.when(
        F.size(col) > 0, F.concat(F.lit(f"### {name}\n"), F.array_join(points, "\n"), F.lit("\n"))
    )
    end = F.lit("---" + (f"\n*{footer}*" if footer else ""))
    body = F.array_compact(
        F.concat(
            F.array(head),
            checks,
            F.array(F.lit("")),
            F.array(section("Top Findings", F.col("tops"), found), section("Suggested Fixes", F.col("fixes"), fixed), end),
        )
    )
    return rows.select("pr_id", F.array_join(body, "\n").alias("comment"))


def write_report(report: DataFrame, path: str, format: str = "text", *, column: str = "report") -> None:
    """Reports to a folder, one sub-folder per project or diff: ``text``, ``json`` or ``parquet``."""
    if format not in ("text", "json", "parquet"):
        raise ValueError(f"Unsupported format: {format}. Supported: text, json, parquet")
    if format == "text":
        keys = [c for c in report.columns if c != column]
        report.select(*keys, F.col(column).alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)
    else:
        report.write.mode("overwrite").format(format).save(path)
