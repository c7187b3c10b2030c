"""One query per operator over the given tables, for the correctness gate.

Prose operators run on the text tables as they are. Code operators run on files
and diffs that Spark renders from the tables (``scanloom.plans.corpus``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import paths, severity, text
from scanloom.functions.patterns import SECRET_PATTERNS
from scanloom.operators import filters, gate, issues, learning, reports, rewrite, rules, secrets
from scanloom.operators.rule_predicates import PREDICATES
from scanloom.plans import corpus, grouping, review, scan
from scanloom.session import shared_folder
from scanloom.sources import diffs as diff_source
from scanloom.sources import files as file_source
from scanloom.sources.python_functions import function_table
from scanloom.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def web(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.rendered(spark, sf, corpus.WEB_FILES)


def server(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.rendered(spark, sf, corpus.SERVER_FILES)


def env(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.rendered(spark, sf, corpus.ENV_FILES)


def py_samples(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.rendered(spark, sf, corpus.PY_SAMPLE_FILES)


def ts_samples(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.rendered(spark, sf, corpus.TS_SAMPLE_FILES)


def diff_table(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.rendered(spark, sf, corpus.DIFFS)


def hunk_table(spark: SparkSession, sf: str) -> DataFrame:
    return diff_source.parse(diff_table(spark, sf).drop("project_id"))


def all_files(spark: SparkSession, sf: str) -> DataFrame:
    return web(spark, sf).unionByName(server(spark, sf)).unionByName(env(spark, sf))


# --- secrets in prose -------------------------------------------------------------


@query
def secret_counts_by_lang(spark, sf):
    n = secrets.count_secrets(F.col("text"))
    return (
        documents(spark, sf)
        .select("lang", n.alias("n"))
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum("n").cast("long").alias("n_secrets"),
            F.count_if(F.col("n") > 0).alias("n_docs_with_secret"),
        )
    )


@query
def secret_counts_by_type(spark, sf):
    counts = F.array(
        *[
            F.struct(F.lit(p.type).alias("type"), secrets.count_matches(F.col("text"), p).alias("n"))
            for p in SECRET_PATTERNS
        ]
    )
    return (
        documents(spark, sf)
        .select(F.explode(counts).alias("c"))
        .groupBy(F.col("c.type").alias("type"))
        .agg(F.sum("c.n").cast("long").alias("n_secrets"), F.count_if(F.col("c.n") > 0).alias("n_docs"))
    )


@query
def secret_rollup_by_source(spark, sf):
    found = secrets.find_secrets(documents(spark, sf).select("source", "text"), "text")
    return secrets.rollup_by_type(found, "source")


@query
def documents_with_secret(spark, sf):
    return documents(spark, sf).filter(secrets.has_secret(F.col("text"))).select("doc_id", "source", "lang")


@query
def secret_matches(spark, sf):
    return secrets.find_secrets(documents(spark, sf).select("doc_id", "text"), "text").select(
        "doc_id", "type", "line", "name", "value"
    )


@query
def redacted_documents(spark, sf):
    clean = rewrite.redact_text(F.col("text"))
    return documents(spark, sf).select("doc_id", F.md5(clean).alias("text_md5"), F.length(clean).alias("n_chars"))


@query
def top_documents_per_source(spark, sf):
    n = secrets.count_secrets(F.col("text"))
    rows = documents(spark, sf).select("source", "doc_id", n.cast("long").alias("n_secrets")).filter("n_secrets > 0")
    return gate.top_n(rows, 10, "source", F.col("n_secrets").desc(), F.col("doc_id"))


@query
def secrets_by_quality(spark, sf):
    n = secrets.count_secrets(F.col("text"))
    docs = documents(spark, sf).select("doc_id", n.alias("n"))
    return (
        docs.join(table(spark, sf, "labels"), "doc_id")
        .groupBy("quality", "toxic")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("long").alias("n_secrets"))
    )


@query
def secrets_in_conversations(spark, sf):
    n = secrets.count_secrets(F.col("text"))
    return (
        table(spark, sf, "conversations")
        .select("role", n.alias("n"))
        .groupBy("role")
        .agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n").cast("long").alias("n_secrets"))
    )


@query
def secrets_in_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    return pages.select("page_id", secrets.count_secrets(F.col("text")).cast("long").alias("n_secrets"))


# --- sources and scalar functions -------------------------------------------------


@query
def lines_per_document(spark, sf):
    lines = text.splitlines(F.col("text"))
    return documents(spark, sf).select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.array_max(F.transform(lines, F.length)).cast("long").alias("longest"),
        F.size(F.filter(lines, lambda x: text.strip(x) == "")).cast("long").alias("n_blank"),
    )


@query
def line_source(spark, sf):
    turns = file_source.from_table(
        table(spark, sf, "conversations"),
        project=F.col("role"),
        path=F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        content=F.col("text"),
    )
    return file_source.lines(turns).select(
        "project_id", "path", "line_no", F.md5("line").alias("line_md5"), F.length(text.indent_of(F.col("line"))).alias("indent")
    )


@query
def decoded_documents(spark, sf):
    raw = documents(spark, sf).select(
        F.col("source").alias("project_id"),
        F.col("doc_id").cast("string").alias("path"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode("text", "UTF-8"))
        .alias("content"),
        F.col("n_chars").alias("length"),
    )
    strict = file_source.decode(raw).select("project_id", "path", F.md5("content").alias("text_md5"), F.lit("strict").alias("how"))
    lenient = file_source.decode(raw, lenient=True).select(
        "project_id", "path", F.md5("content").alias("text_md5"), F.lit("lenient").alias("how")
    )
    return strict.unionByName(lenient)


@query
def glob_sources(spark, sf):
    files = all_files(spark, sf)
    py = file_source.glob_python(files).select("project_id", "path", F.lit("*.py").alias("glob"))
    return py.unionByName(file_source.glob_scripts(files).select("project_id", "path", F.lit("*.[jt]s*").alias("glob")))


@query
def env_name_source(spark, sf):
    return file_source.env_names(env(spark, sf), root_only=False)


@query
def url_suffixes(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf, "pages").select(
        "page_id",
        paths.name_of(path).alias("name"),
        paths.suffix_of(path).alias("suffix"),
        F.size(paths.parts_of(path)).cast("long").alias("n_parts"),
    )


@query
def excluded_urls(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    rows = table(spark, sf, "pages").select(
        "page_id",
        filters.in_folder(path, ["en", "fr", "build"]).alias("in_folder"),
        filters.has_suffix(path, [".html", ".htm"]).alias("has_suffix"),
        filters.too_large(F.octet_length("html").cast("long"), 4096).alias("too_large"),
    )
    return rows.groupBy("in_folder", "has_suffix", "too_large").agg(F.count(F.lit(1)).alias("n_pages"))


@query
def shown_text(spark, sf):
    out = None
    for strategy in diff_source.TRUNCATION:
        cut = diff_source.truncated(F.col("text"), max_size=1000, strategy=strategy)
        part = documents(spark, sf).select("doc_id", F.lit(strategy).alias("strategy"), cut.alias("c")).select(
            "doc_id", "strategy", F.md5("c.text").alias("text_md5"), F.col("c.is_truncated").alias("is_truncated")
        )
        out = part if out is None else out.unionByName(part)
    return out


# --- filters on files -------------------------------------------------------------


@query
def scannable_files(spark, sf):
    return filters.scannable(all_files(spark, sf), max_size=400).select("project_id", "path")


@query
def skipped_files(spark, sf):
    return filters.skipped(all_files(spark, sf), max_size=400).select("project_id", "path", "reason")


@query
def config_exclusion(spark, sf):
    keep = filters.Exclusion(directories=[*filters.CONFIG_DIRS, "jobs"], globs=[*filters.CONFIG_GLOBS, "p?.ts", "c[0-4]*.py"])
    return filters.not_excluded(all_files(spark, sf), keep).select("project_id", "path")


@query
def files_below_root(spark, sf):
    return filters.below_root(web(spark, sf), "api").select("project_id", "path")


@query
def file_types(spark, sf):
    files = all_files(spark, sf).select("project_id", filters.lang_of(F.col("path")).alias("lang"))
    return files.groupBy("project_id", "lang").agg(F.count(F.lit(1)).alias("n_files"))


@query
def server_files(spark, sf):
    path, content = F.col("path"), F.col("content")
    return server(spark, sf).filter(filters.is_server_file(path, content)).select("project_id", "path")


@query
def secrets_in_code(spark, sf):
    files = web(spark, sf).unionByName(server(spark, sf))
    return secrets.find_file_secrets(files).select("project_id", "path", "lang", "type", "line", "name", "value")


@query
def secrets_in_code_by_type(spark, sf):
    return secrets.count_by_type(secrets.find_file_secrets(web(spark, sf)))


# --- functions, learning, issues --------------------------------------------------


def _functions(files: DataFrame, method: str) -> DataFrame:
    f = function_table(filters.scannable(files), method=method)
    return f.select(
        "project_id",
        "path",
        "line",
        "name",
        "is_async",
        F.size("decorators").cast("long").alias("n_decorators"),
        F.size("params").cast("long").alias("n_params"),
        "returns",
        F.get("context", F.lit(1)).alias("line_above"),
    )


@query
def function_table_native(spark, sf):
    return _functions(web(spark, sf), "native")


@query
def function_table_exact(spark, sf):
    return _functions(web(spark, sf), "exact")


@query
def learned_patterns(spark, sf):
    learned = learning.learn(all_files(spark, sf))
    return learned.select("project_id", "kind", "value", "path", F.col("pos").cast("long").alias("pos"))


@query
def most_common_patterns(spark, sf):
    return learning.most_common(learning.learn(all_files(spark, sf)))


@query
def first_token_handler(spark, sf):
    return learning.first_handler(learning.learn(server(spark, sf)))


@query
def learned_summary(spark, sf):
    return learning.summarise(learning.learn(all_files(spark, sf)))


@query
def missing_auth(spark, sf):
    return issues.open_routes(filters.scannable(web(spark, sf)))


@query
def missing_auth_exact(spark, sf):
    return issues.open_routes(filters.scannable(web(spark, sf)), method="exact")


@query
def missing_auth_options(spark, sf):
    return issues.open_routes(
        filters.scannable(web(spark, sf)), include_async=True, auth_scope="decorators", lookback=8
    )


@query
def missing_auth_by_line_windows(spark, sf):
    files = filters.scannable(web(spark, sf))
    return issues.missing_auth_in_lines(file_source.lines(files), function_table(files))


@query
def missing_csrf(spark, sf):
    return issues.missing_csrf(filters.scannable(server(spark, sf)))


@query
def env_var_style(spark, sf):
    return issues.env_var_style(scan.with_learned(filters.scannable(env(spark, sf))))


@query
def env_var_upper_case(spark, sf):
    return issues.env_var_style(scan.with_learned(filters.scannable(env(spark, sf))), style="upper")


@query
def scan_issues(spark, sf):
    found = scan.scan(all_files(spark, sf))
    return found.groupBy("project_id", "issue_type").agg(F.count(F.lit(1)).alias("n_issues"))


@query
def scan_findings(spark, sf):
    return scan.findings(all_files(spark, sf)).drop("level")


# --- rewrites -----------------------------------------------------------------------


def _fixed(files: DataFrame) -> DataFrame:
    return rewrite.redact_secrets(files).select(
        "project_id",
        "path",
        "modified",
        "fixes",
        F.array_join("vars", ",").alias("vars"),
        F.md5("fixed_content").alias("content_md5"),
    )


@query
def redacted_python(spark, sf):
    return _fixed(web(spark, sf))


@query
def redacted_scripts(spark, sf):
    return _fixed(server(spark, sf))


@query
def new_env_names(spark, sf):
    fixed = rewrite.redact_secrets(filters.scannable(server(spark, sf)))
    return rewrite.new_env_names(fixed, file_source.env_names(env(spark, sf))).select("project_id", "name")


@query
def env_upsert(spark, sf):
    files = filters.scannable(server(spark, sf))
    fixed = rewrite.redact_secrets(files)
    return rewrite.upsert_env(fixed, files, file_source.env_names(files))


@query
def inserted_decorators(spark, sf):
    flagged = scan.flag(web(spark, sf))
    return rewrite.apply_improvements(flagged).select(
        "project_id", "path", "improved", F.md5("improved_content").alias("content_md5")
    )


@query
def inserted_decorators_by_line_windows(spark, sf):
    files = filters.scannable(web(spark, sf))
    found = issues.open_routes(files)
    lines = rewrite.insert_in_lines(file_source.lines(files), found, F.lit(learning.DEFAULT_AUTH))
    return rewrite.rebuild_text(lines).select("project_id", "path", F.md5("content").alias("content_md5"))


@query
def upper_cased_env(spark, sf):
    return rewrite.apply_improvements(scan.flag(env(spark, sf))).select("project_id", "path", "improved", "improved_content")


@query
def fix_summary(spark, sf):
    return gate.scan_summary(scan.fix(web(spark, sf)).files)


# --- rules ----------------------------------------------------------------------------


def _keys(*classes: str) -> list[str]:
    return [k for k, p in PREDICATES.items() if p.cls in classes]


@query
def line_rules_python(spark, sf):
    return rules.match_rules(py_samples(spark, sf), keys=_keys("L")).drop("lang")


@query
def line_rules_scripts(spark, sf):
    return rules.match_rules(ts_samples(spark, sf), keys=_keys("L")).drop("lang")


@query
def block_rules_python(spark, sf):
    return rules.match_rules(py_samples(spark, sf), keys=_keys("B")).drop("lang")


@query
def block_rules_scripts(spark, sf):
    return rules.match_rules(ts_samples(spark, sf), keys=_keys("B")).drop("lang")


@query
def function_rules(spark, sf):
    return rules.match_rules(py_samples(spark, sf), keys=_keys("F")).drop("lang")


@query
def pair_rules(spark, sf):
    files = py_samples(spark, sf).unionByName(ts_samples(spark, sf))
    return rules.match_rules_once(files, keys=_keys("J")).drop("lang")


@query
def all_rules_by_severity(spark, sf):
    files = py_samples(spark, sf).unionByName(ts_samples(spark, sf))
    found = rules.rule_findings(rules.match_rules_once(files))
    return found.groupBy("project_id", "severity", "category").agg(F.count(F.lit(1)).alias("n_findings"))


#: Rules whose hits in ``corpus.PY_STRINGS`` and ``TS_STRINGS`` the oracle lists by hand.
STRING_RULES = [
    *[k for k in PREDICATES if k.startswith("py-security/python.sql-injection")],
    "py-security/python.raw-sql-execution", "py-security/python.hardcoded-postgres-url", "py-security/python.hardcoded-database-url",
    "py-security/debug.pdb-breakpoint", "py-security/crypto.weak-hash-md5", "ts-security/security.eval-usage",
    "ts-security/security.document-write", "ts-security/security.inner-html-assignment", "ts-security/debug.console-log-production",
    "ts-security/typescript.hardcoded-jwt-secret", "ts-security/crypto.weak-hash",
]


@query
def rules_in_strings(spark, sf):
    """Triple-quoted and prefixed strings, f-strings, template literals and comments of several lines."""
    files = corpus.rendered(spark, sf, corpus.PY_STRING_FILES).unionByName(corpus.rendered(spark, sf, corpus.TS_STRING_FILES))
    return rules.match_rules(files, keys=STRING_RULES).drop("lang")


@query
def line_rules_on_pages(spark, sf):
    pages = spread(table(spark, sf, "pages")).select("page_id", "html")
    return rules.match_line_rules(pages, "ts", "html").groupBy("rule_key").agg(
        F.count(F.lit(1)).alias("n_hits"), F.countDistinct("page_id").alias("n_pages")
    )


@query
def line_rules_on_documents(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return rules.match_line_rules(docs, "ts", "text").groupBy("rule_key").agg(
        F.count(F.lit(1)).alias("n_hits"), F.countDistinct("doc_id").alias("n_docs")
    )


def _user_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One rule per nation: its key as a secret in the code."""
    return table(spark, sf, "nation").select(
        F.concat(F.lit("user/n"), "n_nationkey").alias("rule_key"),
        F.concat(F.lit(r"\bjwt_secret\s*=\s*\""), "n_nationkey", F.lit('"')).alias("regex"),
        F.lit("comments").alias("mask"),
        F.array(F.lit("py")).alias("languages"),
    )


@query
def user_rules(spark, sf):
    return rules.match_user_rules(web(spark, sf), _user_rules(spark, sf)).drop("lang")


@query
def user_rules_many(spark, sf):
    """More rules than one batch holds, without a mask, with a language twice."""
    many = table(spark, sf, "part").select(
        F.concat(F.lit("user/p"), "p_partkey").alias("rule_key"),
        F.concat(F.lit(r"\bjwt_secret\s*=\s*\""), "p_partkey", F.lit('"')).alias("regex"),
        F.lit(None).cast("string").alias("mask"),
        F.array(F.lit("py"), F.lit("py")).alias("languages"),
    )
    return rules.match_user_rules(web(spark, sf), many, batch=64).drop("lang")


def _rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    return rules.rule_findings(rules.match_rules(ts_samples(spark, sf), keys=_keys("L")))


@query
def severe_findings(spark, sf):
    found = filters.severe(_rule_findings(spark, sf), "WARNING")
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n_findings"))


@query
def findings_without_rules(spark, sf):
    left = filters.without_rules(_rule_findings(spark, sf), ["typescript.consistent-naming", "typescript.any-type-usage"])
    noisy = left.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0")
    return filters.without_rules(left, noisy).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_findings"))


@query
def findings_by_severity(spark, sf):
    found = _rule_findings(spark, sf).withColumn("severity", severity.finding_level(F.col("severity")))
    return gate.count_by_severity(found)


@query
def distinct_rules(spark, sf):
    return gate.distinct_rules(_rule_findings(spark, sf)).select("project_id", F.array_join("rule_ids", ",").alias("rule_ids"))


@query
def severity_pivot(spark, sf):
    found = _rule_findings(spark, sf)
    return gate.pivot_categories(found, "project_id").na.fill(0).withColumnsRenamed(
        {"ERROR": "n_error", "WARNING": "n_warning", "INFO": "n_info"}
    )


@query
def exit_status(spark, sf):
    return gate.exit_status(web(spark, sf), scan.findings(web(spark, sf)))


def _raw_files(spark: SparkSession, sf: str) -> DataFrame:
    """A project per supplier with two binary files: clean, with an open route, no UTF-8, a bracket left open, or not read."""
    rows = table(spark, sf, "supplier").withColumn("project_id", F.concat(F.lit("s"), "s_suppkey"))
    kind, clean = F.col("s_suppkey") % 5, F.lit("x = [1, (2)]  # (\n").cast("binary")
    open_route = F.lit("from fastapi import FastAPI\n\n@app.get('/x')\ndef read():\n    return 1\n").cast("binary")
    first = (
        F.when(kind == 0, clean)
        .when(kind == 1, open_route)
        .when(kind == 2, F.concat(clean, F.unhex(F.lit("FFFE"))))
        .when(kind == 3, F.lit("x = (1,\n").cast("binary"))
    )
    file = lambda path, content: rows.select("project_id", F.lit(path).alias("path"), content.alias("content"))
    other = F.when(F.col("s_suppkey") % 2 == 0, open_route).otherwise(clean)
    return file("app.py", first).unionByName(file("api/more.py", other)).withColumn("length", F.octet_length("content").cast("long"))


@query
def exit_status_of_raw_files(spark, sf):
    return scan.exit_status(_raw_files(spark, sf))


@query
def file_outcomes(spark, sf):
    """Files by the step at which they fail."""
    return file_source.decode_all(_raw_files(spark, sf)).groupBy("path", "failed").agg(F.count(F.lit(1)).alias("n_files"))


# --- reports on findings -----------------------------------------------------------


def _secret_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of the documents as findings, graver in English."""
    found = secrets.find_secrets(documents(spark, sf).select("source", "doc_id", "lang", "text"), "text")
    return found.select(
        F.col("source").alias("project_id"),
        F.concat(F.lit("doc/"), "doc_id").alias("file"),
        "line",
        F.concat(F.lit("Secret of type "), "type").alias("message"),
        F.when(F.col("lang") == "en", "high").otherwise("medium").alias("severity"),
        F.lower("type").alias("rule_id"),
        F.lit(None).cast("string").alias("level"),
    )


@query
def findings_json(spark, sf):
    return reports.findings_report(_secret_findings(spark, sf), "json")


@query
def findings_json_of_unnamed(spark, sf):
    """Findings without a project are a group like any other."""
    found = _secret_findings(spark, sf).withColumn("project_id", F.nullif("project_id", F.lit("src1")))
    return reports.findings_report(found, "json")


@query
def findings_sarif(spark, sf):
    return reports.findings_report(_secret_findings(spark, sf), "sarif")


@query
def findings_markdown(spark, sf):
    projects = documents(spark, sf).select(F.col("source").alias("project_id"))
    return reports.findings_report(_secret_findings(spark, sf), "markdown", projects=projects)


@query
def findings_in_parts(spark, sf):
    found = _rule_findings(spark, sf)
    parts = grouping.collect_in_parts(found, ["project_id"], ["file", "line", "rule_key"], max_items=50)
    return parts.groupBy("project_id").agg(
        F.sum(F.size("items")).cast("long").alias("n_items"), F.max("parts").cast("long").alias("parts")
    )


# --- diffs ---------------------------------------------------------------------------


@query
def diff_hunks(spark, sf):
    return hunk_table(spark, sf).withColumn("lines", F.md5(F.array_join("lines", "\n")))


@query
def diff_totals(spark, sf):
    return diff_source.diff_totals(hunk_table(spark, sf))


@query
def changed_lines(spark, sf):
    return diff_table(spark, sf).select("diff_id", diff_source.changed_lines(F.col("text")).cast("long").alias("changed_lines"))


@query
def added_lines(spark, sf):
    return diff_source.added_lines(hunk_table(spark, sf)).select("diff_id", "file_path", "line_no", "line", "rule_no")


@query
def diff_lines_by_windows(spark, sf):
    rows = diff_table(spark, sf).select("diff_id", F.posexplode(text.splitlines(F.col("text"))).alias("p", "line"))
    lines = rows.select("diff_id", (F.col("p") + 1).alias("line_no"), "line")
    return diff_source.parse_lines(lines).select(
        "diff_id", "line_no", "file_path", "new_start", F.col("new_line_no").cast("int").alias("new_line_no")
    )


@query
def hunks_without_noise(spark, sf):
    kept = filters.without_noise(hunk_table(spark, sf))
    return kept.groupBy("diff_type", "is_binary").agg(F.count(F.lit(1)).alias("n_hunks"), F.sum("additions").alias("additions"))


@query
def diff_markdown(spark, sf):
    return reports.report_of_diffs(diff_table(spark, sf), "markdown")


@query
def diff_json(spark, sf):
    return reports.report_of_diffs(diff_table(spark, sf), "json")


@query
def diff_sarif(spark, sf):
    return reports.report_of_diffs(diff_table(spark, sf), "sarif")


@query
def diff_sarif_results(spark, sf):
    return reports.added_line_results(hunk_table(spark, sf)).drop("rule_no")


# --- gate ------------------------------------------------------------------------------


@query
def review_findings(spark, sf):
    hunks = filters.without_noise(hunk_table(spark, sf))
    return review.review_findings(hunks)


@query
def review_gate(spark, sf):
    return review.review(diff_table(spark, sf)).gate.select(
        "pr_id", "changed_lines", "errors", "n_findings", "risk_score", "auto_approvable", "status", "test_check", "exit_status"
    )


@query
def review_categories(spark, sf):
    hunks = filters.without_noise(hunk_table(spark, sf))
    return gate.severity_by_category(review.review_findings(hunks)).select(
        "pr_id", "security_errors", "security_warnings", "quality", "testing", "touches_tests"
    )


@query
def review_gate_settings(spark, sf):
    """Python alone, without debug prints, weights and limits of its own, tests required."""
    settings = gate.GateSettings(
        threshold="WARNING", languages=("python",), excluded_rules=("debug.print-in-production",), require_tests=True,
        max_changed=8, max_risk=0.5, weights={"high": 0.3, "medium": 0.1},
    )
    return review.review(diff_table(spark, sf), settings=settings).gate.select(
        "pr_id", "changed_lines", "errors", "n_findings", "risk_score", "auto_approvable", "status", "has_tests"
    )


@query
def review_fixes(spark, sf):
    return review.review_fixes(filters.without_noise(hunk_table(spark, sf)))


@query
def review_comments(spark, sf):
    return review.review(diff_table(spark, sf)).comments


def _token(key: str, i: int) -> Column:
    """A token of the i-th kind, made from a key."""
    prefix, n = TOKENS[i]
    return F.concat(F.lit(prefix), F.left(F.repeat(F.md5(F.col(key).cast("string")), 2), F.lit(n)))


#: Prefix and length of each kind of token, in the order of the patterns.
TOKENS = [
    ("sk_live_", 20), ("sk_test_", 20), ("ghp_", 36), ("gho_", 36), ("ghu_", 36), ("ghs_", 36), ("ghr_", 36), ("ai_", 32),
    ("xoxb-", 50), ("xoxp-", 50), ("xoxa-", 50),
]


@query
def token_kinds(spark, sf):
    """Each kind of token in turn, on the second line of a text."""
    which = F.element_at(F.array(*[_token("c_custkey", i) for i in range(len(TOKENS))]), (F.col("c_custkey") % len(TOKENS) + 1).cast("int"))
    texts = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("# one\nvalue = \""), which, F.lit('"')).alias("content"))
    return secrets.find_secrets(texts).select("c_custkey", "type", "line", "match")


def _with_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """A Python file per supplier with three tokens, another with two named secrets, and some env files."""
    rows = table(spark, sf, "supplier").withColumn("project_id", F.concat(F.lit("s"), "s_suppkey"))
    line = lambda name, i: F.concat(F.lit(f"{name} = \""), _token("s_suppkey", i), F.lit('"\n'))
    named = F.concat(F.lit('token = "t'), "s_suppkey", F.lit('"\npassword = "p'), "s_suppkey", F.lit('"\n'))
    known = F.when(F.col("s_suppkey") % 3 == 0, "TOKEN=x\n").when(F.col("s_suppkey") % 3 == 1, "OTHER=1\n")
    file = lambda path, content: rows.select("project_id", F.lit(path).alias("path"), content.alias("content"))
    files = file("keys.py", F.concat(line("a", 2), line("b", 2), line("c", 2))).unionByName(file("named.py", named))
    files = files.unionByName(file(".env.example", known).where("content is not null"))
    return files.withColumn("length", F.octet_length("content").cast("long"))


@query
def redacted_three_tokens(spark, sf):
    fixed = rewrite.redact_secrets(_with_secrets(spark, sf).where("path = 'keys.py'"))
    return fixed.select("project_id", "fixed_content", "fixes", F.array_join("vars", ",").alias("vars"))


@query
def env_upsert_existing(spark, sf):
    """Projects whose env file has the name already, has others, or is missing."""
    files = _with_secrets(spark, sf).where("path <> 'keys.py'")
    return rewrite.upsert_env(rewrite.redact_secrets(files), files, file_source.env_names(files))


@query
def findings_by_file(spark, sf):
    found = _secret_findings(spark, sf)
    return reports.findings_report(found, "files").select("project_id", "part", F.md5("report").alias("report_md5"))


@query
def report_formats(spark, sf):
    """Each format by a name in any case."""
    found = _secret_findings(spark, sf)
    parts = [
        reports.findings_report(found, name).select(F.lit(name.lower()).alias("format"), "project_id", F.md5("report").alias("report_md5"))
        for name in ("JSON", "Sarif", "MD")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def report_files(spark, sf):
    """Reports written to the shared folder and read back as a tree of files."""
    projects = documents(spark, sf).select(F.col("source").alias("project_id"))
    report = reports.findings_report(_secret_findings(spark, sf), "markdown", projects=projects)
    folder = f"{shared_folder(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    reports.write_report(report.select("project_id", "report"), folder)
    tree = file_source.read_tree(spark, folder, glob="*.txt", max_size=None)
    return tree.select(F.regexp_replace("project_id", "^project_id=", "").alias("project_id"), F.md5("content").alias("content_md5"))


@query
def gate_by_source(spark, sf):
    found = _secret_findings(spark, sf).withColumn("category", F.lit("security"))
    docs = documents(spark, sf)
    n_lines = F.size(text.splitlines(F.col("text")))
    changes = docs.groupBy(F.col("source").alias("project_id")).agg(F.sum(n_lines).alias("changed_lines"))
    return gate.gate(found, changes, key="project_id").select(
        "project_id", "changed_lines", "n_findings", "risk_score", "auto_approvable", "status"
    )
