import json

import pytest
from pyspark.sql import functions as F

from scanloom.operators import gate, reports
from scanloom.plans import scan
from scanloom.plans.grouping import collect_in_parts
from scanloom.sources import files

SCHEMA = "project_id string, file string, line int, message string, severity string, rule_id string, level string"


@pytest.fixture(scope="module")
def findings(spark):
    rows = [
        ("p", "t.py", 10, "Hardcoded secret", "high", "secret", None),
        ("p", "t.py", 20, "SQL risk", "medium", "sql", "error"),
        ("p", "u.py", 1, "odd", "unknown", "odd", None),
        ("q", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_markdown(spark, findings):
    projects = spark.createDataFrame([("p",), ("q",), ("clean",)], "project_id string")
    got = {r.project_id: r.report for r in reports.findings_report(findings, "md", projects=projects).collect()}
    assert got["p"] == (
        "## Security Findings\n\n### 🟠 High (1)\n- **t.py:10** - Hardcoded secret (`secret`)\n\n"
        "### 🟡 Medium (1)\n- **t.py:20** - SQL risk (`sql`)\n"
    )
    assert got["q"] == "## Security Findings\n\n### 🔵 Low (1)\n- **unknown:?** - No message (`unknown`)\n"
    assert got["clean"] == "✅ No issues found."


def test_json_and_sarif(findings):
    js = {r.project_id: json.loads(r.report) for r in reports.findings_report(findings, "json").collect()}
    assert [f["line"] for f in js["p"]["findings"]] == [10, 20, 1] and "level" not in js["p"]["findings"][0]
    sarif = {r.project_id: json.loads(r.report) for r in reports.findings_report(findings, "sarif").collect()}
    run = sarif["p"]["runs"][0]
    assert sarif["p"]["version"] == "2.1.0" and [r["level"] for r in run["results"]] == ["warning", "error", "warning"]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["odd", "secret", "sql"]
    assert sarif["q"]["runs"][0]["results"][0]["ruleId"] == "SL0001"
    with pytest.raises(ValueError, match="Supported"):
        reports.findings_report(findings, "xml")


def test_parts_hold_every_row(spark):
    """A hot project and a pile of equal rows are cut, and nothing is lost."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 200)).alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"),
    )
    parts = collect_in_parts(rows, ["k"], ["v"], max_items=50)
    back = parts.select("k", F.explode("items").alias("i")).select("k", "i.v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    sizes = {(r.k, r.part): r["n"] for r in parts.select("k", "part", F.size("items").alias("n")).collect()}
    assert [n for (k, _), n in sorted(sizes.items()) if k == "hot"] == [50] * 20
    assert all(part == 0 for k, part in sizes if k != "hot")


def test_parts_follow_each_other_and_keep_null_groups(spark):
    rows = [(None, "f", i) for i in range(25)] + [("a", f"f{i // 40}", i % 3) for i in range(95)] + [("a", None, None)]
    df = spark.createDataFrame(rows, "k string, file string, line int")
    parts = sorted(collect_in_parts(df, ["k"], ["file", "line"], max_items=10).collect(), key=lambda r: (r.k or "", r.part))
    for k in (None, "a"):
        own = [r for r in parts if r.k == k]
        assert [r.part for r in own] == list(range(len(own))) and {r.parts for r in own} == {len(own)}
        assert [len(r["items"]) for r in own[:-1]] == [10] * (len(own) - 1)
        want = sorted(((f or "", -1 if n is None else n) for q, f, n in rows if q == k))
        assert [(i.file or "", -1 if i.line is None else i.line) for r in own for i in r["items"]] == want


def test_hot_project_reports_together_hold_all(spark):
    rows = [("p", f"f{i % 7}.py", i, "m", "high", f"r{i % 5}", None) for i in range(300)]
    docs = reports.findings_report(spark.createDataFrame(rows, SCHEMA), "json", max_items=40).collect()
    assert len(docs) > 1
    lines = [f["line"] for d in docs for f in json.loads(d.report)["findings"]]
    assert sorted(lines) == list(range(300))
    shown = reports.findings_report(spark.createDataFrame(rows, SCHEMA), "markdown", max_items=40).collect()
    assert len(shown) == 8 and all("High (300)" in d.report for d in shown)
    sarif = reports.findings_report(spark.createDataFrame(rows, SCHEMA), "sarif", max_items=40).collect()
    assert all(len(json.loads(d.report)["runs"][0]["tool"]["driver"]["rules"]) == 5 for d in sarif)


def test_summaries(spark, findings):
    counts = {(r.project_id, r.severity): (r.severity_rank, r.n_findings) for r in gate.count_by_severity(findings).collect()}
    assert counts == {("p", "high"): (2, 1), ("p", "medium"): (3, 1)}
    assert {r.project_id: r.rule_ids for r in gate.distinct_rules(findings).collect()}["p"] == ["odd", "secret", "sql"]
    projects = spark.createDataFrame([("p",), ("clean",), ("bad",)], "project_id string")
    failed = spark.createDataFrame([("bad",)], "project_id string")
    assert {r.project_id: r.exit_status for r in gate.exit_status(projects, findings, failed).collect()} == {"p": 1, "clean": 0, "bad": 2}


def test_status_of_files_that_fail(spark):
    rows = [
        ("ok", "a.py", b"x = '(' # [\ny = (1,\n 2)\n"), ("hit", "a.py", b"@app.get('/x')\ndef f():\n    return 1\n"), ("raw", "a.bin", b"\xff\xfe"),
        ("raw", "b.py", b"x = 1\n"), ("open", "a.py", b"def f(:\n  x = 1\n"), ("open", "b.js", b"f(\n"), ("none", "a.py", None), ("blank", "a.py", b""),
    ]
    raw = spark.createDataFrame(rows, "project_id string, path string, content binary").withColumn("length", F.octet_length("content").cast("long"))
    got = {(r.project_id, r.path): (r.failed, r.content is None) for r in files.decode_all(raw).collect()}
    assert {k: v for k, v in got.items() if v[0]} == {("raw", "a.bin"): ("decode", True), ("open", "a.py"): ("parse", False), ("none", "a.py"): ("read", True)}
    status = {r.project_id: (r.n_findings, r.exit_status) for r in scan.exit_status(raw).collect()}
    assert status == {"ok": (0, 0), "hit": (1, 1), "raw": (0, 2), "open": (0, 2), "none": (0, 2), "blank": (0, 0)}


def test_report_by_file(spark):
    rows = [("p", "b.py", 2, "high", "m2", "r2"), ("p", "a.py", 9, "low", "m1", "r1"), ("p", "b.py", 1, None, None, None), ("p", None, None, "high", "x", "r3")]
    found = spark.createDataFrame(rows, "project_id string, file string, line int, severity string, message string, rule_id string")
    text = reports.findings_report(found, "files").first().report
    assert text.split("\n\n")[0] == "## Security Findings" and text.count("### ") == 3
    assert "### a.py\n\n- Line 9 [low] m1 (`r1`)\n" in text
    assert "### b.py\n\n- Line 1 [low] No message (`unknown`)\n- Line 2 [high] m2 (`r2`)\n" in text
    assert "### unknown\n\n- Line ? [high] x (`r3`)" in text


def test_write(spark, findings, tmp_path):
    report = reports.findings_report(findings, "markdown")
    reports.write_report(report, str(tmp_path / "t"))
    back = {r.project_id: r for r in spark.read.text(str(tmp_path / "t"), wholetext=True).collect()}
    assert back["p"].value.rstrip("\n").endswith("(`sql`)")
    for how in ("json", "parquet"):
        reports.write_report(report, str(tmp_path / how), how)
        assert spark.read.format(how).load(str(tmp_path / how)).count() == 2
    with pytest.raises(ValueError):
        reports.write_report(report, str(tmp_path / "x"), "xml")
