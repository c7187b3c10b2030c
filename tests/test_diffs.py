import json

import pytest
from pyspark.sql import functions as F

from scanloom.operators import gate, reports
from scanloom.plans import corpus, review
from scanloom.sources import diffs

ONE = "diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,3 +1,4 @@\n def hello():\n+    print(\"hello\")\n     return \"world\"\n"
MANY = (
    "diff --git a/o.py b/n.py\nsimilarity index 90%\nrename from o.py\nrename to n.py\n--- a/o.py\n+++ b/n.py\n"
    "@@ -5 +5,2 @@ def x\n-old\n+new\n+++odd\n\\ No newline at end of file\n@@ -20,2 +21,2 @@\n keep\n-a\n+b\n"
    "diff --git a/i.png b/i.png\nnew file mode 100644\nBinary files /dev/null and b/i.png differ\n"
    "diff --git a/g.ts b/g.ts\ndeleted file mode 100644\n--- a/g.ts\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    "diff --git a/c.py b/d.py\nsimilarity index 100%\ncopy from c.py\ncopy to d.py\n"
)


@pytest.fixture(scope="module")
def hunks(spark):
    return diffs.parse(spark.createDataFrame([("one", ONE), ("many", MANY), ("none", "")], "diff_id string, text string"))


def test_one_hunk(hunks):
    r = hunks.filter("diff_id = 'one'").first()
    assert (r.file_path, r.old_start, r.old_count, r.new_start, r.new_count) == ("t.py", 1, 3, 1, 4)
    assert (r.additions, r.deletions, r.diff_type, r.is_binary) == (1, 0, "modified", False)
    assert r.lines == ONE.split("\n")[3:-1]


def test_kinds_and_headers(hunks):
    rows = hunks.filter("diff_id = 'many'").orderBy("file_no", "hunk_no").collect()
    assert [(r.file_no, r.hunk_no, r.file_path, r.diff_type, r.is_binary, len(r.lines)) for r in rows] == [
        (1, 1, "n.py", "renamed", False, 5), (1, 2, "n.py", "renamed", False, 4), (2, 1, "i.png", "added", True, 0),
        (3, 1, "g.ts", "deleted", False, 2), (4, 1, "d.py", "copied", False, 0),
    ]
    assert (rows[0].old_file, rows[0].new_file, rows[0].old_count, rows[0].new_count) == ("o.py", "n.py", 1, 2)
    assert (rows[2].old_file, rows[2].new_file, rows[3].old_file, rows[3].new_file) == (None, "i.png", "g.ts", None)


def test_totals_and_changed_lines(spark, hunks):
    totals = {r.diff_id: (r.total_additions, r.total_deletions, r.total_files) for r in diffs.diff_totals(hunks).collect()}
    assert totals == {"one": (1, 0, 1), "many": (2, 3, 4)}
    df = spark.createDataFrame([(ONE,)], "t string")
    assert df.select(diffs.changed_lines(F.col("t"))).first()[0] == 2


def test_line_numbers_are_those_of_the_new_file(hunks):
    rows = diffs.added_lines(hunks).orderBy("diff_id", "rule_no").collect()
    assert [(r.diff_id, r.rule_no, r.file_path, r.line_no, r.line) for r in rows] == [
        ("many", 1, "n.py", 5, "new"), ("many", 2, "n.py", 22, "b"), ("one", 1, "t.py", 2, '    print("hello")'),
    ]
    plain = diffs.added_text(hunks).select("diff_id", "line_no", "line")
    assert sorted(plain.collect()) == sorted(diffs.added_lines(hunks).select("diff_id", "line_no", "line").collect())


def test_headers_without_git(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n--- a/y.py\t2020\n+++ b/y.py\t2020\n@@ -1 +1 @@\n-a\n+b\n"
    rows = diffs.parse(spark.createDataFrame([("d", text)], "diff_id string, text string")).collect()
    assert [(r.file_path, r.additions, r.deletions) for r in rows] == [("x.py", 1, 1), ("y.py", 1, 1)]


def test_window_form_is_the_same(spark):
    table = corpus.rendered(spark, "/root/testdata/sf0.001", corpus.DIFFS).drop("project_id")
    lines = table.select("diff_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    parsed = diffs.parse_lines(lines)
    # Blocks of three lines: headers and counts cross many of them.
    assert sorted(map(str, diffs.parse_lines(lines, block_rows=3).collect())) == sorted(map(str, parsed.collect()))
    seen = parsed.filter(F.col("line").startswith("+") & ~F.col("line").startswith("+++") & F.col("new_line_no").isNotNull())
    got = seen.select("diff_id", "file_path", F.col("new_line_no").cast("int"), F.expr("substr(line, 2)"))
    want = diffs.added_lines(diffs.parse(table)).select("diff_id", "file_path", "line_no", "line")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_truncation(spark):
    df = spark.createDataFrame([("abcdefghij",)], "t string")
    cut = lambda s, n=4: df.select(diffs.truncated(F.col("t"), max_size=n, strategy=s).alias("c")).first().c
    assert [cut(s).text for s in diffs.TRUNCATION] == ["abcd", "ghij", "abij"]
    assert cut("head").is_truncated and cut("head", 10).text == "abcdefghij" and not cut("head", 10).is_truncated
    with pytest.raises(ValueError):
        diffs.truncated(F.col("t"), strategy="smart")


def test_diff_reports(hunks):
    md = {r.diff_id: r.report for r in reports.diff_report(hunks).collect()}
    assert md["one"] == "**Summary**: 1 files, +1 -0\n\n### t.py\n\n```diff\n" + "\n".join(ONE.split("\n")[3:-1]) + "\n```\n"
    assert "### i.png (binary)\n*Binary file changed*" in md["many"]
    js = {r.diff_id: json.loads(r.report) for r in reports.diff_report(hunks, "json").collect()}
    assert js["one"]["total_additions"] == 1 and js["one"]["files"][0]["file"] == "t.py" and js["one"]["is_truncated"] is False
    assert js["many"]["files"][2]["old_file"] is None
    sarif = {r.diff_id: json.loads(r.report) for r in reports.diff_report(hunks, "SARIF").collect()}
    run = sarif["many"]["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["SL0001", "SL0002"] == [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert run["results"][0]["message"]["text"] == "Added line: new"
    assert run["results"][1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 22, "startColumn": 1}
    whole = {r.diff_id: json.loads(r.report) for r in reports.diff_hunks_json(hunks).collect()}
    assert whole["one"]["files"][0]["new_count"] == 4
    with pytest.raises(ValueError):
        reports.diff_report(hunks, "html")


def test_truncation_note(hunks):
    cut = hunks.withColumn("is_truncated", F.col("diff_id") == "one").withColumn("truncation_reason", F.lit("too long"))
    md = {r.diff_id: r.report for r in reports.diff_report(cut).collect()}
    assert md["one"].startswith("> ⚠️ **Diff Truncated**: too long\n\n**Summary**") and md["many"].startswith("**Summary**")


def test_review(spark):
    text = ONE + (
        "diff --git a/package-lock.json b/package-lock.json\n--- a/package-lock.json\n+++ b/package-lock.json\n@@ -1 +1 @@\n+const x = 1\n"
        "diff --git a/s.ts b/s.ts\n--- a/s.ts\n+++ b/s.ts\n@@ -1 +1,2 @@\n a\n+let token = 'x'\n"
    )
    quiet = "diff --git a/r.md b/r.md\n--- a/r.md\n+++ b/r.md\n@@ -1 +1 @@\n+text\n"
    table = spark.createDataFrame([("1", text), ("2", quiet), ("3", ONE)], "diff_id string, text string")
    fixes = spark.createDataFrame([("1", f"a{i}", "do") for i in range(7)], "pr_id string, action string, description string")
    done = review.review(table, fixes=fixes)
    found = {(r.pr_id, r.file, r.line, r.rule_id) for r in done.findings.collect()}
    assert found == {("1", "t.py", 2, "debug.print-in-production"), ("3", "t.py", 2, "debug.print-in-production"), ("1", "s.ts", 2, "secret-detection")}
    gated = {r.pr_id: r for r in done.gate.collect()}
    assert [(gated[k].status, gated[k].risk_score, gated[k].exit_status) for k in "123"] == [("FAIL", 0.9, 1), ("PASS", 0.0, 0), ("PASS", 0.1, 0)]
    comments = {r.pr_id: r.comment for r in done.comments.collect()}
    assert comments["1"].startswith("## Code review FAIL\n\n**Risk Score:** 0.9 | **Auto-Approvable:** No\n\n### Checks\n- Security: 1 errors, 0 warnings\n")
    assert comments["1"].count("- **a") == 5 and "### Suggested Fixes" not in comments["2"]
    assert "- [ERROR] security: Hardcoded secret detected" in comments["1"]


def test_fixes_come_from_added_lines(spark):
    text = (
        "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +7,5 @@\n keep = 1\n-password = 'old'\n+  password = 'new'\n password = 'kept'\n"
        "+api_key = os.getenv('X')\n+k = 'sk_live_0123456789ab'\n"
        "diff --git a/b.ts b/b.ts\n--- a/b.ts\n+++ b/b.ts\n@@ -1 +1,2 @@\n a\n+let token = 'x'\n"
        "diff --git a/c.md b/c.md\n--- a/c.md\n+++ b/c.md\n@@ -1 +1,2 @@\n a\n+password = 'x'\n"
    )
    table = spark.createDataFrame([("1", text), ("2", ONE), (None, text), ("3", None)], "diff_id string, text string")
    rows = review.review_fixes(diffs.parse(table)).where("pr_id = '1'").collect()
    assert {(r.file, r.line, r.description.split(" becomes ")[1]) for r in rows} == {
        ("a.py", 8, '`password = os.getenv("PASSWORD", "CHANGE_ME_IN_PRODUCTION")`'),
        ("a.py", 11, '`k = os.getenv("API_KEY_1", "CHANGE_ME_IN_PRODUCTION")`'),
        ("b.ts", 2, '`const token = process.env.TOKEN || "CHANGE_ME_IN_PRODUCTION";`'),
    }
    done = review.review(table)
    comments = {r.pr_id: r.comment for r in done.comments.collect()}
    assert comments["1"].count("- **Read the secret from the environment**: ") == 3 and "Suggested Fixes" not in comments["2"]


def test_gate_settings(spark):
    added = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1,3 @@\n a\n+print(1)\n+password = 'x'\n"
    table = spark.createDataFrame([("py", added.format("a.py")), ("tested", added.format("tests/a.py")), ("ts", added.format("a.ts"))], "diff_id string, text string")

    def judged(**settings):
        rows = review.review(table, settings=gate.GateSettings(**settings)).gate.collect()
        return {r.pr_id: (r.n_findings, r.risk_score, r.auto_approvable) for r in rows}

    assert judged(languages=("python",))["ts"] == (0, 0.0, True)
    quiet = judged(threshold="ERROR", excluded_rules=("secret-detection",))
    assert quiet["py"][0] < judged()["py"][0]
    only_info = {"excluded_rules": ("secret-detection", "python.password-in-config"), "languages": ("python",)}
    assert judged(**only_info, require_tests=True)["py"][2] is False and judged(**only_info, require_tests=True)["tested"][2] is True
    assert judged(**only_info, weights={"info": 0.03})["py"][1] == 0.03
    with pytest.raises(ValueError):
        judged(languages=("cobol",))


def test_lines_of_a_diff_in_blocks_of_any_size(spark):
    lines = MANY.split("\n")
    rows = [(d, i, x) for d in ("a", "b") for i, x in enumerate(lines, 1)]
    table = spark.createDataFrame(rows, "diff_id string, line_no int, line string")
    whole = sorted(diffs.parse_lines(table).collect())
    assert len(whole) == len(rows)
    for size in (1, 2, 5):
        assert sorted(diffs.parse_lines(table, block_rows=size).collect()) == whole
    numbers = {r.line: r.new_line_no for r in whole if r.new_line_no}
    wanted = {r.line: r.line_no for r in diffs.added_lines(diffs.parse(spark.createDataFrame([("a", MANY)], "diff_id string, text string"))).collect()}
    assert wanted and all(numbers["+" + line] == at for line, at in wanted.items())


def test_gate_numbers(spark):
    rows = [("1", "a.py", "WARNING", "testing", "m")] + [("2", "tests/a.py", "INFO", "clean-code", "m")] * 3
    found = spark.createDataFrame(rows, "pr_id string, file string, severity string, category string, message string")
    changes = spark.createDataFrame([("1", 10), ("2", 401), ("3", 400)], "pr_id string, changed_lines int")
    got = {r.pr_id: (r.risk_score, r.status, r.test_check, r.quality) for r in gate.gate(found, changes).collect()}
    assert got == {"1": (0.5, "WARNING", "gaps", 0), "2": (0.3, "WARNING", None, 3), "3": (0.0, "PASS", "none", 0)}
    many = spark.createDataFrame([("1", "a", "ERROR", "security", "m")] * 9, found.schema)
    assert gate.gate(many, changes).filter("pr_id = '1'").first().risk_score == 1.0


def parsed(spark, text):
    rows = diffs.parse(spark.createDataFrame([("d", text)], "diff_id string, text string")).orderBy("file_no", "hunk_no").collect()
    return [(r.file_path, r.new_start, r.additions, r.deletions, len(r.lines)) for r in rows]


def test_hunks_end_by_their_counts(spark):
    plain = "--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +1,2 @@\n keep\n--- old comment\n+++ new comment\n@@ -9 +9 @@\n-a\n+b\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-c\n+d\n\\ No newline at end of file\n"
    rows = diffs.parse(spark.createDataFrame([("d", plain)], "diff_id string, text string")).orderBy("file_no", "hunk_no").collect()
    assert [(r.file_path, r.new_start, len(r.lines)) for r in rows] == [("x.sql", 1, 4), ("x.sql", 9, 3), ("y", 1, 4)]
    # What looks like a header stays in its hunk, and is no change, as everywhere.
    assert [(r.additions, r.deletions) for r in rows] == [(0, 0), (1, 1), (1, 1)]
    mailed = "Subject: x\n---\n x | 2 +-\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n-- \n2.39.0\n"
    assert parsed(spark, mailed) == [("x", 1, 1, 1, 3)]


def test_only_line_feeds_end_lines(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n+a\r+b\r@@ -9 +9 @@\u2028+c\n c\n+d\u0085+e\n"
    assert [r[:2] for r in parsed(spark, text)] == [("x", 1)]
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(diffs.changed_lines(F.col("t"))).first()[0] == 3


@pytest.mark.parametrize("format", ["markdown", "json", "sarif"])
def test_reports_of_whole_diffs_move_nothing(spark, hunks, format):
    table = spark.createDataFrame([("one", ONE), ("many", MANY), ("none", "")], "diff_id string, text string")
    whole = reports.report_of_diffs(table, format)
    assert sorted(whole.collect()) == sorted(reports.diff_report(hunks, format).collect())
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_truncation_is_told_in_the_report(spark):
    table = spark.createDataFrame([("one", ONE), ("many", MANY)], "diff_id string, text string")
    got = {r.diff_id: r.report for r in reports.report_of_diffs(table, max_size=200).collect()}
    assert got["many"].startswith(f"> ⚠️ **Diff Truncated**: {len(MANY)} characters, head 200 kept") and "Truncated" not in got["one"]
    told = json.loads(reports.report_of_diffs(table, "json", max_size=200).where("diff_id = 'many'").first().report)
    assert told["is_truncated"] and "head 200" in told["truncation_reason"]


def test_a_review_parses_hunks_once(spark, monkeypatch):
    """Fixes come from the hits that findings come from, and are those of the hunks."""
    from pyspark.sql import functions as F

    from scanloom.plans import corpus, review

    table = corpus.rendered(spark, "/root/testdata/sf0.001", corpus.DIFFS).select("diff_id", "text").limit(60)
    extra = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1,1 +1,3 @@\n a\n+api_key = 'sk_live_12345678901234567890'\n+password = \"p4ss-w0rd\"\n"
    more = [(f, extra.format(f)) for f in ("a.py", "a.ts", "a.tsx", "a.js", "a.jsx", ".js", "a.md", "x/.env.example")]
    table = table.unionByName(spark.createDataFrame(more, "diff_id string, text string")).localCheckpoint()
    want = sorted(map(str, review.review_fixes(review.without_noise(review.diff_source.parse(table))).collect()))
    done = review.review(table)
    assert sorted(map(str, done.fixes.collect())) == want and len(want) > 10
    assert "regexp" not in done.findings._jdf.queryExecution().optimizedPlan().toString()
    plan = done.fixes._jdf.queryExecution().optimizedPlan().toString()
    assert "@@ -" not in plan  # the header of a hunk is not looked for again


def test_hunks_that_fit_their_counts_are_not_folded(spark):
    """Signs are counted in the text; a hunk with a line too many, an empty one or a note is still ended by its counts."""
    text = (
        "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,3 +1,4 @@ f\n a\n-b\n+c\n+++d\n e\n"
        "@@ -9 +10,2 @@\n a\n+b\n\n@@ -20,2 +30,2 @@\n a\n\n@@ -5 odd\n+x\n"
        "diff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file"
    )
    table = spark.createDataFrame([("1", text)], "diff_id string, text string")
    rows = diffs.parse(table).orderBy("file_no", "hunk_no").collect()
    assert [(r.old_start, r.old_count, r.new_start, r.new_count, r.lines[1:], r.additions, r.deletions) for r in rows] == [
        (1, 3, 1, 4, [" a", "-b", "+c", "+++d", " e"], 1, 1), (9, 1, 10, 2, [" a", "+b"], 1, 0), (20, 2, 30, 2, [" a", ""], 0, 0),
        (None, 1, None, 1, ["+x"], 1, 0), (1, 1, 1, 1, ["-a", "+b", "\\ No newline at end of file"], 1, 1),
    ]
    whole = diffs.hunks_in_row(table).select(F.inline("files")).collect()
    assert [(r.file_no, r.hunk_no, r.new_start, r.lines, r.additions) for r in whole] == [(r.file_no, r.hunk_no, r.new_start, r.lines, r.additions) for r in rows]


def test_reviews_cut_only_hunks_with_strings_or_comments_into_tokens(spark):
    from scanloom.functions import text
    from scanloom.functions.lexer import lex
    from scanloom.operators import rules

    table = spark.createDataFrame([(["a = 1", "", "print(x)"],), (["'''", "print(1)", "'''"],), (["x", "// eval(y)"],), ([],)], "raw array<string>")
    for family in ("py", "js"):
        both = table.select(rules.masked_lines(F.col("raw"), family), rules.masked(F.col("raw"), lex(text.numbered(F.col("raw")), family))["_pieces"]).collect()
        assert all(list(got) == list(want) for got, want in both)
    found = review.review_findings(diffs.parse(spark.createDataFrame([("1", ONE), ("2", MANY)], "diff_id string, text string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(additions#" in plan.split("Filter", 1)[1]  # hunks that add nothing end here
    assert {(r.pr_id, r.line, r.rule_id) for r in found.collect()} == {("1", 2, "debug.print-in-production")}
