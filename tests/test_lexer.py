"""Comments and strings out, every line kept."""

import pytest
from pyspark.sql import functions as F

from scanloom.functions import lexer, text
from scanloom.operators import rules
from scanloom.plans.review import review_findings
from scanloom.sources import diffs


def lexed(spark, code, lang):
    """(line, code, bare) of each line."""
    numbered = text.numbered(text.splitlines(F.col("t")))
    row = spark.createDataFrame([(code,)], "t string").select(lexer.lex(numbered, lang).alias("l")).select("l.*")
    row = row.select(text.numbered_pieces(F.col("code")).alias("c"), text.numbered_pieces(F.col("bare")).alias("b")).first()
    assert [p.line for p in row.c] == [p.line for p in row.b] == list(range(1, len(row.c) + 1))
    return [(c.text.rstrip(), " ".join(b.text.split())) for c, b in zip(row.c, row.b, strict=True)]


PY = [
    ('q = """x {}""".format(a)', [('q = "x {}".format(a)', 'q = "".format(a)')]),
    ('q = rf"select {a}" + b"x"', [('q = f"select {a}" + "x"', 'q = "" a + ""')]),
    ('q = f"""\nselect {a}\n"""\nz', [('q = f" select {a} "', 'q = ""'), ("", "a"), ("", ""), ("z", "z")]),
    ('"""\nfoo\n"""; go()', [('""', '""'), ("", ""), ("; go()", "; go()")]),
    ('f(\n"""a\nb"""\n)', [("f(", "f("), ('"a b"', '""'), ("", ""), (")", ")")]),
    ('x = {"k": 1}\n"""doc"""', [('x = {"k": 1}', 'x = {"": 1}'), ('""', '""')]),
    ('a = f"{x["k"]} and {y["z"]}" + b # c', [('a = f"{x["k"]} and {y["z"]}" + b', 'a = "" x[""] y[""] + b')]),
    ('s = f"{{no}}" # "x', [('s = f"no"', 's = ""')]),
    ('p(f"{eval(x)} {y:>{w}}")', [('p(f"{eval(x)} {y:>{w}}")', 'p("" eval(x) y:>{w} )')]),
    ("x = 'a\\\nb'\ny", [('x = "a\\ b"', 'x = ""'), ("", ""), ("y", "y")]),
    ('q = """\na {}\n""".format(b)', [('q = " a {} ".format()', 'q = ""'), ("", ""), (".format(b)", ".format(b)")]),
    ('u = "open\nv = 1', [('u = "open', 'u = "open'), ("v = 1", "v = 1")]),
]
JS = [
    ("/* a\n b */ eval(x)", [("", ""), (" eval(x)", "eval(x)")]),
    ("a = `x\n${b}\n`; c", [("a = `x ${b} `", 'a = ""'), ("", "b"), ("; c", "; c")]),
    ("t = `a ${ c ? `b ${d}` : 'e' } f`; run()", [("t = `a ${ c ?  b ${d}  :  e  } f`; run()", 't = "" c ? "" : "" ; run()')]),
    ("t = `${ f({a: {b: 1}}) }`; `x`", [("t = `${ f({a: {b: 1}}) }`; `x`", 't = "" f({a: {b: 1}}) ; ""')]),
    ("// c `\nx = '//no' // yes", [("", ""), ("x = '//no'", 'x = ""')]),
    ("<p>Don't</p>\na / b", [("<p>Don't</p>", "<p>Don't</p>"), ("a / b", "a / b")]),
]


@pytest.mark.parametrize("code,want", PY)
def test_python(spark, code, want):
    assert lexed(spark, code, "py") == want


@pytest.mark.parametrize("code,want", JS)
def test_scripts(spark, code, want):
    assert lexed(spark, code, "js") == want


def test_many_tokens_are_one_pass(spark):
    """More tokens than a block of the fold holds, and the depth of brackets carried over them."""
    code = "f(\n" + "\n".join(f'"a{i}", """b\n{i}""",  # c' for i in range(500)) + "\n)\n\"\"\"doc\n\"\"\"\nx = 1"
    got = lexed(spark, code, "py")
    assert got[1] == ('"a0", "b 0"', '"", ""') and got[2] == (",", ",")
    assert got[-3:] == [('""', '""'), ("", ""), ("x = 1", "x = 1")]


def test_large_files_take_seconds(spark):
    import time

    code = "".join(f'x{i} = f"a {{b}}" + """c\nd"""  # e\n' for i in range(25_000))
    df = spark.createDataFrame([(code,)], "t string")
    start = time.time()
    numbered = text.numbered(text.splitlines(F.col("t")))
    row = df.select(lexer.lex(numbered, "py").alias("l")).select(F.size(text.numbered_pieces(F.col("l.code"))).alias("n")).first()
    assert row.n == 50_000 and time.time() - start < 30


def test_user_and_built_in_rules_see_the_same_text(spark, make_files):
    files = make_files({"a.py": '"""\nbreakpoint()\n"""\nbreakpoint()\n', "b.js": "`\neval(x)\n`\neval(y)\n"})
    own = spark.createDataFrame([("u1", r"\bbreakpoint\(\)", "strings", ["py"]), ("u2", r"\beval\(", "strings", ["js"])], "rule_key string, regex string, mask string, languages array<string>")
    assert {(r.path, r.line) for r in rules.match_user_rules(files, own).collect()} == {("a.py", 4), ("b.js", 4)}
    built_in = rules.match_rules(files, keys=["py-security/debug.pdb-breakpoint", "ts-security/security.eval-usage"])
    assert {(r.path, r.line) for r in built_in.collect()} == {("a.py", 4), ("b.js", 4)}
    table = spark.createDataFrame([(1, "`\neval(x)\n`\neval(y)")], "id int, t string")
    assert [r.line for r in rules.match_line_rules(table, "js", "t", keys=["ts-security/security.eval-usage"]).collect()] == [4]


def test_added_lines_are_lexed_with_their_hunk(spark):
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,5 @@\n x = \"\"\"\n+breakpoint()\n \"\"\"\n+breakpoint()\n+y = 1\n"
    hunks = diffs.parse(spark.createDataFrame([("d", diff)], "diff_id string, text string"))
    assert {(r.line, r.rule_id) for r in review_findings(hunks).collect()} == {(4, "debug.pdb-breakpoint")}
