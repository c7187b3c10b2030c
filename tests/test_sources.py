import random

from pyspark.sql import functions as F

from scanloom.functions import lexer, text
from scanloom.sources import files as source
from scanloom.sources import python_functions


def test_splitlines_is_pythons(spark):
    rng = random.Random(7)
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["", "\n", "a", "a\n", "\r\n", "a\r\n\r\nb", "\n\n"]
    texts += ["".join(rng.choice(["x", "é", " ", *breaks]) for _ in range(rng.randrange(12))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", text.splitlines(F.col("t")).alias("a"), text.splitlines_keep(F.col("t")).alias("k")).collect()
    for r in rows:
        assert r.a == texts[r.i].splitlines()
        assert r.k == texts[r.i].splitlines(keepends=True)


def test_tree_source(spark, tmp_path):
    for path, data in {
        "one/src/a.py": b"x = 1\n",
        "one/img.png": b"\x89PNG\xff",
        "two/b.ts": "é\n".encode(),
        "two/bad.py": b"ok\xffok\n",
        "two/big.py": b"#" * 300,
    }.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    rows = {(r.project_id, r.path): r.content for r in source.read_tree(spark, str(tmp_path), max_size=200).collect()}
    assert rows == {("one", "src/a.py"): "x = 1\n", ("two", "b.ts"): "é\n"}
    rows = {
        (r.project_id, r.path): r.content
        for r in source.read_tree(spark, str(tmp_path), project_id="all", glob="*.py", max_size=200, lenient=True).collect()
    }
    assert rows == {("all", "one/src/a.py"): "x = 1\n", ("all", "two/bad.py"): "okok\n"}
    one = source.read_tree(spark, str(tmp_path / "one/src/a.py"), project_id="p").collect()
    assert [(r.path, r.length) for r in one] == [("a.py", 6)]


def test_size_reaches_the_listing(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    plan = source.read_tree(spark, str(tmp_path), project_id="p")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1048576)" in plan


def test_env_names(make_files):
    files = make_files({".env.example": "# c=1\nA=1\n  b = 2\nnone\n=x\n", "sub/.env.example": "C=\n"})
    assert [r.name for r in source.env_names(files).collect()] == ["A", "b", ""]
    assert {r.name for r in source.env_names(files, root_only=False).collect()} == {"A", "b", "", "C"}


def test_globs(make_files):
    files = make_files({"a.py": "", "b.json": "", "c.tsx": "", "d.jsx": "", "e.rs": "", "f.pyc": ""})
    assert {r.path for r in source.glob_python(files).collect()} == {"a.py"}
    assert {r.path for r in source.glob_scripts(files).collect()} == {"b.json", "c.tsx", "d.jsx"}


def test_numbered_text_keeps_numbers(spark):
    df = spark.createDataFrame([('a = """x\ny # z\n"""\nb = "#"  # c\n',)], "t string")
    code = lexer.lex(text.numbered(text.splitlines(F.col("t"))), "py")["code"]
    pieces = df.select(text.numbered_pieces(code).alias("p")).first().p
    assert [(p.line, p.text) for p in pieces] == [(1, 'a = "x y # z "'), (2, ""), (3, ""), (4, 'b = "#"  ')]


def test_functions_with_deep_and_long_headers(spark):
    code = (
        "def deep(a=g(h(i(j(k(l(1))))))): pass\n"
        "def long(\n    a: int,\n) -> Tuple[\n    int,\n    Dict[str, int],\n]:\n    return 1\n"
        "def lam(a, b=lambda x, y: 1, *, c={'k': (1, 2)}): pass\n"
        "def cont(a, b) \\\n        -> int:\n    pass\n"
    )
    files = spark.createDataFrame([("p", "a.py", code)], "project_id string, path string, content string")
    got = {r.name: r for r in python_functions.function_table(files).collect()}
    want = {r.name: r for r in python_functions.function_table(files, method="exact").collect()}
    assert set(got) == set(want) == {"deep", "long", "lam", "cont"}
    for name, f in got.items():
        assert (f.line, len(f.params)) == (want[name].line, len(want[name].params)), name
    assert got["long"].returns == want["long"].returns == "Tuple[int, Dict[str, int]]" and got["cont"].returns == "int"
