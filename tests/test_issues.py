import pytest
from conftest import issue_set
from pyspark.sql import functions as F

from scanloom.operators import issues, learning
from scanloom.plans import corpus, scan
from scanloom.sources.files import lines
from scanloom.sources.python_functions import function_table

AUTH = "@app.get('/login')\n@depends(get_current_user)\ndef login(): pass\n"


@pytest.mark.parametrize("method", ["native", "exact"])
def test_open_route(make_files, method):
    files = make_files({"auth.py": AUTH, "a.py": "@app.get('/x')\ndef x(): pass\n"})
    assert issue_set(issues.open_routes(files, method=method)) == {("a.py", 1, "MISSING_AUTH")}


@pytest.mark.parametrize("method", ["native", "exact"])
def test_indented_file_and_several_routes(make_files, method):
    files = make_files(
        {
            "i.py": "    @app.get('/admin')\n    def admin_panel():\n        return {'users': []}\n",
            "t.py": "".join(f"@app.get('/{n}')\ndef {n}(): pass\n\n" for n in ("a", "b", "c")),
        }
    )
    assert issue_set(issues.open_routes(files, method=method)) == {
        ("i.py", 1, "MISSING_AUTH"), ("t.py", 1, "MISSING_AUTH"), ("t.py", 4, "MISSING_AUTH"), ("t.py", 7, "MISSING_AUTH"),
    }


@pytest.mark.parametrize("method", ["native", "exact"])
def test_route_rules(make_files, method):
    files = make_files(
        {
            "async.py": "@app.get('/x')\nasync def x(): pass\n",
            "named.py": "@app.get('/x')\ndef x(): pass  # @login_required\n",
            "above.py": "@login_required\n@app.get('/x')\ndef x(): pass\n",
            "long.py": '@app.get(\n    "/d",\n    response_model=D\n)\ndef d():\n    return 1\n',
            "far.py": "@router.get('/far')\n\n\n# a\n# b\n# c\ndef far(): pass\n",
            "other.py": "x = '@app.'\ndef y(): pass\n",
            "nested.py": "class A:\n    @router.post('/n')\n    def n(self): pass\n",
        }
    )
    assert issue_set(issues.open_routes(files, method=method)) == {
        ("above.py", 2, "MISSING_AUTH"), ("nested.py", 2, "MISSING_AUTH"), ("other.py", 1, "MISSING_AUTH"),
    }
    wide = issue_set(issues.open_routes(files, method=method, include_async=True, auth_scope="decorators", lookback=8))
    assert wide == {
        ("async.py", 1, "MISSING_AUTH"), ("far.py", 1, "MISSING_AUTH"), ("nested.py", 2, "MISSING_AUTH"),
        ("other.py", 1, "MISSING_AUTH"),
    }
    with pytest.raises(ValueError):
        issues.open_routes(files, auth_scope="everywhere")


def test_window_form_is_the_same(spark):
    files = corpus.rendered(spark, "/root/testdata/sf0.001", corpus.WEB_FILES)
    by_lines = issues.missing_auth_in_lines(lines(files.filter("path like '%.py'")), function_table(files.filter("path like '%.py'")))
    assert sorted(by_lines.collect()) == sorted(issues.open_routes(files).collect())


def test_native_and_exact_functions_agree(spark, make_files):
    tree = {f"s{i}.py": t + "\n" for i, t in enumerate(corpus.PY_SAMPLES)}
    tree |= {
        "doc.py": '"""\ndef no(): pass\n"""\ndef yes(a, *, b: int = (1, 2), c="x,y", **k) -> List[int]:\n    """d"""\n    return 1\n',
        "deco.py": "@a.b(\n    '(',  # )\n    x=[1],\n)\n# c\n\n@c\ndef f(\n    a,\n    /,\n    b,\n): pass\n",
        "cls.py": "class A:\n    @property\n    def p(self): return '#'\n    async def q(self, *args): pass\n",
        "blank.py": "\n" * 3000 + "def z(): pass\n",
    }
    files = make_files(tree)
    cols = ["path", "line", "name", "is_async", "returns", "has_docstring", "context", "file_indented"]
    shape = [*cols, F.size("params").alias("n_params"), F.size("decorators").alias("n_decorators")]
    native = sorted(map(tuple, function_table(files).select(*shape).collect()), key=repr)
    exact = sorted(map(tuple, function_table(files, method="exact").select(*shape).collect()), key=repr)
    assert native == exact and len(native) == 11


def test_exact_drops_files_that_do_not_parse(make_files):
    files = make_files({"bad.py": "def ok(): pass\ndef (:\n"})
    assert function_table(files, method="exact").count() == 0
    assert function_table(files).count() == 1
    with pytest.raises(ValueError):
        function_table(files, method="guess")


def test_csrf(make_files):
    code = "const t = request.cookies.get('token')\nconst u = cookies() // csrf token\nconst session = headers()\nconst token = 1\n"
    files = make_files({"app/api/r.ts": code, "src/r.ts": code, "src/s.js": "'use server'\n" + code, "app/api/r.json": code})
    assert issue_set(issues.missing_csrf(files)) == {
        ("app/api/r.ts", 1, "MISSING_CSRF"), ("app/api/r.ts", 3, "MISSING_CSRF"),
        ("src/s.js", 2, "MISSING_CSRF"), ("src/s.js", 4, "MISSING_CSRF"),
    }


def test_env_style(make_files):
    files = make_files({".env.example": "secret_key=1\n# c=1\njwt_secret=2\nAPI_KEY=\nAPI_KEY=2\n"})
    assert issue_set(scan.scan(files)) == {(".env.example", 1, "ENV_VAR_STYLE"), (".env.example", 3, "ENV_VAR_STYLE")}
    assert issue_set(scan.scan(files, env_check="upper")) == {(".env.example", 1, "ENV_VAR_STYLE"), (".env.example", 3, "ENV_VAR_STYLE")}
    # Whole names are compared, so a tie of good names flags all but the least.
    tie = make_files({".env.example": "B=\nA=\n"})
    assert issue_set(scan.scan(tie)) == {(".env.example", 1, "ENV_VAR_STYLE")}


def test_excluded_folders_and_size(make_files):
    bad = "@app.get('/x')\ndef x(): pass\n"
    files = make_files({"backend/a.py": bad, "node_modules/a.py": bad, "venv/a.py": bad, "big.py": bad + "#" * 1_048_576})
    assert issue_set(scan.scan(files)) == {("backend/a.py", 1, "MISSING_AUTH")}


def test_learning(make_files):
    files = make_files(
        {
            "auth.py": AUTH + "@x(Depends(b))\nasync def no(): pass\n",
            "two.py": "@Depends(a)\ndef f(): pass\n@Depends(a)\ndef g(): pass\n",
            "ind.py": "    @Depends(z)\n    def f(): pass\n",
            "app/api/a.ts": "use server csrf cookie token",
            "app/api/b.js": "cookie session",
            ".env.example": "b=1\nB=2\nb=3\n",
            ("q", "lib/x.py"): AUTH,
        }
    )
    learned = learning.learn(files)
    rows = {(r.project_id, r.kind, r.value): r.n for r in learning.value_counts(learned).collect()}
    assert rows == {
        ("p", learning.AUTH, "depends(get_current_user)"): 1, ("p", learning.AUTH, "Depends(a)"): 2,
        ("p", learning.HANDLER, "csrf_validation"): 1, ("p", learning.HANDLER, "cookie_based"): 2,
        ("p", learning.ENV, "b"): 2, ("p", learning.ENV, "B"): 1, ("q", learning.AUTH, "depends(get_current_user)"): 1,
    }
    assert sorted(learning.learn(files, method="exact").collect()) == sorted(learned.collect())
    summary = {r.project_id: r for r in learning.summarise(learned).collect()}
    assert (summary["p"].auth_decorator, summary["p"].token_handler, summary["p"].env_style) == ("Depends(a)", "csrf_validation", "b")
    assert summary["q"].env_style is None
    assert {(r.project_id, r.kind): r.value for r in learning.most_common(learned).collect()}[("p", learning.HANDLER)] == "cookie_based"
    assert [r.value for r in learning.first_handler(learned).collect()] == ["csrf_validation"]
    assert learning.as_map(learned).filter("project_id = 'p'").first().patterns[learning.ENV] == ["B", "b"]


def test_ties_give_the_least(make_files):
    files = make_files({"a.py": "@depend_b\ndef f(): pass\n@depend_a\ndef g(): pass\n"})
    assert learning.summarise(learning.learn(files)).first().auth_decorator == "depend_a"


def test_findings_carry_the_learned_pattern(make_files):
    files = make_files({"auth.py": AUTH, "a.py": "@app.get('/x')\ndef x(): pass\n", ("q", "b.py"): "@app.get('/x')\ndef x(): pass\n"})
    rows = {r.project_id: r for r in scan.findings(files).collect()}
    assert "`depends(get_current_user)`" in rows["p"].message
    assert f"`{learning.DEFAULT_AUTH}`" in rows["q"].message
    assert (rows["p"].severity, rows["p"].rule_id, rows["p"].file, rows["p"].line) == ("medium", "IMPROVEMENT", "a.py", 1)


def test_nested_issues(make_files):
    files = make_files({"a.py": "@app.get('/x')\ndef x(): pass\n", "b.py": "x = 1\n"})
    rows = issues.nested_issues(scan.flag(files)).collect()
    assert [(r.path, [(i.line, i.issue_type) for i in r.issues]) for r in rows] == [("a.py", [(1, "MISSING_AUTH")])]
