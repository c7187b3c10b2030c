import ast

from pyspark.sql import functions as F

from scanloom.operators import issues, learning, rewrite, secrets
from scanloom.functions.patterns import patterns_for
from scanloom.plans import corpus, scan
from scanloom.sources.files import env_names, lines

AUTH = "@app.get('/login')\n@depends(get_current_user)\ndef login(): pass\n"
GHP = "ghp_" + "a" * 36


def fixed(files):
    return {r.path: r for r in rewrite.redact_secrets(files).collect()}


def test_python_secrets(make_files):
    got = fixed(make_files({"a.py": 'SECRET_KEY = "x"\nAPI_KEY = "y"\n'}))["a.py"]
    assert got.fixes == 2 and got.modified and got.vars == ["SECRET_KEY", "API_KEY"]
    assert got.fixed_content == (
        'import os\nSECRET_KEY = os.getenv("SECRET_KEY", "CHANGE_ME_IN_PRODUCTION")\n'
        'API_KEY = os.getenv("API_KEY", "CHANGE_ME_IN_PRODUCTION")\n'
    )
    ast.parse(got.fixed_content)


def test_tokens_come_first_and_take_their_quotes(make_files):
    source = f'import os\npassword = "p"\na = "{GHP}"\nb = \'sk_live_0123456789\'\napi_key = "sk_test_0123456789"\n'
    got = fixed(make_files({"a.py": source}))["a.py"]
    assert got.vars == ["API_KEY_1", "API_KEY_2", "API_KEY_3", "PASSWORD"]
    tree = ast.parse(got.fixed_content)
    assert got.fixed_content.count("import os") == 1 and len(tree.body) == 5
    assert 'b = os.getenv("API_KEY_1"' in got.fixed_content and 'api_key = os.getenv("API_KEY_2"' in got.fixed_content


def test_scripts(make_files):
    tree = {
        "a.js": 'const apiKey = "x"\nlet stripeKey = "y"\n',
        "b.ts": f"const k = process.env.K\nconst z = '{GHP}'\n",
        "c.tsx": "const token = 'process.env.T'\n",
    }
    got = fixed(make_files(tree))
    assert got["a.js"].vars == ["APIKEY", "STRIPEKEY"]
    assert got["a.js"].fixed_content == (
        rewrite.JS_HEADER + '\nconst apiKey = process.env.APIKEY || "CHANGE_ME_IN_PRODUCTION";\n'
        'const stripeKey = process.env.STRIPEKEY || "CHANGE_ME_IN_PRODUCTION";\n'
    )
    assert got["b.ts"].fixed_content == (
        'const k = process.env.K\nconst z = process.env.API_KEY_1 || "CHANGE_ME_IN_PRODUCTION"\n'
    )
    assert not got["c.tsx"].modified


def test_safe_other_and_large_files_stay(make_files):
    tree = {"a.py": 'token = os.getenv("T")\n', "s.py": "token = \"os.environ['T']\"\n", "r.rs": 'token = "x"\n', "big.py": 'token = "x"\n' + "#" * 1_048_576}
    limited = rewrite.redact_secrets(make_files(tree), max_size=1_048_576).collect()
    for r in limited:
        assert not r.modified and r.fixes == 0 and r.fixed_content == tree[r.path]


def test_equal_tokens_are_replaced_one_by_one(make_files):
    got = fixed(make_files({"a.py": f"x = '{GHP}'\ny = '{GHP}'\n"}))["a.py"]
    assert got.vars == ["API_KEY_1", "API_KEY_2"] and GHP not in got.fixed_content


def test_twice_is_once_and_nothing_is_left(spark):
    for spec in (corpus.WEB_FILES, corpus.SERVER_FILES):
        files = corpus.rendered(spark, "/root/testdata/sf0.001", spec)
        once = rewrite.redact_secrets(files).select("project_id", "path", F.col("fixed_content").alias("content"), "length")
        assert rewrite.redact_secrets(once).filter("modified").count() == 0
        assert secrets.find_file_secrets(once).count() == 0
        for lang in ("py", "js"):
            tokens = patterns_for(lang)[:-1]
            part = once.filter(F.col("path").rlike(r"\.py$" if lang == "py" else r"\.(ts|tsx|js)$"))
            assert part.filter(secrets.has_secret(F.col("content"), tokens)).count() == 0


def test_env_upsert(make_files):
    files = make_files(
        {
            "a.py": 'token = "x"\npassword = "y"\n', "b.py": 'password = "z"\n', ".env.example": "A=1\nTOKEN=2",
            ("q", "a.py"): 'token = "x"\n' + f"k = '{GHP}'\n", ("r", "a.py"): "x = 1\n",
        }
    )
    done = {r.project_id: r.content for r in rewrite.upsert_env(rewrite.redact_secrets(files), files, env_names(files)).collect()}
    assert done == {"p": "A=1\nTOKEN=2\nPASSWORD=\n", "q": rewrite.ENV_HEADER + "\nAPI_KEY_1=\n\nTOKEN=\n"}


def improved(files, **options):
    return {r.path: r.improved_content for r in rewrite.apply_improvements(scan.flag(files, **options)).collect()}


def test_inserted_decorators(make_files):
    tree = {
        "auth.py": AUTH,
        "i.py": "    @app.get('/admin')\n    def admin_panel():\n        return {'users': []}\n",
        "t.py": "".join(f"@app.get('/{n}')\ndef {n}(): pass\n\n" for n in ("a", "b", "c")),
        "c.py": "# note\n@app.get('/x')  # keep 'this'\ndef x(): pass",
        "crlf.py": "@app.get('/x')\r\ndef x(): pass\r\n",
    }
    got = improved(make_files(tree))
    assert got["i.py"].splitlines()[1] == "    @depends(get_current_user)"
    assert got["t.py"] == "".join(f"@app.get('/{n}')\n@depends(get_current_user)\ndef {n}(): pass\n\n" for n in ("a", "b", "c"))
    assert got["c.py"] == "# note\n@app.get('/x')  # keep 'this'\n@depends(get_current_user)\ndef x(): pass"
    assert got["crlf.py"] == "@app.get('/x')\r\n@depends(get_current_user)\ndef x(): pass\r\n"
    assert got["auth.py"] == AUTH
    for path, text in got.items():
        assert "".join(x for x in text.splitlines(True) if x.strip() != "@depends(get_current_user)") == tree[path].replace(
            "@depends(get_current_user)\n", ""
        )


def test_decorator_goes_before_def_of_a_long_route(spark):
    source = '@app.get(\n    "/d",\n    response_model=D\n)\ndef get_dashboard():\n    return 1\n'
    df = spark.createDataFrame([(source,)], "c string")
    out = df.select(rewrite.insert_decorator(F.col("c"), F.array(F.lit(5)), F.lit("depends(u)"))).first()[0]
    assert out.splitlines()[4:6] == ["@depends(u)", "def get_dashboard():"]


def test_upper_case_names(make_files):
    got = improved(make_files({".env.example": "secret_key=secret_key\n jwt=1\nAPI_KEY=\n# x=1\n"}), env_check="upper")
    assert got[".env.example"] == "SECRET_KEY=secret_key\n JWT=1\nAPI_KEY=\n# x=1\n"


def test_window_form_is_the_same(make_files):
    files = make_files({"a.py": "@app.get('/a')\ndef a(): pass\n\n@app.get('/b')\n# c\ndef b(): pass", "b.py": "x = 1"})
    got = rewrite.insert_in_lines(lines(files), issues.open_routes(files), F.lit(learning.DEFAULT_AUTH))
    assert {r.path: r.content for r in rewrite.rebuild_text(got).collect()} == {"a.py": improved(files)["a.py"]}


def test_fix_then_improve(make_files):
    files = make_files({"a.py": 'SECRET_KEY = "x"\n@app.get("/x")\ndef x(): pass\n', ".env.example": "A=1\n"})
    tree = scan.fix(files)
    row = tree.files.filter("path = 'a.py'").first()
    assert [(i.line, i.issue_type) for i in row.issues] == [(3, "MISSING_AUTH")]
    assert row.improved_content == (
        'import os\nSECRET_KEY = os.getenv("SECRET_KEY", "CHANGE_ME_IN_PRODUCTION")\n'
        '@app.get("/x")\n@Depends(get_current_user)\ndef x(): pass\n'
    )
    assert tree.env.first().content == "A=1\n\nSECRET_KEY=\n"
    plain = scan.fix(files, improve=False).files.filter("path = 'a.py'").first()
    assert plain.improved_content == row.fixed_content and not plain.improved


def test_large_files_are_redacted_unless_a_limit_is_given(spark):
    big = "x = 1\n" * 200_000 + 'API_KEY = "abcdefabcdefabcdefabcdef12345678"\n'
    files = spark.createDataFrame([("p", "a.py", big, len(big))], "project_id string, path string, content string, length long")
    assert rewrite.redact_secrets(files).first().fixes == 1
    assert rewrite.redact_secrets(files, max_size=1_048_576).first().fixes == 0


def test_many_secrets_and_edits_take_seconds(spark, make_files):
    import time

    code = "".join(f'a{i} = "{GHP}"\npassword = "p{i}"\n' for i in range(10_000))
    start = time.time()
    got = fixed(make_files({"a.py": code}))["a.py"]
    assert got.fixes == 20_000 and GHP not in got.fixed_content and got.vars[:1] + got.vars[-1:] == ["API_KEY_1", "PASSWORD"]
    assert time.time() - start < 40

    lines = [f"def f{i}(): pass" for i in range(20_000)]
    env = [f"name{i}=1" for i in range(20_000)]
    table = spark.createDataFrame([("\n".join(lines), "\n".join(env), list(range(1, 20_001)))], "a string, b string, at array<int>")
    start = time.time()
    row = table.select(rewrite.insert_decorator(F.col("a"), F.col("at"), F.lit("x")).alias("a"), rewrite.upper_names(F.col("b"), F.col("at")).alias("b")).first()
    assert row.a == "\n".join(f"@x\n{x}" for x in lines) and row.b == "\n".join(env).upper()
    assert time.time() - start < 40


def test_inserts_and_names_against_plain_python(spark):
    import random

    r = random.Random(7)
    for _ in range(12):
        lines = [r.choice(["@a", "@b(", "    x)", "def f():", "    return", "", "y = 1", "async def g(): pass"]) for _ in range(r.randrange(0, 12))]
        at = [r.randrange(-1, 14) for _ in range(r.randrange(0, 6))]
        want: dict[int, list[str]] = {}
        in_chain = lambda x: x.strip().startswith("@") or (not x.strip().startswith(("def ", "async def ", "class ")) and x.startswith((" ", "\t")))
        for n in sorted(at):
            if 1 <= n <= len(lines):
                end = next((k for k in range(n - 1, len(lines)) if not in_chain(lines[k])), len(lines))
                want.setdefault(end, []).append(lines[n - 1][: len(lines[n - 1]) - len(lines[n - 1].lstrip())] + "@d\n")
        text = "".join(x + "\n" for x in lines)
        out = "".join("".join(want.get(k, [])) + x + "\n" for k, x in enumerate(lines)) + "".join(want.get(len(lines), []))
        row = spark.createDataFrame([(text, at)], "t string, at array<int>").select(rewrite.insert_decorator(F.col("t"), F.col("at"), F.lit("d")).alias("a")).first()
        assert row.a == out, (lines, at)
