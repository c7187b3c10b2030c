"""Source files, env files and diffs rendered from rows of the given tables.

The tables hold prose and orders, not code, so the code queries run on files
that Spark renders from them: one file per row, whose parts depend on the
columns of the row. Each corpus grows with its table, and a third of its files
falls into one project. The expressions are plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.sources.tables import spread, table

NL = "chr(10)"
#: A row of a few numbers becomes a file or a diff, whose work is some milliseconds.
ROWS_PER_TASK = 20_000


def _quote(s: str) -> str:
    # A quote sign is written as chr(39), as engines differ in how they escape it.
    pieces = [f"'{p}'" for p in s.split("'")]
    return pieces[0] if len(pieces) == 1 else "concat(" + ", chr(39), ".join(pieces) + ")"


def pick(index: str, options: list[str]) -> str:
    """The ``index``-th of some texts, as SQL. ``{% expr %}`` in a text inserts a column.

    The texts are one constant array and insertions are replacements in the text
    picked, so the generated code stays small however many texts there are.
    """
    exprs: list[str] = []

    def constant(text: str) -> str:
        out = ""
        while "{%" in text:
            before, _, text = text.partition("{%")
            expr, _, text = text.partition("%}")
            if expr.strip() not in exprs:
                exprs.append(expr.strip())
            out += f"{before}<#{exprs.index(expr.strip())}>"
        return _quote(out + text)

    out = f"element_at(array({', '.join(constant(t) for t in options)}), CAST({index} AS INT) + 1)"
    for i, expr in enumerate(exprs):
        out = f"replace({out}, '<#{i}>', CAST({expr} AS STRING))"
    return out


def project_of(key: str, name: str) -> str:
    """A third of all rows goes to one project."""
    return f"CASE WHEN {key} % 3 = 0 THEN 'mono' ELSE concat('{name}', CAST({key} % 40 AS STRING)) END"


# --- web files in Python, one per customer -------------------------------------

WEB_FOLDERS = ["api/", "api/v2/", "node_modules/web/", "src/", "venv/lib/", "app/", "jobs/"]
WEB_HEADS = [
    "import os\nfrom fastapi import FastAPI",
    "from fastapi import FastAPI, Depends",
    '"""Routes of the service.\ndef not_code(): pass\n"""\nimport json',
]
WEB_ROUTES = [
    "@app.get('/items/{% c_custkey %}')\ndef items(): pass",
    "@app.post('/login')\n@depends(get_current_user)\ndef login(user):\n    return user",
    "@router.get('/admin')\n# open on purpose\ndef admin(a, b, c, d, e, f) -> None:\n    print(a)",
    "@app.delete('/x')\n@requires(Depends(check_token))\ndef remove(x: int): return x",
    "@app.put('/y')\nasync def change(y: int):\n    return y",
    "def helper(z):\n    return z",
    "@router.get('/far')\n\n\n# a\n# b\n# c\ndef far(): pass",
    "@app.get('/named')\ndef named(): pass  # @login_required",
]
WEB_SECRETS = [
    'SECRET_KEY = "key-{% c_custkey %}"',
    'api_key = "sk_live_{% 1000000000 + c_custkey %}"',
    'token = os.getenv("TOKEN")',
    'password = "os.getenv(1)"',
    'jwt_secret = "{% c_nationkey %}"\nx = "{% c_nationkey %}"',
    "auth = 'ghp_abcdefghijklmnopqrstuvwxyz{% 1000000000 + c_custkey %}'",
    "# nothing here",
]
WEB_FILES = {
    "table": "customer",
    "project_id": project_of("c_custkey", "team"),
    "path": f"concat({pick('c_custkey % 7', WEB_FOLDERS)}, 'c', CAST(c_custkey AS STRING), "
    "CASE WHEN c_custkey % 11 = 0 THEN '.pyc' ELSE '.py' END)",
    "content": f"concat({pick('c_custkey % 3', WEB_HEADS)}, {NL}, "
    f"{pick('c_custkey % 7', WEB_SECRETS)}, {NL}, {NL}, "
    f"{pick('c_nationkey % 8', WEB_ROUTES)}, {NL}, {NL}, "
    f"{pick('(c_custkey + c_nationkey) % 8', WEB_ROUTES)}, {NL})",
}

# --- server files in TypeScript, one per part ----------------------------------

SERVER_FOLDERS = ["app/api/", "components/", "lib/actions/", "src/", "pages/api/"]
SERVER_HEADS = ['"use server"', "// plain", "'use server'", '"use client"']
SERVER_LINES = [
    "const token = cookies().get('session')",
    "const csrf = request.headers.get('x-csrf-token')",
    "const session = request.cookies.get('{% p_partkey %}')",
    "const token = params.token",
    "const size = headers() // session {% p_size %}",
    "const apiKey = 'key-{% p_partkey %}'",
    'let password = "{% p_size %}"',
    "const live = 'sk_test_{% 1000000000 + p_partkey %}'",
    "const key = process.env.API_KEY",
]
SERVER_FILES = {
    "table": "part",
    "project_id": project_of("p_partkey", "shop"),
    "path": f"concat({pick('p_partkey % 5', SERVER_FOLDERS)}, 'p', CAST(p_partkey AS STRING), "
    f"{pick('p_partkey % 4', ['.ts', '.tsx', '.js', '.json'])})",
    "content": f"concat({pick('p_size % 4', SERVER_HEADS)}, {NL}, "
    f"{pick('p_partkey % 9', SERVER_LINES)}, {NL}, {pick('p_size % 9', SERVER_LINES)}, {NL}, "
    f"{pick('(p_partkey + p_size) % 9', SERVER_LINES)}, {NL})",
}

# --- env files, one per supplier and each its own project ----------------------

ENV_LINES = ["secret_key=1", "# old=1", "API_KEY=", "  jwt_secret = x", "no name here", "API_KEY=again"]
ENV_FILES = {
    "table": "supplier",
    "project_id": "concat('sup', CAST(s_suppkey AS STRING))",
    "path": "CASE WHEN s_suppkey % 5 = 4 THEN 'sub/.env.example' ELSE '.env.example' END",
    "content": f"concat({pick('s_suppkey % 6', ENV_LINES)}, {NL}, {pick('s_nationkey % 6', ENV_LINES)}, {NL}, "
    f"{pick('(s_suppkey + s_nationkey) % 6', ENV_LINES)}, {NL}, 'K', CAST(s_nationkey AS STRING), '=v', {NL})",
}

# --- code samples for the rules ------------------------------------------------

PY_SAMPLES = [
    "JWT_SECRET = \"a\"\nAPI_KEY = 'b'\npasswd = \"c\"",
    "DATABASE_URL = 'postgresql'\nengine = postgresql\nname = \"mysql\"\nother = 'mongodb'",
    "q = f\"select {a}\"\ncursor.execute(q)",
    "q = \"select {}\".format(a)\nr = 1\ncursor.execute(q)",
    "q = \"select %s\" % (a)\ncursor.execute(q)\ncursor.execute(r)",
    "def run():\n    q = f\"select {a}\"\nq = 1\ncursor.execute(q)",
    "query = f\"select {a}\"\nsession.execute(text(query))",
    "session.execute(text(f\"select {a}\"))\nsession.execute(text(\"{}\".format(a)))\nsession.execute(text(\"%s\" % (a)))",
    "for u in users:\n    t = repo.get_tokens_for_user(u.id)\nfor v in users:\n    pass\nrepo.get_tokens(v)",
    "@app.get(\"/a\")\nasync def a(db: Session = Depends(get_db)):\n    return db",
    "@app.post(\"/b\", response_model=B)\nasync def b(x: int) -> None:\n    return x",
    "app.add(CORSMiddleware(\n    app,\n    allow_origins=[\"*\"],\n))",
    "class User(BaseModel):\n    name: str\n\nx = 1",
    "class User(BaseModel):\n    name: str\n    age: int",
    "class Model:\n    class Config:\n        extra = 1\n        arbitrary_types_allowed = True\n    y = 2",
    "load_async()\nasync_load()\nobj.do_await()\nasync def run_async():\n    pass",
    "h = hashlib.md5(x)\nh = hashlib.sha1(x)\nn = random.randint(1, 2)",
    "print(x)  # print(y)\ns = \"print(z)\"\nlogging.debug(x)\nbreakpoint()",
    "f = open(base + '../x', 'r')",
    "def many(a, b, c, d, e, f):\n    \"\"\"doc\"\"\"\n    return a\ndef one(x):\n    return x",
    "from os import *\nimport sys\nassert x == 1\nassert x, \"m\"",
    "try:\n    run()\nexcept:\n    pass\ntry:\n    run()\nexcept:\n    log()",
    "for x in items:\n    items.append(x)\nfor y in items:\n    other.append(y)",
    "out = \"\"\nfor p in parts:\n    out += p",
    "acc = []\nfor p in parts:\n    acc.append(p)",
    "value = 1  # DATABASE_URL = 'x'\ntext = \"SECRET_KEY\"",
    "assert same(a, b)\nassert f(a, b), \"m\"\nassert g(x)[1, 2] == {3, 4}",
    "f = open(os.path.join(a, '..', b), 'r')\ng = open(path.join(a, b), 'r')\nh = open(safe(a), '../x')",
    "app.add(CORSMiddleware(\n    make(app, wrap(1)),\n    allow_origins=[\"*\"],\n))",
]
TS_SAMPLES = [
    "const JWT_SECRET = \"a\"\nprocess.env.JWT_SECRET = 'b'\nconst API_KEY = `c`",
    "POSTGRES_URL = \"p\"\nNEXT_PUBLIC_API_KEY = \"n\"",
    "export default function Page({ a }) {\n  return (<p/>)\n}",
    "export async function save(data) {\n  \"use server\"\n  await run(data)\n}",
    "\"use client\"\nimport { useEffect } from \"react\"",
    "const a = <p dangerouslySetInnerHTML={{ __html: x }} />\nload(next.config.js)",
    "const list = items.map(i => <Item v={i} />)\nsetCount(c => c + 1)",
    "useEffect(() => {\n  if (a) { run() }\n})\nuseEffect(() => {\n  run()\n}, [])",
    "function f(x: any) { return x }\n// @ts-ignore\nconst y = z!\nif (a != b) stop()",
    "eval(code)\nel.innerHTML = html\ndocument.write(x)\nconst r = Math.random()",
    "check(input: any)\nconst body = await request.json()",
    "crypto.createHash(\"md5\")\nconsole.log(x)\nconst s = new Service()",
    "const g = async (a, b) => {\n  return a\n}\nfunction h(a, b, c, d, e, f) {\n  return a\n}",
    "const t = v as Type\nimport * as all from \"x\"\nload()",
    "test(\"adds\", () => {\n  run()\n})",
    "if (ready) {\n  useState(0)\n}",
    "const o = { ...old, k: 1 }\nconst b = <B onClick={() => go()} />",
    "type T = z.infer<typeof schema>",
    "const i = <img src=\"a.png\" />\nconst j = <input name=\"n\" />\nconst k = <button\n  id=\"b\">ok</button>",
    "export function api(a: string): number {\n  return 1\n}",
    "const m = 1 // eval(x)\nconst n = \"document.write(x)\" /* console.log(y) */",
]
PY_SAMPLE_FILES = {
    "table": "orders",
    "project_id": project_of("o_custkey", "py"),
    "path": "concat('src/o', CAST(o_orderkey AS STRING), '.py')",
    "content": f"concat({pick(f'o_orderkey % {len(PY_SAMPLES)}', PY_SAMPLES)}, {NL}, "
    f"{pick(f'o_custkey % {len(PY_SAMPLES)}', PY_SAMPLES)}, {NL})",
}
TS_SAMPLE_FILES = {
    "table": "part",
    "project_id": project_of("p_partkey", "ts"),
    "path": "concat('src/p', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.tsx' ELSE '.js' END)",
    "content": f"concat({pick(f'p_partkey % {len(TS_SAMPLES)}', TS_SAMPLES)}, {NL}, "
    f"{pick(f'(p_partkey + p_size) % {len(TS_SAMPLES)}', TS_SAMPLES)}, {NL})",
}

# --- strings, comments and templates that hold code or end on another line --------

PY_STRINGS = [
    "q = \"\"\"select {}\"\"\".format(a)\ncursor.execute(q)",
    "q = rf\"select {a}\"\ncursor.execute(q)",
    "query = f\"\"\"\nselect {a}\n\"\"\"\nsession.execute(text(query))",
    "x = \"\"\"postgresql\"\"\"",
    "\"\"\"\nfoo\n\"\"\"; breakpoint()",
    "\"\"\"\nbreakpoint()\n\"\"\"\nbreakpoint()",
    "session.execute(text(\"\"\"\nselect %s\n\"\"\" % (a)))",
    "s = f\"{hashlib.md5(x)}\"\nt = \"hashlib.md5(x)\"",
    "q = f\"{{a}}\"\ncursor.execute(q)",
    "def f():\n    \"\"\"eval\n    breakpoint()\n    \"\"\"\n    breakpoint()",
    "u = f\"{d[\"k\"]}\"\nq = f\"{d[\"k\"]} {e[\"l\"]}\"\ncursor.execute(q)",
    "q = b'select %s' % (a)\ncursor.execute(q)",
    "run(\n\"\"\"a\nb\"\"\"\n); breakpoint()",
]
# A dollar sign before a brace is written as chr(36), as Spark's parser takes it for a variable.
TS_STRINGS = [
    "/* a\n b */ eval(x)",
    "const a = `eval(x)`\neval(y)",
    "const a = `text\neval(x)\n{% chr(36) %}{eval(y)}\n`\neval(z)",
    "const t = `a {% chr(36) %}{ c ? `eval({% chr(36) %}{d})` : 'e' } f`; document.write(x)",
    "// `\nconsole.log(a) // `",
    "const s = `\nJWT_SECRET = 'x'\n`",
    "el.innerHTML = `\n<b>\n`\ncrypto.createHash('md5')",
]
PY_STRING_FILES = {
    "table": "orders",
    "project_id": project_of("o_custkey", "py"),
    "path": "concat('src/s', CAST(o_orderkey AS STRING), '.py')",
    "content": f"concat({pick(f'o_orderkey % {len(PY_STRINGS)}', PY_STRINGS)}, {NL})",
}
TS_STRING_FILES = {
    "table": "part",
    "project_id": project_of("p_partkey", "ts"),
    "path": "concat('src/t', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.tsx' ELSE '.js' END)",
    "content": f"concat({pick(f'p_partkey % {len(TS_STRINGS)}', TS_STRINGS)}, {NL})",
}

# --- diffs, one per order ------------------------------------------------------

DIFF_FILES = [
    "diff --git a/src/a{% o_orderkey %}.py b/src/a{% o_orderkey %}.py\n--- a/src/a{% o_orderkey %}.py\n"
    "+++ b/src/a{% o_orderkey %}.py\n@@ -1,3 +1,4 @@\n def hello():\n"
    "+    token = \"t{% o_custkey %}\"\n-    old()\n+    print(1)\n     return 1",
    "diff --git a/package-lock.json b/package-lock.json\nindex 1..2 100644\n--- a/package-lock.json\n"
    "+++ b/package-lock.json\n@@ -10 +10,2 @@ x\n-a\n+b\n+c",
    "diff --git a/img{% o_orderkey % 100 %}.png b/img{% o_orderkey % 100 %}.png\nnew file mode 100644\n"
    "Binary files /dev/null and b/img{% o_orderkey % 100 %}.png differ",
    "diff --git a/old.py b/tests/test_new.py\nsimilarity index 90%\nrename from old.py\nrename to tests/test_new.py\n"
    "--- a/old.py\n+++ b/tests/test_new.py\n@@ -5,2 +5,3 @@\n keep\n+++counter\n+import os\n"
    "@@ -20,3 +21,2 @@ def f\n a\n-b\n-c\n+print(d)",
    "diff --git a/gone.ts b/gone.ts\ndeleted file mode 100644\n--- a/gone.ts\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-y",
]
DIFFS = {
    "table": "orders",
    "diff_id": "CAST(o_orderkey AS STRING)",
    "project_id": project_of("o_custkey", "repo"),
    "text": f"concat({pick('o_orderkey % 5', DIFF_FILES)}, {NL}, {pick('(o_orderkey + o_custkey) % 5', DIFF_FILES)}, {NL})",
}


def rendered(spark: SparkSession, folder: str, corpus: dict[str, str]) -> DataFrame:
    """A corpus over the tables of ``folder``; file corpora also get ``length``."""
    cols = [f"{expr} AS {name}" for name, expr in corpus.items() if name != "table"]
    out = spread(table(spark, folder, corpus["table"]), ROWS_PER_TASK).selectExpr(*cols)
    if "content" in corpus:
        out = out.withColumn("length", F.octet_length("content").cast("long"))
    return out


def rendered_sql(corpus: dict[str, str]) -> str:
    """The same as one SELECT for DuckDB, without ``length``."""
    cols = ", ".join(f"{expr} AS {name}" for name, expr in corpus.items() if name != "table")
    out = f"SELECT {cols} FROM {corpus['table']}"
    return out.replace("element_at(array(", "list_extract(list_value(")
