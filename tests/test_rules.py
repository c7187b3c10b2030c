import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scanloom.operators import rules
from scanloom.operators.rule_data import RULES
from scanloom.operators.rule_predicates import PREDICATES
from scanloom.plans import corpus

PS, PQ, TS, TQ = "py-security/", "py-quality/", "ts-security/", "ts-quality/"
EVERY = [PQ + "python.complex-function", PQ + "python.long-function", PQ + "python.missing-docstring"]
CONST = [TQ + "typescript.consistent-naming", TQ + "typescript.unused-variable"]

# What each sample must give, worked out by hand: {line: rules}.
PY_EXPECTED = [
    {1: [PS + "python.hardcoded-jwt-secret"], 2: [PS + "python.hardcoded-api-key"], 3: [PS + "python.password-in-config"]},
    {1: [PS + "python.hardcoded-database-url", PS + "python.hardcoded-postgres-url"], 2: [PS + "python.hardcoded-database-url"],
     3: [PS + "python.hardcoded-mysql-url"], 4: [PS + "python.hardcoded-mongodb-url"]},
    {1: [PS + "python.sql-injection-fstring"]},
    {1: [PS + "python.raw-sql-execution", PS + "python.sql-injection-format"]},
    {1: [PS + "python.raw-sql-execution", PS + "python.sql-injection-percent"]},
    {1: EVERY},
    {1: [PS + "python.sql-injection-sqlalchemy-fstring"]},
    {1: [PS + "python.sql-injection-sqlalchemy-text-fstring"], 2: [PS + "python.sql-injection-sqlalchemy-text-format"],
     3: [PS + "python.sql-injection-sqlalchemy-text-percent"]},
    {1: [PS + "python.n-plus-one-query"]},
    {2: [*EVERY, PS + "fastapi.missing-dependencies", PS + "fastapi.missing-response-model"]},
    {2: [*EVERY, PQ + "python.missing-return-type", PS + "fastapi.missing-response-model"]},
    {1: [PS + "fastapi.cors-wildcard"]},
    {1: [PS + "pydantic.missing-validation"]},
    {},
    {2: [PS + "pydantic.arbitrary-types-allowed"]},
    {1: [PS + "asyncio.missing-await"], 2: [PS + "asyncio.missing-await"], 3: [PS + "asyncio.missing-await"], 4: EVERY},
    {1: [PS + "crypto.weak-hash-md5"], 2: [PS + "crypto.weak-hash-sha1"], 3: [PS + "crypto.insecure-random"]},
    {1: [PS + "debug.print-in-production"], 3: [PS + "debug.print-in-production"], 4: [PS + "debug.pdb-breakpoint"]},
    {1: [PS + "path.traversal-open"]},
    {1: [*EVERY, PQ + "python.too-many-arguments"], 4: [*EVERY, PQ + "python.missing-type-hints"]},
    {1: [PQ + "python.wildcard-import"], 2: [PQ + "python.unused-import"], 3: [PQ + "python.assert-without-message"]},
    {3: [PQ + "python.bare-except", PQ + "python.exception-swallowing"], 7: [PQ + "python.bare-except"]},
    {1: [PQ + "python.inefficient-loop"]},
    {1: [PQ + "python.string-concat-loop"]},
    {1: [PQ + "python.list-comprehension-opportunity"]},
    {},
]
TS_EXPECTED = {
    0: {1: [*CONST, TS + "typescript.hardcoded-jwt-secret"], 2: [TS + "typescript.hardcoded-jwt-secret"],
        3: [*CONST, TS + "typescript.hardcoded-api-key"]},
    2: {1: [TQ + "react.missing-memo", TQ + "typescript.complex-function", TS + "nextjs.missing-metadata"]},
    3: {1: [TQ + "typescript.complex-function", TS + "auth.missing-csrf-protection", TS + "auth.missing-role-check",
            TS + "nextjs.missing-server-action-validation"]},
    4: {1: [TS + "nextjs.client-component-missing-boundary"]},
    7: {1: [TQ + "react.missing-dependency-array", TS + "react.missing-dependency-array"],
        2: [TQ + "typescript.promise-not-awaited"], 5: [TQ + "typescript.promise-not-awaited"]},
    12: {1: [*CONST, TQ + "typescript.arrow-function-complex"],
         4: [TQ + "typescript.complex-function", TQ + "typescript.too-many-parameters"]},
    14: {1: [TQ + "typescript.test-naming", TQ + "typescript.test-without-expect"], 2: [TQ + "typescript.promise-not-awaited"]},
    15: {1: [TQ + "react.hook-rules-violation"]},
    19: {1: [TQ + "typescript.complex-function", TQ + "typescript.missing-jsdoc"]},
    20: {1: CONST, 2: CONST},
}


@pytest.fixture(scope="module")
def hits(make_files):
    tree = {f"p{i}.py": t + "\n" for i, t in enumerate(corpus.PY_SAMPLES)}
    tree |= {f"t{i}.ts": t + "\n" for i, t in enumerate(corpus.TS_SAMPLES)}
    tree |= {f"j{i}.jsx": t + "\n" for i, t in enumerate(corpus.TS_SAMPLES)}
    files = make_files(tree)
    found = defaultdict(lambda: defaultdict(list))
    for r in rules.match_rules(files).collect():
        found[r.path][r.line].append(r.rule_key)
    return files, {p: {n: sorted(ks) for n, ks in ls.items()} for p, ls in found.items()}


def test_rule_table():
    assert len(RULES) == 94 and set(PREDICATES) == {f"{r[0]}/{r[1]}" for r in RULES}
    assert {c: sum(p.cls == c for p in PREDICATES.values()) for c in "LBFJ"} == {"L": 57, "B": 19, "F": 8, "J": 10}
    assert {s: sum(r[2] == s for r in RULES) for s in ("ERROR", "WARNING", "INFO")} == {"ERROR": 35, "WARNING": 38, "INFO": 21}


def test_python_samples(hits):
    for i, want in enumerate(PY_EXPECTED):
        assert hits[1].get(f"p{i}.py", {}) == {n: sorted(ks) for n, ks in want.items()}, corpus.PY_SAMPLES[i]


def test_typescript_samples(hits):
    for i, want in TS_EXPECTED.items():
        assert hits[1].get(f"t{i}.ts", {}) == {n: sorted(ks) for n, ks in want.items()}, corpus.TS_SAMPLES[i]


def test_every_rule_fires_and_javascript_has_its_own(hits):
    fired = {k for ls in hits[1].values() for ks in ls.values() for k in ks}
    assert fired == set(PREDICATES)
    typed = {f"{r[0]}/{r[1]}" for r in RULES if r[4] == ("ts",)}
    js = {k for p, ls in hits[1].items() if p.startswith("j") for ks in ls.values() for k in ks}
    ts = {k for p, ls in hits[1].items() if p.startswith("t") for ks in ls.values() for k in ks}
    assert js == ts - typed


def test_strict_only_takes_away_but_for_return_types(hits):
    files, _ = hits
    loose = {tuple(r) for r in rules.match_rules(files).drop("lang").collect()}
    strict = {tuple(r) for r in rules.match_rules(files, strict=True).drop("lang").collect()}
    assert {r[3] for r in strict - loose} == {PQ + "python.missing-return-type"}
    gone = {r[3] for r in loose - strict}
    assert {PS + "fastapi.missing-response-model", PQ + "python.missing-docstring", TQ + "typescript.promise-not-awaited"} <= gone


def test_keys(hits):
    files, _ = hits
    got = {r.rule_key for r in rules.match_rules(files, keys=[PS + "crypto.weak-hash-md5"]).collect()}
    assert got == {PS + "crypto.weak-hash-md5"}
    with pytest.raises(ValueError):
        rules.match_rules(files, keys=["no/such"])


def test_pairs_against_brute_force(make_files, spark):
    """All (first, second) pairs of each file, tried one by one."""
    bodies = ["q = f\"{a}\"", "cursor.execute(q)", "if x:", "    q = f\"{b}\"", "    cursor.execute(q)", "def f():", "        cursor.execute(q)", "", "# c"]
    import random

    rng = random.Random(1)
    tree = {f"{i}.py": "\n".join(rng.choice(bodies) for _ in range(rng.randrange(3, 14))) + "\n" for i in range(60)}
    got = {(r.path, r.line) for r in rules.match_rules(make_files(tree), keys=[PS + "python.sql-injection-fstring"]).collect()}
    want = set()
    for path, code in tree.items():
        ls = [(n, len(x) - len(x.lstrip()), x.split("#")[0]) for n, x in enumerate(code.splitlines(), 1)]
        ls = [x for x in ls if x[2].strip()]
        for i, (n, d, x) in enumerate(ls):
            m = re.match(r"\s*(\w+)\s*=\s*f\"", x)
            for m_, e, y in ls[i + 1 :]:
                if not m or e < d:
                    break
                if re.search(rf"cursor\.execute\(\s*{m[1]}\s*\)", y):
                    want.add((path, n))
    assert got == want and len(want) > 20


def test_copies_are_matched_once(spark, make_files, monkeypatch):
    """Copies of a text in a language give the hits of each file; a text differs by language."""
    texts = [*corpus.PY_SAMPLES[:6], *corpus.TS_SAMPLES[:6], "", "x"]
    tree = {(f"p{i % 3}", f"{i}-{k}.{suffix}"): t for i in range(4) for k, t in enumerate(texts) for suffix in ("py", "ts", "js", "tsx", "md")}
    rows = make_files(tree)
    rows = rows.union(rows.limit(20)).union(spark.createDataFrame([(None, "n.py", None, 0)] * 3, rows.schema))
    seen, before = [], rules._hits_of
    monkeypatch.setattr(rules, "_hits_of", lambda f, *a: seen.append(f.count()) or before(f, *a))
    for strict in (False, True):
        plain = sorted(map(str, rules.match_rules(rows, strict=strict).collect()))
        assert sorted(map(str, rules.match_rules_once(rows, strict=strict).collect())) == plain and len(plain) > 100
    assert seen[1] == seen[3] == 3 * len(texts) + 1
    apart = make_files({f"{i}.py": f"breakpoint()\nx = {i}" for i in range(20)})
    assert rules.match_rules_once(apart).count() == rules.match_rules(apart).count() == 20 and seen[-1] == 20


def test_user_rules_of_any_number(spark, hits):
    files, _ = hits
    rows = [("u/1", r"\bcursor\b", "comments", ["py"]), ("u/2", r"JWT_SECRET", "strings", ["py", "ts"]), ("u/3", r"@ts-ignore", "none", ["ts"])]
    table = spark.createDataFrame(rows, "rule_key string, regex string, mask string, languages array<string>")
    few = sorted(rules.match_user_rules(files, table).collect())
    assert few == sorted(rules.match_user_rules(files, table, batch=1).collect())
    odd = [("u/1", r"\bcursor\b", None, ["py", "py", None]), ("u/1", r"\bcursor\b", "comments", ["py", None]), ("u/4", None, "none", ["py"]), ("u/5", "x", "none", None), (None, "x", "none", ["py"])]
    again = rules.match_user_rules(files, spark.createDataFrame(odd, table.schema)).collect()
    assert sorted(again) == [r for r in few if r.rule_key == "u/1"]
    assert {r.rule_key for r in few} == {"u/1", "u/2", "u/3"}
    assert rules.match_user_rules(files, table.limit(0)).count() == 0


def test_findings_have_the_metadata(hits):
    files, _ = hits
    row = rules.rule_findings(rules.match_rules(files, keys=[PS + "crypto.weak-hash-md5"])).first()
    assert (row.severity, row.category, row.level, row.rule_id) == ("ERROR", "security", "error", "crypto.weak-hash-md5")
    table = rules.rule_table(files.sparkSession)
    assert table.filter("rule_id = 'path.traversal-open'").first().metadata["cwe"].startswith("CWE-22")
    assert table.count() == 94


def test_text_tables(spark):
    pages = spark.createDataFrame([(1, "<img src='a'>\n<p/>\neval(x)"), (2, "none")], "page int, html string")
    got = {(r.page, r.line, r.rule_key) for r in rules.match_line_rules(pages, "ts", "html").collect()}
    assert got == {(1, 1, TQ + "a11y.missing-alt"), (1, 3, TS + "security.eval-usage")}


def test_long_and_odd_texts_do_not_overflow(make_files):
    tree = {
        "a.py": "x = \"" + "a\\\"" * 100_000 + "\"\n" + "\n" * 20_000 + "@a(" + "(" * 500 + "\ndef f(): pass\n",
        "b.ts": "const a = `" + "x\n" * 50_000 + "`\nuseEffect(() => {" + "{a}" * 20_000 + "})\n<button>" + "<b>x</b>" * 20_000 + "</button>\n",
        "c.py": "x = '''" + "'\n" * 30_000 + "'''\nclass Config:\n" + "    a = 1\n" * 20_000 + "    arbitrary_types_allowed = True\n",
    }
    keys = {r.rule_key for r in rules.match_rules(make_files(tree)).collect()}
    assert {PS + "pydantic.arbitrary-types-allowed", TS + "react.missing-dependency-array", TQ + "a11y.button-type"} <= keys


def test_hints_never_hide_a_match():
    """A line that a regex matches holds one of the literals tested before it."""
    lines = [x for t in [*corpus.PY_SAMPLES, *corpus.TS_SAMPLES] for x in t.split("\n")]
    lines += [x.replace(" ", "\t") for x in lines] + [x.replace(" ", "  ") for x in lines]
    for key, p in PREDICATES.items():
        if p.cls == "L":
            matched = [x for x in lines if re.search(p.regex, x)]
            assert matched and all(any(h in x for h in p.hints) for x in matched), key
        if p.cls == "J":
            lefts = [x for x in lines if re.search(p.left, x)]
            rights = [x for x in lines for rx in p.rights if re.search(rx, x)]
            assert lefts and all(p.left_hint in x for x in lefts), key
            assert rights and all(any(h in x for h in p.hints) for x in rights), key


@pytest.mark.parametrize(
    "path,code,key",
    [
        ("a.py", "f = open(os.path.join(a, '..', b), 'r')", "py-security/path.traversal-open"),
        ("a.py", "assert f(a, b)", "py-quality/python.assert-without-message"),
        ("a.py", "app.add(CORSMiddleware(wrap(f(1)), allow_origins=['*']))", "py-security/fastapi.cors-wildcard"),
        ("a.ts", "function f(\n  a,\n  b,\n  c,\n  d,\n  e,\n  g\n) {}", "ts-quality/typescript.too-many-parameters"),
        ("a.tsx", "useEffect(() => { a({ b: { c: { d: { e: { f: 1 } } } } }) })", "ts-security/react.missing-dependency-array"),
    ],
)
def test_rules_are_as_wide_as_their_patterns(spark, path, code, key):
    files = spark.createDataFrame([("p", path, code)], "project_id string, path string, content string")
    assert key in {r.rule_key for r in rules.match_rules(files).collect()}


def test_long_lines_do_not_overflow(spark):
    code = "assert f(" + "a, " * 60_000 + "b)\nopen(" + "x" * 100_000 + ")\nCORSMiddleware(" + "a" * 100_000 + ")\n"
    files = spark.createDataFrame([("p", "a.py", code)], "project_id string, path string, content string")
    assert "py-quality/python.assert-without-message" in {r.rule_key for r in rules.match_rules(files).collect()}


def test_literals_that_a_regex_needs(spark):
    want = {
        r'\bjwt_secret\s*=\s*"123"': ["jwt_secret", '"123"'], "abc?def": ["def"], "(abc)+xyz": ["abc", "xyz"], "(abc)?xyz": [],
        "(?:foo)bar": ["foo", "bar"], "(?i)abc": [], "abc|def": [], r"[a-z]+_key[0-9]{2}tail": ["_key", "tail"], r"\x41bcd\.efg": ["bcd", "efg"],
        "a.b.c": [], r"\Qabc\E": [], "ab*cde": ["cde"], r"\p{L}abc": ["abc"], "[^]abc]def": ["def"], "[[abc]def]ghi": [], "(?=abc)def": [],
    }
    rows = spark.createDataFrame([(r,) for r in want], "r string").select("r", rules.needed_literals(F.col("r")).alias("l")).collect()
    assert {r.r: r.l for r in rows} == want


def test_user_rules_by_index_equal_plain_search(spark, make_files):
    """Rules with and without a key, every mask, many of one literal."""
    import random
    import re

    r = random.Random(3)
    parts = ["key", "token", "abc", r"\d+", "[xyz]", r"\s*=\s*", "a?", "(ab)+", "(foo|bar)", ".", "q"]
    own = [(f"r{i}", "".join(r.choices(parts, k=r.randint(1, 4))), r.choice([None, "none", "comments"]), ["js", "py"]) for i in range(300)]
    own += [(f"n{i}", rf'\bkey\s*=\s*"{i}"', "comments", ["py", "py"]) for i in range(1500)]
    texts = {f"f{i}.py": "\n".join("".join(r.choices(["key", "token", "abc", "12", "x", " = ", "abab", "foo", "q", " "], k=8)) for _ in range(10)) for i in range(4)}
    texts["k.py"] = "\n".join(f'key = "{i}"' for i in range(0, 3000, 7))
    table = spark.createDataFrame(own, "rule_key string, regex string, mask string, languages array<string>")
    got = {(h.path, h.line, h.rule_key) for h in rules.match_user_rules(make_files(texts), table, batch=50).collect()}
    want = {(p, n, k) for p, t in texts.items() for n, line in enumerate(t.split("\n"), 1) for k, rx, _, _ in own if re.search(rx, line)}
    assert got == want


def test_user_rules_meet_lines_by_whole_literals(spark, make_files):
    """Rules that differ in a number share no key, however many there are; long literals differ at any place."""
    long = "a" * 40
    own = [(f"n{i}", rf'\bjwt_secret\s*=\s*"{i}"', "none", ["py"]) for i in range(100, 6000)]
    own += [(f"l{i}", f"{long}{i}{long}", "none", ["py"]) for i in range(100, 200)]
    table = spark.createDataFrame(own, "rule_key string, regex string, mask string, languages array<string>")
    known = rules._known_rules(table)
    assert known.groupBy("key").count().agg(F.max("count")).first()[0] == 1
    code = "".join(f'jwt_secret = "{i}"\nx = "{i}"\n{long}{i}{long}\n' for i in range(90, 5000, 7))
    found = rules.match_user_rules(make_files({"a.py": code}), table).collect()
    want = {(3 * k + 1, f"n{i}") for k, i in enumerate(range(90, 5000, 7)) if i >= 100}
    want |= {(3 * k + 3, f"l{i}") for k, i in enumerate(range(90, 5000, 7)) if 100 <= i < 200}
    assert {(h.line, h.rule_key) for h in found} == want and len(found) == len(want)
    # Lines with a number and no ``jwt_secret`` are not looked up.
    lines = rules._masked_lines(make_files({"a.py": code})).select("project_id", "path", "lang", "line", F.lit("none").alias("mask"), F.col("_raw").alias("text"))
    held = rules._held_keys(lines, known.filter("rule_key like 'n%'"), ["path", "line"])
    assert held.filter("text like 'x%'").count() == 0 and held.count() > 0


def test_user_rules_do_not_pass_through_the_driver(spark, make_files, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    seen, before = [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: seen.append(len(out := before(self))) or out)
    table = spark.range(5000).select(F.concat(F.lit("r"), "id").alias("rule_key"), F.concat(F.lit("name"), "id").alias("regex"), F.lit("none").alias("mask"), F.array(F.lit("py")).alias("languages"))
    found = rules.match_user_rules(make_files({"a.py": "x = name4999"}), table)
    assert max(seen, default=0) <= 3
    assert {h.rule_key for h in found.collect()} == {"r4999", "r499", "r49", "r4"}


def test_a_file_of_loops_takes_seconds(make_files):
    import time

    code = "".join(f"for x{i} in xs:\n    repo.get_tokens(x{i if i % 2 else i + 1})\n" for i in range(24_000))
    files = make_files({"a.py": code})
    start = time.time()
    found = {r.line for r in rules.match_rules(files, keys=[PS + "python.n-plus-one-query"]).collect()}
    assert len(code) > 1 << 20 and found == {2 * i + 1 for i in range(1, 24_000, 2)}
    assert time.time() - start < 60
