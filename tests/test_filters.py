import fnmatch
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from scanloom.functions import paths
from scanloom.operators import filters

PATHS = [
    "src/main.py", "node_modules/test.js", "file.min.js", "a/.env", "a/b.tar.gz", "venv/x.py", "x.pyc", "build", ".hidden.py",
    "trail.", "a..b", "src/types.d.ts", "yarn.lock", "src/x.generated.ts", "g/h.pb.go", "target/x.rs", "my.auto.js",
]


def test_suffix_is_pathlibs(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    for r in df.select("path", paths.suffix_of(F.col("path")).alias("s"), paths.name_of(F.col("path")).alias("n")).collect():
        assert r.n == PurePosixPath(r.path).name
        if r.path != "trail.":  # newer Pythons call the bare dot a suffix
            assert r.s == PurePosixPath(r.path).suffix, r.path


def test_globs_are_fnmatch(spark):
    names = ["a.min.js", "amin.js", "x.d.ts", "a1", "ab", "a-b", "q[", "a+b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for glob in ["*.min.js", "a?", "a[0-9]", "a[!0-9]", "*[*", "a+*", "*"]:
        got = {r.n for r in df.filter(F.col("n").rlike(paths.glob_regex(glob))).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, glob)}, glob


def test_default_scan_drops(make_files):
    files = make_files({p: "x" for p in PATHS} | {"big.py": "y" * 1_048_577, "full.py": "y" * 1_048_576})
    kept = {r.path for r in filters.scannable(files).collect()}
    assert {"src/main.py", "file.min.js", "full.py", "target/x.rs"} <= kept
    assert not kept & {"node_modules/test.js", "venv/x.py", "x.pyc", "build", "big.py"}


def test_config_exclusion(make_files):
    kept = {r.path for r in filters.not_excluded(make_files({p: "x" for p in PATHS})).collect()}
    assert "src/main.py" in kept
    assert not kept & {"node_modules/test.js", "file.min.js", "src/types.d.ts", "yarn.lock", "g/h.pb.go", "target/x.rs"}


def test_below_root(make_files):
    files = make_files({"root/a.py": "", "rooted/b.py": "", "root/c/d.py": ""})
    assert {r.path for r in filters.below_root(files, "root").collect()} == {"a.py", "c/d.py"}


def test_server_files(make_files):
    files = make_files(
        {"app/api/x.rs": "", "src/a.ts": "'use server'\n", "src/b.py": '"use server"', "actions": "", "actionsx/y.ts": "", "c.js": '"use server"'}
    )
    got = {r.path for r in files.filter(filters.is_server_file(F.col("path"), F.col("content"))).collect()}
    assert got == {"app/api/x.rs", "src/a.ts", "actions", "c.js"}


def test_severity_threshold_and_excluded_rules(spark):
    rows = [("a", "critical"), ("b", "ERROR"), ("c", "medium"), ("d", "WARNING"), ("e", "low"), ("f", "INFO"), ("g", "odd")]
    df = spark.createDataFrame(rows, "rule_id string, severity string")
    assert {r.rule_id for r in filters.severe(df, "medium").collect()} == {"a", "b", "c", "d"}
    assert {r.rule_id for r in filters.severe(df, "WARNING").collect()} == {"a", "b", "c", "d"}
    assert {r.rule_id for r in filters.severe(df).collect()} == {"a", "b", "c", "d", "e"}
    assert filters.without_rules(df, ["a", "b"]).count() == 5
    assert filters.without_rules(df, df.filter("rule_id > 'c'")).count() == 3


def test_diff_noise_switches(spark):
    df = spark.createDataFrame([(p,) for p in ["a.lock", "go.sum", "x.min.js", "i.png", "t.d.ts", "m.py"]], "file_path string")
    left = lambda noise: {r.file_path for r in filters.without_noise(df, noise).collect()}
    assert left(None) == {"m.py"}
    assert left(filters.DiffNoise(lockfiles=False)) == {"m.py", "a.lock", "go.sum"}
    assert left(filters.DiffNoise(False, False, False, False)) == {r.file_path for r in df.collect()}


def test_skipped_files_and_their_reasons(spark):
    rows = [("p", "a/node_modules/x.js", "x", 1), ("p", "a.png", "x", 1), ("p", "big.py", "x", 9_000_000), ("p", "bad.py", None, 3), ("p", "ok.py", "x", 1)]
    files = spark.createDataFrame(rows, "project_id string, path string, content string, length long")
    got = {r.path: r.reason for r in filters.skipped(files).collect()}
    assert got == {"a/node_modules/x.js": "excluded folder", "a.png": "excluded suffix", "big.py": "larger than 1048576 bytes", "bad.py": "not readable as UTF-8"}
