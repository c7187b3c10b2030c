import random
import re

from pyspark.sql import functions as F

from scanloom.functions.patterns import SECRET_PATTERNS, pattern_of
from scanloom.operators import rewrite, secrets

TAIL = "0123456789abcdefghijABCDEFGHIJ012345"
SAMPLES = {
    "STRIPE_LIVE_KEY": ("sk_live_0123456789", "sk_live_012345678"),
    "STRIPE_TEST_KEY": ("sk_test_01234.6789", "sk_test_01234"),
    "GITHUB_PERSONAL_TOKEN": ("ghp_" + TAIL, "ghp_" + TAIL[:-1]),
    "GITHUB_OAUTH_TOKEN": ("gho_" + TAIL, "gho_" + TAIL[:-1]),
    "GITHUB_USER_TOKEN": ("ghu_" + TAIL, "ghu_" + TAIL[:-1]),
    "GITHUB_SERVER_TOKEN": ("ghs_" + TAIL, "ghs_" + TAIL[:-1]),
    "GITHUB_REFRESH_TOKEN": ("ghr_" + TAIL, "ghr_" + TAIL[:-1]),
    "OPENAI_API_KEY": ("ai_" + TAIL[:32], "ai_" + TAIL[:31]),
    "SLACK_BOT_TOKEN": ("xoxb-" + "a1-" * 17, "xoxb-" + "a" * 49),
    "SLACK_USER_TOKEN": ("xoxp-" + "a1-" * 17, "xoxp-" + "a" * 49),
    "SLACK_APP_TOKEN": ("xoxa-" + "a1-" * 17, "xoxa-" + "a" * 49),
    "GENERIC_SECRET_PY": ("Api_Key = 'v'", "'api_key = \"v\""),
    "GENERIC_SECRET_JS": ("let stripeKey = 'v'", "stripeKey = 'v'"),
}


def test_each_pattern_hits_and_misses(spark):
    rows = [(t, good, bad) for t, (good, bad) in SAMPLES.items()]
    df = spark.createDataFrame(rows, "t string, good string, bad string")
    for p in SECRET_PATTERNS:
        r = df.filter(F.col("t") == p.type).select(
            secrets.count_matches(F.col("good"), p).alias("g"), secrets.count_matches(F.col("bad"), p).alias("b")
        ).first()
        assert (r.g, r.b) == (1, 0), p.type


def _random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    bits = [g for g, _ in SAMPLES.values()] + [b for _, b in SAMPLES.values()]
    bits += ["\n", "\n", " ", "#", "'", '"', "token = 'a\nb'", "password=\"x\"", "é", "\ufdd0", "plain text"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_find_secrets_is_finditer(spark):
    """All matches, values and start lines against Python's own regexes."""
    texts = _random_texts(150, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = sorted((r.i, r.type, r.line, r.match, r.value) for r in secrets.find_secrets(df).collect())
    want = []
    for i, t in enumerate(texts):
        for p in SECRET_PATTERNS:
            for m in re.finditer(p.regex, t):
                want.append((i, p.type, t[: m.start()].count("\n") + 1, m[0], m[2] if m.re.groups else m[0]))
    assert got == sorted(want)
    assert len(got) > 300


def test_counts_agree_with_matches(spark):
    texts = _random_texts(80, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    counted = df.select(F.sum(secrets.count_secrets(F.col("content"))).alias("n"), F.count_if(secrets.has_secret(F.col("content"))).alias("d")).first()
    found = secrets.find_secrets(df)
    assert counted.n == found.count()
    assert counted.d == found.select("i").distinct().count()


def test_plain_redaction_leaves_nothing(spark):
    texts = _random_texts(150, 11)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    clean = df.withColumn("content", rewrite.redact_text(F.col("content")))
    tokens = [p for p in SECRET_PATTERNS if not p.type.startswith("GENERIC")]
    assert clean.filter(secrets.has_secret(F.col("content"), tokens)).count() == 0
    one = spark.createDataFrame([("a token = \"xyz\" b",)], "t string").select(rewrite.redact_text(F.col("t"))).first()[0]
    assert one == "a token=[REDACTED] b"


def test_code_secrets_skip_safe_values(make_files):
    files = make_files({"a.py": 'token = "os.getenv(1)"\npassword = "x"\n', "b.ts": "const token = 'process.env.X'\nlet password = 'y'\n"})
    assert secrets.find_file_secrets(files).count() == 2
    assert secrets.find_file_secrets(files, skip_safe=False).count() == 4


def test_rollup_has_totals(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X")], "project_id string, type string")
    rows = {(r.project_id, r.type): r.n_secrets for r in secrets.rollup_by_type(df).collect()}
    assert rows[(None, None)] == 3 and rows[("a", None)] == 2 and rows[("b", "X")] == 1
    assert pattern_of("OPENAI_API_KEY").langs == ("py", "js")
