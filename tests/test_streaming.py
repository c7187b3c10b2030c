from pyspark.sql import functions as F

from scanloom.operators import learning
from scanloom.plans import corpus, scan
from scanloom.streaming import stateless


def test_stream_equals_batch(spark, tmp_path):
    files = corpus.rendered(spark, "/root/testdata/sf0.001", corpus.WEB_FILES).unionByName(
        corpus.rendered(spark, "/root/testdata/sf0.001", corpus.SERVER_FILES)
    )
    source = str(tmp_path / "in")
    files.repartition(3).write.parquet(source)
    batch = spark.read.parquet(source)
    summary = learning.summarise(learning.learn(batch))
    cases = {
        "secrets": stateless.secrets_of,
        "redacted": lambda f: stateless.redacted(f).select("path", "fixed_content", "fixes"),
        "rules": stateless.rule_hits,
        "issues": lambda f: stateless.issue_rows(f, summary),
        "text": lambda f: stateless.redact_text_column(f, "content"),
    }
    for name, op in cases.items():
        stream = stateless.read_files(spark, source, files_per_batch=1)
        out = str(tmp_path / name)
        query = stateless.write(op(stream), out, str(tmp_path / f"{name}-cp"), once=True)
        query.awaitTermination(120)
        got = spark.read.parquet(out)
        want = op(batch)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), name
    assert scan.scan(batch, learned=learning.learn(batch)).count() == stateless.issue_rows(batch, summary).count()
    assert batch.filter(F.col("length") > 0).count() > 0
