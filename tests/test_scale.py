"""Plans and properties that must hold on a cluster."""

import pytest
from pyspark.sql import functions as F

from scanloom.operators import gate, issues, rewrite, rules, secrets
from scanloom.plans import corpus, joins, scan
from scanloom.sources import diffs
from scanloom.sources.python_functions import function_table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A files table on disk, as a job would read it."""
    path = str(tmp_path_factory.mktemp("files"))
    files = corpus.rendered(spark, SF, corpus.WEB_FILES).unionByName(corpus.rendered(spark, SF, corpus.SERVER_FILES))
    files.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_row_local_operators_do_not_shuffle_and_scan_once(spark, stored):
    flagged = issues.with_issues(stored.withColumn("env_style", F.lit("A")))
    texts = stored.select(F.col("path").alias("diff_id"), F.col("content").alias("text"))
    for df in (
        secrets.find_file_secrets(stored), rewrite.redact_secrets(stored), rules.match_rules(stored), flagged,
        rewrite.apply_improvements(flagged.withColumn("auth_decorator", F.lit("a"))), function_table(stored),
        diffs.parse(texts), diffs.added_text(diffs.parse(texts)),
    ):
        text = plan(df)
        assert "Exchange" not in text and "SortMergeJoin" not in text
        assert text.count("FileScan parquet") == 1


def test_learning_scans_once(stored):
    from scanloom.operators import learning

    assert plan(learning.summarise(learning.learn(stored))).count("FileScan parquet") == 1


def test_filters_on_results_do_not_copy_the_fold(stored):
    text = plan(rewrite.redact_secrets(stored).filter("modified and fixes > 1").select("path", "vars"))
    assert text.count("aggregate(") <= 4  # two languages, an outer and an inner fold each


def test_counts_are_partial_before_the_shuffle(stored):
    text = plan(secrets.count_by_type(secrets.find_file_secrets(stored)))
    assert "partial_count" in text


def test_size_filter_and_columns_reach_parquet(stored):
    from scanloom.operators.filters import scannable

    text = plan(scannable(stored).select("project_id"))
    assert "LessThanOrEqual(length,1048576)" in text
    assert "content" not in text.split("ReadSchema")[1]


def test_top_n_is_limited_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    text = plan(gate.top_n(rows, 3, "k", F.col("id")))
    assert "WindowGroupLimit" in text.split("Exchange", 1)[1]


def test_salted_join_is_the_broadcast_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("5", 3)], "k string, v int")
    for how in ("left", "inner"):
        small = joins.join_lookup(left, right, ["k"], how, salt_on=["id"])
        large = joins.join_lookup(left, right, ["k"], how, salt_on=["id"], broadcast_bytes=0)
        assert "BroadcastHashJoin" in plan(small)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.select(small.columns).collect()))


def test_hot_key_is_spread(spark):
    left = spark.range(2000).select(F.lit("hot").alias("k"), "id")
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    salts = joins.salted_join(left, right, ["k"], "left", salt_on=["id"])
    assert salts.count() == 2000
    spread = left.select(F.pmod(F.xxhash64("id"), F.lit(joins.SALTS)).alias("s")).distinct().count()
    assert spread == joins.SALTS


def test_results_do_not_depend_on_partitions(stored):
    def everything(files):
        tree = scan.fix(files)
        return (
            sorted(map(str, scan.findings(files).collect())),
            sorted(map(str, rules.match_rules(files).collect())),
            sorted(map(str, tree.files.select("path", "improved_content", "vars").collect())),
            sorted(map(str, tree.env.collect())),
        )

    assert everything(stored.coalesce(1)) == everything(stored.repartition(7))


def test_checkpoint_folder_comes_from_the_session(spark):
    from scanloom.session import cut_lineage

    df = cut_lineage(spark.range(3))
    folder = spark.sparkContext.getCheckpointDir()
    assert folder and df.count() == 3
    assert cut_lineage(spark.range(2)).count() == 2 and spark.sparkContext.getCheckpointDir() == folder


def test_texts_do_not_move_when_the_learned_table_is_large(spark, stored, monkeypatch):
    """Beyond the broadcast limit the narrow rows of issues are joined, not the files."""
    small = [sorted(map(str, f(stored).collect())) for f in (scan.scan, scan.findings)]
    monkeypatch.setattr(joins.join_lookup, "__kwdefaults__", {**joins.join_lookup.__kwdefaults__, "broadcast_bytes": 0})
    monkeypatch.setattr(joins.heavy_keys, "__defaults__", (2000,))
    for f, want in zip((scan.scan, scan.findings), small, strict=True):
        df = f(stored)
        tree = df._jdf.queryExecution().optimizedPlan().toString()
        joined = tree.split("Join LeftOuter")[1:]
        assert joined and all("content" not in line for line in tree.split("\n") if "Join" in line)
        assert sorted(map(str, df.collect())) == want


def test_copies_follow_the_weight_of_a_key(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v int")
    heavy = joins.heavy_keys(left, ["k"], 4000)
    assert {r.k: r._salts for r in heavy.collect()} == {"hot": 5}  # 1000 rows of 3 + 16 bytes
    for how in ("left", "inner"):
        plain = joins.join_lookup(left, right, ["k"], how, salt_on=["id"])
        salted = joins.salted_join(left, right, ["k"], how, salt_on=["id"], heavy=heavy)
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.select(plain.columns).collect()))


def test_lines_of_diffs_are_read_once_and_shuffled_once(spark, stored, tmp_path):
    rows = stored.select(F.col("path").alias("diff_id"), F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    rows.write.parquet(str(tmp_path / "lines"))
    done = diffs.parse_lines(spark.read.parquet(str(tmp_path / "lines")), block_rows=5)
    done.write.parquet(str(tmp_path / "out"))
    done.collect()
    ran = plan(done).split("== Initial Plan ==")[0]
    assert ran.count("FileScan parquet") == 1 and "ReusedExchange" in ran
    assert ran.count("Exchange") - ran.count("ReusedExchange") <= 4


def test_rows_of_a_task_are_bounded_where_files_are_rendered(spark, tmp_path):
    """Numbers compress well, so the splits of a table do not tell how much work its rows become."""
    from scanloom.sources.tables import spread, table

    spark.range(100_000).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    rows = corpus.rendered(spark, str(tmp_path), corpus.DIFFS).groupBy(F.spark_partition_id()).count()
    assert rows.agg(F.max("count")).first()[0] <= corpus.ROWS_PER_TASK
    assert spread(table(spark, str(tmp_path), "orders"), 7_000).rdd.getNumPartitions() == 15
