import random

from pyspark.sql import functions as F

from scanloom.llm import mixing


def filled(total, caps, weights):
    """Budgets of siblings by raising a common level in steps."""
    given, left, open_ = {n: 0.0 for n in caps}, float(min(total, sum(caps.values()))), set(caps)
    while left > 1e-9 and open_:
        level = left / sum(weights[n] for n in open_)
        full = {n for n in open_ if given[n] + level * weights[n] >= caps[n]}
        if not full:
            for n in open_:
                given[n] += level * weights[n]
            return given
        for n in full:
            left -= caps[n] - given[n]
            given[n] = float(caps[n])
        open_ -= full
        left = min(total, sum(caps.values())) - sum(given.values())
    return given


def test_shortages_go_to_siblings_before_ancestors(spark):
    r = random.Random(3)
    leaves = [(f"domain{d}", lang, f"s{d}{lang}{k}", r.randint(1, 2000)) for d in range(4) for lang in ("en", "de", "xx") for k in range(3)]
    weights = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 0}, "language": {"en": 5, "de": 2}, "source": {"s0en1": 7}}
    df = spark.createDataFrame([(*x, 3 * x[3]) for x in leaves], "domain string, language string, source string, have long, cap long")
    for share in (1, 4, 30):
        got = {(x.domain, x.language, x.source): x.given for x in mixing.budgets(df, F.col("all_tokens") * share / 10, weights).collect()}
        total = sum(x[3] for x in leaves) * share / 10
        cap = lambda *p: sum(3 * x[3] for x in leaves if x[: len(p)] == p)
        want = {}
        domains = {d for d, *_ in leaves if d != "domain3"}
        by_domain = filled(total, {d: cap(d) for d in domains}, {d: weights["domain"][d] for d in domains})
        for d in domains:
            langs = {x[1] for x in leaves}
            by_lang = filled(by_domain[d], {y: cap(d, y) for y in langs}, {y: weights["language"].get(y, 1) for y in langs})
            for y in langs:
                own = {x[2] for x in leaves if x[:2] == (d, y)}
                by_source = filled(by_lang[y], {s: cap(d, y, s) for s in own}, {s: weights["source"].get(s, 1) for s in own})
                want |= {(d, y, s): by_source[s] for s in own}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1.001 for k in want)


def test_prefix_of_each_epoch_is_within_the_budget(spark):
    rows = [(i, "word " * (1 + i % 13), "en", f"src{i % 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.mix(docs, F.floor(F.col("all_tokens") * 3 / 2))
    total = sum(1 + i % 13 for i in range(3000))
    used = taken.agg(F.sum("tokens")).first()[0]
    assert total * 3 // 2 - 2 * 13 <= used <= total * 3 // 2
    counts = {r.doc_id: r.n for r in taken.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) <= {1, 2, 3}
    again = {(r.doc_id, r.epoch) for r in mixing.mix(docs.repartition(5), F.floor(F.col("all_tokens") * 3 / 2)).collect()}
    rows = taken.select("doc_id", "epoch", "draw", "source").collect()
    assert again == {(r.doc_id, r.epoch) for r in rows}
    for source in ("src0", "src1"):  # the last epoch holds a prefix of its order
        last = max(r.epoch for r in rows if r.source == source)
        ids = {r.doc_id for r in rows if r.source == source and r.epoch == last}
        draw = {d.doc_id: d.draw for d in docs.where(F.col("source") == source).select("doc_id", mixing.draw(F.col("doc_id").cast("string"), F.lit(last), mixing.SEED).alias("draw")).collect()}
        assert ids == {d for d, x in draw.items() if x <= max(draw[i] for i in ids)}


def test_only_dataframe_functions_run(odd_docs):
    plan = mixing.mix(odd_docs, F.col("all_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in plan]


def test_odd_rows(odd_docs, no_docs):
    whole = mixing.mix(odd_docs, F.col("all_tokens"), max_epochs=1)
    assert {r["_last"] for r in whole.collect()} == {"b"} and {r["_id"] for r in whole.collect()} == {"c"}
    assert set(odd_docs.columns) <= set(whole.columns) and whole.where("tokens > 0").count() == odd_docs.where(mixing.words(F.col("text")) > 0).count()
    assert mixing.mix(no_docs, F.col("all_tokens")).count() == 0
    assert mixing.mix(odd_docs, F.lit(0)).where("tokens > 0").count() == 0
