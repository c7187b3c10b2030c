import random

from pyspark.sql import functions as F

from scanloom.llm import line_frequency as lf


def plain_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)})


def test_measures_equal_plain_python():
    r = random.Random(2)
    for _ in range(300):
        words = [r.choice("ab") for _ in range(r.randint(0, 40))]
        assert lf.repeat_words([w.encode() for w in words]) == plain_repeats(words)
    assert lf.measures(None) == lf.measures("") == (0, 0, 0, 0, 0)
    assert lf.measures("ü# é\n a\n\n a\nx\x85y $<>") == (6, 11, 4, 1, 0)


def test_lines_above_the_limit_of_a_host_are_removed(spark):
    body = " ".join(f"w{i}" for i in range(25))
    rows = [(i, "h", f"{body} {i}\nshared  LINE here") for i in range(4)] + [(i, "g", "shared line here\nshared line here") for i in (10, 11)] + [(20, None, f"{body} x\nnull host")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.n_words, r.words_left, r.kept) for r in lf.line_rules(docs, max_docs=2).collect()}
    assert got[0] == (29, 26, True)
    assert got[10] == (6, 6, False)
    assert got[20] == (28, 0, False)
    clean = {r.doc_id: r.text for r in lf.without_frequent_lines(docs, max_docs=2).collect()}
    assert clean[1] == f"{body} 1" and clean[10] == rows[4][2] and clean[20] == ""
    assert lf.line_rules(docs, F.lit("one"), max_docs=100).where("kept").count() == 7


def test_odd_rows(odd_docs, no_docs):
    got = lf.line_rules(odd_docs)
    assert got.count() == odd_docs.count() and got.where("base_failed is null or kept is null or n_words is null").count() == 0
    assert set(odd_docs.columns) - {"text"} <= set(got.columns)
    assert {(r["_row"], r["_HOST"]) for r in got.collect()} == {("d", "f")}
    for r in got.collect():
        assert not (r.base_failed and r.kept)
    assert lf.line_rules(no_docs).count() == 0 and lf.without_frequent_lines(no_docs).count() == 0
    assert lf.without_frequent_lines(odd_docs).columns == odd_docs.columns
