from collections import Counter
from math import exp, log

import numpy as np
import pytest

from scanloom.llm import language_id as lid

LETTERS = lid.letter_table()


def plain_model(texts):
    """Interpolated Kneser-Ney of order 4 as a function of a gram's four units, from the definition."""
    grams = Counter(g for t in texts for g in lid.grams_of(t, LETTERS).tolist())
    tuples = Counter({tuple(g >> 16 * k & 0xFFFF for k in (3, 2, 1, 0)): n for g, n in grams.items()})
    by = {4: tuples}
    for k in (3, 2, 1):
        by[k] = Counter(g[1:] for g in by[k + 1])
    d, total, types = {}, {}, {}
    for k, c in by.items():
        once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d[k] = once / (once + 2 * twice) if once and twice else 0.5
        total[k], types[k] = Counter(), Counter()
        for g, n in c.items():
            total[k][g[:-1]] += n
            types[k][g[:-1]] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / (types[1][()] + 1)
        below, ctx = p(g[1:]), g[:-1]
        if ctx not in total[k]:
            return below
        return max(by[k][g] - d[k], 0) / total[k][ctx] + d[k] * types[k][ctx] / total[k][ctx] * below

    return p


EN = ["the cat sat on the mat and the dog ran to the house", "she said that they were on the other side of the hill", "there is the thing that he wanted to have this morning"]
DE = ["der hund und die katze sind in dem haus", "wir haben das nicht gewusst und sind gegangen", "ich weiß nicht was das ist und warum es größer wird"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(str(i), lang, t) for lang, texts in (("en", EN), ("de", DE)) for i, t in enumerate(texts)] + [("x", None, "abc"), ("y", "en", None)]
    return lid.train(spark.createDataFrame(rows, "key string, lang string, text string"))


def test_probabilities_equal_the_definition(model):
    for i, texts in enumerate((DE, EN)):
        p = plain_model(texts)
        for text in ["the house is größer", "zzz qqq", "und", *EN]:
            grams = lid.grams_of(text, LETTERS)
            want = -sum(log(p(tuple(g >> 16 * k & 0xFFFF for k in (3, 2, 1, 0)))) for g in grams.tolist()) / len(grams)
            assert model.tables.entropies(text, LETTERS)[1][i] == pytest.approx(want, rel=1e-5)


def test_probabilities_of_a_context_sum_to_one(model):
    alphabet = sorted({ord(c) for t in EN for c in t} | {32})
    base = lid.grams_of("the", LETTERS)[2] >> np.uint64(16) << np.uint64(16)
    grams = np.array([int(base) | c for c in alphabet], np.uint64) * np.uint64(lid.HASH)
    unseen = exp(model.tables.unseen[1])
    total = np.exp(model.tables.of(grams)[:, 1].astype(float)).sum()
    assert 1 - 3 * unseen < total <= 1 + 1e-4


def test_bounded_model_still_tells_languages_apart(spark):
    rows = [(str(i), lang, t) for lang, texts in (("en", EN), ("de", DE)) for i, t in enumerate(texts)]
    small = lid.train(spark.createDataFrame(rows, "key string, lang string, text string"), model_entries=400)
    assert small.judge("the dog on the hill", LETTERS)[0] == "en" and small.judge("das haus und der hund", LETTERS)[0] == "de"


def test_a_model_too_large_to_broadcast_keeps_all_and_judges_alike(spark, model, odd_docs):
    rows = [(str(i), lang, t) for lang, texts in (("en", EN), ("de", DE)) for i, t in enumerate(texts)]
    large = lid.train(spark.createDataFrame(rows, "key string, lang string, text string"), model_entries=400)
    assert isinstance(large.tables, lid.Joined) and isinstance(model.tables, lid.Tables)
    assert [own.count() for own, _ in large.tables.orders] == [len(k) for k in model.tables.keys]
    texts = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(20 + i, t) for i, t in enumerate([*EN, *DE, "the house is größer", "qxzj wvkq"])], "doc_id long, text string"))
    one, other = (sorted(lid.predict(texts, m).collect(), key=repr) for m in (model, large))
    assert len(one) == len(other)
    for a, b in zip(one, other, strict=True):
        assert (a.doc_id, a.text, a.lang_pred, a.rejected) == (b.doc_id, b.text, b.lang_pred, b.rejected)
        assert a.score == pytest.approx(b.score, rel=1e-6) and a.cross_entropy == (None if b.cross_entropy is None else pytest.approx(b.cross_entropy, rel=1e-6))


def test_judgement_and_rejection(model):
    assert model.judge("the other house that they have", LETTERS)[0] == "en"
    assert model.judge("ich und der hund sind größer", LETTERS)[0] == "de"
    for text in (None, "", "12 %% !", "\U0001f600"):
        assert model.judge(text, LETTERS) == ("und", 0.0, None, True)
    assert model.judge("qxzj wvkq jjxz pqvw zzkx qqjw " * 10, LETTERS)[3]


def test_limits_of_rejection_come_from_all_texts(spark):
    rows = [(str(i), "en", EN[0]) for i in range(40)] + [(str(40 + i), "de", t) for i, t in enumerate(DE)] + [("rare", "en", "zqxj")]
    limits = [lid.train(spark.createDataFrame(rows, "key string, lang string, text string"), calibration_texts=n) for n in (1, 2, 100)]
    assert len({tuple(m.reach) for m in limits}) == len({tuple(m.usual) for m in limits}) == 1
    n, h = limits[0].tables.entropies("zqxj", LETTERS)
    en = limits[0].langs.index("en")
    assert limits[0].reach[en] == pytest.approx(lid.MARGIN * (h[en] - limits[0].usual[en]) * n**0.5)


def test_odd_rows(spark, odd_docs, no_docs):
    got = lid.identify(odd_docs).select("doc_id", "text", "lang_pred", "score", "rejected", "held_out").collect()
    assert len(got) == odd_docs.count() and set(odd_docs.columns) <= set(lid.identify(odd_docs).columns)
    for r in got:
        assert (r.lang_pred == "und") == (not lid.has_letter(r.text)) and 0 <= r.score <= 1
        assert r.held_out is not None and (r.doc_id is not None or not r.held_out)
    assert lid.identify(no_docs).count() == 0
    nothing = lid.identify(odd_docs.withColumn("lang", odd_docs["lang"].substr(1, 0)).where("doc_id = 3")).collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_held_out_accuracy(spark):
    got = lid.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").select("lang", "lang_pred", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
