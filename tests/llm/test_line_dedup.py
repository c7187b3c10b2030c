import random

import pytest

from scanloom.llm import line_dedup as ld


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(rows, least=5):
    """Texts and numbers of removed lines, comparing each line with all earlier ones."""
    places = []
    order = sorted({(r[0] is not None, r[0] or 0, r[2], r[1] or "") for r in rows})
    for known, doc, key, text in order:
        for i, line in enumerate(text.split("\n")):
            if words := ld.words_of(line):
                places.append(((known, doc, key, text), i, words))
    gone, earlier = set(), []
    for who, i, words in places:
        for other in earlier:
            if words == other or (min(len(words), len(other)) >= least and abs(len(words) - len(other)) < 2 and edit_distance(words, other) < 2):
                gone.add((who, i))
                break
        earlier.append(words)
    out = []
    for doc, text, key in rows:
        who = (doc is not None, doc or 0, key, text or "")
        lines = (text or "").split("\n")
        out.append((doc, None if text is None else "\n".join(x for i, x in enumerate(lines) if (who, i) not in gone), sum((who, i) in gone for i in range(len(lines)))))
    return sorted(out, key=repr)


def check(spark, df):
    keyed = df.selectExpr("doc_id", "text", "xxhash64(text) k").collect()
    got = sorted(((r.doc_id, r.text, r.lines_removed) for r in ld.dedup_lines(df).select("doc_id", "text", "lines_removed").collect()), key=repr)
    assert got == brute([(r.doc_id, r.text, r.k) for r in keyed])


def test_within_one_edit_is_the_edit_distance():
    r = random.Random(4)
    for _ in range(3000):
        a = [r.choice("abc") for _ in range(r.randint(0, 6))]
        b = list(a)
        for _ in range(r.randint(0, 2)):
            k = r.randint(0, 2)
            at = r.randint(0, len(b))
            b[at : at + (k > 0)] = [] if k == 1 else [r.choice("abc")]
        assert ld.within_one_edit(a, b) == (edit_distance(a, b) <= 1)


def test_near_lines_share_a_half_and_a_variant():
    r = random.Random(8)
    for _ in range(2000):
        a = [r.choice(["a", "b", "cc"]).encode() for _ in range(r.randint(5, 9))]
        b = list(a)
        at, kind = r.randrange(len(b)), r.randint(0, 2)
        b[at : at + (kind > 0)] = [] if kind == 1 else [b"new"]
        if len(b) >= 5:
            assert set(ld.half_keys(a)) & set(ld.half_keys(b))
            assert {v for _, v in ld.variants(a)} & {v for _, v in ld.variants(b)}


def test_equals_brute_force(spark):
    r = random.Random(11)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Eps", "zeta"]
    lines = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 8))) for _ in range(60)]
    rows = []
    for i in range(70):
        own = []
        for _ in range(r.randint(0, 6)):
            words = r.choice(lines).split(" ")
            for _ in range(r.randint(0, 2)):
                at = r.randint(0, len(words))
                words[at : at + r.randint(0, 1)] = r.choice([[], ["new"], [r.choice(vocabulary)]])
            own.append(" ".join(words))
        rows.append((i, "\n".join(own)))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(spark, odd_docs, no_docs):
    check(spark, odd_docs)
    kept = ld.dedup_lines(odd_docs)
    assert kept.columns == [*odd_docs.columns, "lines_removed"] and kept.count() == odd_docs.count()
    assert ld.dedup_lines(no_docs).count() == 0
    with pytest.raises(ValueError):
        ld.removed_lines(odd_docs, min_words=1)
