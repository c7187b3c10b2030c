import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from scanloom.llm import merkle as mk


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values) -> str:
    shown = [None if v is None else str(v) for v in values]
    return h(*["-" if s is None else f"{len(s.encode())}:{s}" for s in shown])


def levels(digests: list[str]) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[str | None, int]]:
    return [(row[i >> k ^ 1] if i >> k ^ 1 < len(row) else None, i >> k & 1) for k, row in enumerate(tree[:-1])]


def plain(rows: list[tuple], claim) -> list[tuple]:
    """(doc_id, leaf, subroot, root, siblings, folded) of (doc_id, text, lang, source, n_chars) rows."""
    digest = lambda d, t, la, s, n: leaf(d, s, la, n, t)
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, digest(*r), claim(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees.append(levels([x[2] for x in groups[g]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, (there, doc, own, claimed) in enumerate(groups[g]):
            steps = path(trees[k], i) + path(top, k)
            now = claimed
            for sibling, left in steps:
                now = h(now) if sibling is None else h(sibling, now) if left else h(now, sibling)
            out.append((doc if there else None, own, trees[k][-1][0], top[-1][0], [s for s, _ in steps if s], now))
    return out


def key(t):
    return tuple(str(x) for x in t)


def test_least_sets_lead_to_the_root():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 70)
        at = np.array(sorted(r.sample(range(n), r.randint(1, n))))
        asked = {(level, p) for level, places in mk.missing(at, n) for p in places.tolist()}
        known, needed = set(at.tolist()), set()
        for level in range(mk.height(n)):
            for p in known:
                if p ^ 1 < mk.width(n, level) and p ^ 1 not in known:
                    needed.add((level, p ^ 1))
            known = {p >> 1 for p in known}
        assert asked == needed and mk.width(n, mk.height(n)) == 1


def test_equals_plain_trees(spark, monkeypatch):
    monkeypatch.setattr(mk, "LEVELS", 3)
    monkeypatch.setattr(mk, "RUN", 7)
    r = random.Random(2)
    rows = [(r.choice([None, i, i // 2]), r.choice([None, "", "a ü", "t" * i]), r.choice([None, "en", "de", "üb", "Z"]), "s", r.choice([None, i])) for i in range(150)]
    rows += [(1000, "alone", "single", None, 5)] + [(7, "same", "en", "s", 1)] * 20
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, place string, leaf string")
    more = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in mk.FIELDS]
    tampered = mk.build(docs.repartition(5), mk.leaf_digest(more))
    want = plain(rows, lambda x: leaf(x[0], x[3], x[2], None if x[4] is None else x[4] + 1, x[1]))
    got = [(p.doc_id, p.leaf, p.subroot, p.root, p.siblings, p.folded_root) for p in mk.prove(tampered).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {p.verified for p in mk.prove(mk.build(docs)).collect()} == {True}
    for p in mk.prove(tampered).collect():
        assert p.verified == (p.folded_root == p.root)


def test_partitions_fetch_few_nodes(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    made = mk.build(docs)
    assert made.nodes.where("level = 0 and tree >= 0").count() == 5000 and made.leaves.select("part", "run").distinct().count() <= 12
    assert mk.prove(made).where("verified").count() == 5000


def test_odd_rows(odd_docs, no_docs):
    got = mk.prove(mk.build(odd_docs)).collect()
    assert len(got) == odd_docs.count() and all(p.verified for p in got) and len({p.root for p in got}) == 1
    assert mk.build(no_docs).root is None and mk.prove(mk.build(no_docs)).count() == 0
    one = mk.prove(mk.build(odd_docs.where("doc_id = 1"))).collect()
    assert one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].siblings == []
