import random

from scanloom.llm import spelling as sp


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(vocabulary: dict[str, int], ratio: int = 10) -> set[tuple]:
    near = {w: [v for v in vocabulary if one_edit(w, v)] for w in vocabulary}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * vocabulary[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), None if form[w] is None else vocabulary[form[w]]) for w, n in vocabulary.items()}


def random_words(r: random.Random, alphabet: str, count: int, longest: int) -> list[str]:
    return sorted({"".join(r.choices(alphabet, k=r.randint(0, longest))) for _ in range(count)})


def test_both_schemes_find_each_pair_once():
    r = random.Random(5)
    for k in range(150):
        words = random_words(r, r.choice(["ab", "abc", "aß\U0001f600é"]), r.randint(1, 60), 9)
        got = [(words[a], words[b]) for left in (True, False) for a, b in zip(*sp.near_words(words, words, left), strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}, k


def test_words_asked_for_need_not_be_filed():
    query, word = sp.near_words(["form"], ["forms", "ford", "xyzzy", "fxrm", "form"], True)
    assert sorted(zip(query.tolist(), word.tolist(), strict=True)) == [(0, 0), (1, 0)]
    assert [len(x) for x in sp.near_words(["form"], ["fxrm"], False)] == [1, 1]


def test_very_long_words():
    words = sorted(["a" * 5000, "a" * 4999, "ab" * 2500, "ab" * 2500 + "a"])
    query, word = sp.near_words(words, words, True)
    assert {(len(words[a]), len(words[b])) for a, b in zip(query, word, strict=True)} == {(5000, 4999), (4999, 5000), (5000, 5001), (5001, 5000)}


def test_suffixes_are_in_order():
    import numpy as np

    text = np.array([1, 2, 2, 1, 2, 2, 1, 3, 1, 0])
    assert sp.suffix_ranks(text, 4).tolist() == sorted(range(10), key=lambda i: text[i:].tolist())


def test_equals_brute_force_with_blocks_and_without(spark):
    r = random.Random(9)
    vocabulary = {w: int(10 ** r.uniform(0, 4)) for w in random_words(r, "abé", 400, 7)}
    vocabulary |= {"prefix" + w: int(10 ** r.uniform(0, 4)) for w in random_words(r, "abcde", 60, 4)}
    table = spark.createDataFrame([(w, n, "x") for w, n in vocabulary.items()] + [(None, 3, "x"), ("nothing", None, "x")], "word string, n long, half string")
    for filed in (sp.FILED, 16):  # the second deals common halves to blocks
        got = sp.spelling_variants(table, filed=filed).collect()
        assert len(got) == len(vocabulary)
        assert {tuple(row) for row in got} == plain(vocabulary)


def test_forms_are_followed_to_the_last(spark):
    vocabulary = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10000, "zzzzzzz": 1}
    got = {r.word: (r.form, r.root) for r in sp.spelling_variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaabbbb") and got["aaabbbb"] == (None, "aaabbbb") and got["zzzzzzz"] == (None, "zzzzzzz")


def test_runs_of_odd_rows(odd_docs, no_docs, spark):
    runs = [r.run for r in sp.letter_runs(odd_docs, 7).collect()]
    assert "x" * 5000 in runs and "ü" * 40 in runs and not any(r != r.lower() and r.isascii() for r in runs)
    one = spark.createDataFrame([("ABCDEFÀ abcdefg1hijklmnop short",)], "text string")
    assert [r.run for r in sp.letter_runs(one, 7).collect()] == ["abcdefÀ", "abcdefg", "hijklmnop"]
    assert sp.letter_runs(no_docs, 7).count() == 0
    empty = spark.createDataFrame([], "word string, n long")
    assert sp.spelling_variants(empty).count() == 0 and sp.spelling_variants(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]
