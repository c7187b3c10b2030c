"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes.

A word of n characters is cut in the middle. Of two words one edit apart, one half of
either is whole in the other, at the same end. So words are filed and asked for under
their halves, and each task builds the FM-index of the words of some halves, one of
them and one of the reversed text, over ``$word$word$..``. Searching for a word, a
half is matched from the middle outwards up to the delimiter, then the match is
extended over the other half with one error allowed, and must end at a delimiter. A
match is an interval of suffix ranks in both indexes at once; the suffixes that begin
with the delimiter are in the order of the words, so the rank of a whole match is the
number of the word.

Words of a half that very many share are dealt to blocks with an index each, and all
words that ask for this half go to all of its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import measured, settle

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Rows that are filed in one index, about; a half with more has blocks of its own. Words that are searched at a time.
FILED, ASKED = 1 << 15, 1 << 12
#: A word's form is so many times as frequent.
RATIO = 10

END, MARK = 0, 1  # symbols: end of the text, delimiter; characters follow
_FOUND = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
_FOUND_DDL = "word string, n long, n_near long, best_n long, best string"


# --- the index ---------------------------------------------------------------


def suffix_ranks(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of a text in order, by doubling; it ends in a symbol that occurs once.

    The first sort looks at as many symbols as a long holds, each further one at twice as many.
    """
    bits = max(int(symbols - 1).bit_length(), 1)
    reach = min(62 // bits, len(text))
    key = np.zeros(len(text), np.int64)
    for k in range(reach):
        key <<= bits
        key[: len(text) - k] |= text[k:]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if rank[order[-1]] == len(text) - 1 or reach >= len(text):
            return order
        key = rank * (len(text) + 1)
        key[: len(text) - reach] += rank[reach:] + 1
        reach *= 2


class Ranks:
    """The Burrows-Wheeler transform of a text, with counts of symbols before a place."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.bwt = text[suffix_ranks(text, symbols) - 1]
        words = len(text) // 64 + 1
        bits = np.zeros((symbols + 1, words * 8), np.uint8)  # row c + 1: where the symbol is at most c
        for c in range(symbols):
            packed = np.packbits(self.bwt <= c, bitorder="little")
            bits[c + 1, : packed.size] = packed
        bits = bits.view(np.uint64)
        counts = np.bitwise_count(bits).astype(np.int64)
        self.words, self.bits, self.before = words, bits.ravel(), (np.cumsum(counts, 1) - counts).ravel()
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def upto(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many symbols before a place are at most this one; -1 is below all."""
        at = (symbol + 1) * self.words + (place >> 6)
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.bits[at] & low)

    def extended(self, symbol: np.ndarray, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (low, other, size) of matches with one more symbol at the end that this transform extends; ``other`` is the other index's."""
        below, upto = self.upto(symbol - 1, low), self.upto(symbol, low)
        below_end, upto_end = self.upto(symbol - 1, low + size), self.upto(symbol, low + size)
        before = upto - below
        return self.smaller[symbol] + before, other + below_end - below, upto_end - below_end - before


class Index:
    """A bidirectional FM-index of distinct words in code-point order."""

    def __init__(self, words: list[str], alphabet: np.ndarray):
        self.alphabet = alphabet
        self.symbols = len(alphabet) + 2
        marked = self.coded("".join(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.concatenate([[MARK], np.insert(marked, np.cumsum(lengths), MARK)]).astype(np.int64)
        self.left = Ranks(np.append(text, END), self.symbols)
        self.right = Ranks(np.append(text[::-1], END), self.symbols)
        self.length = len(text) + 1

    def coded(self, text: str) -> np.ndarray:
        return np.searchsorted(self.alphabet, np.frombuffer(text.encode("utf-32-le"), np.uint32)) + 2


def alphabet_of(words: list[str]) -> np.ndarray:
    return np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))


# --- the search schemes --------------------------------------------------------


def _following(ranks: Ranks, low: np.ndarray, size: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(match, symbol): the distinct characters that follow each match on the side that ``ranks`` extends."""
    wide = size > symbols
    rows = np.flatnonzero(~wide)
    at = np.repeat(rows, size[rows])
    step = np.arange(at.size) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
    seen = np.unique(at * symbols + ranks.bwt[low[at] + step])
    match, symbol = seen // symbols, seen % symbols
    if wide.any():
        match = np.concatenate([match, np.repeat(np.flatnonzero(wide), symbols - 2)])
        symbol = np.concatenate([symbol, np.tile(np.arange(2, symbols), int(wide.sum()))])
    return match[symbol > MARK], symbol[symbol > MARK]


def one_error(index: Index, exact: list[str], rest: list[str], to_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): the words that hold ``exact`` whole and ``rest`` with one edit behind it (before it, if not ``to_right``).

    Both are given in the order in which they are matched: ``exact`` from the middle of
    the word outwards, ``rest`` from the middle to the other end. Each pair is found
    once: of equal characters in a row the first is deleted, and a character is
    inserted behind equal ones, not before.
    """
    matching, extending = (index.left, index.right) if to_right else (index.right, index.left)
    ends = lambda parts: np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    codes, more = index.coded("".join(exact)), index.coded("".join(rest))
    exact_end, rest_end = ends(exact), ends(rest)
    exact_at, rest_at = np.concatenate([[0], exact_end[:-1]]), np.concatenate([[0], rest_end[:-1]])
    rest_length = rest_end - rest_at

    query = np.arange(len(exact))
    low, other, size = np.zeros(len(exact), np.int64), np.zeros(len(exact), np.int64), np.full(len(exact), index.length)
    for step in range(int((exact_end - exact_at).max(initial=0)) + 1):
        at = exact_at + step
        going = np.flatnonzero((at <= exact_end) & (size > 0))
        symbol = np.where(at[going] < exact_end[going], codes[np.minimum(at[going], len(codes) - 1)] if len(codes) else MARK, MARK)
        low[going], other[going], size[going] = matching.extended(symbol, low[going], other[going], size[going])
    query = query[size > 0]
    low, other, size = other[query], low[query], size[query]  # from now on the other end is extended

    found_query, found_word = [], []
    none = np.zeros(0, np.int64)
    erred = (none, none, none, none, none)  # query, place in rest, low, other, size
    step = 0
    while query.size or erred[0].size:
        q, place, a, b, s = erred
        kept = []
        if q.size:
            last = place == rest_length[q]
            symbol = np.where(last, MARK, more[np.minimum(rest_at[q] + place, len(more) - 1)] if len(more) else MARK)
            a, b, s = extending.extended(symbol, a, b, s)
            done = last & (s > 0)
            found_query.append(q[done])
            found_word.append((b if to_right else a)[done] - 2)  # the ranks before: the end, and the last delimiter
            on = ~last & (s > 0)
            kept.append((q[on], place[on] + 1, a[on], b[on], s[on]))
        if query.size:
            open_ = step < rest_length[query]
            at = np.minimum(rest_at[query] + step, max(len(more) - 1, 0))
            own = np.where(open_, more[at] if len(more) else -1, -1)
            drop = open_ & ((own != more[at - 1]) if step else True)
            kept.append((query[drop], np.full(int(drop.sum()), step + 1), low[drop], other[drop], size[drop]))
            match, symbol = _following(extending, low, size, index.symbols)
            a, b, s = extending.extended(symbol, low[match], other[match], size[match])
            same = symbol == own[match]
            off = ~same
            kept.append((query[match[off]], np.full(int(off.sum()), step), a[off], b[off], s[off]))
            off &= open_[match]
            kept.append((query[match[off]], np.full(int(off.sum()), step + 1), a[off], b[off], s[off]))
            query, low, other, size = query[match[same]], a[same], b[same], s[same]
        erred = tuple(np.concatenate(c) for c in zip(*kept, strict=True))
        step += 1
    return np.concatenate([none, *found_query]), np.concatenate([none, *found_word])


def near_words(words: list[str], asked: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number in ``asked``, number in ``words``): words one edit from those asked for whose left (right) half they hold whole.

    ``words`` are distinct and in code-point order. Pairs whose left half is whole are
    left to the search for that.
    """
    index = Index(words, alphabet_of(words + asked))
    half = [len(w) // 2 for w in asked]
    found = []
    for i in range(0, len(asked), ASKED):
        part = list(zip(asked[i : i + ASKED], half[i : i + ASKED], strict=True))
        if left:
            query, word = one_error(index, [w[:h][::-1] for w, h in part], [w[h:] for w, h in part], True)
        else:
            query, word = one_error(index, [w[h:] for w, h in part], [w[:h][::-1] for w, h in part], False)
            own = np.fromiter((not words[v].startswith(part[q][0][: part[q][1]]) for q, v in zip(query.tolist(), word.tolist(), strict=True)), bool, len(query))
            query, word = query[own], word[own]
        found.append((query + i, word))
    return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])


# --- on Spark ------------------------------------------------------------------


def _searched(table: pa.Table) -> pa.Table:
    """For each word that asks: how many near words this group holds, and the best of them."""
    left = table.column("left")[0].as_py()
    filed = dict(zip(*(table.filter(table.column("filed")).column(c).to_pylist() for c in ("word", "n")), strict=True))
    asking = table.filter(table.column("asks"))
    asked, own = asking.column("word").to_pylist(), asking.column("n")
    words = sorted(filed)
    if not asked or not words:
        return pa.table([asked, own, [0] * len(asked), [None] * len(asked), [None] * len(asked)], schema=_FOUND)
    query, word = near_words(words, asked, left)
    counts = np.fromiter((filed[w] for w in words), np.int64, len(words))
    order = np.lexsort((word, -counts[word], query))
    query, word = query[order], word[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    best: list[int | None] = [None] * len(asked)
    for q, w in zip(query[first].tolist(), word[first].tolist(), strict=True):
        best[q] = w
    return pa.table(
        [asked, own, np.bincount(query, minlength=len(asked)), [None if w is None else int(counts[w]) for w in best], [None if w is None else words[w] for w in best]], schema=_FOUND
    )


def _halves(words: DataFrame) -> DataFrame:
    """A row for each half under which a word is filed: of its own length, or of words one character shorter or longer; under one of each side it asks, too."""
    n = F.length("word")
    half = lambda left, size, own: F.struct(
        F.lit(left).alias("left"), (F.substring("word", F.lit(1), size) if left else F.substring("word", n - size + 1, size)).alias("half"), (size == own).alias("asks")
    )
    div = lambda c: F.floor(c / 2).cast("int")
    rows = [half(True, div(n - 1), div(n)), half(True, div(n + 1), div(n)), half(False, div(n), div(n + 1)), half(False, div(n) + 1, div(n + 1))]
    return words.select("word", "n", F.inline(F.array(*rows)))


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO, filed: int = FILED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``vocabulary`` (word, n), distinct words with their counts.

    n_near: the words that differ by exactly one inserted, deleted or replaced character.
    form: of them the one of largest n, the first in code-point order among equal ones,
    if its n is at least ``ratio`` times the word's; else null. root: the last of the
    forms that follow each other from the word, the word itself if it has none.

    A row without word or n is left out; the empty word is a word. An empty table gives
    an empty table; other columns are not looked at.
    """
    words = settle(vocabulary.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    halves = _halves(words)
    shards = max(1, -(-4 * words.count() // filed))
    hot = settle(halves.groupBy("left", "half").count().where(F.col("count") > filed).select("left", "half", F.ceil(F.col("count") / filed).cast("int").alias("blocks")), "halves")
    common = halves.withColumn("filed", F.lit(True))
    shard = F.pmod(F.xxhash64("left", "half"), F.lit(shards)).cast("int")
    if hot.isEmpty():
        rows = common.select("left", F.lit("").alias("own"), shard.alias("shard"), "word", "n", "asks", "filed")
    else:
        few = measured(hot)
        rows = common.join(few, ["left", "half"], "left_anti").select("left", F.lit("").alias("own"), shard.alias("shard"), "word", "n", "asks", "filed")
        block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
        dealt = common.join(few, ["left", "half"])
        stays = dealt.select("left", F.col("half").alias("own"), block.alias("shard"), "word", "n", "asks", "filed")
        goes = dealt.where("asks").select("left", F.col("half").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("shard"), "word", "n", "asks", F.lit(False).alias("filed"), block.alias("home"))
        rows = rows.unionByName(stays).unionByName(goes.where("shard <> home").drop("home"))
    found = rows.groupBy("left", "own", "shard").applyInArrow(_searched, _FOUND_DDL)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    near = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
    is_form = -F.col("_best.less") >= ratio * F.col("n")
    formed = settle(near.select("word", "n", "n_near", F.when(is_form, F.col("_best.word")).alias("form"), F.when(is_form, -F.col("_best.less")).alias("form_n")), "forms")
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Each round doubles the length of the way that is known; counts grow along it, so it ends."""
    now = settle(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def letter_runs(docs: DataFrame, least: int, text_col: str = "text", *keep: str) -> DataFrame:
    """(run, *keep): each maximal run of at least so many letters of the texts, A-Z in lower case; null texts have none."""
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{least},}}+"), F.lit(0))
    rows = docs.select(*keep, F.explode(runs).alias("run"))
    return rows.select(*keep, F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
