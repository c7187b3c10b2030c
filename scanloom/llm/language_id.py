"""Language identification with interpolated Kneser-Ney character models.

Every labelled text gives its 4-grams of characters (UTF-16 code units, letters in
lower case, all else one blank). Spark counts them and derives the lower orders'
continuation counts, discounts, probabilities and back-off weights with grouped
sums and joins. The model keeps every gram and context. Up to a measured size it is
a few sorted arrays of hashes with a row of log probabilities, one for each
language, that are broadcast; beyond it stays in tables, and the grams of texts are
counted and joined with it. A text goes to the language with the lowest
cross-entropy per character. It is rejected if that is further above what the language's own texts
have than a limit calibrated on all of them.
"""

import copy
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import drop_settled, measured, plain_state, rebuilt, settle, tidied, tidy, unused

ORDER = 4
BLANK = 32
#: The hash of a gram is its 64 bits times this odd number; the other undoes it.
HASH = 0x9E3779B97F4A7C15
UNHASH = pow(HASH, -1, 1 << 64)
#: A model of at most so many numbers of 4 bytes, over all orders and languages, is broadcast; a larger one is joined, with equal results.
MODEL_ENTRIES = 1 << 23
#: Texts per language that set the sharpness of the score; the limits of rejection come from all texts.
CALIBRATION_TEXTS = 512
UNDETERMINED = "und"
#: Grams of a language that a worker gathers before it sorts them, and distinct ones that it holds before it hands them on.
PENDING, HELD = 500_000, 500_000
#: Grams of a text that are looked up at a time.
LOOKUP = 250_000
#: Texts of more characters than this vary no less in their cross-entropy.
STEADY_CHARS = 400
MARGIN = 1.25


def letter_table() -> np.ndarray:
    """By code unit: letters and marks in lower case, halves of characters beyond the first plane as they are, all else a blank."""
    table = np.full(1 << 16, BLANK, np.uint16)
    for code in range(1 << 16):
        if 0xD800 <= code < 0xE000:
            table[code] = code
        elif unicodedata.category(c := chr(code))[0] in "LM":
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams_of(text: str, table: np.ndarray) -> np.ndarray:
    """The packed 4-grams of a text, one for each of its characters and one for its end; none for a text without letters."""
    units = table[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)]
    blank = units == BLANK
    units = units[~(blank & np.concatenate(([True], blank[:-1])))]
    if len(units) and units[-1] == BLANK:
        units = units[:-1]
    if not len(units):
        return np.zeros(0, np.uint64)
    edge = np.full(ORDER - 1, BLANK, np.uint64)
    u = np.concatenate((edge, units.astype(np.uint64), edge[:1]))
    grams = u[: -(ORDER - 1)].copy()
    for k in range(1, ORDER):
        grams <<= np.uint64(16)
        grams |= u[k : len(u) - ORDER + 1 + k]
    return grams


def _tally(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order and their counts."""
    if weights is None:
        grams = np.sort(grams)
    else:
        order = np.argsort(grams, kind="stable")
        grams, weights = grams[order], weights[order]
    at = np.flatnonzero(np.concatenate(([len(grams) > 0], grams[1:] != grams[:-1])))
    if weights is None:
        return grams[at], np.diff(np.append(at, len(grams)))
    return grams[at], np.add.reduceat(weights, at) if len(at) else weights


def _count_grams(source):
    """Counts by language of a partition's texts, handed on whenever many are held."""
    table, schema = letter_table(), pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    raw: dict[str, list[np.ndarray]] = {}
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[str, int] = {}

    def fold(lang):
        if raw.get(lang):
            held.setdefault(lang, []).append(_tally(np.concatenate(raw.pop(lang))))
        size[lang] = 0
        parts = held.get(lang, [])
        if len(parts) > 1:
            held[lang] = [_tally(np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts]))]

    def out(lang):
        fold(lang)
        for g, n in held.pop(lang, []):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    for batch in source:
        pa.default_memory_pool().release_unused()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            grams = grams_of(text.as_py(), table)
            raw.setdefault(lang, []).append(grams)
            size[lang] = size.get(lang, 0) + len(grams)
            if size[lang] > PENDING:
                fold(lang)
                if sum(len(g) for g, _ in held[lang]) > HELD:
                    yield from out(lang)
    for lang in sorted({*raw, *held}):
        yield from out(lang)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of ``labelled`` (lang, text), neither null."""
    found = labelled.select("lang", "text").mapInArrow(tidied(_count_grams), "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (lang, gram, n, p) and (lang, context, weight), interpolated with all lower orders.

    The highest order counts occurrences, lower ones the distinct characters before
    a gram. p is the interpolated probability of the last character after the rest;
    weight is what a context leaves to the next lower order. The discount of an order
    is n1 / (n1 + 2 n2), with n1 and n2 the numbers of its grams counted once and
    twice, and a half where there are none of either.
    """
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << 16 * k) - 1
        by_order[k] = settle(by_order[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask).cast("long")).alias("gram")).agg(F.count("*").alias("n")), "grams")
    made, below = [], None
    for k in range(1, ORDER + 1):
        grams = by_order[k].withColumn("context", F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long"))
        sums = grams.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"))
        discount = sums.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
        contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(discount, "lang")
        contexts = contexts.withColumn("weight", F.col("d") * F.col("types") / F.col("total"))
        joined = grams.join(contexts, ["lang", "context"])
        if below is None:
            lower = joined.withColumn("q", 1 / (F.col("types") + 1))
        else:
            lower = joined.withColumn("rest", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1).cast("long"))).join(below, ["lang", "rest"])
        p = settle(lower.select("lang", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("q")).alias("p")), "grams")
        below = p.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q"))
        made.append((p, contexts.select("lang", "context", "weight", "total", "types")))
    return made


class Tables:
    """The model: for each order, sorted hashes of grams and of contexts, and a column of logarithms for each language."""

    def __init__(self, langs: list[str], rows: list[tuple], weights: list[tuple], unseen: np.ndarray):
        """rows, weights: for each order, arrays (language index, key, logarithm)."""
        self.langs, self.unseen = langs, unseen
        self.keys, self.logs, self.back_keys, self.back_logs = [], [], [], []
        for (lang, key, log), (wlang, wkey, wlog) in zip(rows, weights, strict=True):
            back_keys, back = self._spread(wlang, wkey, wlog, 0.0)
            self.back_keys.append(back_keys)
            self.back_logs.append(back)
            keys, logs = self._spread(lang, key, log, np.nan)
            order = len(self.keys) + 1
            gap = np.isnan(logs)
            some = np.flatnonzero(gap.any(axis=1))
            if len(some):  # a gram that one language knows, in another
                logs[some] = np.where(gap[some], self._backed_off(keys[some] * np.uint64(UNHASH), order), logs[some])
            self.keys.append(keys)
            self.logs.append(logs)

    def _spread(self, lang, key, log, empty):
        hashed = key.view(np.uint64) * np.uint64(HASH)
        keys, at = np.unique(hashed, return_inverse=True)
        out = np.full((len(keys), len(self.langs)), empty, np.float32)
        out[at, lang] = log
        return keys, out

    def _backed_off(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Logarithms of grams that the order has not: the context's weight, then the next lower order."""
        context = grams >> np.uint64(16) if order > 1 else np.zeros_like(grams)
        keys, logs = self.back_keys[order - 1], self.back_logs[order - 1]
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        if len(keys):
            hashed = context * np.uint64(HASH)
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            out = np.where((keys[at] == hashed)[:, None], logs[at], out)
        if order == 1:
            return out + self.unseen
        return out + self.of((grams & np.uint64((1 << 16 * (order - 1)) - 1)) * np.uint64(HASH), order - 1)

    def of(self, hashed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """The logarithms of the probabilities of hashed grams, a column for each language."""
        keys, logs = self.keys[order - 1], self.logs[order - 1]
        if not len(keys):
            return self._backed_off(hashed * np.uint64(UNHASH), order)
        at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        out = logs[at]
        missing = np.flatnonzero(keys[at] != hashed)
        if len(missing):
            out[missing] = self._backed_off(hashed[missing] * np.uint64(UNHASH), order)
        return out

    def entropies(self, text: str, letters: np.ndarray, order: int = ORDER) -> tuple[int, np.ndarray]:
        """Number of characters judged, and the cross-entropy per character in each language, by grams of the order."""
        grams = grams_of(text, letters)
        if not len(grams):
            return 0, np.zeros(len(self.langs))
        mask = np.uint64((1 << 16 * order) - 1)
        total = np.zeros(len(self.langs))
        for i in range(0, len(grams), LOOKUP):
            hashed, n = _tally((grams[i : i + LOOKUP] & mask) * np.uint64(HASH))
            total -= n @ self.of(hashed, order).astype(np.float64)
        return len(grams), total / len(grams)


class Joined:
    """The model as tables: for each order (gram, own) and (context, back), arrays of logarithms by language, null and 0 where a language has none."""

    def __init__(self, langs: list[str], orders: list[tuple[DataFrame, DataFrame]], unseen: np.ndarray):
        self.langs, self.unseen = langs, unseen
        self.orders = [(self._wide(p, "gram", "p", "own", None), self._wide(c, "context", "weight", "back", 0.0)) for p, c in orders]

    def _wide(self, df: DataFrame, key: str, value: str, name: str, empty: float | None) -> DataFrame:
        by_lang = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", F.log(value).cast("float")))).alias("logs"))
        found = F.transform(F.lit(self.langs), lambda lang: F.coalesce(F.try_element_at("logs", lang), F.lit(empty).cast("float")))
        return settle(by_lang.select(key, found.alias(name)), "model")

    def logs(self, grams: DataFrame) -> DataFrame:
        """(gram, logs, bare) for each distinct gram: by language the logarithm of its probability, and that of its last character alone."""
        needed = {ORDER: settle(grams.select("gram").distinct(), "needed")}
        for k in range(ORDER - 1, 0, -1):
            needed[k] = settle(needed[k + 1].select(_last(k).alias("gram")).distinct(), "needed")
        below = None
        for k, (own, back) in enumerate(self.orders, 1):
            context = F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")
            found = needed[k].join(own, "gram", "left").withColumn("context", context).join(measured(back), "context", "left")
            if below is None:
                found = found.withColumn("lower", F.lit(self.unseen.tolist()).cast("array<float>"))
            else:
                found = found.withColumn("rest", _last(k - 1)).join(below, "rest")
            left = F.transform("lower", lambda x, i: F.coalesce(F.get("back", i), F.lit(0.0).cast("float")) + x)
            logs = F.transform(left, lambda x, i: F.coalesce(F.get("own", i), x))
            made = settle(found.select("gram", logs.alias("logs"), (logs if below is None else F.col("bare")).alias("bare")), "logs")
            below = made.select(F.col("gram").alias("rest"), F.col("logs").alias("lower"), "bare")
        return made

    def entropies(self, texts: DataFrame) -> DataFrame:
        """(text_key, n, has_letters, h, bare) for each distinct text that has grams: its characters and its cross-entropies by language."""
        counts = settle(texts.select("text").mapInArrow(_text_grams, _TEXT_GRAMS_DDL), "grams")
        joined = counts.join(measured(self.logs(counts)), "gram")
        # A text that is repeated has its grams and their number repeated alike.
        sums = [F.sum(F.col("n") * F.col(c)[i].cast("double")).alias(f"{c}{i}") for c in ("logs", "bare") for i in range(len(self.langs))]
        summed = joined.groupBy("text_key").agg(F.sum("n").alias("all"), F.first("chars").alias("n"), F.first("has_letters").alias("has_letters"), *sums)
        mean = lambda c: F.array(*[-F.col(f"{c}{i}") / F.col("all") for i in range(len(self.langs))])
        return summed.select("text_key", "n", "has_letters", mean("logs").alias("h"), mean("bare").alias("bare"))


def _last(k: int) -> Column:
    """The last k characters of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long"))


_TEXT_GRAMS = pa.schema([("text_key", pa.binary()), ("gram", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("has_letters", pa.bool_())])
_TEXT_GRAMS_DDL = "text_key binary, gram long, n long, chars long, has_letters boolean"


def text_key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _text_grams(source):
    """The distinct grams of each text with their counts."""
    letters = letter_table()
    for batch in source:
        for text in batch.column("text"):
            if (text := text.as_py()) is None:
                continue
            grams, n = _tally(grams_of(text, letters))
            key, chars, lettered = text_key(text), int(n.sum()), has_letter(text)
            for i in range(0, len(grams), LOOKUP):
                g, m = grams[i : i + LOOKUP], n[i : i + LOOKUP]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(g), pa.binary()), pa.array(g.view(np.int64)), pa.array(m.astype(np.int64)), pa.array([chars] * len(g), pa.int64()), pa.array([lettered] * len(g))], schema=_TEXT_GRAMS)
        pa.default_memory_pool().release_unused()


class Model:
    """Tables, and by language the usual cross-entropy and how far above it texts may lie.

    That is the reach of the language's own texts, more for short ones, and at least the
    slack: half the way to what single characters without context give, since new texts
    lie above those learned from.
    """

    def __init__(self, tables: Tables | Joined):
        self.tables, self.langs, self.sharpness = tables, tables.langs, 1.0
        self.usual = np.zeros(len(tables.langs))
        self.reach = np.full(len(tables.langs), np.inf)
        self.slack = np.zeros(len(tables.langs))

    def judge(self, text: str | None, letters: np.ndarray) -> tuple[str, float, float | None, bool]:
        """(language, score, cross-entropy, rejected). The score is the calibrated share of the best language."""
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, None, True
        if isinstance(self.tables, Joined):
            spark = self.tables.orders[0][0].sparkSession
            return tuple(predict(spark.createDataFrame([(text,)], "text string"), self).drop("text").first())
        return self.verdict(*self.tables.entropies(text, letters))

    def verdict(self, n: int, h: np.ndarray) -> tuple[str, float, float, bool]:
        best = int(np.argmin(h))
        share = float(1 / np.exp(np.maximum(-700, -self.sharpness * (h - h[best]))).sum())
        limit = self.usual[best] + max(self.slack[best], self.reach[best] / np.sqrt(min(n, STEADY_CHARS)))
        return self.langs[best], share, float(h[best]), bool(h[best] > limit)


def train(labelled: DataFrame, model_entries: int = MODEL_ENTRIES, calibration_texts: int = CALIBRATION_TEXTS) -> Model:
    """A model of all texts of ``labelled`` (key, lang, text).

    Rows with a null language or text are left out. All texts are counted, and all
    their grams and contexts are kept. A model of up to ``model_entries`` numbers is
    held in memory, a larger one in tables. Limits come from all texts; ``calibration_texts``
    texts of each language, dealt by the hash of their key, set the sharpness.
    """
    labelled = labelled.where("lang is not null and text is not null")
    counts = settle(gram_counts(labelled), "grams")
    orders = [(p, settle(c, "contexts")) for p, c in kneser_ney(counts)]
    share = {r["lang"]: r["types"] for r in orders[0][1].collect()}
    langs = sorted(share)
    unseen = np.array([-np.log(share[lang] + 1.0) for lang in langs], np.float32)
    if _entries(orders, len(langs), model_entries) <= model_entries:
        index = {lang: i for i, lang in enumerate(langs)}

        def held(df: DataFrame, key: str, value: str) -> tuple:
            got = df.select("lang", key, F.log(value).alias("log")).toArrow()
            lang = got["lang"].combine_chunks().dictionary_encode()
            at = np.array([index[x] for x in lang.dictionary.to_pylist()], np.int64)
            return at[lang.indices.to_numpy()], got[key].to_numpy(), got["log"].to_numpy()

        model = Model(Tables(langs, [held(p, "gram", "p") for p, _ in orders], [held(c, "context", "weight") for _, c in orders], unseen))
    else:
        model = Model(Joined(langs, orders, unseen))
    for df in [counts, *(t for pair in orders for t in pair)]:
        drop_settled(df)
    if langs:
        _calibrate(model, labelled, calibration_texts)
    return model


def _entries(orders: list[tuple[DataFrame, DataFrame]], langs: int, most: int) -> int:
    """Numbers of 4 bytes in the arrays of the model, a key as two; counted until there are more than ``most``."""
    found = 0
    for p, c in reversed(orders):
        for keys in (p.select("gram"), c.select("context")):
            found += keys.distinct().count() * (langs + 2)
            if found > most:
                return found
    return found


def _entropies(texts: DataFrame, tables: Tables | Joined) -> DataFrame:
    """(lang, deal, n, h, bare) of the texts with grams: characters, cross-entropies by language, and those by single characters."""
    if isinstance(tables, Joined):
        found, keyed = tables.entropies(texts), texts.select("lang", "deal", _key_of("text").alias("text_key"))
        return keyed.join(found, "text_key").select("lang", "deal", "n", "h", "bare")
    held = texts.sparkSession.sparkContext.broadcast(plain_state(tables))
    schema = pa.schema([("lang", pa.string()), ("deal", pa.int64()), ("n", pa.int64()), ("h", pa.list_(pa.float64())), ("bare", pa.list_(pa.float64()))])

    def run(source):
        letters, tables = letter_table(), rebuilt(Tables, held.value)
        for batch in source:
            got = [tables.entropies(t.as_py(), letters) for t in batch.column("text")]
            bare = [tables.entropies(t.as_py(), letters, 1)[1].tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("deal"), pa.array([n for n, _ in got], pa.int64()), pa.array([h.tolist() for _, h in got], schema.field("h").type), pa.array(bare, schema.field("h").type)], schema=schema)

    return texts.select("lang", "deal", "text").mapInArrow(tidied(run), "lang string, deal long, n long, h array<double>, bare array<double>").where("n > 0")


def _key_of(text_col: str) -> Column:
    return F.unhex(F.md5(F.encode(F.col(text_col).cast("string"), "UTF-8")))


def _calibrate(model: Model, labelled: DataFrame, texts: int) -> None:
    langs = model.langs
    scored = settle(_entropies(labelled.select("lang", F.xxhash64("key", "text").alias("deal"), "text"), model.tables), "scored")
    dealt = None
    for lang in langs:
        part = scored.where(F.col("lang") == lang).orderBy("deal").select("lang", "h").limit(texts)
        dealt = part if dealt is None else dealt.unionByName(part)
    rows = dealt.collect()
    best_like, best = -np.inf, 1.0
    gaps = np.array([np.array(r["h"]) - r["h"][langs.index(r["lang"])] for r in rows]).reshape(-1, len(langs))
    for sharpness in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0):
        like = -np.log(np.exp(np.minimum(700, -sharpness * gaps)).sum(axis=1)).sum() if len(gaps) else 0.0
        if like > best_like:
            best_like, best = like, sharpness
    model.sharpness = best
    place = F.array_position(F.lit(langs), F.col("lang")).cast("int")
    own = scored.select("lang", "n", F.element_at("h", place).alias("h"), F.element_at("bare", place).alias("bare"))
    middle = own.groupBy("lang").agg(*(F.percentile_approx(c, 0.5, 100_000).alias(c) for c in ("h", "bare"))).collect()
    usual = {r["lang"]: r["h"] for r in middle}
    if not usual:
        return
    above = F.col("h") - F.element_at(F.create_map(*[F.lit(x) for pair in usual.items() for x in pair]), F.col("lang"))
    reach = own.groupBy("lang").agg(F.max(above * F.sqrt(F.least("n", F.lit(STEADY_CHARS)))).alias("reach")).collect()
    for r in middle:
        i = langs.index(r["lang"])
        model.usual[i], model.slack[i] = r["h"], max(0.0, (r["bare"] - r["h"]) / 2)
    for r in reach:
        model.reach[langs.index(r["lang"])] = MARGIN * max(0.5, r["reach"])
    drop_settled(scored)


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected (names begin with ``prefix``), for each row.

    lang_pred is ``und``, score 0, cross_entropy null and rejected true where the text is
    null or has no letter, or nothing was learned. Ties between languages go to the
    first by name. Columns of the same names are replaced.
    """
    spark = docs.sparkSession
    names = [prefix + x for x in ("lang_pred", "score", "cross_entropy", "rejected")]
    if isinstance(model.tables, Joined):
        return _predict_joined(docs, model, text_col, names)
    held = spark.sparkContext.broadcast(plain_state(model))

    @F.arrow_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def judged(source: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, model = letter_table(), rebuilt(Model, held.value, tables=Tables)
        for texts in source:  # one text at a time becomes a Python string
            columns = list(zip(*(model.judge(t.as_py(), letters) for t in texts), strict=True)) or [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "cross_entropy", "rejected"])
            tidy()

    # Not deterministic for Catalyst: it would judge a text once more for each filter on the verdict.
    (held_in,) = unused(docs, "_judged")
    made = docs.withColumn(held_in, judged.asNondeterministic()(F.col(text_col).cast("string")))
    return made.withColumns({n: F.col(held_in)[x] for n, x in zip(names, ("lang_pred", "score", "cross_entropy", "rejected"), strict=True)}).drop(held_in)


def _predict_joined(docs: DataFrame, model: Model, text_col: str, names: list[str]) -> DataFrame:
    light = copy.copy(model)
    light.tables = None
    held = docs.sparkSession.sparkContext.broadcast(plain_state(light))
    schema = pa.schema([("_text_key", pa.binary()), ("_lang", pa.string()), ("_score", pa.float64()), ("_entropy", pa.float64()), ("_rejected", pa.bool_())])

    def run(source):
        model = rebuilt(Model, held.value)
        for batch in source:
            got = [model.verdict(n, np.array(h.as_py())) for n, h in zip(batch.column("n").to_pylist(), batch.column("h"), strict=True)]
            columns = list(zip(*got, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    found = model.tables.entropies(texts).where("has_letters").select("text_key", "n", "h")
    judged = settle(found.mapInArrow(run, "_text_key binary, _lang string, _score double, _entropy double, _rejected boolean"), "judged")
    own, *given = temporary = unused(docs, "_key", *judged.columns)
    made = docs.withColumn(own, _key_of(text_col)).join(measured(judged.toDF(*given)), F.col(own) == F.col(given[0]), "left")
    values = (F.coalesce(given[1], F.lit(UNDETERMINED)), F.coalesce(given[2], F.lit(0.0)), F.col(given[3]), F.coalesce(given[4], F.lit(True)))
    return made.withColumns(dict(zip(names, values, strict=True))).drop(*temporary)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, lang, text) of the rows to learn from: crc32 of the id as text, modulo 4, is not 2, and neither lang nor text is null.

    A row with a null id is not learned from.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return docs.where(fold != 2).select(F.col(id_col).cast("string").alias("key"), "lang", "text").where("lang is not null and text is not null")


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from the training rows of ``docs`` and predict all its rows: all columns, held_out and those of ``predict``."""
    model = train(training_rows(docs, id_col))
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return predict(docs, model).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
