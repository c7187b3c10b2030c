"""Quality rules with the frequency of lines across the documents of a host.

First the rules on a text alone: it fails with fewer than 20 words, or if over 30 of
100 words lie in eight-word windows that occur twice or more. Then the lines: each
normalised line is hashed, the distinct documents of a host that hold it are
counted, lines above the limit are removed, and a document of which too little is
left is rejected.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.common import measured, settle, unused

#: A line goes if more documents than this of one host hold it.
MAX_DOCS = 10
#: A document is rejected if fewer words than this, or a smaller share of its words, are left.
MIN_WORDS, MIN_SHARE = 20, 0.3
MAX_REPEATED_PERCENT, WINDOW = 30, 8
SYMBOLS = b"#*$%&|<>"

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words that lie in windows found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.unique(np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64), return_inverse=True)[1].astype(np.uint64)
    # Words have small exact codes; windows are told apart by 64-bit polynomials over an odd base.
    hashed = np.zeros(n, np.uint64)
    for k in range(window):
        hashed = (hashed ^ (codes[k : k + n] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def normalised(line: bytes) -> bytes:
    """A line as it is compared: its words in lower case (A-Z), one blank between them."""
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(normalised(line))
    return x - (1 << 64) if x >> 63 else x


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null: all zero.

    Words are runs other than the six ASCII blanks; word_chars counts code points.
    Lines are compared as they are.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    letters = sum(map(len, words)) - (len(raw) - len(text or ""))  # a blank has one byte, so what is over belongs to words
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), letters, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def _distinct_lines(source):
    """(host, line) for each distinct line with a word of each document."""
    schema = pa.schema([("host", pa.string()), ("line", pa.int64())])
    for batch in source:
        hosts, lines, size = [], [], 0
        for host, text in zip(batch.column("host").to_pylist(), batch.column("text"), strict=True):
            own = {line_hash(x) for x in (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()}
            hosts += [host] * len(own)
            lines += own
            if len(lines) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(lines, pa.int64())], schema=schema)
                hosts, lines = [], []
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(lines, pa.int64())], schema=schema)


def frequent_lines(docs: DataFrame, host: Column, text_col: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line): hashes of the lines that more than ``max_docs`` documents of a host hold; a null host is one of its own."""
    found = docs.select(host.cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).mapInArrow(_distinct_lines, "host string, line long")
    return found.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "line")


_PROFILE = T.StructType([T.StructField(c, T.LongType()) for c in _BASE] + [T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_PROFILE)
def _profile(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
        rows.append((*measures(text), [line_hash(x) for x in lines], [len(x.split()) for x in lines]))
    return pd.DataFrame(rows, columns=[*_BASE, "lines", "sizes"])


def line_rules(docs: DataFrame, host: Column | None = None, text_col: str = "text", max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs``, all columns but the text, with the measures, base_failed, words_left and kept, for each row.

    ``host`` defaults to the column source. words_left: words on lines that are not
    frequent on the host. kept: not base_failed, at least ``min_words`` words left and
    at least ``min_share`` of all. A null text has no words and fails. Repeated rows
    count as documents of their own. A line that a document repeats counts once for
    its frequency and is removed wherever it stands. Columns of the same names are
    replaced. An empty table gives an empty table.
    """
    host = F.col("source") if host is None else host
    frequent = settle(frequent_lines(docs, host, text_col, max_docs), "frequent")
    of, at, profile, held, gone = temporary = unused(docs, "_host", "_row", "_p", "_lines", "_removed")
    profiled = docs.withColumn(of, host.cast("string")).withColumn(profile, _profile(F.col(text_col).cast("string"))).drop(text_col)
    profiled = profiled.withColumns({c: F.col(profile)[c] for c in _BASE}).withColumn(held, F.arrays_zip(F.col(profile)["lines"], F.col(profile)["sizes"])).drop(profile)
    profiled = settle(profiled.withColumn(at, F.monotonically_increasing_id()), "profiles")

    lines = profiled.select(at, F.col(of).alias("of"), F.explode(held).alias("x")).select(at, "of", F.col("x.lines").alias("line"), F.col("x.sizes").alias("words"))
    common = measured(frequent)
    found = lines.join(common, lines["of"].eqNullSafe(common["host"]) & (lines["line"] == common["line"]))
    removed = settle(found.groupBy(at).agg(F.sum("words").alias(gone)), "removed")
    judged = profiled.drop(held).join(removed, at, "left").withColumn("words_left", F.col("n_words") - F.coalesce(gone, F.lit(0)))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    kept = ~base_failed & (F.col("words_left") >= min_words) & (F.col("words_left") >= min_share * F.col("n_words"))
    return judged.withColumn("base_failed", base_failed).withColumn("kept", kept).drop(*temporary)


@F.pandas_udf(T.StringType())
def _clean(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(text, lines):
        if text is None or lines is None or not len(lines):
            return text
        lines = set(lines)
        return "\n".join(x for x in text.split("\n") if not x.strip() or line_hash(x.encode("utf-8", "surrogatepass")) not in lines)

    return pd.Series([cut(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)


def without_frequent_lines(docs: DataFrame, host: Column | None = None, text_col: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs``, all rows and columns, with the frequent lines of each host cut from the texts; null texts stay null."""
    host = F.col("source") if host is None else host
    of, key, held, of2, key2 = unused(docs, "_host", "_key", "_gone", "_of", "_of_key")
    keyed = docs.withColumn(of, host.cast("string")).withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    frequent = settle(frequent_lines(docs, host, text_col, max_docs), "frequent")
    lines = keyed.select(F.col(of).alias(of2), F.col(key).alias(key2), F.explode(_profile(F.col(text_col).cast("string"))["lines"]).alias("line"))
    common = measured(frequent)
    found = lines.join(common, lines[of2].eqNullSafe(common["host"]) & (lines["line"] == common["line"]))
    gone = settle(found.groupBy(of2, key2).agg(F.collect_set(lines["line"]).alias(held)), "removed")
    joined = keyed.join(gone, keyed[of].eqNullSafe(gone[of2]) & (keyed[key] == gone[key2]), "left")
    return joined.withColumn(text_col, _clean(F.col(text_col).cast("string"), F.col(held))).select(*docs.columns)
