"""Near-duplicate lines across documents by a deletion-neighbourhood join.

The unit of an edit is a word: two lines are near if one becomes the other by at
most one inserted, deleted or replaced word, and both have at least five words, so
that they are at least 0.8 alike; shorter lines must be equal. Each distinct line
emits the hash of itself and of all its variants with one word left out. Lines one
edit apart share a variant; those that share one are verified by the edit distance
of their words.

A line one edit from another also shares, whole, the first or the last half of its
words with it. Distinct lines that share no half with another distinct line emit
nothing: that loses no pair and leaves few lines to expand.
"""

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.common import measured, null_safe, settle, tidied, tidy, unused

MIN_WORDS = 5
#: A Python worker hands on so many rows at a time.
ROWS_OUT = 20_000

_LINES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32()), ("words", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("halves", pa.list_(pa.int64()))])
_LINES_DDL = "doc_id long, text_key long, line int, words int, h1 long, h2 long, halves array<long>"
_VARIANTS = pa.schema([("variant", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32()), ("words", pa.string())])
_VARIANTS_DDL = "variant long, place int, doc_id long, text_key long, line int, words string"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(joined: bytes) -> tuple[int, int]:
    """128 bits of a normalised line as two signed longs."""
    x = xxhash.xxh3_128_intdigest(joined)
    return _signed(x >> 64), _signed(x & (1 << 64) - 1)


def words_of(line: str) -> list[bytes]:
    """Runs of bytes other than the six ASCII blanks, A-Z in lower case."""
    return line.encode("utf-8", "surrogatepass").lower().split()


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of halves: two lines within one edit have one in common.

    For a pair whose shorter line has m words, that is the first m // 2 words or the
    last m - m // 2. A line takes part as the shorter one, m its length, and as the
    longer one, m one less.
    """
    found = []
    for m in (len(words), len(words) - 1):
        h = m // 2
        for side, part in ((b"<", words[:h]), (b">", words[len(words) - (m - h) :])):
            found.append(_signed(xxhash.xxh3_64_intdigest(b" ".join((side, str(m).encode(), *part)))))
    return found


def variants(words: list[bytes]) -> list[tuple[int, int]]:
    """(place, hash) of the line itself, place -1, and of what is left without the word at each place."""
    joined = b" ".join(words)
    digest, at, found = xxhash.xxh3_64_intdigest, 0, [(-1, _signed(xxhash.xxh3_64_intdigest(joined)))]
    for place, w in enumerate(words):
        end = at + len(w) + 1
        found.append((place, _signed(digest(joined[:at] + joined[end:] if end <= len(joined) else joined[: max(0, at - 1)]))))
        at = end
    return found


def within_one_edit(a: list, b: list) -> bool:
    """Whether at most one inserted, deleted or replaced word makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col).alias("text_key"), text.alias("text"))


def _emit_lines(min_words: int):
    def run(source):
        for batch in source:
            rows = []
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text"), strict=True):
                for i, line in enumerate((text.as_py() or "").split("\n")):
                    words = words_of(line)
                    if words:
                        rows.append((doc, key, i, len(words), *line_hash(b" ".join(words)), half_keys(words) if len(words) >= min_words else []))
                        if len(rows) >= ROWS_OUT:
                            yield _record(rows, _LINES)
                            rows = []
            if rows:
                yield _record(rows, _LINES)

    return run


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line with a word: its place, number of words, 128-bit hash, and half keys if it is long enough."""
    return _keyed(docs, id_col, text_col).mapInArrow(tidied(_emit_lines(min_words)), _LINES_DDL)


def _emit_variants(source):
    """For each wanted line: its words once (place null), the hash of itself (place -1) and of what is left without each of its words."""
    for batch in source:
        rows = []
        docs, keys, lists = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "lines"))
        for doc, key, lines, text in zip(docs, keys, lists, batch.column("text"), strict=True):
            split = text.as_py().split("\n")
            for i in lines:
                words = words_of(split[i])
                rows.append((None, None, doc, key, i, b" ".join(words).decode("utf-8", "replace")))
                rows += [(v, place, doc, key, i, None) for place, v in variants(words)]
                if len(rows) >= ROWS_OUT:
                    yield _record(rows, _VARIANTS)
                    rows = []
        if rows:
            yield _record(rows, _VARIANTS)


@F.arrow_udf(T.BooleanType())
def _one_edit(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([within_one_edit(x.as_py().split(" "), y.as_py().split(" ")) for x, y in zip(a, b, strict=True)], pa.bool_())


def near_lines(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first): the distinct long lines of ``classes`` that have an earlier distinct line within one edit.

    A distinct line stands at its first place. Lines that lack the same word at the
    same place of one variant are one edit from each other, and a line that is a
    variant is one edit from all that have it; so it is enough to compare each line
    with the earliest such line of a variant, and no pairs within a group are made.
    """
    long = classes.where(F.size("halves") > 0)
    halves = long.select("h1", F.explode(F.array_distinct("halves")).alias("half"))
    shared = settle(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "halves")
    some = settle(halves.join(measured(shared), "half", "left_semi").select("h1").distinct(), "halves")
    wanted = long.join(measured(some), "h1", "left_semi")  # by one of the line's two hashes: at worst a line too many
    wanted = settle(wanted.groupBy("first.doc_id", "first.text_key").agg(F.collect_list("first.line").alias("lines")), "wanted")
    keyed, few = _keyed(docs, id_col, text_col), measured(wanted)
    texts = keyed.join(few, null_safe(keyed, few, ["doc_id", "text_key"])).select(keyed["doc_id"], keyed["text_key"], "lines", "text")
    emitted = settle(texts.mapInArrow(tidied(_emit_variants), _VARIANTS_DDL), "variants")
    place = F.struct("doc_id", "text_key", "line")
    words = emitted.where("variant is null").select(place.alias("first"), "words").distinct()

    # Most variants belong to one line: the others are found by a narrow sum, and all that follows is about them.
    line = F.xxhash64("doc_id", "text_key", "line").alias("id")
    common = emitted.where("variant is not null").select("variant", line).groupBy("variant").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    common = settle(common.where("low <> high").select("variant"), "variants")
    members = emitted.join(measured(common), "variant", "left_semi").select("variant", "place", place.alias("first"))
    members = settle(members, "variants")
    same = settle(members.groupBy("variant", "place").agg(F.min("first").alias("earliest"), F.max("first").alias("latest")).where("earliest <> latest").drop("latest"), "variants")
    lacking = members.join(same, ["variant", "place"]).where("earliest < first").select("first", "earliest")
    left_out = F.col("place") >= 0
    both = members.groupBy("variant").agg(F.min(F.when(~left_out, F.col("first"))).alias("whole"), F.min(F.when(left_out, F.col("first"))).alias("earliest"))
    both = settle(both.where("whole is not null and earliest is not null"), "variants")
    shorter = both.where("earliest < whole").select(F.col("whole").alias("first"), "earliest")
    longer = members.where(left_out).join(both.select("variant", "whole"), "variant").where("whole < first").select("first", F.col("whole").alias("earliest"))
    pairs = settle(lacking.unionByName(shorter).unionByName(longer).distinct(), "pairs")
    checked = pairs.join(words, "first").join(words.select(F.col("first").alias("earliest"), F.col("words").alias("earlier_words")), "earliest")
    return checked.where(_one_edit("words", "earlier_words")).select("first").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, lines): numbers of the lines to go from each document that loses some, from 0.

    A line goes if an equal line stands earlier, or if it has an earlier line within
    one edit. Earlier is by doc_id (null first), then by the hash of the text, then by
    line number. Rows that repeat id and text are one document, and lose the same
    lines. Lines without a word stay. Equal means equal words, A-Z and a-z alike.
    """
    if min_words < 2:
        raise ValueError("lines of one word are all one edit apart")
    lines = settle(lines_of(docs, id_col, text_col, min_words), "lines")
    place = F.struct("doc_id", "text_key", "line")
    classes = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    classes = settle(classes, "lines")
    near = settle(near_lines(docs, classes, id_col, text_col).withColumn("near", F.lit(True)), "near")
    told = classes.join(measured(near), "first", "left").where("near or n > 1").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("h1", "h2", place.alias("place")).join(measured(settle(told, "lines")), ["h1", "h2"]).where("near or place <> first")
    return gone.groupBy("place.doc_id", "place.text_key").agg(F.collect_set("place.line").alias("lines"))


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, lines: pa.Array) -> pa.Array:
    def cut(t, gone):
        if not t.is_valid or not gone.is_valid:
            return t.as_py()
        gone = set(gone.as_py())
        return "\n".join(x for i, x in enumerate(t.as_py().split("\n")) if i not in gone)

    out = pa.array([cut(t, g) for t, g in zip(text, lines, strict=True)], pa.string())
    tidy()
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated and near-repeated lines cut from its texts, and lines_removed, a long.

    Every row and column stays; a text whose lines all go is empty, a null text stays
    null. See ``removed_lines`` for what goes. An empty table gives an empty table; a
    column named lines_removed is replaced.
    """
    gone = settle(removed_lines(docs, id_col, text_col, min_words), "removed")
    gone_id, gone_key, cut_lines = unused(docs, "_gone_id", "_gone_key", "_gone")
    few = measured(gone.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key), F.col("lines").alias(cut_lines)))
    on = docs[id_col].cast("long").eqNullSafe(few[gone_id]) & (F.xxhash64(docs[text_col].cast("string")) == few[gone_key])
    joined = docs.join(few, on, "left").drop(gone_id, gone_key)
    # Not deterministic for Catalyst: it would cut a text once more for each filter on what is left.
    cut = F.coalesce(_without.asNondeterministic()(F.when(F.col(cut_lines).isNotNull(), F.col(text_col).cast("string")), F.col(cut_lines)), F.col(text_col).cast("string"))
    return joined.withColumn(text_col, cut).withColumn("lines_removed", F.greatest(F.lit(0), F.coalesce(F.size(cut_lines), F.lit(0))).cast("long")).drop(cut_lines)
