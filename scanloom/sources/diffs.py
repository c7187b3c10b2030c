"""Unified diffs to hunks, and hunks to numbered lines.

A *diffs* table has ``diff_id, text``; a *hunks* table has one row per hunk (and
one for a file without hunks), with ``lines`` starting at its ``@@`` line. A
diff is cut into files and files into hunks by splitting at their headers, and a
hunk ends where the counts of its header are used up. All of it happens in the row
of the diff; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.arrays import let, with_fields
from scanloom.operators.filters import is_added
from scanloom.plans.ordered import BLOCK_ROWS, running

# The kinds of change.
ADDED, MODIFIED, DELETED, RENAMED, COPIED = DIFF_TYPES = ["added", "modified", "deleted", "renamed", "copied"]

_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
HUNK_COLUMNS = [
    "file_no", "hunk_no", "file_path", "old_start", "old_count", "new_start", "new_count", "lines",
    "diff_type", "additions", "deletions", "old_file", "new_file", "is_binary",
]


def _body_size(hunk_lines: Column) -> Column:
    """How many lines a hunk has by the counts of its header, that line included.

    One pass with three numbers: old and new lines still to come, and lines taken. A
    note on a missing line end belongs to the line before it. What can't be a line of
    a hunk ends it as well.
    """

    def step(s: Column, line: Column) -> Column:
        old, new = line.startswith("-"), line.startswith("+")
        both = line.startswith(" ") | (line == "") | (line == "\r")
        open_ = (s["old"] > 0) | (s["new"] > 0)
        note = line.startswith("\\")
        taken = ~s["done"] & ((open_ & (old | new | both)) | note)
        return F.struct(
            (s["old"] - F.when(taken & (old | both), 1).otherwise(0)).alias("old"),
            (s["new"] - F.when(taken & (new | both), 1).otherwise(0)).alias("new"),
            (s["n"] + F.when(taken, 1).otherwise(0)).alias("n"),
            (s["done"] | ~taken).alias("done"),
        )

    def count(body: Column) -> Column:
        start = F.struct(
            _count(body[0], 2).alias("old"), _count(body[0], 4).alias("new"), F.lit(1).alias("n"), F.lit(False).alias("done")
        )
        return F.aggregate(F.slice(body, F.lit(2), F.size(body)), start, step, lambda s: s["n"])

    return let(hunk_lines, count)


def _own_lines(hunk: Column) -> Column:
    """Lines of a hunk without what follows it."""
    return let(F.split(hunk, "\n", -1), lambda body: F.slice(body, F.lit(1), _body_size(body)))


def _without_end(piece: Column) -> Column:
    """A piece of a diff without its last line end."""
    return F.when(piece.endswith("\n"), F.substring(piece, F.lit(1), F.length(piece) - 1)).otherwise(piece)


def _lines_of(piece: Column) -> Column:
    return F.split(_without_end(piece), "\n", -1)


# Stands between the files of a diff without git headers while they are cut; a private-use character.
_FILE_CUT = "\ue002"
_PLAIN_HEADER = r"(?md)^--- [^\n]*\n\+\+\+ "


def _cut_plain(diff: Column) -> Column:
    """A diff without git headers cut into files.

    A deleted line ``-- x`` above an added line ``++ y`` looks like the header of a
    file. So each hunk is ended by its counts first, and only what follows it can hold
    a header.
    """

    def marked(piece: Column) -> Column:
        def split(body: Column) -> Column:
            n = _body_size(body)
            own = F.concat(F.array_join(F.slice(body, F.lit(1), n), "\n"), F.lit("\n"))
            rest = F.array_join(F.slice(body, n + 1, F.size(body)), "\n")
            header = F.regexp_extract(rest, r"(?sd)(--- [^\n]*\n\+\+\+ .*)", 1)
            return F.when(rest.rlike(_PLAIN_HEADER), F.concat(own, F.lit(_FILE_CUT), header, F.lit("\n"))).otherwise(own)

        return F.when(piece.startswith("@@ -"), let(_lines_of(piece), split)).otherwise(piece)

    clean = F.replace(diff, F.lit(_FILE_CUT), F.lit("\ufffd"))
    pieces = F.split(clean, r"(?md)^(?=@@ -\d)", -1)
    first = F.regexp_replace(pieces[0], r"(?sd)\A.*?^?(?=--- [^\n]*\n\+\+\+ )", "")
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), marked)
    return F.split(F.concat(first, F.array_join(rest, "")), _FILE_CUT, -1)


def _file_chunks(diff: Column) -> Column:
    """One text per file, from its header on and without its last line end. Diffs without git headers are cut at ``---``/``+++``."""
    git = F.split(_without_end(diff), r"\n(?=diff --git )", -1)
    plain = F.transform(_cut_plain(diff), _without_end)
    chunks = F.when(diff.startswith("diff --git ") | diff.contains("\ndiff --git "), git).otherwise(plain)
    return F.filter(chunks, lambda c: c.startswith("diff --git ") | c.startswith("--- "))


def _found(head: Column, regex: str) -> Column:
    """What the first match of a regex holds; regexes begin with a line end, which is far cheaper to find than ``^``."""
    return F.get(F.regexp_extract_all(head, F.lit(regex), F.lit(1)), F.lit(0))


def _has_line(head: Column, begin: str) -> Column:
    """A line of a header begins with a text."""
    return head.contains("\n" + begin)


def _count(line: Column, group: int) -> Column:
    """A count of a hunk header; one when it is left out."""
    got = F.regexp_extract(line, _HUNK, group)
    return F.when(line == "", 0).otherwise(F.when(got == "", 1).otherwise(got.cast("int")))


def _file_fields(chunk: Column) -> Column:
    """struct<old_file, new_file, diff_type, is_binary, _hunks> of one file of a diff.

    A file without hunks has one empty hunk, so that it keeps a row. A header is cut off with a
    line end in front, so that all its lines begin behind one.
    """

    def named(cut: Column) -> Column:
        head = cut[0]
        old = F.coalesce(
            _found(head, r"(?d)\n--- (?:a/)?([^\t\r\n]+)"),
            _found(head, r"(?d)\n(?:rename|copy) from ([^\r\n]+)"),
            _found(head, r"(?d)\ndiff --git a/(.+?) b/"),
        )
        new = F.coalesce(
            _found(head, r"(?d)\n\+\+\+ (?:b/)?([^\t\r\n]+)"),
            _found(head, r"(?d)\n(?:rename|copy) to ([^\r\n]+)"),
            _found(head, r"(?d)\ndiff --git a/.+? b/([^\r\n]+)"),
        )
        return F.struct(cut.alias("cut"), old.alias("old"), new.alias("new"))

    def fields(x: Column) -> Column:
        cut, head = x["cut"], x["cut"][0]
        is_new = _has_line(head, "new file mode") | (x["old"] == "/dev/null")
        is_gone = _has_line(head, "deleted file mode") | (x["new"] == "/dev/null")
        kind = (
            F.when(is_new, ADDED)
            .when(is_gone, DELETED)
            .when(_has_line(head, "rename from "), RENAMED)
            .when(_has_line(head, "copy from "), COPIED)
            .otherwise(MODIFIED)
        )
        binary = _has_line(head, "GIT binary patch") | (head.contains("Binary files ") & head.rlike(r"(?d)\nBinary files .* differ"))
        return F.struct(
            F.when(~is_new, x["old"]).alias("old_file"),
            F.when(~is_gone, x["new"]).alias("new_file"),
            kind.alias("diff_type"),
            binary.alias("is_binary"),
            F.when(F.size(cut) > 1, F.slice(cut, F.lit(2), F.size(cut))).otherwise(F.array(F.lit(""))).alias("_hunks"),
        )

    cut = F.split(F.concat(F.lit("\n"), chunk), r"\n(?=@@ -\d)", -1)
    return let(let(cut, named), fields)


#: The four numbers of a hunk header, empty where left out; the rest of the hunk goes.
_RANGE = r"(?s)^(?:@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@)?.*"


#: A line, with its first sign as the group.
_LINE = r"([^\n])[^\n]*+\n?"


def _beginning(hunk: Column, sign: str) -> Column:
    """How many lines behind the first begin with a sign of several characters."""
    gone = F.octet_length(hunk) - F.octet_length(F.replace(hunk, F.lit("\n" + sign), F.lit("\n")))
    return F.when(hunk.contains("\n" + sign), F.floor(gone / len(sign)).cast("int")).otherwise(0)


def _hunk_fields(hunk: Column, more: dict[str, Column] | None = None) -> Column:
    """struct of the line range, the lines and their counts, behind ``more``.

    Where the first signs of all lines fit the counts of the header, which is nearly
    everywhere, the hunk ends where its text does and they are counted as one text. Only
    others are folded.
    """

    def fields(x: Column) -> Column:
        start = lambda i: F.when(x["range"][i] != "", x["range"][i].cast("int"))
        count = lambda i: F.when(x["range"][i] == "", 1).otherwise(x["range"][i].cast("int"))
        named = lambda old, n_old, new, n_new, lines, added, deleted: F.struct(
            *[c.alias(n) for n, c in (more or {}).items()],
            old.cast("int").alias("old_start"),
            n_old.cast("int").alias("old_count"),
            new.cast("int").alias("new_start"),
            n_new.cast("int").alias("new_count"),
            lines.alias("lines"),
            added.cast("int").alias("additions"),
            deleted.cast("int").alias("deletions"),
        )
        signs = lambda sign: F.octet_length(x["signs"]) - F.octet_length(F.replace(x["signs"], F.lit(sign), F.lit("")))
        old, new = signs("-"), signs("+")
        kept = F.octet_length(x["signs"]) - old - new
        fits = x["signs"].rlike(r"^@[-+ ]*\z") & ~hunk.endswith("\n") & (count(1) == kept + old - 1) & (count(3) == kept + new - 1)
        zero = F.lit(0)
        return (
            F.when(hunk == "", named(zero, zero, zero, zero, F.array().cast("array<string>"), zero, zero))
            .when(fits, named(
                start(0), count(1), start(2), count(3), F.split(hunk, "\n", -1), new - _beginning(hunk, "+++"), old - _beginning(hunk, "---"),
            ))
            .otherwise(let(_own_lines(hunk), lambda body: named(
                start(0), count(1), start(2), count(3), body, F.size(F.filter(body, is_added)),
                F.size(F.filter(body, lambda line: line.startswith("-") & ~line.startswith("---"))),
            )))
        )

    facts = F.struct(
        F.split(F.regexp_replace(hunk, _RANGE, "$1 $2 $3 $4"), " ", -1).alias("range"),
        F.regexp_replace(hunk, _LINE, "$1").alias("signs"),
    )
    return let(facts, fields)


def parse(diffs: DataFrame, text: str = "text") -> DataFrame:
    """Hunks of each diff: the other columns of ``diffs`` and ``HUNK_COLUMNS``."""
    keep = [c for c in diffs.columns if c != text]
    chunks = diffs.select(*keep, F.posexplode(_file_chunks(F.col(text))).alias("_f", "_chunk"))
    files = with_fields(chunks, _file_fields(F.col("_chunk"))).drop("_chunk")
    hunks = files.select("*", F.posexplode("_hunks").alias("_h", "_hunk")).drop("_hunks")
    hunks = with_fields(hunks, _hunk_fields(F.col("_hunk")))
    return hunks.select(
        *keep,
        (F.col("_f") + 1).alias("file_no"),
        (F.col("_h") + 1).alias("hunk_no"),
        F.coalesce("new_file", "old_file").alias("file_path"),
        "old_start",
        "old_count",
        "new_start",
        "new_count",
        "lines",
        "diff_type",
        "additions",
        "deletions",
        "old_file",
        "new_file",
        "is_binary",
    )


def hunks_in_row(diffs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``diffs`` and ``files``, an array with a struct per hunk in order.

    What belongs to a diff is in its row before it is parsed and stays there, so a
    report of whole diffs moves nothing.
    """

    def of_file(f: Column, i: Column) -> Column:
        def of_hunk(hunk: Column, j: Column) -> Column:
            return _hunk_fields(
                hunk,
                {"file_no": i + 1, "hunk_no": j + 1, "file_path": F.coalesce(f["new_file"], f["old_file"])}
                | {c: f[c] for c in ("old_file", "new_file", "diff_type", "is_binary")},
            )

        return F.transform(f["_hunks"], of_hunk)

    files = F.flatten(F.transform(F.transform(_file_chunks(F.col(text)), _file_fields), of_file))
    return with_fields(diffs, F.struct(files.alias("files"))).drop(text)


def added_in(hunk: Column) -> Column:
    """array<struct<line_no, line>>: added lines of one hunk with their signs; a binary file has none."""
    added = F.filter(new_lines(hunk["lines"], hunk["new_start"]), lambda x: is_added(x["line"]))
    return F.when(hunk["is_binary"], F.slice(added, F.lit(1), F.lit(0))).otherwise(added)


def diff_totals(hunks: DataFrame) -> DataFrame:
    """Additions, deletions and files per diff."""
    return hunks.groupBy("diff_id").agg(
        F.sum("additions").alias("total_additions"),
        F.sum("deletions").alias("total_deletions"),
        F.countDistinct("file_path").alias("total_files"),
    )


def changed_lines(diff: Column) -> Column:
    """Lines of a diff that start with ``+``; the ``+++`` headers count too."""
    return F.regexp_count(diff, F.lit(r"(?md)^\+"))


def touches_tests(diff: Column) -> Column:
    """A file of the diff names a test, in any case."""
    return diff.rlike(r"(?mi)^diff --git .*test")


def new_lines(lines: Column, new_start: Column) -> Column:
    """Lines of the new file in a hunk with their numbers: deleted lines and marks have none.

    A context line that lost its blank is taken as an empty line.
    """
    kept = F.filter(lines, lambda x: x.startswith("+") | x.startswith(" ") | (x == ""))
    return F.transform(kept, lambda x, i: F.struct((new_start + i).alias("line_no"), x.alias("line")))


def added_lines(hunks: DataFrame) -> DataFrame:
    """Added lines with their number in the new file; binary files have none.

    ``rule_no`` counts them through the diff. Additions are summed per hunk
    first, so the window sees one row per hunk and not one per line.
    """
    before = Window.partitionBy("diff_id").orderBy("file_no", "hunk_no").rowsBetween(Window.unboundedPreceding, -1)
    keep = [c for c in hunks.columns if c not in HUNK_COLUMNS]
    text = hunks.filter(~F.col("is_binary")).withColumn("_before", F.coalesce(F.sum("additions").over(before), F.lit(0)))
    added = F.filter(new_lines(F.col("lines"), F.col("new_start")), lambda x: is_added(x["line"]))
    return text.select(
        *keep, "file_no", "hunk_no", "file_path", "_before", F.posexplode(added).alias("_i", "_l")
    ).select(
        *keep,
        "file_no",
        "hunk_no",
        "file_path",
        F.col("_l.line_no").alias("line_no"),
        F.substring(F.col("_l.line"), F.lit(2), F.length("_l.line")).alias("line"),
        (F.col("_before") + F.col("_i") + 1).cast("long").alias("rule_no"),
    )


def added_text(hunks: DataFrame) -> DataFrame:
    """Added lines without the running number: no window, so it also runs on a stream."""
    keep = [c for c in hunks.columns if c not in HUNK_COLUMNS]
    added = F.filter(new_lines(F.col("lines"), F.col("new_start")), lambda x: is_added(x["line"]))
    return (
        hunks.filter(~F.col("is_binary"))
        .select(*keep, "file_no", "hunk_no", "file_path", F.explode(added).alias("_l"))
        .select(
            *keep,
            "file_no",
            "hunk_no",
            "file_path",
            F.col("_l.line_no").alias("line_no"),
            F.substring(F.col("_l.line"), F.lit(2), F.length("_l.line")).alias("line"),
        )
    )


def parse_lines(diff_lines: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Current file and hunk of each line, for diffs that come one line per row.

    ``diff_lines`` has ``diff_id, line_no, line``. Adds ``file_path, new_start,
    new_line_no``. The last headers are carried forward in blocks, so a diff of
    any length runs in many tasks.
    """
    line, line_no = F.col("line"), F.col("line_no")
    is_file, is_hunk = line.startswith("diff --git "), line.rlike(_HUNK)
    is_new = line.startswith("+") | line.startswith(" ") | (line == "")
    rows = running(
        diff_lines,
        "diff_id",
        "line_no",
        {"_seen": F.when(is_new, 1).otherwise(0)},
        {
            "_file": F.when(is_file, F.regexp_extract(line, r"^diff --git a/.+? b/(.+)$", 1)),
            "_hunk": F.when(is_hunk, F.regexp_extract(line, _HUNK, 3).cast("int")),
        },
        block_rows,
    )
    in_hunk = F.col("_hunk.at") > F.col("_file.at")
    seen_in_hunk = F.col("_seen") - F.col("_hunk._seen")
    return rows.select(
        *diff_lines.columns,
        F.col("_file.value").alias("file_path"),
        F.when(in_hunk, F.col("_hunk.value")).alias("new_start"),
        F.when(in_hunk & is_new, F.col("_hunk.value") + seen_in_hunk - 1).alias("new_line_no"),
    )


TRUNCATION = ["head", "tail", "middle"]
MAX_DIFF_SIZE = 50_000


def truncated(diff: Column, *, max_size: int = MAX_DIFF_SIZE, strategy: str = "head") -> Column:
    """struct<text, is_truncated, truncation_reason> of a diff shown in a report."""
    if strategy not in TRUNCATION:
        raise ValueError(f"strategy is one of {TRUNCATION}, not {strategy!r}")
    half = max_size // 2
    cut = {
        "head": F.substring(diff, F.lit(1), F.lit(max_size)),
        "tail": F.right(diff, F.lit(max_size)),
        "middle": F.concat(F.substring(diff, F.lit(1), F.lit(half)), F.right(diff, F.lit(max_size - half))),
    }[strategy]
    long = F.length(diff) > max_size
    reason = F.format_string(f"%d characters, {strategy} {max_size} kept", F.length(diff))
    return F.struct(
        F.when(long, cut).otherwise(diff).alias("text"),
        long.alias("is_truncated"),
        F.when(long, reason).alias("truncation_reason"),
    )
