"""Code without its comments and strings, with the number of every line kept.

A numbered text (see ``functions.text``) is cut into tokens by one regex: comments,
strings with their quotes, and the code between them. One pass over the tokens, with
the depth of brackets as its state, tells docstrings from operands and puts strings
together that hold strings themselves: f-strings and template literals with quotes
in their braces. From the tokens two texts are written.

``code``: no comments. A string keeps its content, on the line where it begins. A
triple-quoted one has plain quotes, of prefixes only ``f`` stays, and ``{{`` of an
f-string goes, so that a pattern for one-line strings fits it. A string that is a
statement by itself has no content.

``bare``: strings are ``""``, followed by the code in the braces of f-strings and
template literals.

Both hold the mark of every line, also of those inside a comment or string; what
follows on the last line of a string has that line's number. ``.format(`` or ``%``
behind a string of several lines also stands, as ``.format()`` or ``%()``, on the
line where it begins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.arrays import fold, let
from scanloom.functions.text import MARK, MARK_OPEN

_DQ = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_TDQ = r'"""(?:[^"\\]++|\\.|"(?!""))*+"""'
_TSQ = r"'''(?:[^'\\]++|\\.|'(?!''))*+'''"
_BT = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"

#: What strings and comments begin with; a text without them is one token.
SIGNS = {"py": "\"'#", "js": "\"'`/"}
# Behind any token the next one begins, so together they are the text.
_TOKENS = {
    "py": rf"(?s){_TDQ}|{_TSQ}|{_DQ}|{_SQ}|#[^\n]*+|[^{SIGNS['py']}]++|[\"']",
    "js": rf"(?s){_DQ}|{_SQ}|{_BT}|//[^\n]*+|/\*.*?\*/|[^{SIGNS['js']}]++|[\"'`/]",
}
_PREFIX = r"(?i)(?<!\w)([rbuf]{1,2})$"
#: Code in front of a string that begins a line; a line that a backslash continues does not begin.
_BEGINS = rf"(?is)(?:^|(?<!\\)\n){MARK}[ \t]*+(?:[rbuf]{{1,2}})?$"

_BRACES = r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
_HOLE = rf"\{{((?:[^{{}}]++|{_BRACES})*+)\}}"
_WHOLE_TEMPLATE = r"(?s)^`(?:[^`\\$]++|\\.|\$(?!\{)|\$\{(?:[^{}`]++|\{(?:[^{}`]++|\{[^{}`]*+\})*+\})*+\})*+"
_NEXT_LINE = rf"\n{MARK}"
_MARKS = rf"(?s)({_NEXT_LINE})|[^\n]++|\n"
_GLUE = r"^[ \t]*(\.format|%)[ \t]*\("

_ITEM = "struct<kind:string,text:string,prefix:string>"


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _facts(tokens: Column, lang: str) -> Column:
    """What the pass needs to know of each token, found without its state; an empty one ends the text."""

    def of(t: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        quoted = t.rlike("^[\"'`]") & (F.length(t) > 1)
        comment = t.startswith("#") if lang == "py" else t.startswith("//") | t.startswith("/*")
        kind = F.when(quoted, "s").when(comment, "x").otherwise("c")
        if lang == "py":
            prefix = F.when(quoted, F.lower(F.regexp_extract(before, _PREFIX, 1))).otherwise("")
            alone = quoted & (F.coalesce(before, F.lit("")).rlike(_BEGINS) | (i == 0))
            plain = F.regexp_replace(t, rf"\{{\{{|\}}\}}|{_HOLE}", "")
            triple = t.startswith('"""') | t.startswith("'''")
            holes = F.when(quoted & ~triple & before.rlike(r"(?i)(?<!\w)(?:f|rf|fr)$") & t.contains("{"), _count(plain, "{") - _count(plain, "}"))
        else:
            prefix, alone = F.lit(""), F.lit(False)
            rest = F.regexp_replace(t, _WHOLE_TEMPLATE, "")
            holes = F.when(t.startswith("`") & t.contains("${"), let(rest, lambda r: _count(r, "{") - _count(r, "}")))
        depth = F.when(kind == "c", _count(t, "([{") - _count(t, ")]}")).otherwise(0)
        return F.struct(
            kind.alias("kind"), t.alias("text"), F.coalesce(prefix, F.lit("")).alias("prefix"), F.coalesce(alone, F.lit(False)).alias("alone"),
            F.greatest(F.coalesce(holes, F.lit(0)), F.lit(0)).alias("holes"), depth.alias("depth"),
        )

    return F.transform(F.concat(tokens, F.array(F.lit(""))), of)


def _items(facts: Column) -> Column:
    """Tokens with their kinds: ``c`` code, ``x`` comment, ``s`` string, ``d`` string that is a statement."""

    def step(s: Column, f: Column) -> Column:
        def result(depth: Column, holes: Column, held: Column, prefix: Column, out: Column) -> Column:
            state = F.struct(depth.cast("int").alias("depth"), holes.cast("int").alias("holes"), held.alias("held"), prefix.alias("prefix"))
            return F.struct(state.alias("state"), out.cast(_ITEM).alias("out"))

        def item(kind: Column, text: Column, prefix: Column) -> Column:
            return F.struct(kind.alias("kind"), text.alias("text"), prefix.alias("prefix"))

        none, zero, empty = F.lit(None), F.lit(0), F.lit("")
        left = s["holes"] + _count(f["text"], "{") - _count(f["text"], "}")
        held = F.concat(s["held"], f["text"])
        ends = ((f["kind"] == "s") & (left <= 0)) | (f["text"] == "")
        kind = F.when(f["alone"] & (s["depth"] == 0), F.lit("d")).otherwise(f["kind"])
        return (
            F.when((s["holes"] > 0) & ends, result(s["depth"], zero, empty, empty, item(F.lit("s"), held, s["prefix"])))
            .when(s["holes"] > 0, result(s["depth"], F.greatest(left, F.lit(1)), held, s["prefix"], none))
            .when(f["holes"] > 0, result(s["depth"], f["holes"], f["text"], f["prefix"], none))
            .otherwise(result(F.greatest(s["depth"] + f["depth"], zero), zero, empty, empty, item(kind, f["text"], f["prefix"])))
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("holes"), F.lit("").alias("held"), F.lit("").alias("prefix"))
    plain = F.transform(facts, lambda f: F.struct(f["kind"], f["text"], f["prefix"]))
    return F.when(F.exists(facts, lambda f: f["alone"] | (f["holes"] > 0)), fold(facts, start, step, _ITEM)).otherwise(plain.cast(f"array<{_ITEM}>"))


def _marks(text: Column) -> Column:
    return F.when(text.contains(MARK_OPEN), F.regexp_replace(text, _MARKS, "$1")).otherwise("")


def _string(it: Column, after: Column, lang: str) -> Column:
    """A string in ``code``."""
    text = it["text"]
    several = text.contains(MARK_OPEN)
    flat = lambda t: F.regexp_replace(F.regexp_replace(t, _NEXT_LINE, " "), "[\"'`\\n]", " ")
    inner = lambda n: F.substring(text, F.lit(n + 1), F.length(text) - 2 * n)
    glued = F.when(several & after.rlike(_GLUE), F.concat(F.regexp_extract(after, _GLUE, 1), F.lit("()"))).otherwise("")
    if lang == "py":
        triple = text.startswith('"""') | text.startswith("'''")
        holes = it["prefix"].contains("f")
        shown = F.when(triple, F.concat(F.lit('"'), flat(inner(3)), F.lit('"'))).when(several, F.concat(F.lit('"'), flat(inner(1)), F.lit('"'))).otherwise(text)
        single = F.when(holes & text.contains("{{"), F.regexp_replace(shown, rf"\{{\{{|\}}\}}|({_HOLE})", "$1")).otherwise(shown)
        return F.concat(F.when(holes, "f").otherwise(""), single, glued, _marks(text))
    nested = text.startswith("`") & inner(1).contains("`")
    return F.when(several | nested, F.concat(F.left(text, F.lit(1)), flat(inner(1)), F.left(text, F.lit(1)), _marks(text))).otherwise(text)


def _emptied(it: Column, lang: str) -> Column:
    """A string in ``bare``: its marks, and the code in its braces."""
    text = it["text"]
    if lang == "py":
        has = it["prefix"].contains("f") & text.contains("{")
        rx = rf"(?s)({_NEXT_LINE})|\{{\{{|{_HOLE}|[^{{\n]++|."
    else:
        has = text.startswith("`") & text.contains("${")
        rx = rf"(?s)({_NEXT_LINE})|\${_HOLE}|[^$\n]++|."
    code = F.regexp_replace(F.regexp_replace(text, rx, "$1 $2"), r"`[^`]*+`|\"[^\"\n]*+\"|'[^'\n]*+'", '""')
    return F.concat(F.lit('""'), F.when(has, code).otherwise(_marks(text)))


def _written(items: Column, lang: str) -> Column:
    def of(it: Column, i: Column) -> Column:
        after = F.get(items, i + 1)
        prefix = F.when((it["kind"] == "c") & after["kind"].isin("s", "d"), F.length(after["prefix"])).otherwise(0)
        code = F.when(prefix > 0, F.left(it["text"], F.length(it["text"]) - prefix)).otherwise(it["text"])
        alone = F.concat(F.lit('""'), _marks(it["text"]))
        text = F.when(it["kind"] == "c", code).when(it["kind"] == "x", _marks(it["text"])).when(it["kind"] == "d", alone)
        following = F.when(after["kind"] == "c", after["text"]).otherwise("")
        return F.struct(
            text.otherwise(_string(it, F.coalesce(following, F.lit("")), lang)).alias("code"),
            F.when(it["kind"] == "s", _emptied(it, lang)).otherwise(text.otherwise("")).alias("bare"),
        )

    return let(
        F.transform(items, of),
        lambda w: F.struct(F.array_join(F.transform(w, lambda x: x["code"]), "").alias("code"), F.array_join(F.transform(w, lambda x: x["bare"]), "").alias("bare")),
    )


def lex(numbered: Column, lang: str) -> Column:
    """``struct<code, bare>`` of a numbered text in Python (``py``) or a script (``js``)."""
    tokens = F.regexp_extract_all(numbered, F.lit(_TOKENS[lang]), F.lit(0))
    return let(tokens, lambda t: let(_facts(t, lang), lambda f: let(_items(f), lambda i: _written(i, lang))))
