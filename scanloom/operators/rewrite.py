"""Rewrites: secrets to environment reads, inserted decorators, upper-cased names.

Every rewrite gives a new column; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import paths, text
from scanloom.functions.arrays import fold, let, with_fields
from scanloom.functions.patterns import CHANGE_ME, GENERIC_JS, GENERIC_PY, SECRET_PATTERNS, patterns_for
from scanloom.operators.filters import is_safe_value, lang_of
from scanloom.operators.learning import DEFAULT_AUTH
from scanloom.operators.secrets import may_hold_any
from scanloom.sources.files import is_env_line, lines

JS_HEADER = "// IMPORTANTE: Variáveis de ambiente geradas automaticamente"
ENV_HEADER = "# Variáveis de ambiente auto-geradas"
REDACTED = "[REDACTED]"
_STATE = "struct<text:string,n:int,vars:array<string>>"


def _quoted(regex: str) -> str:
    """A token, with the quotes around it if it has the same on both sides."""
    return f"\"(?:{regex})\"|'(?:{regex})'|(?:{regex})"


def _redacted(content: Column, lang: str) -> Column:
    """Text, fix count and names after all patterns of a language ran in order.

    The fold goes over the patterns; each takes its matches from the text as the
    earlier ones left it. The text is cut at all of them and put together once, so
    its length counts once for each pattern, however many matches there are.

    Where the original misbehaves this does the sane thing: a match is replaced
    where it stands, quotes around a token are replaced with it (a call inside
    quotes is not code), and a script's variable is named by its identifier, not by
    the secret.
    """
    named = GENERIC_PY if lang == "py" else GENERIC_JS
    patterns = F.array(
        *[F.struct(F.lit(p.regex if p is named else _quoted(p.regex)).alias("rx"), F.lit(p is named).alias("generic")) for p in patterns_for(lang)]
    )

    def fixed(full: Column, i: Column, acc: Column, p: Column) -> Column:
        name = F.regexp_extract(full, named.regex, 1)
        value = F.when(p["generic"], F.regexp_extract(full, named.regex, 2)).otherwise("")
        var = F.when(p["generic"], F.upper(name)).otherwise(F.concat(F.lit("API_KEY_"), (acc["n"] + i + 1).cast("string")))
        if lang == "py":
            read = F.concat(F.lit('os.getenv("'), var, F.lit(f'", "{CHANGE_ME}")'))
            generic = F.concat(name, F.lit(" = "), read)
        else:
            read = F.concat(F.lit("process.env."), var, F.lit(f' || "{CHANGE_ME}"'))
            generic = F.concat(F.lit("const "), name, F.lit(" = "), read, F.lit(";"))
        new = F.struct(F.when(p["generic"], generic).otherwise(read).alias("text"), var.alias("var"))
        return F.when(is_safe_value(value, full, lang), F.struct(full.alias("text"), F.lit(None).cast("string").alias("var"))).otherwise(new)

    def joined(acc: Column, p: Column, fixes: Column) -> Column:
        between = F.split(acc["text"], p["rx"], F.lit(-1))
        body = F.flatten(F.transform(between, lambda part, i: F.array(part, F.get(fixes, i)["text"])))
        names = F.filter(F.transform(fixes, lambda f: f["var"]), lambda v: v.isNotNull())
        return let(
            names,
            lambda v: F.struct(F.array_join(body, "").alias("text"), (acc["n"] + F.size(v)).alias("n"), F.concat(acc["vars"], v).alias("vars")),
        )

    def step(acc: Column, p: Column) -> Column:
        matches = F.regexp_extract_all(acc["text"], p["rx"], F.lit(0))
        return let(
            F.transform(matches, lambda full, i: fixed(full, i, acc, p)),
            lambda fixes: F.when(F.size(fixes) == 0, acc).otherwise(joined(acc, p, fixes).cast(_STATE)),
        )

    start = F.struct(content.alias("text"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("vars"))
    return F.aggregate(patterns, start.cast(_STATE), step)


def add_first(text_col: Column, fixes: Column, content: Column, lang: str, header: str = JS_HEADER) -> Column:
    """``import os`` for Python, a comment for scripts, where a fix was made and it is missing."""
    if lang == "py":
        missing = ~content.rlike(r"(?m)^\s*import os\b")
        first = "import os\n"
    else:
        missing = ~content.contains("process.env")
        first = header + "\n"
    return F.when((fixes > 0) & missing, F.concat(F.lit(first), text_col)).otherwise(text_col)


def redact_secrets(files: DataFrame, *, max_size: int | None = None, header: str = JS_HEADER) -> DataFrame:
    """Adds ``fixed_content, fixes, vars, modified`` in the row of the file: no shuffle.

    Files of other languages and files that hold no secret come back as they are.
    A file of any size is redacted; only where a ``max_size`` is given, files above
    it come back as they are, secrets and all (``filters.skipped`` lists them).
    """
    content, lang = F.col("content"), lang_of(F.col("path"))
    usable = F.lit(True) if max_size is None else F.col("length") <= max_size
    holds = lambda family: usable & (lang == family) & may_hold_any(content, patterns_for(family))
    as_it_is = F.struct(content.alias("text"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("vars"))
    done = F.when(holds("py"), _redacted(content, "py")).when(holds("js"), _redacted(content, "js")).otherwise(as_it_is.cast(_STATE))

    def with_first_line(fix: Column) -> Column:
        first = F.when(lang == "py", add_first(fix["text"], fix["n"], content, "py")).otherwise(
            add_first(fix["text"], fix["n"], content, "js", header)
        )
        return F.struct(first.alias("fixed_content"), fix["n"].alias("fixes"), fix["vars"].alias("vars"))

    return with_fields(files, let(done, with_first_line)).withColumn("modified", F.col("fixed_content") != content)


def redact_lines(lines: DataFrame) -> DataFrame:
    """Adds ``fixed_content, fixes, vars`` to lines of files (``path, content``): as in a file, but nothing is put above a line."""
    lang, content = lang_of(F.col("path")), F.col("content")
    fix = F.when(lang == "py", _redacted(content, "py")).when(lang == "js", _redacted(content, "js"))
    fields = let(fix, lambda f: F.struct(f["text"].alias("fixed_content"), f["n"].alias("fixes"), f["vars"].alias("vars")))
    return with_fields(lines, fields)


def redact_text(content: Column) -> Column:
    """Plain redaction for text that is not code; names of generic assignments stay."""
    out = content
    for p in SECRET_PATTERNS:
        if p in (GENERIC_PY, GENERIC_JS):
            out = F.regexp_replace(out, p.regex, f"$1={REDACTED}")
        else:
            out = F.regexp_replace(out, p.regex, REDACTED)
    return F.when(may_hold_any(content, SECRET_PATTERNS), out).otherwise(content)


def new_env_names(redacted: DataFrame, env: DataFrame) -> DataFrame:
    """Names that fixes need and the root ``.env.example`` lacks, in order of first use.

    ``env`` is the output of ``env_names``. A project has few distinct names
    (eleven, and as many numbered ones as its worst file has), whatever its size.
    """
    used = redacted.select("project_id", "path", F.posexplode("vars").alias("pos", "name"))
    first = used.groupBy("project_id", "name").agg(F.min(F.struct("path", "pos")).alias("first_use"))
    known = env.select("project_id", "name").distinct()
    return first.join(known, ["project_id", "name"], "left_anti")


def upsert_env(redacted: DataFrame, env_files: DataFrame, env: DataFrame) -> DataFrame:
    """``project_id, content``: the new text of each root ``.env.example`` that changes.

    ``env_files`` is a files table; of it only the root env files are read.
    """
    new = (
        new_env_names(redacted, env)
        .groupBy("project_id")
        .agg(F.sort_array(F.collect_list(F.struct("first_use", "name"))).alias("new"))
    )
    old = env_files.filter(F.col("path") == ".env.example").select("project_id", F.col("content").alias("old"))
    entries = F.transform("new", lambda v: F.concat(v["name"], F.lit("=\n")))
    fresh = F.concat(F.lit(ENV_HEADER + "\n"), F.array_join(entries, "\n"))
    added = F.concat(F.col("old"), F.lit("\n"), F.array_join(entries, "\n"))
    return new.join(old, "project_id", "left").select("project_id", F.coalesce(added, fresh).alias("content"))


# --- improvements ----------------------------------------------------------


def _in_chain(line: Column) -> Column:
    """The line belongs to a chain of decorators or to the rest of a long one."""
    bare = text.strip(line)
    is_head = bare.startswith("def ") | bare.startswith("async def ") | bare.startswith("class ")
    return bare.startswith("@") | (~is_head & (line.startswith(" ") | line.startswith("\t")))


def insert_decorator(content: Column, at_lines: Column, decorator: Column) -> Column:
    """Text with ``decorator`` put after the chain that starts at each of ``at_lines``.

    Insertions are keyed by lines of the original text, so several in one file
    do not shift one another.
    """
    deco = F.when(decorator.startswith("@"), decorator).otherwise(F.concat(F.lit("@"), decorator))

    # One pass from the last line up tells where the chain of each line ends; then each line takes what is put before it.
    def step(end: Column, line: Column) -> Column:
        here = F.when(line["chain"], end).otherwise(line["i"])
        text_ = F.when(line["wanted"] > 0, F.array_repeat(F.concat(text.indent_of(line["line"]), deco, F.lit("\n")), line["wanted"]))
        out = F.struct(here.alias("at"), text_.alias("new"))
        return F.struct(here.alias("state"), F.when(line["wanted"] > 0, out).alias("out"))

    def marked(lines: Column) -> Column:
        return F.transform(
            _flags(at_lines, F.size(lines)),
            lambda wanted, i: let(F.get(lines, i), lambda line: F.struct(i.alias("i"), line.alias("line"), wanted.alias("wanted"), _in_chain(line).alias("chain"))),
        )

    def rebuilt(lines: Column) -> Column:
        ends = fold(F.reverse(marked(lines)), F.size(lines), step, "struct<at:int,new:array<string>>")
        # In order of their places, which is that of their lines; what is at one place follows the order of the lines, too.
        pieces = let(F.reverse(ends), lambda inserts: F.concat(
            F.transform(inserts, lambda x, k: F.struct(x["at"].alias("at"), F.lit(0).alias("kind"), k.alias("k"), F.array_join(x["new"], "").alias("text"))),
            F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("k"), line.alias("text"))),
        ))
        return F.array_join(F.transform(F.sort_array(pieces), lambda x: x["text"]), "")

    return let(text.splitlines_keep(content), rebuilt)


def _flags(at_lines: Column, n_lines: Column) -> Column:
    """How often each line is among ``at_lines``: an array with an entry for each of the lines."""
    hits = F.concat(F.filter(at_lines, lambda n: (n >= 1) & (n <= n_lines)), F.sequence(F.lit(1), F.greatest(n_lines, F.lit(1))))

    def step(last: Column, n: Column) -> Column:
        # Sorted, each line stands once more than it is asked for; the count goes out with the last of them.
        same = last["n"] == n
        out = F.when(~same & (last["n"] > 0), last["times"])
        return F.struct(F.struct(n.alias("n"), F.when(same, last["times"] + 1).otherwise(0).alias("times")).alias("state"), out.alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("times"))
    counts = fold(F.concat(F.sort_array(hits.cast("array<int>")), F.array(F.lit(-1))), start, step, "int")
    return F.when(n_lines > 0, counts).otherwise(F.array().cast("array<int>"))


def upper_names(content: Column, at_lines: Column) -> Column:
    """Text with the name on each of ``at_lines`` of an env file in upper case."""
    upper = lambda line: text.replace_first(line, text.first_piece(line), F.upper(text.first_piece(line)))
    return let(
        text.splitlines_keep(content),
        lambda lines: F.array_join(
            F.transform(_flags(at_lines, F.size(lines)), lambda wanted, i: let(F.get(lines, i), lambda line: F.when(wanted > 0, upper(line)).otherwise(line))),
            "",
        ),
    )


def apply_improvements(flagged: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``improved_content, improved``; needs ``issues`` and ``auth_decorator``.

    ``flagged`` is the output of ``issues.with_issues`` with the learned
    columns joined, so a file meets its issues without a join on its text.
    """
    col, lang = F.col(content), lang_of(F.col("path"))
    of_type = lambda t: F.transform(
        F.filter("issues", lambda i: i["issue_type"] == t), lambda i: i["line"]
    )
    auth, env = of_type("MISSING_AUTH"), of_type("ENV_VAR_STYLE")
    deco = F.coalesce(F.col("auth_decorator"), F.lit(DEFAULT_AUTH))
    out = (
        F.when((lang == "py") & (F.size(auth) > 0), insert_decorator(col, auth, deco))
        .when((lang == "env") & (F.size(env) > 0), upper_names(col, env))
        .otherwise(col)
    )
    can = ((lang == "py") & (F.size(auth) > 0)) | ((lang == "env") & (F.size(env) > 0))
    return with_fields(
        flagged, F.struct(out.alias("improved_content"), F.coalesce(can, F.lit(False)).alias("improved"))
    )


def insert_in_lines(line_table: DataFrame, issues: DataFrame, decorator: Column) -> DataFrame:
    """As ``insert_decorator`` for tables that hold one line per row.

    Gives the lines of each file that has an issue, with the new ones keyed
    between the old: ``project_id, path, line_no`` (a double), ``line``.
    """
    from pyspark.sql import Window

    by_file = Window.partitionBy("project_id", "path").orderBy("line_no")
    ends = line_table.withColumn(
        "chain_end",
        F.coalesce(
            F.min(F.when(~_in_chain(F.col("line")), F.col("line_no"))).over(
                by_file.rowsBetween(0, Window.unboundedFollowing)
            ),
            F.max("line_no").over(by_file.rowsBetween(0, Window.unboundedFollowing)) + 1,
        ),
    )
    deco = F.when(decorator.startswith("@"), decorator).otherwise(F.concat(F.lit("@"), decorator))
    new = ends.join(issues.withColumnRenamed("line", "line_no"), ["project_id", "path", "line_no"]).select(
        "project_id",
        "path",
        (F.col("chain_end") - 0.5).alias("line_no"),
        F.concat(text.indent_of(F.col("line")), deco).alias("line"),
    )
    touched = line_table.join(issues.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")
    return touched.withColumn("line_no", F.col("line_no").cast("double")).unionByName(new)


def rebuild_text(line_table: DataFrame) -> DataFrame:
    """Lines of each file joined to one text in order of ``line_no``."""
    return (
        line_table.groupBy("project_id", "path")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
        .select("project_id", "path", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))
    )


def env_lines(files: DataFrame) -> DataFrame:
    """Lines of env files that set a name."""
    env = files.filter(paths.name_of(F.col("path")) == ".env.example")
    return lines(env).filter(is_env_line(F.col("line")))
