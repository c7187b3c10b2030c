"""Rule matching over files, and findings from it.

All built-in rules of a file are evaluated in the row of that file: one masking
pass, then line rules on its pieces, block rules on its numbered text, function
rules on its function array, and pair rules on short arrays of candidate lines.
Nothing is shuffled and no pairs are emitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import paths, text
from scanloom.functions.arrays import fold, let, with_fields
from scanloom.functions.lexer import SIGNS, lex
from scanloom.operators.rule_data import RULES
from scanloom.operators.rule_predicates import PREDICATES, Block, Func, Line, Pair, block_regex
from scanloom.plans.joins import join_lookup
from scanloom.session import cut_lineage
from scanloom.sources.python_functions import functions_in, may_define

RULES_SCHEMA = (
    "rule_key string, rule_id string, class string, regex string, mask string, message string, severity string, "
    "category string, languages array<string>, metadata map<string,string>"
)
_HITS = "array<struct<line:int,rule_key:string>>"
RULES_PER_BATCH = 500
#: Least and most characters of the key under which a user's rule is found.
GRAM, LONGEST_KEY = 3, 32
#: A literal that one in so many rules needs is looked for in a line before their keys are.
SHARED = 16
_RULE_OF = {f"{r[0]}/{r[1]}": r for r in RULES}


def rule_table(spark: SparkSession) -> DataFrame:
    """The 94 built-in rules as rows."""
    rows = []
    for key, (_, id_, severity, category, langs, message, metadata) in _RULE_OF.items():
        p = PREDICATES[key]
        regex = {"L": "regex", "B": "regex", "J": "left"}.get(p.cls)
        rows.append(
            (
                key,
                id_,
                p.cls,
                getattr(p, regex) if regex else None,
                getattr(p, "mask", "comments"),
                message,
                severity,
                category,
                list(langs),
                {"category": category, **metadata},
            )
        )
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rule_lang(path: Column) -> Column:
    """``py``, ``ts``, ``js`` or NULL."""
    suffix = paths.suffix_of(path)
    return (
        F.when(suffix == ".py", "py").when(suffix.isin(".ts", ".tsx"), "ts").when(suffix.isin(".js", ".jsx"), "js")
    )


def _selected(family: str, cls: str, keys: Iterable[str] | None) -> dict:
    """Predicates of a class for Python (``py``) or for scripts (``js``)."""
    wanted = None if keys is None else set(keys)
    return {
        k: PREDICATES[k]
        for k, r in _RULE_OF.items()
        if ("py" in r[4]) == (family == "py") and PREDICATES[k].cls == cls and (wanted is None or k in wanted)
    }


def _typed_only(key: str) -> bool:
    """The rule is for TypeScript and not for JavaScript."""
    return _RULE_OF[key][4] == ("ts",)


def _masked(name: str) -> str:
    return {"none": "_raw", "comments": "_code", "strings": "_bare"}[name]


def _holds_any(col: Column, literals: Iterable[str]) -> Column:
    out = F.lit(False)
    for s in literals:
        out = out | col.contains(s)
    return out


# --- line rules --------------------------------------------------------------


def _line_hits(
    raw: Column, code: Column, bare: Column, rules: dict[str, Line], strict: bool, typed: Column | None = None
) -> Column:
    """Keys of the rules a line matches. Rules that share a predicate are tested once.

    Where ``typed`` is false, rules for TypeScript alone do not apply.
    """
    by_predicate: dict[tuple, list[str]] = {}
    for key, rule in rules.items():
        by_predicate.setdefault((rule, _typed_only(key)), []).append(key)
    tests = []
    for (rule, typed_only), same in by_predicate.items():
        line = {"none": raw, "comments": code, "strings": bare}[rule.mask]
        hit = line.rlike(rule.regex)
        if rule.hints:
            hit = _holds_any(line, rule.hints) & hit
        if typed is not None and typed_only:
            hit = typed & hit
        if rule.unless:
            hit = hit & ~line.rlike(rule.unless)
        if strict and rule.strict:
            hit = hit & ~code.rlike(rule.strict)
        tests.append(F.when(hit, F.array(*[F.lit(k) for k in same])))
    return F.flatten(F.array_compact(F.array(*tests)))


def _all_line_hits(rules: dict[str, Line], strict: bool) -> Column:
    def of_piece(p: Column) -> Column:
        keys = _line_hits(p["raw"], p["text"], p["bare"], rules, strict, F.col("lang") == "ts")
        return F.transform(keys, lambda k: F.struct(p["line"].alias("line"), k.alias("rule_key")))

    return F.flatten(F.transform("_pieces", of_piece)).cast(_HITS)


# --- block rules -------------------------------------------------------------


def _block_hits(rules: dict[str, Block], strict: bool) -> list[Column]:
    by_predicate: dict[tuple, list[str]] = {}
    for key, rule in rules.items():
        by_predicate.setdefault((rule, _typed_only(key)), []).append(key)
    return [_block_hit(rule, same, typed_only, strict) for (rule, typed_only), same in by_predicate.items()]


def _block_hit(rule: Block, keys: list[str], typed_only: bool, strict: bool) -> Column:
    rx = block_regex(rule.strict if strict and rule.strict else rule.regex)
    found = F.array_distinct(F.regexp_extract_all(F.col(_masked(rule.mask)), F.lit(rx), F.lit(1)))
    hits = F.flatten(
        F.transform(
            found,
            lambda n: F.array(*[F.struct(n.cast("int").alias("line"), F.lit(k).alias("rule_key")) for k in keys]),
        )
    )
    applies = F.col("_code").contains(rule.hint)
    if typed_only:
        applies = applies & (F.col("lang") == "ts")
    return F.when(applies, hits.cast(_HITS))


# --- function rules ----------------------------------------------------------


def _function_hits(rules: dict[str, Func], strict: bool) -> Column:
    """One expression over the function array; conditions are plain SQL on a function."""
    tests = [
        f"case when {r.test(strict)} then named_struct('line', f.line, 'rule_key', '{k}') end"
        for k, r in rules.items()
    ]
    return F.expr(f"filter(flatten(transform(_functions, f -> array({', '.join(tests)}))), h -> h is not null)").cast(
        _HITS
    )


# --- pair rules --------------------------------------------------------------


def _groups(regex: str) -> int:
    return re.compile(regex).groups


def _name_of(line: Column, regex: str) -> Column:
    return F.concat_ws(" ", *[F.regexp_extract(line, regex, g + 1) for g in range(_groups(regex))])


def _named_lines(lines: Column, regex: str, hints: Iterable[str]) -> Column:
    """array<struct<line, name>> of the lines that match."""
    return F.transform(
        F.filter(lines, lambda line: _holds_any(line["text"], hints) & line["text"].rlike(regex)),
        lambda line: F.struct(line["line"].alias("line"), _name_of(line["text"], regex).alias("name")),
    )


def _left_lines(lines: Column, rule: Pair) -> Column:
    """array<struct<at, line, name>>: first lines, as they are in ``lines``; ``at`` is where a finding goes."""
    is_left = lambda line: line["text"].contains(rule.left_hint) & line["text"].rlike(rule.left)
    if rule.before is None:
        return F.transform(
            F.filter(lines, is_left),
            lambda line: F.struct(line["line"].alias("at"), line.alias("line"), _name_of(line["text"], rule.left).alias("name")),
        )

    def with_line_before(line: Column, i: Column) -> Column:
        above = F.get(lines, i - 1)
        names = [_name_of(above["text"], rule.before)]
        if _groups(rule.left):
            names.append(_name_of(line["text"], rule.left))
        return F.when(
            is_left(line) & (i > 0) & above["text"].rlike(rule.before),
            F.struct(above["line"].alias("at"), line.alias("line"), F.concat_ws(" ", *names).alias("name")),
        )

    return F.filter(F.transform(lines, with_line_before), lambda x: x.isNotNull())


def _pair_hits(key: str, rule: Pair) -> Column:
    """First lines that have a fitting second line in their scope.

    Only the next second line of the name can be the one that counts. First and second
    lines are sorted by name and from the last line up, and one pass over them
    remembers the second line that it met last.
    """
    lines = F.col("_code_lines")
    end = {"block": lambda x: x["end_block"], "body": lambda x: x["end_body"], "file": lambda x: F.lit(None).cast("int")}[rule.scope]
    event = lambda x, name, right, at, end: F.struct(
        name.alias("name"), (-x["line"]).alias("up"), F.lit(right).alias("right"), at.cast("int").alias("at"), end.cast("int").alias("end")
    )
    lefts = F.transform(_left_lines(lines, rule), lambda x: event(x["line"], x["name"], 0, x["at"], end(x["line"])))
    rights = F.concat(*[_named_lines(lines, rx, rule.hints) for rx in rule.rights])
    rights = F.transform(rights, lambda r: event(r, r["name"], 1, F.lit(None), F.lit(None)))

    def step(last: Column, e: Column) -> Column:
        found = (e["right"] == 0) & (last["name"] == e["name"]) & (e["end"].isNull() | (last["line"] < e["end"]))
        seen = F.when(e["right"] == 1, F.struct(e["name"].alias("name"), (-e["up"]).alias("line"))).otherwise(last)
        return F.struct(seen.alias("state"), F.when(found, F.struct(e["at"].alias("line"), F.lit(key).alias("rule_key"))).alias("out"))

    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("line"))
    hits = let(lefts, lambda x: F.when(F.size(x) > 0, fold(F.sort_array(F.concat(x, rights)), none, step, "struct<line:int,rule_key:string>")))
    return F.when(_hinted(rule), hits).cast(_HITS)


def _hinted(rule: Pair) -> Column:
    return F.col("_code").contains(rule.left_hint) & _holds_any(F.col("_code"), rule.hints)


# --- all of them -------------------------------------------------------------


def _by_family(of_py: Column, of_js: Column) -> Column:
    return F.when(F.col("lang") == "py", of_py).otherwise(of_js)


def _prepare(files: DataFrame, pairs: Iterable[Pair]) -> DataFrame:
    """Adds what the rules look at, each once per file.

    ``_raw`` lines; ``_code`` and ``_bare``, the numbered text without comments
    and without strings; ``_pieces``, its lines; ``_code_lines``, those that hold
    code, if one of ``pairs`` may match; ``_functions`` of Python files.
    """
    return (
        _lexed(files)
        .withColumn(
            "_functions",
            F.when(
                (F.col("lang") == "py") & may_define(F.col("content")), functions_in(F.col("_raw"), F.col("_code"))
            ),
        )
        .withColumn("_code_lines", _code_lines(pairs))
    )


def _lexed(files: DataFrame) -> DataFrame:
    """Files that rules look at, with ``lang, _raw, _code, _bare, _pieces``."""
    rows = (
        files.withColumn("lang", rule_lang(F.col("path")))
        .filter(F.col("lang").isNotNull())
        .select("project_id", "path", "lang", "content", *[c for c in ("_digest",) if c in files.columns])
        .withColumn("_raw", text.splitlines(F.col("content")))
    )
    lexed = _by_family(lex(text.numbered(F.col("_raw")), "py"), lex(text.numbered(F.col("_raw")), "js"))
    return with_fields(rows, masked(F.col("_raw"), lexed))


def masked(raw: Column, lexed: Column) -> Column:
    """``_code`` and ``_bare`` of a lexed text and its ``_pieces``: each line as it was (``raw``), without comments (``text``), without strings (``bare``)."""

    def of(both: Column) -> Column:
        return let(
            F.struct(text.numbered_pieces(both["code"]).alias("code"), text.numbered_pieces(both["bare"]).alias("bare")),
            lambda p: F.struct(
                F.concat(both["code"], F.lit("\n")).alias("_code"),
                F.concat(both["bare"], F.lit("\n")).alias("_bare"),
                F.transform(
                    p["code"],
                    lambda c, i: F.struct(c["line"], c["text"], F.get(raw, i).alias("raw"), F.get(p["bare"], i)["text"].alias("bare")),
                ).alias("_pieces"),
            ),
        )

    return let(lexed, of)


def masked_lines(raw: Column, family: str) -> Column:
    """``_pieces`` of lines. Where nothing begins a string or comment, all is code and nothing is cut into tokens."""
    as_they_are = F.transform(
        raw,
        lambda x, i: let(text.without_marks(x), lambda c: F.struct((i + 1).alias("line"), c.alias("text"), x.alias("raw"), c.alias("bare"))),
    )
    lexed = masked(raw, lex(text.numbered(raw), family))["_pieces"]
    return F.when(F.exists(raw, lambda x: x.rlike(f"[{SIGNS[family]}]")), lexed).otherwise(as_they_are)


_CODE_LINE = "struct<line:int,indent:int,text:string,end_block:int,end_body:int>"


def _code_lines(rules: Iterable[Pair]) -> Column:
    """Lines that hold code, with the line at which what is indented like them (``end_block``) or more (``end_body``) ends.

    Only of files in which a rule may find its two lines. One pass from the last line
    up holds the lines below that are less and less indented.
    """
    lines = F.transform(
        F.filter("_pieces", lambda p: p["text"].rlike(r"\S")),
        lambda p: F.struct(
            p["line"].alias("line"),
            F.length(F.regexp_extract(p["text"], r"^([ \t]*)", 1)).alias("indent"),
            p["text"].alias("text"),
        ),
    )

    def step(below: Column, line: Column) -> Column:
        less = F.filter(below, lambda b: b["indent"] < line["indent"])
        last = lambda kept: F.try_element_at(kept, F.lit(-1))["line"]
        body = last(F.filter(below, lambda b: b["indent"] <= line["indent"]))
        out = F.struct(line["line"], line["indent"], line["text"], last(less).alias("end_block"), body.alias("end_body"))
        return F.struct(F.concat(less, F.array(F.struct(line["indent"].alias("indent"), line["line"].alias("line")))).alias("state"), out.alias("out"))

    wanted = F.lit(False)
    for rule in rules:
        wanted = wanted | _hinted(rule)
    start = F.array().cast("array<struct<indent:int,line:int>>")
    return F.when(wanted, let(lines, lambda x: F.reverse(fold(F.reverse(x), start, step, _CODE_LINE))))


def _family_hits(family: str, keys: Iterable[str] | None, strict: bool) -> Column:
    rules = {c: _selected(family, c, keys) for c in "LBFJ"}
    parts = _block_hits(rules["B"], strict)
    if rules["L"]:
        parts.append(_all_line_hits(rules["L"], strict))
    if rules["F"]:
        parts.append(_function_hits(rules["F"], strict))
    parts += [_pair_hits(k, r) for k, r in rules["J"].items()]
    none = F.array().cast(_HITS)
    return F.concat(none, *[F.coalesce(p, none) for p in parts])


def match_rules(files: DataFrame, *, keys: Iterable[str] | None = None, strict: bool = False) -> DataFrame:
    """``project_id, path, lang, line, rule_key``: every place a built-in rule matches.

    One scan of the files, whatever the number of rules. ``keys`` picks rules
    (``pack/id``); ``strict`` adds the tests that the text of a rule promises
    and its pattern lacks.
    """
    rows = _hits_of(files, keys, strict)
    return rows.select("project_id", "path", "lang", F.explode("_hits").alias("_h")).select("project_id", "path", "lang", "_h.line", "_h.rule_key")


def _hits_of(files: DataFrame, keys: Iterable[str] | None, strict: bool) -> DataFrame:
    """``files`` that rules look at with ``_hits``."""
    keys = None if keys is None else list(keys)
    unknown = set(keys or ()) - set(_RULE_OF)
    if unknown:
        raise ValueError(f"no such rules: {sorted(unknown)}")
    hits = _by_family(_family_hits("py", keys, strict), _family_hits("js", keys, strict))
    pairs = {r for family in ("py", "js") for r in _selected(family, "J", keys).values()}
    return with_fields(_prepare(files, pairs), F.struct(hits.alias("_hits")))


def match_rules_once(files: DataFrame, *, keys: Iterable[str] | None = None, strict: bool = False) -> DataFrame:
    """What ``match_rules`` gives, with files of the same language and text matched once.

    Trees hold many copies of a file: vendored, generated, forked. One pass tells how
    many texts differ; where that is over half, files are matched where they are.
    Otherwise the distinct texts are matched and their hits joined to the files by
    language and digest, so texts that are copies do not move.
    """
    known = files.withColumn("lang", rule_lang(F.col("path"))).filter(F.col("lang").isNotNull())
    texts = once(known.select("lang", "content"))
    if texts is None:
        return match_rules(files, keys=keys, strict=strict)
    named = texts.select(F.lit(None).cast("string").alias("project_id"), F.concat(F.lit("a."), "lang").alias("path"), "content", F.sha2("content", 256).alias("_digest"))
    hits = _hits_of(named, keys, strict).filter(F.size("_hits") > 0)
    of_file = known.select("project_id", "path", "lang", F.sha2("content", 256).alias("_digest"))
    found = join_lookup(of_file, hits.select("lang", "_digest", "_hits"), ["lang", "_digest"], "inner", salt_on=["path"])
    return found.select("project_id", "path", "lang", F.inline("_hits"))


#: Distinct texts that a task matches.
TEXTS_PER_TASK = 2_000


def once(texts: DataFrame) -> DataFrame | None:
    """The distinct rows of a table of texts, spread by their number; None if over half of all rows differ."""
    row = texts.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*texts.columns)).alias("differ")).first()
    if 2 * row["differ"] > row["n"]:
        return None
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-row["differ"] // TEXTS_PER_TASK))
    return texts.distinct().repartition(tasks)


def match_line_rules(table: DataFrame, lang: str, content: str, *, keys: Iterable[str] | None = None) -> DataFrame:
    """Line rules of one language on any table with a text column: its other columns, ``line, rule_key``.

    For text whose language no path tells, such as pages or documents. Works on
    streams.
    """
    keep = [c for c in table.columns if c != content]
    family = "py" if lang == "py" else "js"
    rules = {k: r for k, r in _selected(family, "L", keys).items() if lang in _RULE_OF[k][4]}
    raw = text.splitlines(F.col(content))
    pieces = let(raw, lambda r: masked_lines(r, family))
    rows = table.select(*keep, F.explode(pieces).alias("_p"))
    hits = _line_hits(F.col("_p.raw"), F.col("_p.text"), F.col("_p.bare"), rules, False)
    return rows.select(*keep, F.col("_p.line").alias("line"), F.explode(hits).alias("rule_key"))


def match_user_rules(files: DataFrame, rules: DataFrame, *, batch: int = RULES_PER_BATCH) -> DataFrame:
    """Line rules given as rows (``rule_key, regex, mask, languages``), any number of them.

    Rules are found by an index: of the literals that a regex needs, the one that
    fewest rules need is its key, up to ``LONGEST_KEY`` characters of it, so rules meet
    in a key only if they need the same literal. The first ``GRAM`` characters of all
    keys go to all tasks with the lengths of the keys and the literals that many rules
    share, so only lines that hold both leave theirs, once for each run of characters
    that may be a key. A regex that needs no three characters in a row is tried on every
    line of its languages, ``batch`` of them to a row.

    A null mask is ``comments``; a repeated language counts once; equal rows are one
    rule; a row without key, regex or languages is no rule. The rules are written
    once, as several joins read them.
    """
    known = cut_lineage(_known_rules(rules))
    masks = sorted(r["mask"] for r in known.select("mask").distinct().collect())  # three at most
    out = ["project_id", "path", "lang", "line", "rule_key"]
    texts = F.array(*[F.struct(F.lit(m).alias("mask"), F.col(_masked(m)).alias("text")) for m in masks] or [F.struct(F.lit("").alias("mask"), F.lit("").alias("text"))])
    lines = _masked_lines(files).select("project_id", "path", "lang", "line", F.inline(texts))
    spread_by = ["project_id", "path", "line"]

    keyed = known.filter(F.col("key").isNotNull())
    met = join_lookup(_held_keys(lines, keyed, spread_by), keyed.drop("sign"), ["lang", "mask", "key"], "inner", salt_on=spread_by)
    by_key = met.filter(F.rlike("text", F.col("regex"))).select(*out)

    others = known.filter(F.col("key").isNull())
    n_others = others.count()
    if not n_others:
        return by_key
    part = F.pmod(F.xxhash64("rule_key", "regex"), F.lit(-(-n_others // batch)))
    batches = others.withColumn("_part", part).groupBy("lang", "mask", "_part").agg(F.collect_list(F.struct("rule_key", "regex")).alias("rules"))
    tried = join_lookup(lines, batches.drop("_part"), ["lang", "mask"], "inner", salt_on=spread_by)
    matching = F.filter("rules", lambda r: F.rlike(F.col("text"), r["regex"]))
    one_by_one = tried.select("project_id", "path", "lang", "line", F.explode(matching).alias("_r")).select(*out[:-1], "_r.rule_key")
    return by_key.unionByName(one_by_one)


def _held_keys(lines: DataFrame, keyed: DataFrame, spread_by: list[str]) -> DataFrame:
    """``lines`` with ``key``: a row for each run of characters of a text that is as long as a key and begins like it.

    Written once, as finding them reads all files and the join behind it may read them twice.
    """
    gram = F.left(F.col("key"), F.lit(GRAM))
    ways = keyed.groupBy("lang", "mask", gram.alias("gram"), F.length("key").alias("n")).agg(F.collect_set("sign").alias("signs"))
    begins = ways.groupBy("lang", "mask", "gram").agg(F.collect_list(F.struct("n", "signs")).alias("ways"))
    grams = lines.withColumn("gram", F.explode(grams_of(F.col("text"))))
    near = join_lookup(grams, begins, ["lang", "mask", "gram"], "inner", salt_on=spread_by)
    # Keys are printable and hold no sign of a regex. Behind a look-ahead the next run may overlap.
    runs = lambda w: F.regexp_extract_all(
        F.col("text"), F.concat(F.lit("(?=("), F.col("gram"), F.lit("[ -~]{"), (w["n"] - GRAM).cast("string"), F.lit("}))")), F.lit(1)
    )
    may = F.filter("ways", lambda w: F.exists(w["signs"], lambda s: F.contains(F.col("text"), s)))
    keys = F.flatten(F.transform(may, lambda w: F.array_distinct(runs(w))))
    return cut_lineage(near.select(*lines.columns, F.explode(keys).alias("key")))


def _known_rules(rules: DataFrame) -> DataFrame:
    """``lang, mask, rule_key, regex, key, sign``: a row for each rule and language.

    ``key`` is the literal under which the rule is found, ``sign`` the one that it shares with
    most rules, if one in ``SHARED`` has it; empty if none.
    """
    mask = F.coalesce("mask", F.lit("comments"))
    known = mask.isin("none", "comments", "strings")
    usable = rules.filter(F.col("rule_key").isNotNull() & F.col("regex").isNotNull())
    rows = usable.select(
        "rule_key", "regex", F.when(known, mask).otherwise(F.raise_error(F.concat(F.lit("no such mask: "), mask))).alias("mask"),
        F.explode(F.array_distinct("languages")).alias("lang"),
    ).distinct()
    rows = rows.filter(F.col("lang").isNotNull())
    literals = F.array_distinct(F.flatten(F.transform(needed_literals(F.col("regex")), _key_pieces)))
    needed = rows.select("*", F.explode_outer(literals).alias("key"))
    every = rows.groupBy("lang", "mask").agg(F.count("*").alias("rules"))
    counts = needed.groupBy("lang", "mask", "key").agg(F.count("*").alias("n")).join(F.broadcast(every), ["lang", "mask"])
    counted = join_lookup(needed, counts, ["lang", "mask", "key"], "inner", salt_on=["rule_key", "regex"])
    rarest = F.min(F.struct("n", (-F.length("key")).alias("short"), "key"))["key"]
    sign = F.max(F.when(F.col("n") * SHARED >= F.col("rules"), F.struct("n", "key")))["key"]
    return counted.groupBy("lang", "mask", "rule_key", "regex").agg(rarest.alias("key"), F.coalesce(sign, F.lit("")).alias("sign"))


def _key_pieces(literal: Column) -> Column:
    """A literal, or pieces of ``LONGEST_KEY`` characters that cover it."""
    last = F.greatest(F.length(literal) - (LONGEST_KEY - 1), F.lit(1))
    at = F.concat(F.sequence(F.lit(1), last, F.lit(LONGEST_KEY)), F.array(last))
    return F.transform(at, lambda i: F.substring(literal, i, F.lit(LONGEST_KEY)))


_ESCAPE = r"\\(?:[xN]\{[^}]*\}|x..|u....|[pP]\{[^}]*\}|[pP].|c.|0[0-7]{1,3}|k<[^>]*>|[0-9]+|.)"
_CUT = "\x00"


def needed_literals(regex: Column) -> Column:
    """Runs of printable characters that every match of a regex holds; none where that is not plain to see.

    Regexes with alternatives, flags, look-around, quotations, nested classes or groups
    that may be missing give none.
    """
    atoms = F.regexp_replace(F.regexp_replace(regex, _ESCAPE, _CUT), r"\[\^?\]?[^\]]*\]", _CUT)
    unclear = regex.rlike(r"\\Q|\[[^\]]*(?:\[|&&)") | atoms.rlike(r"\||\(\?(?!:)|\)[*?{]")
    solid = F.regexp_replace(F.regexp_replace(atoms, r"\(\?:", "("), r".(?:[*?]|\{[^}]*\})[+?]?", _CUT)
    runs = F.split(solid, r"[^ -~]|[.^$+()\[\]{}*?|\\]", -1)
    return F.when(unclear, F.array().cast("array<string>")).otherwise(F.filter(runs, lambda r: F.length(r) >= GRAM))


def grams_of(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a text."""
    return let(
        F.split(text, ""),
        lambda c: F.array_distinct(
            F.transform(
                F.slice(c, F.lit(1), F.greatest(F.size(c) - (GRAM - 1), F.lit(0))),
                lambda x, i: F.concat(x, *[F.get(c, i + k) for k in range(1, GRAM)]),
            )
        ),
    )


def _masked_lines(files: DataFrame) -> DataFrame:
    """Lines as they are (``_raw``), without comments (``_code``), without strings (``_bare``)."""
    lines = _lexed(files).select("project_id", "path", "lang", F.explode("_pieces").alias("_p"))
    return lines.select("project_id", "path", "lang", "_p.line", F.col("_p.raw").alias("_raw"), F.col("_p.text").alias("_code"), F.col("_p.bare").alias("_bare"))


def rule_findings(hits: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Hits with the severity, category and message of their rule.

    The built-in table has 94 rows and is broadcast; a table of the user's is
    measured first, and beyond the limit its rows are copied over salts.
    """
    meta = ["rule_key", "rule_id", "message", "severity", "category"]
    if rules is None:
        joined = hits.join(F.broadcast(rule_table(hits.sparkSession)).select(*meta), "rule_key")
    else:
        joined = join_lookup(hits, rules.select(*meta), ["rule_key"], "inner", salt_on=["project_id", "path", "line"])
    return joined.select(
        "project_id",
        F.col("path").alias("file"),
        "line",
        "message",
        "severity",
        "rule_id",
        F.when(F.col("severity") == "ERROR", "error")
        .when(F.col("severity") == "WARNING", "warning")
        .otherwise("note")
        .alias("level"),
        "category",
        "rule_key",
    )


def line_rule_hits(raw: Column, code: Column, bare: Column, family: str, typed: Column) -> Column:
    """Keys of the line rules that one line matches, for tables whose rows are lines."""
    return _line_hits(raw, code, bare, _selected(family, "L", None), False, typed)
