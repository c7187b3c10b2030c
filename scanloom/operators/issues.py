"""Issue detection: open routes, token handling without CSRF, env names out of style.

``with_issues`` keeps each file in its row and adds the issues as an array, so
neither lines nor texts are shuffled. ``issues`` gives the same as a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import paths, text
from scanloom.functions.arrays import with_fields
from scanloom.operators.filters import SCRIPT_SUFFIXES, has_suffix, is_server_file, lang_of
from scanloom.operators.learning import DEFAULT_AUTH
from scanloom.sources.files import is_env_line
from scanloom.sources.python_functions import LOOKBACK, function_table, functions_in, may_define, with_lines

MISSING_AUTH, MISSING_CSRF, ENV_VAR_STYLE = "MISSING_AUTH", "MISSING_CSRF", "ENV_VAR_STYLE"
_ISSUES = "array<struct<line:int,issue_type:string>>"
_FOUND = "array<struct<line:int,issue_type:string,env_name:string>>"

# Words and patterns the checks look for.
AUTH_WORDS = ["@auth", "@login_required", "@permission"]
ROUTE_SIGNS = ["@app.", "@router."]
REQUEST_ACCESS = r"(cookies\(\)|headers\(\)|request\.(cookies|headers))"


def _is_route(line: Column) -> Column:
    return line.contains(ROUTE_SIGNS[0]) | line.contains(ROUTE_SIGNS[1])


def _passes(line: Column) -> Column:
    bare = text.strip(line)
    return (bare == "") | bare.startswith("@") | bare.startswith("#")


def route_offset(above: list[Column]) -> Column:
    """How many lines above ``above[0]`` the route line is, or NULL.

    ``above[k]`` is the line ``k`` above. The search stops at a line that is
    neither blank nor a decorator nor a comment.
    """
    out = F.when(_is_route(above[0]), F.lit(0))
    for k, line in enumerate(above[1:], 1):
        out = out.when(_is_route(line), F.lit(k)).when(~_passes(line), F.lit(None).cast("int"))
    return out


def _open_route(f: Column, lookback: int, include_async: bool, auth_scope: str) -> Column:
    """Line of the route if function ``f`` is one without authentication, else NULL."""
    offset = route_offset([F.get(f["context"], F.lit(k)) for k in range(lookback + 1)])
    head = F.lower(F.get(f["context"], F.lit(0)))
    guarded = F.exists(f["decorators"], lambda d: F.lower(d).contains("depend"))
    for word in AUTH_WORDS:
        guarded = guarded | head.contains(word)
    if auth_scope == "decorators":
        words = "^(" + "|".join(w[1:] for w in AUTH_WORDS) + ")"
        guarded = guarded | F.exists(f["decorators"], lambda d: F.lower(d).rlike(words))
    open_ = offset.isNotNull() & ~guarded
    if not include_async:
        open_ = open_ & ~f["is_async"]
    return F.when(open_, f["line"] - offset)


def _check_scope(auth_scope: str) -> None:
    if auth_scope not in ("def_line", "decorators"):
        raise ValueError(f"auth_scope is def_line or decorators, not {auth_scope!r}")


def _as_issues(line_nos: Column, type_: str) -> Column:
    return F.transform(
        F.filter(line_nos, lambda n: n.isNotNull()),
        lambda n: F.struct(n.cast("int").alias("line"), F.lit(type_).alias("issue_type"), F.lit(None).cast("string").alias("env_name")),
    )


def missing_auth(
    functions: DataFrame, *, include_async: bool = False, auth_scope: str = "def_line", lookback: int = LOOKBACK
) -> DataFrame:
    """Issues of a function table. The line is that of the route decorator.

    ``auth_scope="decorators"`` also accepts an auth decorator above ``def``;
    a larger ``lookback`` (give the function table the same) also finds routes
    behind more lines.
    """
    _check_scope(auth_scope)
    f = F.struct("context", "decorators", "is_async", "line")
    return (
        functions.withColumn("_f", f)
        .select("project_id", "path", _open_route(F.col("_f"), lookback, include_async, auth_scope).alias("line"))
        .filter(F.col("line").isNotNull())
        .withColumn("issue_type", F.lit(MISSING_AUTH))
    )


def missing_auth_in_lines(line_table: DataFrame, functions: DataFrame, *, lookback: int = LOOKBACK) -> DataFrame:
    """As ``missing_auth`` where the lines are rows already: one window per file looks back."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_id", "path").orderBy("line_no")
    above = [F.col("line"), *[F.lag("line", k).over(w) for k in range(1, lookback + 1)]]
    routes = line_table.select("project_id", "path", "line_no", "line", route_offset(above).alias("offset"))
    head = F.lower("line")
    named = F.lit(False)
    for word in AUTH_WORDS:
        named = named | head.contains(word)
    guarded = F.exists("decorators", lambda d: F.lower(d).contains("depend"))
    defs = functions.filter(~F.col("is_async") & ~guarded).select("project_id", "path", F.col("line").alias("line_no"))
    return (
        routes.filter(F.col("offset").isNotNull() & ~named)
        .join(defs, ["project_id", "path", "line_no"])
        .select(
            "project_id",
            "path",
            (F.col("line_no") - F.col("offset")).alias("line"),
            F.lit(MISSING_AUTH).alias("issue_type"),
        )
    )


def lacks_csrf(line: Column) -> Column:
    """A line that reads a token, cookie or session from the request and does not mention CSRF."""
    low = F.lower(line)
    touches = low.contains("token") | low.contains("cookie") | low.contains("session")
    return touches & ~low.contains("csrf") & line.rlike(REQUEST_ACCESS)


def breaks_env_style(line: Column, env_style: Column, style: str = "mode") -> Column:
    """An env line whose name is not the one expected.

    ``mode`` compares the whole name to the upper-cased most common name of the
    project, so nearly every line differs. ``upper`` only asks for upper case.
    """
    name = text.first_piece(line)
    wrong = env_style.isNotNull() & (name != F.upper(env_style)) if style == "mode" else name != F.upper(name)
    return is_env_line(line) & wrong


def with_issues(
    files: DataFrame,
    content: str = "content",
    *,
    include_async: bool = False,
    auth_scope: str = "def_line",
    lookback: int = LOOKBACK,
    env_check: str = "mode",
) -> DataFrame:
    """Adds ``issues``: array of (line, issue_type), empty for a clean file.

    ``files`` carry the learned column ``env_style`` of their project. Python
    functions are found natively; see ``missing_auth`` for the exact way.
    """
    wrong = lambda line: breaks_env_style(line, F.col("env_style"), env_check)
    prepared, found = _detected(files, content, wrong, include_async, auth_scope, lookback)
    issues = F.transform(found, lambda i: F.struct(i["line"], i["issue_type"])).cast(_ISSUES)
    return with_fields(prepared, F.struct(issues.alias("issues"))).drop("_check", "_text", "_lines", "_code")


def issue_candidates(
    files: DataFrame, *, include_async: bool = False, auth_scope: str = "def_line", lookback: int = LOOKBACK, env_check: str = "mode"
) -> DataFrame:
    """``project_id, path, line, issue_type, env_name`` without what is learned of projects.

    Narrow rows, to be joined with it afterwards: with ``mode`` every line of an env
    file that sets a name is a candidate, with its name (``confirmed``).
    """
    wrong = is_env_line if env_check == "mode" else lambda line: breaks_env_style(line, F.lit(None), env_check)
    prepared, found = _detected(files.select("project_id", "path", "content"), "content", wrong, include_async, auth_scope, lookback)
    return prepared.select("project_id", "path", F.explode(found).alias("_i")).select("project_id", "path", "_i.*")


def confirmed(candidates: DataFrame, *, env_check: str = "mode") -> DataFrame:
    """Candidates, joined with ``env_style``, that are issues."""
    if env_check == "mode":
        candidates = candidates.filter(F.col("env_name").isNull() | (F.col("env_name") != F.upper("env_style")))
    return candidates.drop("env_name")


def _detected(
    files: DataFrame, content: str, wrong: Callable[[Column], Column], include_async: bool, auth_scope: str, lookback: int
) -> tuple[DataFrame, Column]:
    """Files prepared for the checks, and the array of what is found; ``wrong`` tells the lines of env files to be reported."""
    _check_scope(auth_scope)
    col, path = F.col(content), F.col("path")
    lang = lang_of(path)
    prepared = with_lines(
        files.withColumn(
            "_check",
            F.when(
                (lang == "py") & may_define(col) & (col.contains(ROUTE_SIGNS[0]) | col.contains(ROUTE_SIGNS[1])), "py"
            )
            .when((lang == "js") & col.rlike(REQUEST_ACCESS) & is_server_file(path, col), "js")
            .when(lang == "env", "env"),
        ).withColumn("_text", F.when(F.col("_check").isNotNull(), col)),
        "_text",
        F.col("_check") == "py",
    )
    check = F.col("_check")
    functions = functions_in(F.col("_lines"), F.col("_code"), lookback=lookback)
    auth = F.transform(functions, lambda f: _open_route(f, lookback, include_async, auth_scope))
    csrf = F.transform("_lines", lambda line, i: F.when(lacks_csrf(line), i + 1))
    names = F.transform("_lines", lambda line, i: F.when(wrong(line), F.struct((i + 1).alias("line"), text.first_piece(line).alias("name"))))
    env = F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: F.struct(x["line"], F.lit(ENV_VAR_STYLE).alias("issue_type"), x["name"]))
    found = (
        F.when(check == "py", _as_issues(auth, MISSING_AUTH).cast(_FOUND))
        .when(check == "js", _as_issues(csrf, MISSING_CSRF).cast(_FOUND))
        .when(check == "env", env.cast(_FOUND))
        .otherwise(F.array().cast(_FOUND))
    )
    return prepared, found


def explode_issues(flagged: DataFrame, *keep: str) -> DataFrame:
    """``project_id, path, line, issue_type`` and the ``keep`` columns."""
    cols = ["project_id", "path", *keep]
    return flagged.select(*cols, F.explode("issues").alias("_i")).select(*cols, "_i.*")


def nested_issues(flagged: DataFrame) -> DataFrame:
    """One row per file that has issues, with them as a list."""
    return flagged.filter(F.size("issues") > 0).select("project_id", "path", "issues")


def missing_csrf(files: DataFrame) -> DataFrame:
    """CSRF issues alone."""
    return explode_issues(_alone(files, "js"))


def env_var_style(files: DataFrame, *, style: str = "mode") -> DataFrame:
    """Env style issues alone; ``files`` carry ``env_style``."""
    return explode_issues(with_issues(files.filter(lang_of(F.col("path")) == "env"), env_check=style))


def open_routes(files: DataFrame, *, method: str = "native", **options) -> DataFrame:
    """Open routes alone, natively or with exact parsing."""
    py = files.filter(lang_of(F.col("path")) == "py")
    back = options.get("lookback", LOOKBACK)
    return missing_auth(function_table(py, method=method, lookback=back), **options)


def _alone(files: DataFrame, lang: str) -> DataFrame:
    return with_issues(files.filter(lang_of(F.col("path")) == lang).withColumn("env_style", F.lit(None).cast("string")))


# The texts of the suggestions.
_AUTH_TEXT = (
    "💡 Rota sem autenticação detectada. Padrão do projeto: `%s`. "
    "Pode ser aplicado com indentação automática."
)
_CSRF_TEXT = (
    "💡 Manipulação de token/session sem validação CSRF.%s "
    "Recomendado adicionar middleware de validação CSRF."
)
_CSRF_HINT = " Padrão detectado: %s."
_ENV_TEXT = (
    "💡 Estilo de variável inconsistente. Padrão do projeto: `%s=`. "
    "Pode ser padronizado."
)
FINDING_SEVERITY, FINDING_RULE = "medium", "IMPROVEMENT"


def suggest_improvement(issues: DataFrame) -> DataFrame:
    """Adds ``suggestion``, NULL where there is none.

    ``issues`` carry the learned columns ``auth_decorator, token_handler,
    env_style`` of their project.
    """
    kind, path = F.col("issue_type"), F.col("path")
    hint = F.coalesce(F.format_string(_CSRF_HINT, F.col("token_handler")), F.lit(""))
    hint = F.when(F.col("token_handler").isNull(), "").otherwise(hint)
    return issues.withColumn(
        "suggestion",
        F.when(
            (kind == MISSING_AUTH) & (paths.suffix_of(path) == ".py"),
            F.format_string(_AUTH_TEXT, F.coalesce("auth_decorator", F.lit(DEFAULT_AUTH))),
        )
        .when((kind == MISSING_CSRF) & has_suffix(path, SCRIPT_SUFFIXES), F.format_string(_CSRF_TEXT, hint))
        .when(
            (kind == ENV_VAR_STYLE) & (paths.name_of(path) == ".env.example") & F.col("env_style").isNotNull(),
            F.format_string(_ENV_TEXT, F.col("env_style")),
        ),
    )


def to_findings(suggested: DataFrame) -> DataFrame:
    """Issues that have a suggestion as findings."""
    return suggested.filter(F.col("suggestion").isNotNull()).select(
        "project_id",
        F.col("path").alias("file"),
        "line",
        F.col("suggestion").alias("message"),
        F.lit(FINDING_SEVERITY).alias("severity"),
        F.lit(FINDING_RULE).alias("rule_id"),
        F.lit(None).cast("string").alias("level"),
    )
