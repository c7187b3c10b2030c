"""What a project is used to: its auth decorators, token handlers and env names.

A *learned* table has ``project_id, kind, value, path, pos``, one row per use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import paths, text
from scanloom.operators.filters import is_server_file, scannable
from scanloom.sources.files import JS_GLOB, PY_GLOB, glob_python, is_env_line
from scanloom.sources.python_functions import function_table, functions_in, is_indented, may_define, with_lines

# The kinds, the handler names, and the decorator to use when a
# project shows none.
AUTH, HANDLER, ENV = "fastapi_auth_decorator", "nextjs_token_handler", "env_var_style"
CSRF_VALIDATION, COOKIE_BASED = "csrf_validation", "cookie_based"
DEFAULT_AUTH = "Depends(get_current_user)"


_USES = "array<struct<kind:string,value:string,pos:int>>"


def _auth_uses(functions: Column) -> Column:
    """Decorators that hold "depend", of sync functions."""
    sync = F.filter(functions, lambda f: ~f["is_async"])
    return F.flatten(
        F.transform(
            sync,
            lambda f: F.transform(
                F.filter(f["decorators"], lambda d: F.lower(d).contains("depend")),
                lambda d: F.struct(F.lit(AUTH).alias("kind"), d.alias("value"), f["line"].alias("pos")),
            ),
        )
    ).cast(_USES)


def _handler_uses(content: Column) -> Column:
    low = F.lower(content)
    csrf = F.when(content.contains("use server") & low.contains("csrf"), CSRF_VALIDATION)
    cookie = F.when(low.contains("cookie") & (low.contains("token") | low.contains("session")), COOKIE_BASED)
    return F.transform(
        F.array_compact(F.array(csrf, cookie)),
        lambda v, i: F.struct(F.lit(HANDLER).alias("kind"), v.alias("value"), i.alias("pos")),
    ).cast(_USES)


def _env_uses(lines: Column) -> Column:
    return F.filter(
        F.transform(
            lines,
            lambda line, i: F.when(
                is_env_line(line),
                F.struct(F.lit(ENV).alias("kind"), text.first_piece(line).alias("value"), (i + 1).alias("pos")),
            ),
        ),
        lambda x: x.isNotNull(),
    ).cast(_USES)


def _explode_uses(rows: DataFrame, uses: Column) -> DataFrame:
    return rows.select("project_id", "path", F.explode(uses).alias("_u")).select(
        "project_id", "_u.kind", "_u.value", "path", "_u.pos"
    )


def exact_auth_decorators(files: DataFrame) -> DataFrame:
    """Auth decorators of files that parse as they stand, by parsing them."""
    functions = function_table(glob_python(files), method="exact").filter(~F.col("is_async") & ~F.col("file_indented"))
    return (
        functions.select("project_id", "path", "line", F.explode("decorators").alias("value"))
        .filter(F.lower("value").contains("depend"))
        .select("project_id", F.lit(AUTH).alias("kind"), "value", "path", F.col("line").alias("pos"))
    )


def learn(files: DataFrame, *, method: str = "native", skip: bool = True) -> DataFrame:
    """All three kinds over the files that the default scan reads.

    * auth: decorators that hold "depend", of sync functions in Python files
      that parse as they stand (so not in one that is indented as a whole);
    * handlers: how scripts that run on the server handle tokens;
    * env: names in the ``.env.example`` at the root of a project.

    The native method reads the files once for all of them.
    """
    files = scannable(files) if skip else files
    path, content, name = F.col("path"), F.col("content"), paths.name_of(F.col("path"))
    is_py = name.rlike(PY_GLOB) & may_define(content) & F.lower(content).contains("depend") & ~is_indented(content)
    kind = (
        F.when(path == ".env.example", ENV)
        .when(name.rlike(PY_GLOB), F.when(is_py, AUTH))
        .when(name.rlike(JS_GLOB) & is_server_file(path, content), HANDLER)
    )
    if method == "exact":
        kind = F.when(kind != AUTH, kind)
    rows = with_lines(files.select("project_id", "path", "content", kind.alias("_kind")).filter("_kind is not null"), is_code=F.col("_kind") == AUTH)
    uses = (
        F.when(F.col("_kind") == ENV, _env_uses(F.col("_lines")))
        .when(F.col("_kind") == HANDLER, _handler_uses(content))
        .otherwise(_auth_uses(functions_in(F.col("_lines"), F.col("_code"))))
    )
    native = _explode_uses(rows, uses)
    return native if method == "native" else native.unionByName(exact_auth_decorators(files))


def value_counts(learned: DataFrame) -> DataFrame:
    """Uses and first use per project, kind and value. Partial counts come before the shuffle."""
    return learned.groupBy("project_id", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "pos")).alias("first_use")
    )


def most_common(learned: DataFrame) -> DataFrame:
    """``project_id, kind, value``: the most common value; a tie gives the least one."""
    return (
        value_counts(learned)
        .groupBy("project_id", "kind")
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    )


def first_handler(learned: DataFrame) -> DataFrame:
    """``project_id, value``: the token handler seen first, in order of path."""
    return (
        value_counts(learned)
        .filter(F.col("kind") == HANDLER)
        .groupBy("project_id")
        .agg(F.min_by("value", F.struct("first_use", "value")).alias("value"))
    )


def summarise(learned: DataFrame) -> DataFrame:
    """One row per project: ``auth_decorator, token_handler, env_style``, NULL where nothing was seen.

    Values are counted first, so the last step sees one row per distinct value
    and not one per use.
    """
    counts = value_counts(learned)
    common = F.struct(-F.col("n"), F.col("value"))
    return counts.groupBy("project_id").agg(
        F.min_by(F.when(F.col("kind") == AUTH, F.col("value")), F.when(F.col("kind") == AUTH, common)).alias(
            "auth_decorator"
        ),
        F.min_by(
            F.when(F.col("kind") == HANDLER, F.col("value")),
            F.when(F.col("kind") == HANDLER, F.struct("first_use", "value")),
        ).alias("token_handler"),
        F.min_by(F.when(F.col("kind") == ENV, F.col("value")), F.when(F.col("kind") == ENV, common)).alias("env_style"),
    )


def as_map(learned: DataFrame) -> DataFrame:
    """``project_id, patterns``: distinct values per kind as a map, for projects whose lists are wanted whole."""
    return (
        value_counts(learned)
        .groupBy("project_id", "kind")
        .agg(F.sort_array(F.collect_list("value")).alias("values"))
        .groupBy("project_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "values")))).alias("patterns"))
    )
