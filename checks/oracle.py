"""SQL for DuckDB that gives the same results as ``spark_queries``, found another way.

Where Spark keeps a file in its row and folds over arrays, the SQL here goes
over lines: it numbers them, looks around with windows and joins them. RE2 has
no look-behind and no back-references, so a few patterns are written differently.
"""

from __future__ import annotations

import re

from checks import spark_queries
from scanloom.functions.patterns import CHANGE_ME, SECRET_PATTERNS, TOKEN_PATTERNS
from scanloom.functions.severity import RULE_TO_FINDING
from scanloom.operators import filters, issues, learning, reports, rewrite
from scanloom.operators.rule_data import RULES
from scanloom.operators.rule_predicates import PREDICATES
from scanloom.plans import corpus, review
from scanloom.sources.diffs import TRUNCATION


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


ORACLES: dict[str, str] = {}

# --- patterns in RE2 ---------------------------------------------------------------

_BEFORE = r"""(^|[^'"#])"""
GENERIC = {
    "GENERIC_SECRET_PY": rf"""(?i){_BEFORE}(secret_key|jwt_secret|api_key|password|token)\s*=\s*["']([^"']+)["']""",
    "GENERIC_SECRET_JS": rf"""(?i){_BEFORE}(?:const|let|var)\s+(secretKey|jwtSecret|apiKey|stripeKey|password|token)"""
    r"""\s*=\s*["']([^"']+)["']""",
}
RE2 = {p.type: GENERIC.get(p.type, p.regex) for p in SECRET_PATTERNS}


def n_matches(col: str, type_: str) -> str:
    return f"len(regexp_extract_all({col}, {q(RE2[type_])}))"


def n_secrets(col: str) -> str:
    return "(" + " + ".join(n_matches(col, t) for t in RE2) + ")"


def matches(source: str, keys: str, col: str, types=tuple(RE2)) -> str:
    """One row per match of a table of lines (``keys, line_no, col``)."""
    parts = []
    for t in types:
        rx = q(RE2[t])
        if t in GENERIC:
            name, value = f"regexp_extract_all({col}, {rx}, 2)", f"regexp_extract_all({col}, {rx}, 3)"
        else:
            value = f"regexp_extract_all({col}, {rx})"
            name = f"list_transform({value}, lambda x: CAST(NULL AS VARCHAR))"
        parts.append(
            f"SELECT {keys}, {q(t)} AS type, CAST(line_no AS INTEGER) AS line, unnest({name}) AS name, "
            f"unnest({value}) AS value FROM {source}"
        )
    return " UNION ALL ".join(parts)


def redacted(col: str) -> str:
    out = col
    for p in SECRET_PATTERNS:
        new = rf"\1\2={rewrite.REDACTED}" if p.type == "GENERIC_SECRET_PY" else rewrite.REDACTED
        rx = RE2[p.type]
        if p.type == "GENERIC_SECRET_JS":
            # The name alone is kept, and what stands before the declaration.
            new = rf"\1\2={rewrite.REDACTED}"
        out = f"regexp_replace({out}, {q(rx)}, {q(new)}, 'g')"
    return out


# --- tables of files and lines -----------------------------------------------------


def line_table(source: str, keys: str, col: str = "content") -> str:
    """Lines of rendered files, which end in one newline."""
    body = f"string_split(rtrim({col}, chr(10)), chr(10))"
    return f"SELECT {keys}, unnest({body}) AS line, CAST(generate_subscripts({body}, 1) AS INTEGER) AS line_no FROM {source}"


NAME = "string_split(path, '/')[-1]"
SUFFIX = rf"regexp_extract({NAME}, '^.+(\.[^.]+)$', 1)"
SCRIPT = f"{SUFFIX} IN ('.js', '.ts', '.jsx', '.tsx')"
KEEP = (
    f"NOT list_has_any(string_split(path, '/'), {strings(filters.EXCLUDED_DIRS)}) "
    f"AND {SUFFIX} NOT IN ({', '.join(q(s) for s in filters.EXCLUDED_SUFFIXES)})"
)
SERVER = (
    f"(regexp_matches(path, '^({'|'.join(filters.SERVER_DIRS)})(/|$)') OR ({SCRIPT} AND "
    "(contains(content, '\"use server\"') OR contains(content, chr(39) || 'use server' || chr(39)))))"
)
BARE = "trim(line, ' ' || chr(9))"


def _file_ctes() -> dict[str, str]:
    c = {
        "web": corpus.rendered_sql(corpus.WEB_FILES),
        "server": corpus.rendered_sql(corpus.SERVER_FILES),
        "env": corpus.rendered_sql(corpus.ENV_FILES),
        "files": "SELECT * FROM web UNION ALL SELECT * FROM server UNION ALL SELECT * FROM env",
        "py": corpus.rendered_sql(corpus.PY_SAMPLE_FILES),
        "ts": corpus.rendered_sql(corpus.TS_SAMPLE_FILES),
        "kept": f"SELECT * FROM web WHERE {KEEP}",
        "web_lines": line_table("kept", "project_id, path"),
        "server_lines": line_table("server", "project_id, path, content"),
        "env_lines": line_table("env", "project_id, path"),
    }
    # Functions of the web files. A line that is neither blank nor a decorator nor
    # a comment ends the decorators of what follows.
    upto = "OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    c["marked"] = f"""
        SELECT *, {BARE} AS bare,
          regexp_matches(line, '^\\s*(async\\s+)?def\\s+\\w+\\(') AND suffix = '.py'
            AND coalesce(sum(len(regexp_extract_all(line, '\"{{3}}'))) {upto}, 0) % 2 = 0 AS is_def,
          max(CASE WHEN {BARE} <> '' AND NOT starts_with({BARE}, '@') AND NOT starts_with({BARE}, '#')
              THEN line_no END) {upto} AS last_stop,
          lag(line, 1) OVER (PARTITION BY path ORDER BY line_no) AS line_above
        FROM (SELECT *, {SUFFIX} AS suffix FROM web_lines)"""
    c["decorators"] = """
        SELECT d.project_id, d.path, d.line_no, d.line AS def_line, l.line_no AS at, substr(l.bare, 2) AS value
        FROM marked d JOIN marked l ON d.path = l.path AND l.line_no < d.line_no
          AND l.line_no > coalesce(d.last_stop, 0) AND starts_with(l.bare, '@')
        WHERE d.is_def"""
    params = r"regexp_extract(line, 'def\s+\w+\((.*?)\)', 1)"
    c["functions"] = f"""
        SELECT project_id, path, CAST(line_no AS INTEGER) AS line, regexp_extract(line, 'def\\s+(\\w+)', 1) AS name,
          regexp_matches(line, '^\\s*async\\s') AS is_async,
          (SELECT count(*) FROM decorators x WHERE x.path = m.path AND x.line_no = m.line_no) AS n_decorators,
          CASE WHEN {params} = '' THEN 0 ELSE len(string_split({params}, ',')) END AS n_params,
          nullif(trim(regexp_extract(line, '->\\s*([^:]+):', 1)), '') AS returns, line_above, line AS def_line
        FROM marked m WHERE is_def"""
    c["learned"] = f"""
        SELECT project_id, {q(learning.AUTH)} AS kind, value, path, CAST(line_no AS BIGINT) AS pos FROM decorators
        WHERE lower(value) LIKE '%depend%' AND NOT regexp_matches(def_line, '^\\s*async\\s')
        UNION ALL
        SELECT project_id, {q(learning.HANDLER)}, unnest(list_filter([csrf, cookie], lambda x: x IS NOT NULL)), path,
          unnest(range(0, len(list_filter([csrf, cookie], lambda x: x IS NOT NULL))))
        FROM (SELECT project_id, path,
            CASE WHEN contains(content, 'use server') AND contains(lower(content), 'csrf') THEN 'csrf_validation' END AS csrf,
            CASE WHEN contains(lower(content), 'cookie')
              AND (contains(lower(content), 'token') OR contains(lower(content), 'session')) THEN 'cookie_based' END AS cookie
          FROM server WHERE {SERVER} AND regexp_matches({NAME}, '\\.[jt]s'))
        UNION ALL
        SELECT project_id, {q(learning.ENV)}, trim(split_part(line, '=', 1)), path, line_no FROM env_lines
        WHERE path = '.env.example' AND contains(line, '=') AND NOT starts_with(ltrim(line), '#')"""
    c["counts"] = "SELECT project_id, kind, value, count(*) AS n, min((path, pos)) AS first_use FROM learned GROUP BY ALL"
    c["common"] = """
        SELECT project_id, kind, value FROM counts
        QUALIFY row_number() OVER (PARTITION BY project_id, kind ORDER BY n DESC, value) = 1"""
    c["handler"] = f"""
        SELECT project_id, value FROM counts WHERE kind = {q(learning.HANDLER)}
        QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY first_use, value) = 1"""
    c["summary"] = f"""
        SELECT p.project_id, a.value AS auth_decorator, h.value AS token_handler, e.value AS env_style
        FROM (SELECT DISTINCT project_id FROM learned) p
        LEFT JOIN common a ON a.project_id = p.project_id AND a.kind = {q(learning.AUTH)}
        LEFT JOIN handler h ON h.project_id = p.project_id
        LEFT JOIN common e ON e.project_id = p.project_id AND e.kind = {q(learning.ENV)}"""
    c["auth"] = routes_sql(4, False, False)
    c["csrf"] = f"""
        SELECT project_id, path, line_no AS line, 'MISSING_CSRF' AS issue_type FROM server_lines
        WHERE {SCRIPT} AND {SERVER} AND regexp_matches(lower(line), 'token|cookie|session')
          AND NOT contains(lower(line), 'csrf') AND regexp_matches(line, {q(issues.REQUEST_ACCESS)})"""
    c["style"] = f"""
        SELECT e.project_id, path, line_no AS line, 'ENV_VAR_STYLE' AS issue_type, e.line AS text
        FROM env_lines e JOIN common m ON m.project_id = e.project_id AND m.kind = {q(learning.ENV)}
        WHERE contains(line, '=') AND NOT starts_with(ltrim(line), '#')
          AND trim(split_part(line, '=', 1)) <> upper(m.value)"""
    c["found"] = """
        SELECT project_id, path, line, issue_type FROM auth UNION ALL SELECT project_id, path, line, issue_type FROM csrf
        UNION ALL SELECT project_id, path, line, issue_type FROM style"""
    return c


def routes_sql(lookback: int, include_async: bool, by_decorators: bool) -> str:
    """Open routes: the first route line at or above ``def`` with nothing else between."""
    is_route = lambda c: f"(contains({c}, '@app.') OR contains({c}, '@router.'))"
    passes = lambda c: f"(trim({c}) = '' OR starts_with(trim({c}), '@') OR starts_with(trim({c}), '#'))"
    lags = ", ".join(f"lag(line, {k}) OVER w AS p{k}" for k in range(1, lookback + 1))
    ladder = f"CASE WHEN {is_route('line')} THEN 0 " + " ".join(
        f"WHEN {is_route(f'p{k}')} THEN {k} WHEN NOT {passes(f'p{k}')} THEN NULL" for k in range(1, lookback + 1)
    ) + " END"
    guard = "lower(x.value) LIKE '%depend%'"
    if by_decorators:
        guard += " OR regexp_matches(lower(x.value), '^(auth|login_required|permission)')"
    sync = "" if include_async else "AND NOT regexp_matches(line, '^\\s*async\\s')"
    return f"""
        SELECT project_id, path, CAST(line_no - up AS INTEGER) AS line, 'MISSING_AUTH' AS issue_type FROM (
          SELECT *, {ladder} AS up FROM (SELECT *, {lags} FROM marked WINDOW w AS (PARTITION BY path ORDER BY line_no))
        ) m WHERE is_def AND up IS NOT NULL {sync} AND NOT regexp_matches(lower(line), '@auth|@login_required|@permission')
          AND NOT EXISTS (SELECT 1 FROM decorators x WHERE x.path = m.path AND x.line_no = m.line_no AND ({guard}))"""


CTES = _file_ctes()


def sql(body: str, **extra: str) -> str:
    """``body`` with the common tables it needs in front, each after those it reads."""
    known = {**CTES, **extra}
    order: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text):
            if name in known and name not in order:
                add(known[name])
                order.append(name)

    add(body)
    # MATERIALIZED: the planner must not work a table out again for each use.
    head = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order)
    return (f"WITH {head}\n" if head else "") + body


# --- secrets in prose -----------------------------------------------------------------

ORACLES["secret_counts_by_lang"] = f"""
    SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_secrets, count(*) FILTER (n > 0) AS n_docs_with_secret
    FROM (SELECT lang, {n_secrets('text')} AS n FROM documents) GROUP BY lang"""
ORACLES["secret_counts_by_type"] = " UNION ALL ".join(
    f"SELECT {q(t)} AS type, CAST(sum(n) AS BIGINT) AS n_secrets, count(*) FILTER (n > 0) AS n_docs "
    f"FROM (SELECT {n_matches('text', t)} AS n FROM documents)"
    for t in RE2
)
DOC_LINES = (
    "SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"
)
HITS = matches("doc_lines", "doc_id, source, lang", "line")
ORACLES["secret_rollup_by_source"] = sql(
    "SELECT source, type, count(*) AS n_secrets FROM hits GROUP BY ROLLUP (source, type) HAVING count(*) > 0",
    doc_lines=DOC_LINES,
    hits=HITS,
)
ORACLES["documents_with_secret"] = f"SELECT doc_id, source, lang FROM documents WHERE {n_secrets('text')} > 0"
ORACLES["secret_matches"] = sql("SELECT doc_id, type, line, name, value FROM hits", doc_lines=DOC_LINES, hits=HITS)
ORACLES["redacted_documents"] = f"""
    SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n_chars
    FROM (SELECT doc_id, {redacted('text')} AS t FROM documents)"""
ORACLES["top_documents_per_source"] = f"""
    SELECT source, doc_id, n_secrets, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_secrets DESC, doc_id) AS rank
      FROM (SELECT source, doc_id, CAST({n_secrets('text')} AS BIGINT) AS n_secrets FROM documents) WHERE n_secrets > 0
    ) WHERE rank <= 10"""
ORACLES["secrets_by_quality"] = f"""
    SELECT quality, toxic, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_secrets
    FROM (SELECT doc_id, {n_secrets('text')} AS n FROM documents) JOIN labels USING (doc_id) GROUP BY quality, toxic"""
ORACLES["secrets_in_conversations"] = f"""
    SELECT role, count(*) AS n_turns, CAST(sum({n_secrets('text')}) AS BIGINT) AS n_secrets FROM conversations GROUP BY role"""
ORACLES["secrets_in_pages"] = f"SELECT page_id, CAST({n_secrets('html')} AS BIGINT) AS n_secrets FROM pages"

# --- sources and scalar functions -------------------------------------------------------

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def split_lines(col: str) -> str:
    pieces = f"regexp_split_to_array({col}, {q(_BREAK)})"
    return f"CASE WHEN {pieces}[-1] = '' THEN {pieces}[:-2] ELSE {pieces} END"


ORACLES["lines_per_document"] = f"""
    SELECT doc_id, len(ls) AS n_lines, list_max(list_transform(ls, lambda x: length(x))) AS longest,
      len(list_filter(ls, lambda x: trim(x, ' ' || chr(9)) = '')) AS n_blank
    FROM (SELECT doc_id, {split_lines('text')} AS ls FROM documents)"""
ORACLES["line_source"] = f"""
    SELECT project_id, path, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line_md5,
      CAST(length(regexp_extract(line, '^(\\s*)', 1)) AS INTEGER) AS indent
    FROM (SELECT role AS project_id, concat_ws('/', conv_id, turn) AS path, unnest({split_lines('text')}) AS line,
      generate_subscripts({split_lines('text')}, 1) AS line_no FROM conversations)"""
ORACLES["decoded_documents"] = """
    SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS path, md5(text) AS text_md5, 'strict' AS how
    FROM documents WHERE doc_id % 5 <> 0
    UNION ALL SELECT source, CAST(doc_id AS VARCHAR), md5(text), 'lenient' FROM documents"""
ORACLES["glob_sources"] = sql(
    f"""SELECT project_id, path, '*.py' AS glob FROM files WHERE {NAME} GLOB '*.py'
    UNION ALL SELECT project_id, path, '*.[jt]s*' FROM files WHERE {NAME} GLOB '*.[jt]s*'"""
)
ORACLES["env_name_source"] = sql(
    """SELECT project_id, path, line_no, trim(split_part(line, '=', 1)) AS name FROM env_lines
    WHERE contains(line, '=') AND NOT starts_with(ltrim(line), '#')"""
)
_URL = "regexp_replace(url, '[?#].*$', '')"
ORACLES["url_suffixes"] = f"""
    SELECT page_id, {NAME} AS name, {SUFFIX} AS suffix, len(string_split(path, '/')) AS n_parts
    FROM (SELECT page_id, {_URL} AS path FROM pages)"""
ORACLES["excluded_urls"] = f"""
    SELECT list_has_any(string_split(path, '/'), ['en', 'fr', 'build']) AS in_folder,
      {SUFFIX} IN ('.html', '.htm') AS has_suffix, strlen(html) > 4096 AS too_large, count(*) AS n_pages
    FROM (SELECT {_URL} AS path, html FROM pages) GROUP BY ALL"""
_SHOWN = {
    "head": "substr(text, 1, 1000)",
    "tail": "right(text, 1000)",
    "middle": "substr(text, 1, 500) || right(text, 500)",
}
ORACLES["shown_text"] = " UNION ALL ".join(
    f"SELECT doc_id, {q(s)} AS strategy, md5(CASE WHEN length(text) > 1000 THEN {_SHOWN[s]} ELSE text END) AS text_md5, "
    "length(text) > 1000 AS is_truncated FROM documents"
    for s in TRUNCATION
)

# --- filters ---------------------------------------------------------------------------

ORACLES["scannable_files"] = sql(f"SELECT project_id, path FROM files WHERE {KEEP} AND strlen(content) <= 400")
ORACLES["skipped_files"] = sql(
    f"""SELECT project_id, path, reason FROM (SELECT *, CASE
      WHEN list_has_any(string_split(path, '/'), {strings(filters.EXCLUDED_DIRS)}) THEN 'excluded folder'
      WHEN {SUFFIX} IN ({', '.join(q(s) for s in filters.EXCLUDED_SUFFIXES)}) THEN 'excluded suffix'
      WHEN strlen(content) > 400 THEN 'larger than 400 bytes' END AS reason FROM files) WHERE reason IS NOT NULL"""
)
_GLOBS = " OR ".join(
    f"{NAME} GLOB {q(g)} OR path GLOB {q(g)}" for g in [*filters.CONFIG_GLOBS, "p?.ts", "c[0-4]*.py"]
)
ORACLES["config_exclusion"] = sql(
    f"""SELECT project_id, path FROM files
    WHERE NOT list_has_any(string_split(path, '/'), {strings([*filters.CONFIG_DIRS, "jobs"])})
      AND {SUFFIX} NOT IN ({', '.join(q(s) for s in filters.CONFIG_SUFFIXES)}) AND NOT ({_GLOBS})"""
)
ORACLES["files_below_root"] = sql("SELECT project_id, substr(path, 5) AS path FROM web WHERE starts_with(path, 'api/')")
_LANG = f"CASE WHEN {SUFFIX} = '.py' THEN 'py' WHEN {SCRIPT} THEN 'js' WHEN {NAME} = '.env.example' THEN 'env' END"
ORACLES["file_types"] = sql(f"SELECT project_id, {_LANG} AS lang, count(*) AS n_files FROM files GROUP BY ALL")
ORACLES["server_files"] = sql(f"SELECT project_id, path FROM server WHERE {SERVER}")


def code_matches(lang: str, source: str, lines: str) -> str:
    types = [p.type for p in SECRET_PATTERNS if lang in p.langs]
    safe = "regexp_matches(trim(value), '^os\\.(getenv\\(|environ\\[|environ\\.get\\()')" if lang == "py" else "false"
    return f"SELECT project_id, path, {q(lang)} AS lang, type, line, name, value FROM ({matches(lines, 'project_id, path', 'line', types)}) WHERE NOT {safe}"


_CODE = {
    "py_lines": line_table(f"(SELECT * FROM web WHERE {SUFFIX} = '.py')", "project_id, path"),
    "js_lines": line_table(f"(SELECT * FROM server WHERE {SCRIPT})", "project_id, path"),
}
ORACLES["secrets_in_code"] = sql(
    f"{code_matches('py', 'web', 'py_lines')} UNION ALL {code_matches('js', 'server', 'js_lines')}", **_CODE
)
ORACLES["secrets_in_code_by_type"] = sql(
    f"SELECT project_id, type, count(*) AS n_secrets FROM ({code_matches('py', 'web', 'py_lines')}) GROUP BY ALL", **_CODE
)

# --- functions, learning, issues ---------------------------------------------------------

_FUNCTIONS = sql("SELECT project_id, path, line, name, is_async, n_decorators, n_params, returns, line_above FROM functions")
ORACLES["function_table_native"] = _FUNCTIONS
ORACLES["function_table_exact"] = _FUNCTIONS
ORACLES["learned_patterns"] = sql("SELECT project_id, kind, value, path, pos FROM learned")
ORACLES["most_common_patterns"] = sql("SELECT * FROM common")
ORACLES["first_token_handler"] = sql("SELECT * FROM handler")
ORACLES["learned_summary"] = sql("SELECT * FROM summary")
for _name in ("missing_auth", "missing_auth_exact", "missing_auth_by_line_windows"):
    ORACLES[_name] = sql("SELECT * FROM auth")
ORACLES["missing_auth_options"] = sql("SELECT * FROM wide", wide=routes_sql(8, True, True))
ORACLES["missing_csrf"] = sql("SELECT * FROM csrf")
ORACLES["env_var_style"] = sql("SELECT project_id, path, line, issue_type FROM style")
ORACLES["env_var_upper_case"] = sql(
    """SELECT project_id, path, line_no AS line, 'ENV_VAR_STYLE' AS issue_type FROM env_lines
    WHERE contains(line, '=') AND NOT starts_with(ltrim(line), '#')
      AND trim(split_part(line, '=', 1)) <> upper(trim(split_part(line, '=', 1)))"""
)
ORACLES["scan_issues"] = sql("SELECT project_id, issue_type, count(*) AS n_issues FROM found GROUP BY ALL")


def _message(template: str, value: str) -> str:
    before, after = template.split("%s")
    return f"{q(before)} || {value} || {q(after)}"


_hint = f"coalesce({_message(issues._CSRF_HINT, 'token_handler')}, '')"
FINDINGS = f"""
    SELECT project_id, path AS file, line, CASE issue_type
        WHEN 'MISSING_AUTH' THEN {_message(issues._AUTH_TEXT, f"coalesce(auth_decorator, {q(learning.DEFAULT_AUTH)})")}
        WHEN 'MISSING_CSRF' THEN {_message(issues._CSRF_TEXT, _hint)}
        ELSE {_message(issues._ENV_TEXT, 'env_style')} END AS message,
      'medium' AS severity, 'IMPROVEMENT' AS rule_id
    FROM found LEFT JOIN summary USING (project_id)"""
ORACLES["scan_findings"] = sql(FINDINGS)

# --- rewrites ----------------------------------------------------------------------------

_PY_READ = f'os.getenv("%s", "{CHANGE_ME}")'
_JS_READ = f'process.env.%s || "{CHANGE_ME}"'


def fixed_python(source: str) -> str:
    """A web file holds at most one secret, so its fix has number 1."""
    body = "content"
    for p in TOKEN_PATTERNS:
        rx = f"""["']{p.regex}["']"""
        body = f"regexp_replace({body}, {q(rx)}, {q(_PY_READ % 'API_KEY_1')})"
    token = "regexp_matches(content, 'sk_live_[0-9]{10}|ghp_[0-9a-z]{36}')"
    for name in ("SECRET_KEY", "jwt_secret"):
        rx = rf"""\b{name}\s*=\s*["'][^"']+["']"""
        body = f"regexp_replace({body}, {q(rx)}, {q(name + ' = ' + _PY_READ % name.upper())})"
    var = (
        f"CASE WHEN {SUFFIX} <> '.py' THEN '' WHEN {token} THEN 'API_KEY_1' "
        "WHEN contains(content, 'SECRET_KEY = ') THEN 'SECRET_KEY' "
        "WHEN contains(content, 'jwt_secret = ') THEN 'JWT_SECRET' ELSE '' END"
    )
    return f"""
      SELECT project_id, path, content, var, CASE WHEN var = '' THEN content
          WHEN regexp_matches(content, '(?m)^\\s*import os\\b') THEN body ELSE 'import os' || chr(10) || body END AS fixed
      FROM (SELECT *, {body} AS body, {var} AS var FROM {source})"""


_FIXED = """SELECT project_id, path, fixed <> content AS modified, CAST(fixes AS INTEGER) AS fixes, vars, md5(fixed) AS content_md5"""
ORACLES["redacted_python"] = sql(
    f"{_FIXED} FROM (SELECT *, CASE WHEN var = '' THEN 0 ELSE 1 END AS fixes, var AS vars FROM fixed_py)",
    fixed_py=fixed_python("web"),
)
_TOK = "regexp_matches(line, 'sk_test_[0-9]{10}')"
_GEN = f"regexp_matches(line, {q(RE2['GENERIC_SECRET_JS'])})"
_GEN_NAME = f"regexp_extract(line, {q(RE2['GENERIC_SECRET_JS'])}, 2)"
_JS = {
    "sl": f"SELECT *, {_TOK} AS tok, {_GEN} AS gen FROM server_lines WHERE {SCRIPT}",
    "sn": """SELECT *, sum(CASE WHEN tok THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS tok_no FROM sl""",
    "sv": f"""SELECT *, CASE WHEN tok THEN 'API_KEY_' || CAST(tok_no AS BIGINT) WHEN gen THEN upper({_GEN_NAME}) END AS var
      FROM sn""",
    "sr": f"""SELECT *, CASE
        WHEN tok THEN regexp_replace(line, '''sk_test_[0-9]+''', replace({q(_JS_READ)}, '%s', var))
        WHEN gen THEN 'const ' || {_GEN_NAME} || ' = ' || replace({q(_JS_READ)}, '%s', var) || ';'
        ELSE line END AS new_line FROM sv""",
    "fixed_js": f"""
      SELECT project_id, path, any_value(content) AS content, count(var) AS fixes,
        coalesce(string_agg(var, ',' ORDER BY gen, line_no) FILTER (var IS NOT NULL), '') AS vars,
        CASE WHEN count(var) > 0 AND NOT contains(any_value(content), 'process.env')
          THEN {q(rewrite.JS_HEADER)} || chr(10) ELSE '' END
          || string_agg(new_line, chr(10) ORDER BY line_no) || chr(10) AS fixed
      FROM sr GROUP BY project_id, path
      UNION ALL SELECT project_id, path, content, 0, '', content FROM server WHERE NOT ({SCRIPT})""",
    "names": """
      SELECT project_id, name, min((path, pos)) AS first_use FROM (
        SELECT project_id, path, unnest(string_split(vars, ',')) AS name,
          generate_subscripts(string_split(vars, ','), 1) AS pos
        FROM fixed_js WHERE fixes > 0) GROUP BY ALL""",
}
ORACLES["redacted_scripts"] = sql(f"{_FIXED} FROM fixed_js", **_JS)
ORACLES["new_env_names"] = sql(
    """SELECT project_id, name FROM names WHERE (project_id, name) NOT IN (
      SELECT (project_id, value) FROM learned WHERE kind = 'env_var_style')""",
    **_JS,
)
ORACLES["env_upsert"] = sql(
    f"""SELECT project_id, {q(rewrite.ENV_HEADER)} || chr(10)
      || string_agg(name || '=' || chr(10), chr(10) ORDER BY first_use, name) AS content FROM names GROUP BY project_id""",
    **_JS,
)
def _chain(alias: str) -> str:
    bare = f"trim({alias}.line, ' ' || chr(9))"
    return (
        f"(starts_with({bare}, '@') OR ((starts_with({alias}.line, ' ') OR starts_with({alias}.line, chr(9))) "
        f"AND NOT regexp_matches({bare}, '^(def |async def |class )')))"
    )


def inserted(decorator: str) -> dict[str, str]:
    return {
        "ins": f"""
          SELECT a.project_id, a.path, min(l.line_no) - 0.5 AS k,
            any_value(regexp_extract(r.line, '^(\\s*)', 1)) || '@' || any_value({decorator}) AS line
          FROM auth a JOIN web_lines l ON l.path = a.path AND l.line_no >= a.line AND NOT {_chain('l')}
          JOIN web_lines r ON r.path = a.path AND r.line_no = a.line
          LEFT JOIN summary s ON s.project_id = a.project_id GROUP BY a.project_id, a.path, a.line""",
        "merged": """
          SELECT project_id, path, CAST(line_no AS DOUBLE) AS k, line FROM web_lines
          UNION ALL SELECT project_id, path, k, line FROM ins""",
    }


ORACLES["inserted_decorators"] = sql(
    """SELECT project_id, path, path IN (SELECT path FROM auth) AS improved,
      md5(string_agg(line, chr(10) ORDER BY k) || chr(10)) AS content_md5 FROM merged GROUP BY project_id, path""",
    **inserted(f"coalesce(s.auth_decorator, {q(learning.DEFAULT_AUTH)})"),
)
ORACLES["inserted_decorators_by_line_windows"] = sql(
    """SELECT project_id, path, md5(string_agg(line, chr(10) ORDER BY k)) AS content_md5 FROM merged
    WHERE path IN (SELECT path FROM auth) GROUP BY project_id, path""",
    **inserted(q(learning.DEFAULT_AUTH)),
)
ORACLES["upper_cased_env"] = sql(
    """SELECT e.project_id, e.path, bool_or(s.line IS NOT NULL) AS improved,
      string_agg(CASE WHEN s.line IS NULL THEN e.line
        ELSE upper(split_part(e.line, '=', 1)) || substr(e.line, length(split_part(e.line, '=', 1)) + 1) END,
        chr(10) ORDER BY e.line_no) || chr(10) AS improved_content
    FROM env_lines e LEFT JOIN style s ON s.path = e.path AND s.project_id = e.project_id AND s.line = e.line_no
    GROUP BY e.project_id, e.path"""
)
ORACLES["fix_summary"] = sql(
    """SELECT project_id, count(*) AS files, count(*) FILTER (var <> '' OR n > 0) AS files_with_issues,
      CAST(sum(CASE WHEN var <> '' THEN 1 ELSE 0 END) AS BIGINT) AS fixes, CAST(sum(n) AS BIGINT) AS improvements,
      count(*) FILTER (var <> '' OR n > 0) = 0 AS all_clear
    FROM (SELECT *, (SELECT count(*) FROM auth a WHERE a.path = f.path) AS n FROM fixed_py f) GROUP BY project_id""",
    fixed_py=fixed_python("kept"),
)

# --- rules ---------------------------------------------------------------------------------

_DQ, _SQ, _BT = r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'", r"`(?:[^`\\]|\\.)*`"
_STRINGS = {"py": f"{_DQ}|{_SQ}", "js": f"{_DQ}|{_SQ}|{_BT}"}
_COMMENT = {"py": "#.*$", "js": r"//.*$|/\*.*?\*/"}
RULE_OF = {f"{r[0]}/{r[1]}": r for r in RULES}


def code(col: str, lang: str) -> str:
    return f"regexp_replace({col}, {q(f'({_STRINGS[lang]})|{_COMMENT[lang]}')}, '\\1', 'g')"


def bare(col: str, lang: str) -> str:
    return f"regexp_replace({col}, {q(_STRINGS[lang])}, '\"\"', 'g')"


def nested(opening: str, closing: str, depth: int) -> str:
    other = opening[:-1] + closing[1:]
    inner = f"|{nested(opening, closing, depth - 1)}" if depth else ""
    return f"{opening}(?:[^{other[1:-1]}]{inner})*{closing}"


_CALL, _BRACKET = nested(r"[(]", r"[)]", 2), nested(r"[(\[{]", r"[)\]}]", 2)
# Patterns of the oracle's own, where the library's use what this engine has not.
OWN_LINES = {
    "py-security/path.traversal-open": rf"\bopen\((?:[^,)]*\.\.[^,)]*|[\w.]+\((?:[^()]|{_CALL})*\.\.(?:[^()]|{_CALL})*\)\s*),",
    "py-quality/python.assert-without-message": rf"^\s*assert\s+(?:[^,]+|(?:[^,()\[\]{{}}]|{_BRACKET})+)$",
}


def line_rules(lang: str, typed: str = "true") -> str:
    """List of the rules that a line (``line, code, bare``) matches."""
    tests = []
    for key, rule in RULE_OF.items():
        p = PREDICATES[key]
        if p.cls != "L" or ("py" in rule[4]) != (lang == "py"):
            continue
        col = {"none": "line", "comments": "code", "strings": "bare"}[p.mask]
        test = f"regexp_matches({col}, {q(OWN_LINES.get(key, p.regex))})"
        if p.unless:
            test += f" AND NOT regexp_matches({col}, {q(p.unless)})"
        if rule[4] == ("ts",):
            test += f" AND {typed}"
        tests.append(f"CASE WHEN {test} THEN {q(key)} END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


def sample_lines(source: str, lang: str) -> dict[str, str]:
    return {
        "raw_lines": line_table(source, "project_id, path"),
        "coded": f"SELECT *, {code('line', lang)} AS code FROM raw_lines",
        "masked": f"SELECT *, {bare('code', lang)} AS bare FROM coded",
    }


_IS_TSX = f"{SUFFIX} IN ('.ts', '.tsx')"
ORACLES["line_rules_python"] = sql(
    f"SELECT project_id, path, line_no AS line, unnest({line_rules('py')}) AS rule_key FROM masked", **sample_lines("py", "py")
)
TS_LINE_HITS = f"SELECT project_id, path, line_no AS line, unnest({line_rules('js', _IS_TSX)}) AS rule_key FROM masked"
ORACLES["line_rules_scripts"] = sql(TS_LINE_HITS, **sample_lines("ts", "js"))

# Blocks: the text from each line to the end of its file, against the pattern at its start.
_Q = """["']"""
_ACTION = rf"[ \t]*export[ \t]+async[ \t]+function[ \t]+\w+\s*\([^)]*\)[^{{\n]*\{{\s*{_Q}use server{_Q}"
_PAGE = r"[ \t]*export[ \t]+default[ \t]+function[ \t]+\w+\s*\([^)]*\)[^{\n]*\{\s*return[ \t]*\("
_EFFECT = r"[^\n]*?\buseEffect\(\s*\(\s*\)\s*=>\s*\{(?:[^{}]|\{[^{}]*\})*\}\s*\)"
_TEST = rf"[^\n]*?\btest\(\s*{_Q}[^\"'\n]*{_Q}\s*,\s*\(\s*\)\s*=>\s*\{{"
BLOCKS = {
    "py-security/fastapi.cors-wildcard": rf"[^\n]*?\bCORSMiddleware\((?:[^()]|{_CALL})*\ballow_origins\s*=\s*\[{_Q}\*{_Q}\]",
    "py-security/pydantic.missing-validation": r"[ \t]*class[ \t]+\w+\([ \t]*BaseModel[ \t]*\)[ \t]*:\s*\w+[ \t]*:[ \t]*str"
    r"[ \t]*(?:\n[ \t]*)*(?:\n[^ \t\n]|$)",
    "py-security/pydantic.arbitrary-types-allowed": r"    class[ \t]+Config[ \t]*:[ \t]*\n(?:        [^\n]*\n)*?"
    r"        arbitrary_types_allowed[ \t]*=[ \t]*True\b",
    "py-quality/python.exception-swallowing": r"[ \t]*except[ \t]*:\s*pass[ \t]*(?:\n|$)",
    "ts-security/nextjs.missing-metadata": _PAGE,
    "ts-security/nextjs.missing-server-action-validation": _ACTION,
    "ts-security/react.missing-dependency-array": _EFFECT,
    "ts-security/auth.missing-role-check": _ACTION,
    "ts-security/auth.missing-csrf-protection": _ACTION,
    "ts-quality/typescript.complex-function": r"[^\n]*?\bfunction[ \t]+\w+\s*\([^)]*\)[^{};\n]*\{",
    "ts-quality/typescript.arrow-function-complex": r"[^\n]*?\bconst[ \t]+\w+[^=\n]*=[ \t]*(?:async[ \t]+)?"
    r"\([^)]*\)[^=\n]*=>\s*\{",
    "ts-quality/typescript.too-many-parameters": r"[^\n]*?\bfunction\s+\w+\s*\((?:[^,()]*,){5,}[^)]*\)",
    "ts-quality/typescript.test-naming": _TEST,
    "ts-quality/typescript.test-without-expect": _TEST,
    "ts-quality/react.missing-dependency-array": _EFFECT,
    "ts-quality/react.missing-memo": _PAGE,
    "ts-quality/react.hook-rules-violation": r"[^\n]*?\bif[ \t]*\([^\n{]*\)\s*\{[^{}]*\buseState\(",
    "ts-quality/a11y.button-type": r"[^\n]*?<button\b[^>]*>(?:[^<]|<[^/])*</button>",
    "ts-quality/typescript.missing-jsdoc": r"[ \t]*export[ \t]+function[ \t]+\w+\s*\([^)]*\)[^{;\n]*\{",
}


def block_rules(lang: str) -> str:
    tests = []
    for key, rx in BLOCKS.items():
        rule = RULE_OF[key]
        if ("py" in rule[4]) == (lang == "py"):
            typed = f" AND {_IS_TSX}" if rule[4] == ("ts",) else ""
            tests.append(f"CASE WHEN regexp_matches(rest, {q('^' + rx)}){typed} THEN {q(key)} END")
    return f"""SELECT project_id, path, line_no AS line, unnest(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)) AS rule_key
      FROM (SELECT *, string_agg(code, chr(10)) OVER (PARTITION BY path ORDER BY line_no
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM coded)"""


ORACLES["block_rules_python"] = sql(block_rules("py"), **sample_lines("py", "py"))
TS_BLOCK_HITS = block_rules("js")
ORACLES["block_rules_scripts"] = sql(TS_BLOCK_HITS, **sample_lines("ts", "js"))
_ARGS = r"regexp_replace(regexp_extract(code, 'def\s+\w+\((.*)\)\s*(->[^:]*)?:', 1), '\([^()]*\)', '', 'g')"
FUNCTION_HITS = f"""
    SELECT project_id, path, line, unnest(list_filter([
        'py-quality/python.complex-function', 'py-quality/python.long-function', 'py-quality/python.missing-docstring',
        CASE WHEN n >= 6 THEN 'py-quality/python.too-many-arguments' END,
        CASE WHEN n = 1 AND regexp_matches(args, '^\\w+$') THEN 'py-quality/python.missing-type-hints' END,
        CASE WHEN regexp_matches(code, '->\\s*None\\s*:') THEN 'py-quality/python.missing-return-type' END,
        CASE WHEN is_async AND regexp_matches(above, '^@app\\.(get|post|put|delete|patch)\\(')
          THEN 'py-security/fastapi.missing-response-model' END,
        CASE WHEN is_async AND regexp_matches(above, '^@app\\.\\w+\\(') AND regexp_matches(args, ':.*=\\s*Depends')
          THEN 'py-security/fastapi.missing-dependencies' END], lambda x: x IS NOT NULL)) AS rule_key
    FROM (SELECT *, CASE WHEN args = '' THEN 0 ELSE len(string_split(args, ',')) END AS n FROM (
      SELECT project_id, path, line_no AS line, code, {_ARGS} AS args, regexp_matches(code, '^\\s*async\\s') AS is_async,
        lag(code) OVER (PARTITION BY path ORDER BY line_no) AS above FROM coded)
    WHERE regexp_matches(code, '^\\s*(async\\s+)?def\\s+\\w+\\('))"""
ORACLES["function_rules"] = sql(FUNCTION_HITS, **sample_lines("py", "py"))


def pair_rule(key: str) -> str:
    """Two lines of a file with one name; no line between may end the scope."""
    p = PREDICATES[key]

    def groups(col: str, rx: str) -> str:
        n = re.compile(rx).groups
        return "concat_ws(' ', " + ", ".join(f"regexp_extract({col}, {q(rx)}, {i + 1})" for i in range(n)) + ")" if n else "''"

    name = groups("l.code", p.left)
    cond, at = "true", "l.line_no"
    if p.before:
        before = groups("l.above", p.before)
        name = f"concat_ws(' ', {before}, {name})" if re.compile(p.left).groups else before
        cond, at = f"regexp_matches(l.above, {q(p.before)})", "l.above_no"
    ends = {"block": "z.indent < l.indent", "body": "z.indent <= l.indent", "file": "false"}[p.scope]
    family = "py" if "py" in RULE_OF[key][4] else "js"
    return " UNION ".join(
        f"""SELECT DISTINCT l.project_id, l.path, {at} AS line, {q(key)} AS rule_key
        FROM solid l JOIN solid r ON l.path = r.path AND r.line_no > l.line_no
        WHERE l.family = {q(family)} AND regexp_matches(l.code, {q(p.left)}) AND {cond} AND regexp_matches(r.code, {q(rx)})
          AND {name} = {groups('r.code', rx)}
          AND NOT EXISTS (SELECT 1 FROM solid z WHERE z.path = l.path AND z.line_no > l.line_no AND z.line_no <= r.line_no
            AND {ends})"""
        for rx in p.rights
    )


PAIR_KEYS = [k for k, p in PREDICATES.items() if p.cls == "J"]
_SOLID = {
    "raw_py": line_table("py", "project_id, path"),
    "raw_ts": line_table("ts", "project_id, path"),
    "coded_both": f"""SELECT *, 'py' AS family, {code('line', 'py')} AS code FROM raw_py
      UNION ALL SELECT *, 'js', {code('line', 'js')} FROM raw_ts""",
    "solid": """SELECT *, length(regexp_extract(code, '^([ \\t]*)', 1)) AS indent,
        lag(code) OVER (PARTITION BY path ORDER BY line_no) AS above,
        lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS above_no
      FROM coded_both WHERE regexp_matches(code, '\\S')""",
}
PAIR_HITS = " UNION ALL ".join(f"({pair_rule(k)})" for k in PAIR_KEYS)
ORACLES["pair_rules"] = sql(PAIR_HITS, **_SOLID)

# Rule rows as a table; the SQL side joins it as Spark does.
RULE_ROWS = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(k)}, {q(r[1])}, {q(r[2])}, {q(r[3])}, {q(r[5])})" for k, r in RULE_OF.items()
) + ") t(rule_key, rule_id, severity, category, message)"


def _prefixed(ctes: dict[str, str], prefix: str) -> dict[str, str]:
    names = list(ctes)
    out = {}
    for n, body in ctes.items():
        for m in names:
            body = re.sub(rf"\b{m}\b", prefix + m, body)
        out[prefix + n] = body
    return out


def _with_prefix(body: str, ctes: dict[str, str], prefix: str) -> str:
    for m in ctes:
        body = re.sub(rf"\b{m}\b", prefix + m, body)
    return body


_PYS, _TSS = sample_lines("py", "py"), sample_lines("ts", "js")
_ALL_HITS = {
    **_prefixed(_PYS, "p_"),
    **_prefixed(_TSS, "t_"),
    **_SOLID,
    "every_hit": " UNION ALL ".join(
        [
            _with_prefix(
                f"SELECT project_id, path, line_no AS line, unnest({line_rules('py')}) AS rule_key FROM masked", _PYS, "p_"
            ),
            _with_prefix(TS_LINE_HITS, _TSS, "t_"),
            "(" + _with_prefix(block_rules("py"), _PYS, "p_") + ")",
            "(" + _with_prefix(TS_BLOCK_HITS, _TSS, "t_") + ")",
            "(" + _with_prefix(FUNCTION_HITS, _PYS, "p_") + ")",
            PAIR_HITS,
        ]
    ),
    "rule_rows": RULE_ROWS,
}
ORACLES["all_rules_by_severity"] = sql(
    """SELECT project_id, severity, category, count(*) AS n_findings
    FROM every_hit JOIN rule_rows USING (rule_key) GROUP BY ALL""",
    **_ALL_HITS,
)


def text_rules(table: str, key: str, col: str, lang: str, keys: set[str] | None = None) -> dict[str, str]:
    return {
        "raw_lines": f"SELECT {key}, unnest({split_lines(col)}) AS line FROM {table}",
        "coded": f"SELECT *, {code('line', lang)} AS code FROM raw_lines",
        "masked": f"SELECT *, {bare('code', lang)} AS bare FROM coded",
        "text_hits": f"SELECT {key}, unnest({line_rules(lang)}) AS rule_key FROM masked",
    }


ORACLES["line_rules_on_pages"] = sql(
    "SELECT rule_key, count(*) AS n_hits, count(DISTINCT page_id) AS n_pages FROM text_hits GROUP BY ALL",
    **text_rules("pages", "page_id", "html", "js"),
)
ORACLES["line_rules_on_documents"] = sql(
    "SELECT rule_key, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM text_hits GROUP BY ALL",
    **text_rules("documents", "doc_id", "text", "js"),
)
# What the texts of the rules ask for, sample by sample, read off by hand: (sample, line, rule).
_PY_HITS = [
    (0, 1, "python.sql-injection-format"), (0, 1, "python.raw-sql-execution"), (1, 1, "python.sql-injection-fstring"),
    (2, 1, "python.sql-injection-sqlalchemy-fstring"), (3, 1, "python.hardcoded-postgres-url"), (4, 3, "debug.pdb-breakpoint"),
    (5, 4, "debug.pdb-breakpoint"), (6, 1, "python.sql-injection-sqlalchemy-text-percent"), (7, 1, "crypto.weak-hash-md5"),
    (9, 5, "debug.pdb-breakpoint"), (10, 2, "python.sql-injection-fstring"), (11, 1, "python.sql-injection-percent"),
    (11, 1, "python.raw-sql-execution"), (12, 4, "debug.pdb-breakpoint"),
]
_TS_HITS = [
    (0, 2, "security.eval-usage"), (1, 2, "security.eval-usage"), (2, 3, "security.eval-usage"), (2, 5, "security.eval-usage"),
    (3, 1, "security.document-write"), (4, 2, "debug.console-log-production"), (6, 1, "security.inner-html-assignment"),
    (6, 4, "crypto.weak-hash"),
]


def _by_hand(files: dict[str, str], pack: str, hits: list[tuple], samples: int) -> str:
    known = ", ".join(f"({n}, {line}, {q(f'{pack}/{rule}')})" for n, line, rule in hits)
    return f"""SELECT project_id, path, line, rule_key FROM ({corpus.rendered_sql(files)}) f
      JOIN (VALUES {known}) h(sample, line, rule_key)
        ON CAST(regexp_extract(f.path, '[0-9]+') AS BIGINT) % {samples} = h.sample"""


ORACLES["rules_in_strings"] = (
    _by_hand(corpus.PY_STRING_FILES, "py-security", _PY_HITS, len(corpus.PY_STRINGS))
    + " UNION ALL "
    + _by_hand(corpus.TS_STRING_FILES, "ts-security", _TS_HITS, len(corpus.TS_STRINGS))
)
ORACLES["user_rules_many"] = sql(
    f"""SELECT l.project_id, l.path, l.line_no AS line, 'user/p' || p_partkey AS rule_key
    FROM raw_lines l JOIN part ON contains(l.line, 'jwt_secret = "' || p_partkey || '"') WHERE {SUFFIX} = '.py'""",
    raw_lines=line_table("web", "project_id, path"),
)
ORACLES["user_rules"] = sql(
    f"""SELECT l.project_id, l.path, l.line_no AS line, 'user/n' || n_nationkey AS rule_key
    FROM raw_lines l JOIN nation ON contains(l.line, 'jwt_secret = "' || n_nationkey || '"') WHERE {SUFFIX} = '.py'""",
    raw_lines=line_table("web", "project_id, path"),
)
_TS_FOUND = {
    **_TSS,
    "rule_rows": RULE_ROWS,
    "ts_hits": TS_LINE_HITS,
    "ts_found": "SELECT h.*, r.* EXCLUDE (rule_key) FROM ts_hits h JOIN rule_rows r USING (rule_key)",
}
ORACLES["severe_findings"] = sql(
    """SELECT rule_id, severity, count(*) AS n_findings FROM ts_found WHERE severity IN ('ERROR', 'WARNING') GROUP BY ALL""",
    **_TS_FOUND,
)
ORACLES["findings_without_rules"] = sql(
    """SELECT rule_id, count(*) AS n_findings FROM ts_found
    WHERE rule_id NOT IN ('typescript.consistent-naming', 'typescript.any-type-usage')
    GROUP BY ALL HAVING count(*) % 2 <> 0""",
    **_TS_FOUND,
)
_LEVEL = "CASE severity " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in RULE_TO_FINDING.items()) + " END"
ORACLES["findings_by_severity"] = sql(
    f"""SELECT project_id, severity, CAST(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 5 END AS INTEGER)
      AS severity_rank, count(*) AS n_findings
    FROM (SELECT project_id, {_LEVEL} AS severity FROM ts_found) GROUP BY project_id, severity""",
    **_TS_FOUND,
)
ORACLES["distinct_rules"] = sql(
    "SELECT project_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids FROM ts_found GROUP BY project_id",
    **_TS_FOUND,
)
ORACLES["severity_pivot"] = sql(
    """SELECT project_id, category, count(*) FILTER (severity = 'ERROR') AS n_error,
      count(*) FILTER (severity = 'WARNING') AS n_warning, count(*) FILTER (severity = 'INFO') AS n_info
    FROM ts_found GROUP BY ALL""",
    **_TS_FOUND,
)
ORACLES["exit_status"] = sql(
    """SELECT project_id, count(a.path) AS n_findings, CAST(CASE WHEN count(a.path) > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_status
    FROM (SELECT DISTINCT project_id FROM web) LEFT JOIN auth a USING (project_id) GROUP BY project_id"""
)

ORACLES["exit_status_of_raw_files"] = """
    SELECT project_id, CAST((kind = 1)::INT + (s_suppkey % 2 = 0)::INT AS BIGINT) AS n_findings,
      CAST(CASE WHEN kind IN (2, 3, 4) THEN 2 WHEN kind = 1 OR s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_status
    FROM (SELECT 's' || s_suppkey AS project_id, s_suppkey, s_suppkey % 5 AS kind FROM supplier)"""
ORACLES["file_outcomes"] = """
    SELECT path, failed, count(*) AS n_files FROM (
      SELECT 'app.py' AS path, CASE s_suppkey % 5 WHEN 2 THEN 'decode' WHEN 3 THEN 'parse' WHEN 4 THEN 'read' END AS failed FROM supplier
      UNION ALL SELECT 'api/more.py', NULL FROM supplier) GROUP BY ALL"""

# --- reports on findings -----------------------------------------------------------------

_SECRET_FOUND = {
    "doc_lines": DOC_LINES,
    "hits": HITS,
    "secret_found": """SELECT source AS project_id, 'doc/' || doc_id AS file, line, 'Secret of type ' || type AS message,
      CASE WHEN lang = 'en' THEN 'high' ELSE 'medium' END AS severity, lower(type) AS rule_id FROM hits""",
}
_ORDER = "ORDER BY file, line, message, severity, rule_id"
_FINDINGS_JSON = f"""SELECT project_id, 0 AS part, 1 AS parts, CAST(to_json({{'findings': list({{'file': file, 'line': line,
      'message': message, 'severity': severity, 'rule_id': rule_id}} {_ORDER})}}) AS VARCHAR) AS report
    FROM secret_found GROUP BY project_id"""
ORACLES["findings_json"] = sql(_FINDINGS_JSON, **_SECRET_FOUND)
ORACLES["findings_json_of_unnamed"] = sql(
    _FINDINGS_JSON.replace("FROM secret_found", "FROM (SELECT * REPLACE (nullif(project_id, 'src1') AS project_id) FROM secret_found)"),
    **_SECRET_FOUND,
)
_TOOL = f"'name': {q(reports.TOOL_NAME)}, 'version': {q(reports.TOOL_VERSION)}"


def sarif(results: str, rules: str) -> str:
    return (
        f"CAST(to_json({{'version': {q(reports.SARIF_VERSION)}, '$schema': {q(reports.SARIF_SCHEMA)}, 'runs': "
        f"[{{'tool': {{'driver': {{{_TOOL}, 'rules': {rules}}}}}, 'results': {results}}}]}}) AS VARCHAR)"
    )


def sarif_result(rule: str, message: str, uri: str, line: str) -> str:
    return (
        f"{{'ruleId': {rule}, 'level': 'warning', 'message': {{'text': {message}}}, 'locations': [{{'physicalLocation': "
        f"{{'artifactLocation': {{'uri': {uri}}}, 'region': {{'startLine': {line}, 'startColumn': 1}}}}}}]}}"
    )


_RULE_ITEM = """{'id': x, 'name': x, 'shortDescription': {'text': 'Security finding'},
      'defaultConfiguration': {'level': 'warning'}}"""
ORACLES["findings_sarif"] = sql(
    "SELECT project_id, 0 AS part, 1 AS parts, "
    + sarif(
        f"list({sarif_result('rule_id', 'message', 'file', 'line')} {_ORDER})",
        f"list_transform(list_sort(list_distinct(list(rule_id))), lambda x: {_RULE_ITEM})",
    )
    + " AS report FROM secret_found GROUP BY project_id",
    **_SECRET_FOUND,
)
_POINT = "'- **' || file || ':' || line || '** - ' || message || ' (`' || rule_id || '`)'"


def _md_block(level: str) -> str:
    return (
        f"CASE WHEN count(*) FILTER (severity = '{level}') > 0 THEN chr(10) || '### {reports.SEVERITY_SIGNS[level]} "
        f"{level.capitalize()} (' || count(*) FILTER (severity = '{level}') || ')' || chr(10) || "
        f"string_agg({_POINT}, chr(10) {_ORDER}) FILTER (severity = '{level}') || chr(10) ELSE '' END"
    )


ORACLES["findings_markdown"] = sql(
    f"""SELECT p.project_id, 0 AS part, 1 AS parts, coalesce(r.report, {q(reports.NO_ISSUES)}) AS report
    FROM (SELECT DISTINCT source AS project_id FROM documents) p LEFT JOIN (
      SELECT project_id, '## Security Findings' || chr(10) || {_md_block('high')} || {_md_block('medium')} AS report
      FROM secret_found GROUP BY project_id) r USING (project_id)""",
    **_SECRET_FOUND,
)
ORACLES["findings_by_file"] = sql(
    f"""SELECT project_id, 0 AS part, md5('## Security Findings' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY file) || chr(10)) AS report_md5
    FROM (SELECT project_id, file, '### ' || file || chr(10) || chr(10) || string_agg('- Line ' || line || ' [' || severity || '] ' || message || ' (`'
        || rule_id || '`)', chr(10) {_ORDER}) AS block FROM secret_found GROUP BY project_id, file) GROUP BY project_id""",
    **_SECRET_FOUND,
)
ORACLES["findings_in_parts"] = sql(
    """SELECT project_id, count(*) AS n_items, CAST(ceil(count(*) / 50.0) AS BIGINT) AS parts FROM ts_found GROUP BY project_id""",
    **_TS_FOUND,
)

# --- diffs -----------------------------------------------------------------------------------

_SO_FAR = "OVER (PARTITION BY diff_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_HEAD = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _num(group: int, missing: int) -> str:
    got = f"regexp_extract(head, {q(_HEAD)}, {group})"
    return f"CAST(CASE WHEN head IS NULL THEN 0 WHEN {got} = '' THEN {missing} ELSE CAST(nullif({got}, '') AS INTEGER) END AS INTEGER)"


def _first(rx: str) -> str:
    return f"max(nullif(regexp_extract(line, {q(rx)}, 1), ''))"


_DIFF = {
    "diffs": corpus.rendered_sql(corpus.DIFFS),
    "dl": line_table("diffs", "diff_id", "text"),
    "dn": f"""SELECT *, count(*) FILTER (starts_with(line, 'diff --git ')) {_SO_FAR} AS file_no,
        max(CASE WHEN starts_with(line, 'diff --git ') THEN line_no END) {_SO_FAR} AS file_at,
        max(CASE WHEN starts_with(line, '@@ -') THEN line_no END) {_SO_FAR} AS hunk_at FROM dl""",
    "dh": """SELECT *, CASE WHEN hunk_at > file_at THEN hunk_at END AS hunk,
        starts_with(line, '+') AND NOT starts_with(line, '+++') AS is_add,
        starts_with(line, '-') AND NOT starts_with(line, '---') AS is_del,
        starts_with(line, '+') OR starts_with(line, ' ') OR line = '' AS is_new FROM dn""",
    "dfiles": f"""
      SELECT diff_id, file_no, bool_or(line LIKE 'Binary files % differ') AS is_binary,
        bool_or(line LIKE 'new file mode%') AS is_created, bool_or(line LIKE 'deleted file mode%') AS is_gone,
        bool_or(line LIKE 'rename from %') AS is_renamed,
        coalesce({_first('^--- a/(.+)$')}, {_first('^diff --git a/(.+?) b/')}) AS old_name,
        coalesce({_first('^[+]{3} b/(.+)$')}, {_first('^diff --git a/.+? b/(.+)$')}) AS new_name
      FROM dh WHERE hunk IS NULL GROUP BY ALL""",
    "dbody": """
      SELECT diff_id, file_no, hunk, max(CASE WHEN line_no = hunk THEN line END) AS head,
        count(*) FILTER (is_add) AS additions, count(*) FILTER (is_del) AS deletions, list(line ORDER BY line_no) AS lines
      FROM dh WHERE hunk IS NOT NULL GROUP BY ALL""",
    "hunks": f"""
      SELECT f.diff_id, CAST(f.file_no AS INTEGER) AS file_no,
        CAST(row_number() OVER (PARTITION BY f.diff_id, f.file_no ORDER BY hunk) AS INTEGER) AS hunk_no,
        CASE WHEN is_gone THEN old_name ELSE new_name END AS file_path, {_num(1, 0)} AS old_start, {_num(2, 1)} AS old_count,
        {_num(3, 0)} AS new_start, {_num(4, 1)} AS new_count, coalesce(lines, []) AS lines,
        CASE WHEN is_created THEN 'added' WHEN is_gone THEN 'deleted' WHEN is_renamed THEN 'renamed' ELSE 'modified' END
          AS diff_type,
        CAST(coalesce(additions, 0) AS INTEGER) AS additions, CAST(coalesce(deletions, 0) AS INTEGER) AS deletions,
        CASE WHEN NOT is_created THEN old_name END AS old_file, CASE WHEN NOT is_gone THEN new_name END AS new_file,
        is_binary, hunk
      FROM dfiles f LEFT JOIN dbody b ON b.diff_id = f.diff_id AND b.file_no = f.file_no""",
    "totals": """SELECT diff_id, CAST(sum(additions) AS BIGINT) AS total_additions, CAST(sum(deletions) AS BIGINT) AS total_deletions,
      count(DISTINCT file_path) AS total_files FROM hunks GROUP BY diff_id""",
    "added": """
      SELECT * , row_number() OVER (PARTITION BY diff_id ORDER BY seen_at) AS rule_no FROM (
        SELECT d.diff_id, h.file_path, d.is_add, d.line_no AS seen_at, substr(d.line, 2) AS line,
          CAST(h.new_start + sum(CASE WHEN d.is_new THEN 1 ELSE 0 END)
            OVER (PARTITION BY d.diff_id, d.hunk ORDER BY d.line_no) - 1 AS INTEGER) AS line_no
        FROM dh d JOIN hunks h ON h.diff_id = d.diff_id AND h.hunk = d.hunk WHERE NOT h.is_binary) WHERE is_add""",
}
ORACLES["diff_hunks"] = sql(
    "SELECT * EXCLUDE (hunk, lines), md5(array_to_string(lines, chr(10))) AS lines FROM hunks", **_DIFF
)
ORACLES["diff_totals"] = sql("SELECT * FROM totals", **_DIFF)
ORACLES["changed_lines"] = sql(
    "SELECT diff_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '+'))) AS changed_lines FROM diffs",
    **_DIFF,
)
ORACLES["added_lines"] = sql("SELECT diff_id, file_path, line_no, line, rule_no FROM added", **_DIFF)
ORACLES["diff_lines_by_windows"] = sql(
    f"""SELECT diff_id, line_no, file_path, new_start, CAST(CASE WHEN is_new AND new_start IS NOT NULL THEN new_start
        + sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id, file_at, hunk ORDER BY line_no) - 1 END AS INTEGER)
      AS new_line_no
    FROM (SELECT d.*, regexp_extract(f.line, '^diff --git a/.+? b/(.+)$', 1) AS file_path,
        CAST(nullif(regexp_extract(h.line, {q(_HEAD)}, 3), '') AS INTEGER) AS new_start
      FROM dh d JOIN dl f ON f.diff_id = d.diff_id AND f.line_no = d.file_at
      LEFT JOIN dl h ON h.diff_id = d.diff_id AND h.line_no = d.hunk)""",
    **_DIFF,
)
_NOISE = (
    f"({NAME} GLOB '*.lock' OR {NAME} IN ({', '.join(q(f) for f in filters.LOCK_FILES)}) OR {NAME} GLOB '*.min.*' "
    f"OR {NAME} GLOB '*.png' OR {NAME} GLOB '*.d.ts')"
).replace("path", "file_path")
ORACLES["hunks_without_noise"] = sql(
    f"""SELECT diff_type, is_binary, count(*) AS n_hunks, CAST(sum(additions) AS BIGINT) AS additions FROM hunks
    WHERE NOT {_NOISE} GROUP BY ALL""",
    **_DIFF,
)
_IN_ORDER = "ORDER BY file_no, hunk_no"
ORACLES["diff_markdown"] = sql(
    f"""SELECT diff_id, '**Summary**: ' || any_value(total_files) || ' files, +' || any_value(total_additions) || ' -'
      || any_value(total_deletions) || chr(10) || chr(10) || string_agg('### ' || file_path || CASE WHEN is_binary
        THEN ' (binary)' || chr(10) || '*Binary file changed*' ELSE chr(10) || chr(10) || '```diff' || chr(10)
        || array_to_string(list_append(lines, '```'), chr(10)) || chr(10) END, chr(10) {_IN_ORDER}) AS report
    FROM hunks JOIN totals USING (diff_id) GROUP BY diff_id""",
    **_DIFF,
)
ORACLES["diff_json"] = sql(
    f"""SELECT diff_id, CAST(to_json({{'total_files': any_value(total_files), 'total_additions': any_value(total_additions),
      'total_deletions': any_value(total_deletions), 'is_truncated': false, 'truncation_reason': NULL, 'files':
      list({{'file': file_path, 'old_file': old_file, 'new_file': new_file, 'diff_type': diff_type, 'additions': additions,
        'deletions': deletions, 'lines': lines, 'is_binary': is_binary}} {_IN_ORDER})}}) AS VARCHAR) AS report
    FROM hunks JOIN totals USING (diff_id) GROUP BY diff_id""",
    **_DIFF,
)
_RESULTS = """SELECT diff_id, rule_no, format('SL{:04d}', rule_no) AS rule_id, file_path AS uri, line_no,
    'Added line: ' || trim(line) AS message FROM added"""
_ADDED_RULE = f"""{{'id': rule_id, 'name': {q(reports.ADDED_NAME)}, 'shortDescription': {{'text': {q(reports.ADDED_SHORT)}}},
    'fullDescription': {{'text': {q(reports.ADDED_FULL)}}}, 'defaultConfiguration': {{'level': 'warning'}}}}"""
ORACLES["diff_sarif_results"] = sql("SELECT * EXCLUDE (rule_no) FROM results", results=_RESULTS, **_DIFF)
ORACLES["diff_sarif"] = sql(
    "SELECT diff_id, "
    + sarif(
        f"coalesce(list({sarif_result('rule_id', 'message', 'uri', 'line_no')} ORDER BY rule_no) FILTER (rule_no IS NOT NULL), [])",
        f"coalesce(list({_ADDED_RULE} ORDER BY rule_no) FILTER (rule_no IS NOT NULL), [])",
    )
    + " AS report FROM (SELECT DISTINCT diff_id FROM hunks) LEFT JOIN results USING (diff_id) GROUP BY diff_id",
    results=_RESULTS,
    **_DIFF,
)

# --- gate --------------------------------------------------------------------------------------

_SECRET_RULE = "('secret-detection', 'secret-detection', 'ERROR', 'security', 'Hardcoded secret detected')"


def _secret_test(lang: str) -> str:
    return " + ".join(n_matches("line", p.type) for p in SECRET_PATTERNS if lang in p.langs) + " > 0"


def _added_rules(lang: str, test: str) -> str:
    typed = _IS_TSX
    return f"""SELECT diff_id, path, line_no, unnest(list_concat({line_rules(lang, typed)},
        CASE WHEN {_secret_test(lang)} THEN ['secret-detection'] ELSE [] END)) AS rule_key
      FROM (SELECT *, {bare('code', lang)} AS bare FROM (SELECT *, {code('line', lang)} AS code FROM quiet)) WHERE {test}"""


_REVIEW = {
    **_DIFF,
    "rule_rows": f"{RULE_ROWS} UNION ALL SELECT * FROM (VALUES {_SECRET_RULE})",
    "quiet": f"SELECT *, file_path AS path FROM added WHERE NOT {_NOISE}",
    "review_hits": f"{_added_rules('py', f'{SUFFIX} = {q(chr(46) + chr(112) + chr(121))}')} UNION ALL {_added_rules('js', SCRIPT)}",
    "review_found": """SELECT diff_id AS pr_id, path AS file, line_no AS line, severity, category, message, rule_id
      FROM review_hits JOIN rule_rows USING (rule_key)""",
    "categories": """
      SELECT pr_id, count(*) FILTER (category = 'security' AND severity = 'ERROR') AS security_errors,
        count(*) FILTER (category = 'security' AND severity = 'WARNING') AS security_warnings,
        count(*) FILTER (category = 'security') AS security,
        count(*) FILTER (category IN ('maintainability', 'performance', 'clean-code')) AS quality,
        count(*) FILTER (category = 'testing') AS testing, bool_or(contains(lower(file), 'test')) AS touches_tests,
        count(*) FILTER (severity = 'ERROR') AS errors, count(*) AS n_findings,
        count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos
      FROM review_found GROUP BY pr_id""",
    "gated": """
      SELECT *, CASE WHEN auto_approvable THEN 'PASS' WHEN errors > 0 THEN 'FAIL' ELSE 'WARNING' END AS status,
        CASE WHEN testing > 0 THEN 'gaps' WHEN NOT touches_tests THEN 'none' END AS test_check,
        CAST(CASE WHEN errors > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_status
      FROM (SELECT *, risk_score <= 0.35 AND errors = 0 AND changed_lines <= 400 AS auto_approvable FROM (
        SELECT d.diff_id AS pr_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '+'))) AS INTEGER)
            AS changed_lines,
          coalesce(errors, 0) AS errors, coalesce(n_findings, 0) AS n_findings, coalesce(testing, 0) AS testing,
          coalesce(security, 0) AS security, coalesce(security_errors, 0) AS security_errors,
          coalesce(security_warnings, 0) AS security_warnings, coalesce(quality, 0) AS quality,
          coalesce(touches_tests, false) AS touches_tests,
          round(least(1.0::DOUBLE, coalesce(errors, 0) * 0.8::DOUBLE + coalesce(warnings, 0) * 0.5::DOUBLE
            + coalesce(infos, 0) * 0.1::DOUBLE), 4) AS risk_score
        FROM diffs d LEFT JOIN categories c ON c.pr_id = d.diff_id))""",
    "tops": """
      SELECT pr_id, string_agg('- [' || severity || '] ' || category || ': ' || message, chr(10) ORDER BY rank) AS tops
      FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY CASE severity WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2
        ELSE 3 END, category, file, message) AS rank FROM review_found) WHERE rank <= 10 GROUP BY pr_id""",
}
# The lines that are added hold one kind of secret only.
_REVIEW["fixes"] = f"""
      SELECT diff_id AS pr_id, path AS file, line_no AS line, {q(review.FIX_ACTION)} AS action,
        path || ':' || line_no || ' becomes `' || trim(regexp_replace(line, '(token) = "[^"]+"', {q('\\1 = ' + _PY_READ % 'TOKEN')})) || '`' AS description
      FROM quiet WHERE path LIKE '%.py' AND regexp_matches(line, 'token = "[^"]+"')"""
_REVIEW["best"] = """
      SELECT pr_id, string_agg('- **' || action || '**: ' || description, chr(10) ORDER BY rank) AS best
      FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY action, description) AS rank FROM fixes) WHERE rank <= 5 GROUP BY pr_id"""
ORACLES["review_gate_settings"] = sql(
    """SELECT pr_id, changed_lines, errors, n_findings, risk_score, ok AS auto_approvable, has_tests,
      CASE WHEN ok THEN 'PASS' WHEN errors > 0 THEN 'FAIL' ELSE 'WARNING' END AS status
    FROM (SELECT *, risk_score <= 0.5 AND errors = 0 AND changed_lines <= 8 AND has_tests AS ok FROM (
      SELECT d.diff_id AS pr_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '+'))) AS INTEGER) AS changed_lines,
        coalesce(errors, 0) AS errors, coalesce(warnings, 0) + coalesce(errors, 0) AS n_findings,
        round(least(1.0::DOUBLE, coalesce(errors, 0) * 0.3::DOUBLE + coalesce(warnings, 0) * 0.1::DOUBLE), 4) AS risk_score,
        len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'diff --git ') AND contains(lower(x), 'test'))) > 0 AS has_tests
      FROM diffs d LEFT JOIN (
        SELECT pr_id, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings
        FROM review_found WHERE file LIKE '%.py' AND rule_id <> 'debug.print-in-production' GROUP BY pr_id) c ON c.pr_id = d.diff_id))""",
    **_REVIEW,
)
ORACLES["review_fixes"] = sql("SELECT * FROM fixes", **_REVIEW)
ORACLES["review_findings"] = sql("SELECT * FROM review_found", **_REVIEW)
ORACLES["review_categories"] = sql(
    "SELECT pr_id, security_errors, security_warnings, quality, testing, touches_tests FROM categories", **_REVIEW
)
ORACLES["review_gate"] = sql(
    """SELECT pr_id, changed_lines, errors, n_findings, risk_score, auto_approvable, status, test_check, exit_status
    FROM gated""",
    **_REVIEW,
)
ORACLES["review_comments"] = sql(
    """SELECT pr_id, '## Code review ' || status || chr(10) || chr(10) || '**Risk Score:** ' || CAST(risk_score AS VARCHAR)
      || ' | **Auto-Approvable:** ' || CASE WHEN auto_approvable THEN 'Yes' ELSE 'No' END || chr(10) || chr(10)
      || '### Checks' || chr(10)
      || CASE WHEN security > 0 THEN '- Security: ' || security_errors || ' errors, ' || security_warnings || ' warnings'
        || chr(10) ELSE '' END
      || CASE WHEN quality > 0 THEN '- Quality: ' || quality || ' suggestions' || chr(10) ELSE '' END
      || CASE test_check WHEN 'gaps' THEN '- Test Coverage: gaps detected' || chr(10)
        WHEN 'none' THEN '- Test Coverage: no tests in changes' || chr(10) ELSE '' END
      || chr(10) || CASE WHEN tops IS NULL THEN '' ELSE '### Top Findings' || chr(10) || tops || chr(10) || chr(10) END
      || CASE WHEN best IS NULL THEN '' ELSE '### Suggested Fixes' || chr(10) || best || chr(10) || chr(10) END
      || '---' AS comment
    FROM gated LEFT JOIN tops USING (pr_id) LEFT JOIN best USING (pr_id)""",
    **_REVIEW,
)
ORACLES["gate_by_source"] = sql(
    f"""SELECT project_id, changed_lines, n_findings, risk_score, ok AS auto_approvable,
      CASE WHEN ok THEN 'PASS' ELSE 'WARNING' END AS status
    FROM (SELECT *, risk_score <= 0.35 AND changed_lines <= 400 AS ok FROM (
      SELECT p.project_id, changed_lines, coalesce(n, 0) AS n_findings,
        round(least(1.0::DOUBLE, coalesce(high, 0) * 0.8::DOUBLE + coalesce(medium, 0) * 0.5::DOUBLE), 4) AS risk_score
      FROM (SELECT source AS project_id, CAST(sum(len({split_lines('text')})) AS BIGINT) AS changed_lines FROM documents
        GROUP BY source) p
      LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (severity = 'high') AS high,
        count(*) FILTER (severity = 'medium') AS medium FROM secret_found GROUP BY project_id) f USING (project_id)))""",
    **_SECRET_FOUND,
)

# --- kinds that the given texts do not hold -------------------------------------------------


def _token(key: str, i: int) -> str:
    prefix, n = spark_queries.TOKENS[i]
    return f"'{prefix}' || left(repeat(md5(CAST({key} AS VARCHAR)), 2), {n})"


_KINDS = [p.type for p in TOKEN_PATTERNS]
ORACLES["token_kinds"] = " UNION ALL ".join(
    f"SELECT c_custkey, {q(t)} AS type, 2 AS line, {_token('c_custkey', i)} AS match FROM customer WHERE c_custkey % {len(_KINDS)} = {i}"
    for i, t in enumerate(_KINDS)
)
ORACLES["redacted_three_tokens"] = f"""SELECT 's' || s_suppkey AS project_id, 'import os' || chr(10)
      || {" || ".join(f"{q(f'{n} = ' + _PY_READ % f'API_KEY_{i}')} || chr(10)" for i, n in enumerate("abc", 1))} AS fixed_content,
      3 AS fixes, 'API_KEY_1,API_KEY_2,API_KEY_3' AS vars FROM supplier"""
ORACLES["env_upsert_existing"] = f"""SELECT 's' || s_suppkey AS project_id, CASE s_suppkey % 3
      WHEN 0 THEN 'TOKEN=x' || chr(10) || chr(10) || 'PASSWORD=' || chr(10)
      WHEN 1 THEN 'OTHER=1' || chr(10) || chr(10) || 'TOKEN=' || chr(10) || chr(10) || 'PASSWORD=' || chr(10)
      ELSE {q(rewrite.ENV_HEADER)} || chr(10) || 'TOKEN=' || chr(10) || chr(10) || 'PASSWORD=' || chr(10) END AS content FROM supplier"""
ORACLES["report_formats"] = " UNION ALL ".join(
    f"SELECT {q(name)} AS format, project_id, md5(report) AS report_md5 FROM ({ORACLES[f'findings_{of}']}) WHERE report <> {q(reports.NO_ISSUES)}"
    for name, of in (("json", "json"), ("sarif", "sarif"), ("md", "markdown"))
)
ORACLES["report_files"] = f"SELECT project_id, md5(report || chr(10)) AS content_md5 FROM ({ORACLES['findings_markdown']})"
