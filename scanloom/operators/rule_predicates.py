"""How each built-in rule is matched: one entry per rule, as data.

Classes
    ``L`` one line, by regex. ``B`` a block: a regex over the numbered text that
    may cross lines. ``F`` a condition on the function table. ``J`` two lines
    of one file that share a bound name, the second inside the block or the
    loop body of the first.

Mask of a line rule
    ``comments`` (dropped; the default), ``strings`` (comments dropped and
    string literals emptied), ``none`` (the line as it is); see ``functions.lexer``.

Where the text of a rule asks for more than its pattern tests, the pattern
decides; ``strict`` then leaves out what the text would accept.
"""

from __future__ import annotations

from dataclasses import dataclass

from scanloom.functions.text import MARK, MARK_CLOSE, MARK_OPEN


@dataclass(frozen=True)
class Line:
    regex: str
    mask: str = "comments"
    unless: str | None = None  # such lines never match
    strict: str | None = None  # such lines do not match when strict
    hints: tuple[str, ...] = ()  # every matching line holds one of these literals
    cls: str = "L"


@dataclass(frozen=True)
class Block:
    regex: str  # from the start of a line, after its mark; groups count from 2
    mask: str = "comments"
    strict: str | None = None  # replaces regex when strict
    hint: str = ""  # a literal that every match holds
    cls: str = "B"


@dataclass(frozen=True)
class Func:
    condition: str  # SQL over the function struct f
    strict: str | None = None  # replaces condition when strict
    cls: str = "F"

    def test(self, strict: bool) -> str:
        return self.strict if strict and self.strict else self.condition


@dataclass(frozen=True)
class Pair:
    left: str  # its groups joined by a blank are the bound name
    rights: tuple[str, ...]
    scope: str  # block (same block or deeper), body (deeper only) or file
    before: str | None = None  # the code line before left must match; its groups come first in the name
    mask: str = "comments"
    hints: tuple[str, ...] = ()  # every second line holds one of these literals
    left_hint: str = "="  # every first line holds this literal
    cls: str = "J"


Q = r"""["']"""
QJ = r"""["'`]"""
W = rf"(?:\s|{MARK})*+"  # blanks, also across lines
_CLASS_END = rf"[ \t]*(?:\n(?:{MARK}[ \t]*\n)*(?:{MARK}(?:[^ \t\n]|[ \t]*\z)|\z)|\z)"


def _braces(depth: int) -> str:
    inner = f"|{_braces(depth - 1)}" if depth else ""
    return rf"\{{(?:[^{{}}]++{inner})*+\}}"


def _parens(depth: int) -> str:
    inner = f"|{_parens(depth - 1)}" if depth else ""
    return rf"\((?:[^()]++{inner})*+\)"


def _undotted(depth: int) -> str:
    inner = f"|{_undotted(depth - 1)}" if depth else ""
    return rf"\((?:[^().]++|\.(?!\.){inner})*+\)"


def _dotted(depth: int) -> str:
    """Parentheses that hold two dots somewhere."""
    inner = f"|{_dotted(depth - 1)}" if depth else ""
    return rf"\((?:[^().]++|\.(?!\.)|{_undotted(depth)})*+(?:\.\.{inner})(?:[^()]++|{_parens(depth)})*+\)"


def _any_brackets(depth: int) -> str:
    inner = f"|{_any_brackets(depth - 1)}" if depth else ""
    return rf"[(\[{{](?:[^()\[\]{{}}]++{inner})*+[)\]}}]"


_ANY_TYPE = Line(r"\w+\s*:\s*any\b", "strings", hints=("any",))
_TS_IGNORE = Line(r"//\s*@ts-ignore", "none", hints=("@ts-ignore",))
_NON_NULL = Line(r"[\w)\]]!([^=]|$)", "strings", hints=("!",))
_MAP_KEYS = Line(r"\.map\(\s*\(?\s*\w+\s*\)?\s*=>\s*\(?\s*<\w", strict=r"\bkey=", hints=(".map(",))
_SET_STATE = Line(r"\bset\w+\(\s*\w+\s*=>", "strings", hints=("=>",))
_CONST = Line(r"\bconst\s+\w+\s*(:[^=]+)?=", "strings", hints=("const",))
_SERVER_ACTION = Block(
    rf"[ \t]*export[ \t]+async[ \t]+function[ \t]+\w+{W}\([^)]*\)[^{{\n]*\{{{W}{Q}use server{Q}", hint="use server"
)
_PAGE = Block(
    rf"[ \t]*export[ \t]+default[ \t]+function[ \t]+\w+{W}\([^)]*\)[^{{\n]*\{{{W}return[ \t]*\(", hint="export"
)
_EFFECT = Block(rf"[^\n]*?\buseEffect\({W}\({W}\){W}=>{W}{_braces(15)}{W}\)", "strings", hint="useEffect(")
_TEST = Block(rf"[^\n]*?\btest\({W}{Q}[^\"'\n]*{Q}{W},{W}\({W}\){W}=>{W}\{{", hint="test(")
_EVERY_FUNCTION = Func("true")
_EXECUTE = r"\bcursor\.execute\(\s*(\w+)\s*[,)]"

PREDICATES = {
    # --- Python, security
    "py-security/python.hardcoded-jwt-secret": Line(
        rf"\b(JWT_SECRET(_KEY)?|SECRET_KEY|jwt_secret|secret_key)\s*=\s*{Q}", hints=("SECRET_KEY", "JWT_SECRET", "secret_key", "jwt_secret")),
    "py-security/python.hardcoded-database-url": Line(
        rf"\b(DATABASE_URL|SQLALCHEMY_DATABASE_URI)\s*=\s*{Q}|\b(postgresql|mysql|mongodb)\b", "strings", hints=("DATABASE_UR", "postgresql", "mysql", "mongodb")),
    "py-security/python.hardcoded-api-key": Line(
        rf"\b(API_KEY|OPENAI_API_KEY|ANTHROPIC_API_KEY|GITHUB_TOKEN|STRIPE_SECRET_KEY)\s*=\s*{Q}", hints=("API_KEY", "GITHUB_TOKEN", "STRIPE_SECRET_KEY")),
    "py-security/python.password-in-config": Line(rf"\b(password|pwd|passwd)\s*=\s*{Q}", hints=("password", "pwd", "passwd")),
    "py-security/python.sql-injection-fstring": Pair(
        rf"^\s*(\w+)\s*=\s*f{Q}.*\{{", (_EXECUTE,), "block", hints=("cursor.execute(",)
    ),
    "py-security/python.sql-injection-format": Pair(
        rf"^\s*(\w+)\s*=\s*{Q}.*\{{.*\.format\(", (_EXECUTE,), "block", hints=("cursor.execute(",)
    ),
    "py-security/python.sql-injection-percent": Pair(
        rf"^\s*(\w+)\s*=\s*{Q}[^\"']*{Q}\s*%\s*\(", (_EXECUTE,), "block", hints=("cursor.execute(",)
    ),
    # The pattern tests the variable's name, which can hold none of the signs;
    # testing the assigned value is what its text means.
    "py-security/python.raw-sql-execution": Pair(
        rf"^\s*(\w+)\s*=\s*{Q}[^\"']*[{{%$]", (_EXECUTE,), "block", hints=("cursor.execute(",)
    ),
    # The pattern does not tie the two names.
    "py-security/python.sql-injection-sqlalchemy-fstring": Pair(
        rf"^\s*query\s*=\s*f{Q}.*\{{", (r"\.execute\(\s*text\(\s*\w+\s*\)",), "block", left_hint="query", hints=("text(",)
    ),
    "py-security/python.sql-injection-sqlalchemy-text-fstring": Line(r"""\.execute\(\s*text\(\s*f["'][^"']*\{""", hints=("text(",)),
    "py-security/python.sql-injection-sqlalchemy-text-format": Line(r"\.execute\(\s*text\(.*\.format\(", hints=("text(",)),
    "py-security/python.sql-injection-sqlalchemy-text-percent": Line(
        r"""\.execute\(\s*text\(["'][^"']*["']\s*%""", hints=("text(",)),
    "py-security/python.n-plus-one-query": Pair(
        r"^\s*(?:async\s+)?for\s+(\w+)\s+in\b",
        (r"\.(?:get_tokens_for_user|get_tokens)\(\s*(\w+)(?:\.id)?\s*\)", r"\.execute\(.*\b(\w+)\.id\b"),
        "body",
        left_hint="for", hints=("get_tokens", ".execute("),
    ),
    "py-security/fastapi.missing-response-model": Func(
        r"f.is_async and exists(f.decorators, d -> d rlike '^app\\.(get|post|put|delete|patch)\\(')",
        r"f.is_async and exists(f.decorators, d -> d rlike '^app\\.(get|post|put|delete|patch)\\(') "
        r"and not exists(f.decorators, d -> d like '%response_model%')",
    ),
    "py-security/fastapi.missing-dependencies": Func(
        r"f.is_async and exists(f.decorators, d -> d rlike '^app\\.\\w+\\(') "
        r"and exists(f.params, p -> p rlike ':.*=\\s*Depends')"
    ),
    "py-security/fastapi.cors-wildcard": Block(
        rf"[^\n]*?\bCORSMiddleware\((?:[^()a]++|a(?!llow_origins\b)|{_parens(7)})*+\ballow_origins\s*=\s*\[{Q}\*{Q}\]",
        hint="CORSMiddleware(",
    ),
    "py-security/pydantic.missing-validation": Block(
        rf"[ \t]*class[ \t]+\w+\([ \t]*BaseModel[ \t]*\)[ \t]*:{W}\w+[ \t]*:[ \t]*str{_CLASS_END}", hint="BaseModel"
    ),
    "py-security/pydantic.arbitrary-types-allowed": Block(
        rf"([ \t]*)class[ \t]+Config[ \t]*:[ \t]*\n"
        rf"(?:{MARK}\2[ \t]+(?!arbitrary_types_allowed\b)[^\s][^\n]*+\n|{MARK}[ \t]*+\n)*+"
        rf"{MARK}\2[ \t]+arbitrary_types_allowed[ \t]*=[ \t]*True\b",
        hint="arbitrary_types_allowed",
    ),
    "py-security/asyncio.missing-await": Line(
        r"(^|[^\w.])([\w.]*_async|async_[\w.]*|[\w.]*_await)\(\s*\)", "strings", unless=r"^\s*(async\s+)?def\b", hints=("async", "_await")),
    "py-security/crypto.weak-hash-md5": Line(r"\bhashlib\.md5\(", "strings", hints=("hashlib.md5(",)),
    "py-security/crypto.weak-hash-sha1": Line(r"\bhashlib\.sha1\(", "strings", hints=("hashlib.sha1(",)),
    "py-security/crypto.insecure-random": Line(r"\brandom\.(random\(\)|randint\(|choice\()", "strings", hints=("random.",)),
    "py-security/debug.print-in-production": Line(r"\bprint\(|\blogging\.debug\(", "strings", hints=("print(", "logging.debug(")),
    "py-security/debug.pdb-breakpoint": Line(r"\bbreakpoint\(\)", "strings", hints=("breakpoint()",)),
    "py-security/path.traversal-open": Line(
        rf"\bopen\((?:[^,)]*\.\.[^,)]*,|[\w.]+{_dotted(3)}\s*,)", hints=("open(",)),
    "py-security/python.hardcoded-postgres-url": Line(rf"{Q}postgresql{Q}", hints=("postgresql",)),
    "py-security/python.hardcoded-mysql-url": Line(rf"{Q}mysql{Q}", hints=("mysql",)),
    "py-security/python.hardcoded-mongodb-url": Line(rf"{Q}mongodb{Q}", hints=("mongodb",)),
    # --- Python, quality
    "py-quality/python.complex-function": _EVERY_FUNCTION,
    "py-quality/python.long-function": _EVERY_FUNCTION,
    "py-quality/python.too-many-arguments": Func("size(f.params) >= 6"),
    "py-quality/python.missing-type-hints": Func(r"size(f.params) = 1 and f.params[0] rlike '^\\w+$'"),
    "py-quality/python.missing-return-type": Func("f.returns = 'None'", "f.returns is null"),
    "py-quality/python.wildcard-import": Line(r"^\s*from\s+[\w.]+\s+import\s+\*", hints=("import",)),
    "py-quality/python.unused-import": Line(r"^\s*import\s+\w", hints=("import",)),
    "py-quality/python.bare-except": Line(r"^\s*except\s*:", hints=("except",)),
    "py-quality/python.exception-swallowing": Block(
        rf"[ \t]*except[ \t]*:{W}pass[ \t]*(?=\n|\z)", "strings", hint="except"
    ),
    "py-quality/python.inefficient-loop": Pair(
        r"^\s*(?:async\s+)?for\s+\w+\s+in\s+(\w+)\s*:", (r"^\s*(\w+)\.append\(",), "body", left_hint="for", hints=(".append(",)
    ),
    "py-quality/python.string-concat-loop": Pair(
        r"^\s*(?:async\s+)?for\s+(\w+)\s+in\b",
        (r"^\s*(\w+)\s*\+=\s*(\w+)\s*$",),
        "body",
        before=rf"^\s*(\w+)\s*=\s*(?:\"\"|'')\s*$",
        left_hint="for", hints=("+=",),
    ),
    "py-quality/python.list-comprehension-opportunity": Pair(
        r"^\s*(?:async\s+)?for\s+\w+\s+in\b",
        (r"^\s*(\w+)\.append\(",),
        "body",
        before=r"^\s*(\w+)\s*=\s*\[\]\s*$",
        left_hint="for", hints=(".append(",),
    ),
    "py-quality/python.assert-without-message": Line(
        rf"^\s*assert\s+(?:[^,]+|(?:[^,()\[\]{{}}]++|{_any_brackets(7)})++)$", "strings", hints=("assert",)),
    "py-quality/python.missing-docstring": Func("true", "not f.has_docstring and not startswith(f.name, '_')"),
    # --- TypeScript and JavaScript, security
    "ts-security/typescript.hardcoded-jwt-secret": Line(rf"\b(JWT_SECRET(_KEY)?|SECRET_KEY)\s*=\s*{QJ}", hints=("JWT_SECRET", "SECRET_KEY")),
    "ts-security/typescript.hardcoded-api-key": Line(
        rf"\b(API_KEY|OPENAI_API_KEY|ANTHROPIC_API_KEY)\s*=\s*{QJ}", hints=("API_KEY",)),
    "ts-security/typescript.hardcoded-db-url": Line(rf"\b(DATABASE_URL|POSTGRES_URL|MONGODB_URI)\s*=\s*{QJ}", hints=("DATABASE_URL", "POSTGRES_URL", "MONGODB_URI")),
    "ts-security/typescript.hardcoded-next-public-key": Line(rf"\bNEXT_PUBLIC_API_KEY\s*=\s*{QJ}", hints=("NEXT_PUBLIC_API_KEY",)),
    "ts-security/nextjs.missing-metadata": _PAGE,
    "ts-security/nextjs.missing-server-action-validation": _SERVER_ACTION,
    "ts-security/nextjs.client-component-missing-boundary": Pair(
        rf"^\s*{Q}use client{Q}",
        (rf"^\s*import\s*\{{\s*useEffect\s*\}}\s*from\s*{Q}react{Q}",),
        "file",
        left_hint="use client", hints=("useEffect",),
    ),
    "ts-security/nextjs.dangerous-inner-html": Line(r"dangerouslySetInnerHTML\s*=\s*\{\s*\{?\s*__html:", "strings", hints=("dangerouslySetInnerHTML",)),
    "ts-security/nextjs.missing-csp-headers": Line(r"\bnext\.config\.js\b", "strings", hints=("next.config.js",)),
    "ts-security/react.missing-keys-in-map": _MAP_KEYS,
    "ts-security/react.dangerous-set-state": _SET_STATE,
    "ts-security/react.missing-dependency-array": _EFFECT,
    "ts-security/typescript.any-type-usage": _ANY_TYPE,
    "ts-security/typescript.ts-ignore-comment": _TS_IGNORE,
    "ts-security/typescript.non-null-assertion": _NON_NULL,
    "ts-security/security.eval-usage": Line(r"\b(eval|Function)\(|\bsetTimeout\(", "strings", hints=("eval(", "Function(", "setTimeout(")),
    "ts-security/security.inner-html-assignment": Line(r"\.innerHTML\s*=([^=]|$)", "strings", hints=(".innerHTML",)),
    "ts-security/security.document-write": Line(r"\bdocument\.write\(", "strings", hints=("document.write(",)),
    "ts-security/security.math-random-for-tokens": Line(r"\bMath\.random\(\)", "strings", hints=("Math.random()",)),
    "ts-security/zod.missing-schema-validation": Line(r"\w+\(\s*\w+\s*:\s*any\s*\)", "strings", hints=("any",)),
    "ts-security/zod.unvalidated-request-body": Line(r"\bconst\s+\w+\s*=\s*await\s+request\.json\(\)", "strings", hints=("request.json()",)),
    "ts-security/auth.missing-role-check": _SERVER_ACTION,
    "ts-security/auth.missing-csrf-protection": _SERVER_ACTION,
    "ts-security/crypto.weak-hash": Line(rf"\bcrypto\.createHash\({Q}(md5|sha1){Q}\)", hints=("createHash(",)),
    "ts-security/debug.console-log-production": Line(r"\bconsole\.(log|debug|info)\(", "strings", hints=("console.",)),
    "ts-security/di.service-in-component": Line(r"\bconst\s+\w+\s*=\s*new\s+\w+\(\)", "strings", hints=("new",)),
    # --- TypeScript and JavaScript, quality
    "ts-quality/typescript.complex-function": Block(
        rf"[^\n]*?\bfunction[ \t]+\w+{W}\([^)]*\)[^{{}};\n]*\{{", "strings", hint="function"
    ),
    "ts-quality/typescript.arrow-function-complex": Block(
        rf"[^\n]*?\bconst[ \t]+\w+[^=\n]*=[ \t]*(?:async[ \t]+)?\([^)]*\)[^=\n]*=>{W}\{{", "strings", hint="=>"
    ),
    "ts-quality/typescript.too-many-parameters": Block(
        rf"[^\n]*?\bfunction\s+\w+{W}\((?:[^,()]*+,){{5,}}+[^)]*+\)", "strings", hint="function"
    ),
    "ts-quality/typescript.any-type-usage": _ANY_TYPE,
    "ts-quality/typescript.ts-ignore-comment": _TS_IGNORE,
    "ts-quality/typescript.non-null-assertion": _NON_NULL,
    "ts-quality/typescript.unnecessary-type-assertion": Line(
        r"[\w)\]]\s+as\s+[A-Za-z_]\w*", "strings", unless=r"^\s*(import|export)\b", hints=("as",)),
    "ts-quality/typescript.consistent-naming": _CONST,
    "ts-quality/typescript.promise-not-awaited": Line(
        r"(^|[^\w.])[\w.]+\(\s*\)", "strings", unless=r"\bfunction\b|\bnew\s+[\w.]+\(", strict=r"\bawait\b|\.catch\(", hints=("(",)),
    "ts-quality/typescript.unused-variable": _CONST,
    "ts-quality/typescript.test-naming": _TEST,
    "ts-quality/typescript.test-without-expect": _TEST,
    "ts-quality/typescript.console-in-test": Line(r"\bconsole\.log\(", "strings", hints=("console.log(",)),
    "ts-quality/react.missing-keys-in-map": _MAP_KEYS,
    "ts-quality/react.dangerous-set-state": _SET_STATE,
    "ts-quality/react.missing-dependency-array": _EFFECT,
    "ts-quality/react.missing-memo": _PAGE,
    "ts-quality/react.hook-rules-violation": Block(
        rf"[^\n]*?\bif[ \t]*\([^\n{{]*\){W}\{{[^{{}}]*\buseState\(", "strings", hint="useState("
    ),
    "ts-quality/typescript.ineffective-spread": Line(r"\bconst\s+\w+\s*=\s*\{\s*\.\.\.", "strings", hints=("...",)),
    "ts-quality/react.unnecessary-rerender": Line(r"\bonClick=\{\(\)\s*=>", "strings", hints=("onClick=",)),
    "ts-quality/zod.infer-usage": Line(r"=\s*z\.infer<typeof", "strings", hints=("z.infer<typeof",)),
    "ts-quality/zod.union-instead-of-any": _ANY_TYPE,
    "ts-quality/a11y.missing-alt": Line(r"<img\b[^>]*\bsrc=", strict=r"\balt=", hints=("<img",)),
    "ts-quality/a11y.missing-label": Line(r"<input\b", strict=r"\baria-label|\bid=", hints=("<input",)),
    "ts-quality/a11y.button-type": Block(
        rf"[^\n]*?<button\b[^>]*+>(?:[^<]++|<(?!/button>))*+</button>",
        strict=rf"[^\n]*?<button\b(?![^>]*\btype=)[^>]*+>(?:[^<]++|<(?!/button>))*+</button>",
        hint="<button",
    ),
    "ts-quality/typescript.missing-jsdoc": Block(
        rf"[ \t]*export[ \t]+function[ \t]+\w+{W}\([^)]*\)[^{{;\n]*\{{", "strings", hint="export"
    ),
}


def block_regex(regex: str) -> str:
    """Group 1 is the number of the line a block starts on; blocks may overlap."""
    return f"{MARK_OPEN}(\\d+){MARK_CLOSE}(?={regex})"
