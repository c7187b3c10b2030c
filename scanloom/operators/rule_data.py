"""The built-in rule table as plain data.

Fixed values: pack, id, severity, category, languages, message and further
metadata of each rule, in their natural order. Six ids occur in two packs, so
the key of a rule is ``pack/id``. How each rule is matched is in
``rule_predicates``.
"""

# fmt: off
PY, TS, TSJS = ("py",), ("ts",), ("ts", "js")

CWE_22 = "CWE-22: Path Traversal"
CWE_79 = "CWE-79: Cross-site Scripting"
CWE_89 = "CWE-89: SQL Injection"
CWE_798 = "CWE-798: Use of Hard-coded Credentials"
INJECTION = "A03:2021 - Injection"
AUTH_FAILURES = "A07:2021 - Identification and Authentication Failures"

RULES = [
    # (pack, id, severity, category, languages, message, metadata)
    ("py-security", "python.hardcoded-jwt-secret", "ERROR", "security", PY, "Hardcoded JWT secret detected. Use environment variables.", {"cwe": CWE_798, "owasp": AUTH_FAILURES, "confidence": "HIGH"}),
    ("py-security", "python.hardcoded-database-url", "ERROR", "security", PY, "Hardcoded database connection string. Use environment variables.", {"cwe": "CWE-798"}),
    ("py-security", "python.hardcoded-api-key", "ERROR", "security", PY, "Hardcoded API key detected. Use environment variables.", {"cwe": "CWE-798"}),
    ("py-security", "python.password-in-config", "ERROR", "security", PY, "Hardcoded password detected. Use secrets manager.", {"cwe": "CWE-259: Use of Hard-coded Password"}),
    ("py-security", "python.sql-injection-fstring", "ERROR", "security", PY, "Potential SQL injection via f-string. Use parameterized queries.", {"cwe": CWE_89, "owasp": INJECTION}),
    ("py-security", "python.sql-injection-format", "ERROR", "security", PY, "Potential SQL injection via .format(). Use parameterized queries.", {"cwe": "CWE-89"}),
    ("py-security", "python.sql-injection-percent", "ERROR", "security", PY, "Potential SQL injection via % formatting. Use parameterized queries.", {"cwe": "CWE-89"}),
    ("py-security", "python.raw-sql-execution", "WARNING", "security", PY, "Potential SQL injection: dynamic SQL with user input. Use parameterized queries with placeholders.", {"cwe": "CWE-89"}),
    ("py-security", "python.sql-injection-sqlalchemy-fstring", "ERROR", "security", PY, "SQL injection via f-string in SQLAlchemy text(). Use parameterized queries with bind parameters.", {"cwe": CWE_89, "owasp": INJECTION}),
    ("py-security", "python.sql-injection-sqlalchemy-text-fstring", "ERROR", "security", PY, "SQL injection via f-string in SQLAlchemy text(). Use parameterized queries with bind parameters.", {"cwe": CWE_89, "owasp": INJECTION}),
    ("py-security", "python.sql-injection-sqlalchemy-text-format", "ERROR", "security", PY, "SQL injection via .format() in SQLAlchemy text(). Use parameterized queries with bind parameters.", {"cwe": "CWE-89"}),
    ("py-security", "python.sql-injection-sqlalchemy-text-percent", "ERROR", "security", PY, "SQL injection via % formatting in SQLAlchemy text(). Use parameterized queries with bind parameters.", {"cwe": "CWE-89"}),
    ("py-security", "python.n-plus-one-query", "WARNING", "performance", PY, "N+1 query pattern detected: database query inside loop. Use joinedload or bulk fetch.", {"cwe": "CWE-400: Uncontrolled Resource Consumption"}),
    ("py-security", "fastapi.missing-response-model", "WARNING", "best-practice", PY, "FastAPI endpoint missing response_model. Add for validation and docs.", {"framework": "fastapi"}),
    ("py-security", "fastapi.missing-dependencies", "INFO", "best-practice", PY, "Verify dependency injection is properly typed and scoped.", {"framework": "fastapi"}),
    ("py-security", "fastapi.cors-wildcard", "ERROR", "security", PY, "CORS allow_origins=['*'] is insecure. Restrict to specific domains.", {"cwe": "CWE-942: Permissive Cross-domain Policy", "framework": "fastapi"}),
    ("py-security", "pydantic.missing-validation", "WARNING", "best-practice", PY, "Field missing validation constraints. Add min_length, max_length, regex, etc.", {"framework": "pydantic"}),
    ("py-security", "pydantic.arbitrary-types-allowed", "WARNING", "security", PY, "arbitrary_types_allowed=True bypasses validation. Avoid unless necessary.", {"framework": "pydantic"}),
    ("py-security", "asyncio.missing-await", "ERROR", "bug", PY, "Async function called without await. This creates a coroutine that never runs.", {"cwe": "CWE-835: Infinite Loop"}),
    ("py-security", "crypto.weak-hash-md5", "ERROR", "security", PY, "MD5 is cryptographically broken. Use SHA-256 or SHA-3.", {"cwe": "CWE-327: Use of a Broken or Risky Cryptographic Algorithm"}),
    ("py-security", "crypto.weak-hash-sha1", "ERROR", "security", PY, "SHA1 is cryptographically weak. Use SHA-256 or SHA-3.", {"cwe": "CWE-327"}),
    ("py-security", "crypto.insecure-random", "ERROR", "security", PY, "random module is not cryptographically secure. Use secrets module for tokens/passwords.", {"cwe": "CWE-338: Use of Cryptographically Weak PRNG"}),
    ("py-security", "debug.print-in-production", "INFO", "observability", PY, "Debug print/logging in production code. Use structured logging with appropriate levels.", {}),
    ("py-security", "debug.pdb-breakpoint", "ERROR", "bug", PY, "breakpoint() in production code. Remove before deploying.", {}),
    ("py-security", "path.traversal-open", "ERROR", "security", PY, "Potential path traversal via user-controlled input. Validate and sanitize paths.", {"cwe": CWE_22}),
    ("py-security", "python.hardcoded-postgres-url", "ERROR", "security", PY, "Hardcoded PostgreSQL connection string. Use environment variables.", {"cwe": "CWE-798"}),
    ("py-security", "python.hardcoded-mysql-url", "ERROR", "security", PY, "Hardcoded MySQL connection string. Use environment variables.", {"cwe": "CWE-798"}),
    ("py-security", "python.hardcoded-mongodb-url", "ERROR", "security", PY, "Hardcoded MongoDB connection string. Use environment variables.", {"cwe": "CWE-798"}),
    ("py-quality", "python.complex-function", "WARNING", "maintainability", PY, "Function may be too complex. Consider breaking into smaller functions.", {"metric": "cyclomatic_complexity > 10"}),
    ("py-quality", "python.long-function", "WARNING", "maintainability", PY, "Function is very long (>100 lines). Consider refactoring.", {}),
    ("py-quality", "python.too-many-arguments", "WARNING", "maintainability", PY, "Function has too many arguments (>5). Consider using dataclass/config object.", {}),
    ("py-quality", "python.missing-type-hints", "WARNING", "best-practice", PY, "Function missing type hints. Add type annotations for better IDE support and bug detection.", {}),
    ("py-quality", "python.missing-return-type", "WARNING", "best-practice", PY, "Function missing return type annotation.", {}),
    ("py-quality", "python.wildcard-import", "WARNING", "best-practice", PY, "Wildcard imports pollute namespace. Use explicit imports.", {}),
    ("py-quality", "python.unused-import", "INFO", "clean-code", PY, "Potentially unused import. Remove if not used.", {}),
    ("py-quality", "python.bare-except", "ERROR", "bug", PY, "Bare except catches all exceptions including SystemExit/KeyboardInterrupt. Use 'except Exception:'", {}),
    ("py-quality", "python.exception-swallowing", "ERROR", "bug", PY, "Exception caught and silently ignored. At least log the error.", {}),
    ("py-quality", "python.inefficient-loop", "WARNING", "performance", PY, "Modifying list while iterating. Use list comprehension or separate list.", {}),
    ("py-quality", "python.string-concat-loop", "WARNING", "performance", PY, "String concatenation in loop is O(n^2). Use ''.join() or list comprehension.", {}),
    ("py-quality", "python.list-comprehension-opportunity", "INFO", "clean-code", PY, "Can be simplified to list comprehension: [$EXPR for $X in $LIST]", {}),
    ("py-quality", "python.assert-without-message", "INFO", "testing", PY, "Assert without message makes debugging harder. Add descriptive message.", {}),
    ("py-quality", "python.missing-docstring", "INFO", "documentation", PY, "Public function missing docstring. Add for API documentation.", {}),
    ("ts-security", "typescript.hardcoded-jwt-secret", "ERROR", "security", TSJS, "Hardcoded JWT secret detected. Use environment variables.", {"cwe": CWE_798, "owasp": AUTH_FAILURES, "confidence": "HIGH"}),
    ("ts-security", "typescript.hardcoded-api-key", "ERROR", "security", TSJS, "Hardcoded API key detected. Use environment variables.", {"cwe": "CWE-798"}),
    ("ts-security", "typescript.hardcoded-db-url", "ERROR", "security", TSJS, "Hardcoded database connection string. Use environment variables.", {"cwe": "CWE-798"}),
    ("ts-security", "typescript.hardcoded-next-public-key", "ERROR", "security", TSJS, "Hardcoded NEXT_PUBLIC key detected. Use environment variables.", {"cwe": "CWE-798"}),
    ("ts-security", "nextjs.missing-metadata", "WARNING", "best-practice", TSJS, "Page component missing metadata export. Add export const metadata for SEO.", {"framework": "nextjs"}),
    ("ts-security", "nextjs.missing-server-action-validation", "WARNING", "security", TSJS, "Server Action missing input validation. Validate all inputs with Zod/schema.", {"framework": "nextjs"}),
    ("ts-security", "nextjs.client-component-missing-boundary", "WARNING", "bug", TSJS, "Client component using server-only APIs. Check for server-only imports.", {"framework": "nextjs"}),
    ("ts-security", "nextjs.dangerous-inner-html", "ERROR", "security", TSJS, "dangerouslySetInnerHTML is XSS risk. Sanitize content or use safe alternatives.", {"cwe": CWE_79, "owasp": INJECTION}),
    ("ts-security", "nextjs.missing-csp-headers", "WARNING", "security", TSJS, "Ensure Content Security Policy headers configured in next.config.js", {"framework": "nextjs"}),
    ("ts-security", "react.missing-keys-in-map", "WARNING", "bug", TSJS, "Missing key prop in map iteration. Add unique key for reconciliation.", {"framework": "react"}),
    ("ts-security", "react.dangerous-set-state", "INFO", "bug", TSJS, "Verify functional state update is correct. Avoid stale closures.", {"framework": "react"}),
    ("ts-security", "react.missing-dependency-array", "WARNING", "bug", TSJS, "useEffect missing dependency array. Add dependencies or use [] for mount-only.", {"framework": "react"}),
    ("ts-security", "typescript.any-type-usage", "WARNING", "best-practice", TS, "Avoid 'any' type. Use proper typing or unknown.", {"framework": "typescript"}),
    ("ts-security", "typescript.ts-ignore-comment", "WARNING", "best-practice", TS, "@ts-ignore suppresses type errors. Fix the underlying type issue instead.", {"framework": "typescript"}),
    ("ts-security", "typescript.non-null-assertion", "WARNING", "best-practice", TS, "Non-null assertion (!) bypasses type safety. Handle null/undefined properly.", {"framework": "typescript"}),
    ("ts-security", "security.eval-usage", "ERROR", "security", TSJS, "eval/Function/setTimeout with string is code injection risk. Avoid dynamic code execution.", {"cwe": "CWE-95: Improper Neutralization of Directives in Dynamically Evaluated Code"}),
    ("ts-security", "security.inner-html-assignment", "ERROR", "security", TSJS, "Direct innerHTML assignment is XSS risk. Use textContent or sanitize.", {"cwe": CWE_79}),
    ("ts-security", "security.document-write", "ERROR", "security", TSJS, "document.write is unsafe. Use DOM APIs instead.", {"cwe": "CWE-79"}),
    ("ts-security", "security.math-random-for-tokens", "ERROR", "security", TSJS, "Math.random() is not cryptographically secure. Use crypto.randomUUID() or crypto.getRandomValues().", {"cwe": "CWE-338: Use of Cryptographically Weak PRNG"}),
    ("ts-security", "zod.missing-schema-validation", "WARNING", "best-practice", TS, "Function accepts 'any' input without validation. Define Zod schema.", {"framework": "zod"}),
    ("ts-security", "zod.unvalidated-request-body", "WARNING", "security", TSJS, "Request body parsed without validation. Validate with Zod schema before use.", {"framework": "nextjs"}),
    ("ts-security", "auth.missing-role-check", "ERROR", "security", TSJS, "Admin/mutation Server Action missing role/permission check. Add authorization.", {"cwe": "CWE-862: Missing Authorization", "owasp": "A01:2021 - Broken Access Control"}),
    ("ts-security", "auth.missing-csrf-protection", "WARNING", "security", TSJS, "Server Action missing CSRF protection. Next.js provides automatic protection but verify custom forms.", {"framework": "nextjs"}),
    ("ts-security", "crypto.weak-hash", "ERROR", "security", TSJS, "MD5/SHA1 are cryptographically broken. Use SHA-256 or SHA-3.", {"cwe": "CWE-327"}),
    ("ts-security", "debug.console-log-production", "INFO", "observability", TSJS, "Console logging in production code. Use structured logger (pino, winston) with appropriate levels.", {}),
    ("ts-security", "di.service-in-component", "WARNING", "best-practice", TSJS, "Service instantiated in component. Use dependency injection or singleton pattern.", {"framework": "typescript"}),
    ("ts-quality", "typescript.complex-function", "WARNING", "maintainability", TSJS, "Function may be too complex. Consider breaking into smaller functions.", {}),
    ("ts-quality", "typescript.arrow-function-complex", "WARNING", "maintainability", TSJS, "Arrow function may be too complex. Consider extracting logic.", {}),
    ("ts-quality", "typescript.too-many-parameters", "WARNING", "maintainability", TSJS, "Function has too many parameters (>5). Consider using a config object.", {}),
    ("ts-quality", "typescript.any-type-usage", "WARNING", "best-practice", TS, "Avoid 'any' type. Use proper typing or unknown.", {"framework": "typescript"}),
    ("ts-quality", "typescript.ts-ignore-comment", "WARNING", "best-practice", TS, "@ts-ignore suppresses type errors. Fix the underlying type issue instead.", {"framework": "typescript"}),
    ("ts-quality", "typescript.non-null-assertion", "WARNING", "best-practice", TS, "Non-null assertion (!) bypasses type safety. Handle null/undefined properly.", {"framework": "typescript"}),
    ("ts-quality", "typescript.unnecessary-type-assertion", "INFO", "best-practice", TS, "Type assertion may be unnecessary. Check if inference works.", {"framework": "typescript"}),
    ("ts-quality", "typescript.consistent-naming", "INFO", "style", TSJS, "Use camelCase for variables, PascalCase for types, UPPER_SNAKE for constants.", {}),
    ("ts-quality", "typescript.promise-not-awaited", "WARNING", "bug", TSJS, "Promise returned but not awaited. Add await or .catch().", {}),
    ("ts-quality", "typescript.unused-variable", "INFO", "clean-code", TSJS, "Variable declared but never used. Remove or prefix with _.", {}),
    ("ts-quality", "typescript.test-naming", "INFO", "testing", TSJS, "Use descriptive test names following pattern: 'should do X when Y'.", {}),
    ("ts-quality", "typescript.test-without-expect", "WARNING", "testing", TSJS, "Test without assertions. Add expect() assertions.", {}),
    ("ts-quality", "typescript.console-in-test", "INFO", "testing", TSJS, "Remove console.log from tests. Use expect assertions instead.", {}),
    ("ts-quality", "react.missing-keys-in-map", "WARNING", "bug", TSJS, "Missing key prop in map iteration. Add unique key for reconciliation.", {"framework": "react"}),
    ("ts-quality", "react.dangerous-set-state", "INFO", "bug", TSJS, "Verify functional state update is correct. Avoid stale closures.", {"framework": "react"}),
    ("ts-quality", "react.missing-dependency-array", "WARNING", "bug", TSJS, "useEffect missing dependency array. Add dependencies or use [] for mount-only.", {"framework": "react"}),
    ("ts-quality", "react.missing-memo", "INFO", "performance", TSJS, "Consider React.memo for components rendering frequently with same props.", {"framework": "react"}),
    ("ts-quality", "react.hook-rules-violation", "ERROR", "bug", TSJS, "Hooks must be called at top level, not inside conditionals/loops.", {"framework": "react"}),
    ("ts-quality", "typescript.ineffective-spread", "INFO", "performance", TSJS, "Spread operator creates new object. Consider mutation if in hot path.", {}),
    ("ts-quality", "react.unnecessary-rerender", "INFO", "performance", TSJS, "Inline arrow function creates new function each render. Use useCallback or move outside.", {"framework": "react"}),
    ("ts-quality", "zod.infer-usage", "INFO", "best-practice", TS, "Prefer z.infer<typeof schema> for type inference from schema.", {"framework": "zod"}),
    ("ts-quality", "zod.union-instead-of-any", "INFO", "best-practice", TS, "Use Zod union/discriminated union instead of 'any' for type-safe variants.", {"framework": "zod"}),
    ("ts-quality", "a11y.missing-alt", "WARNING", "accessibility", TSJS, "Image missing alt attribute. Add descriptive alt for accessibility.", {"framework": "react"}),
    ("ts-quality", "a11y.missing-label", "WARNING", "accessibility", TSJS, "Input missing associated label. Add <label> or aria-label.", {"framework": "react"}),
    ("ts-quality", "a11y.button-type", "INFO", "accessibility", TSJS, "Button missing type attribute. Default is 'submit' in forms. Use type='button' when not submitting.", {"framework": "react"}),
    ("ts-quality", "typescript.missing-jsdoc", "INFO", "documentation", TS, "Exported function missing JSDoc. Add for API documentation.", {}),
]
# fmt: on
