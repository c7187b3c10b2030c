"""The secret patterns and where each of them applies."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SecretPattern:
    type: str
    regex: str
    langs: tuple[str, ...]
    hint: str  # a literal that every match holds, or a cheap regex for generics


# Types, regexes and languages, in the order in which they apply.
# Tokens come before the generic assignment of each language.
_TOKENS = [
    ("STRIPE_LIVE_KEY", r"sk_live_[0-9a-zA-Z\.]{10,}", "sk_live_"),
    ("STRIPE_TEST_KEY", r"sk_test_[0-9a-zA-Z\.]{10,}", "sk_test_"),
    ("GITHUB_PERSONAL_TOKEN", r"ghp_[0-9a-zA-Z]{36}", "ghp_"),
    ("GITHUB_OAUTH_TOKEN", r"gho_[0-9a-zA-Z]{36}", "gho_"),
    ("GITHUB_USER_TOKEN", r"ghu_[0-9a-zA-Z]{36}", "ghu_"),
    ("GITHUB_SERVER_TOKEN", r"ghs_[0-9a-zA-Z]{36}", "ghs_"),
    ("GITHUB_REFRESH_TOKEN", r"ghr_[0-9a-zA-Z]{36}", "ghr_"),
    ("OPENAI_API_KEY", r"ai_[0-9a-zA-Z]{32,}", "ai_"),
    ("SLACK_BOT_TOKEN", r"xoxb-[0-9a-zA-Z-]{50,}", "xoxb-"),
    ("SLACK_USER_TOKEN", r"xoxp-[0-9a-zA-Z-]{50,}", "xoxp-"),
    ("SLACK_APP_TOKEN", r"xoxa-[0-9a-zA-Z-]{50,}", "xoxa-"),
]
_GENERIC_PY = (
    "GENERIC_SECRET_PY",
    r"""(?i)(?<!['"#])(secret_key|jwt_secret|api_key|password|token)\s*=\s*["']([^"']{1,})["']""",
)
_GENERIC_JS = (
    "GENERIC_SECRET_JS",
    r"""(?i)(?<!['"#])(?:const|let|var)\s+(secretKey|jwtSecret|apiKey|stripeKey|password|token)\s*=\s*["']([^"']{1,})["']""",
)
CHANGE_ME = "CHANGE_ME_IN_PRODUCTION"

# Every generic match holds "=", blanks and a quote in this order. Finding "="
# first is far cheaper than trying five words at every character.
ASSIGN_HINT = r"""=\s*["']"""

TOKEN_PATTERNS = [SecretPattern(t, r, ("py", "js"), h) for t, r, h in _TOKENS]
GENERIC_PY = SecretPattern(*_GENERIC_PY, ("py",), ASSIGN_HINT)
GENERIC_JS = SecretPattern(*_GENERIC_JS, ("js",), ASSIGN_HINT)
SECRET_PATTERNS = [*TOKEN_PATTERNS, GENERIC_PY, GENERIC_JS]


def patterns_for(lang: str | None = None) -> list[SecretPattern]:
    """Patterns of one language in order, or all of them."""
    return [p for p in SECRET_PATTERNS if lang is None or lang in p.langs]


def pattern_of(type_: str) -> SecretPattern:
    return next(p for p in SECRET_PATTERNS if p.type == type_)
