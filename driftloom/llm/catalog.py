"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, decontam, html, langid, lm, mixing, neardup, quality, secrets, substrings

_MODULES = (secrets, neardup, ann, langid, substrings, quality, html, lm, decontam, mixing)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
