"""Ignore patterns compiled to one regular expression.

A pattern hides a path in any of four ways: a trailing ``/`` names a directory
and everything below it; the glob matches the whole path (``**`` spans
separators and swallows a following ``/``, ``*`` and ``?`` stop at them); a
pattern without ``/`` matches any single segment; ``X/**`` also hides ``X``.  A
leading ``**/`` may stand for nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill.functions.text import SPACE

_TOKEN = re.compile(r"(?P<deep>\*\*/?)|(?P<star>\*)|(?P<one>\?)|(?P<text>[^*?]+)")
_SPECIAL = r"([\\.\[\]{}()+^$|&#~\-])"


def _glob(pattern: str, deep: str) -> str:
    replace = {"deep": lambda t: deep, "star": lambda t: "[^/]*", "one": lambda t: "[^/]", "text": re.escape}
    return "".join(replace[m.lastgroup](m.group()) for m in _TOKEN.finditer(pattern))


def clean(patterns: list[str]) -> list[str]:
    stripped = [p.strip() for p in patterns]
    return [p.replace("\\", "/") for p in stripped if p and not p.startswith("#")]


def pattern_regex(pattern: str) -> str:
    if pattern.endswith("/"):
        return re.escape(pattern.rstrip("/")) + "(?:/.*)?"
    ways = []
    for form in dict.fromkeys([pattern, pattern.removeprefix("**/")]):
        ways.append(_glob(form, ".*"))
        if "/" not in form:
            ways.append("(?:.*/)?" + _glob(form, "[^/]*") + "(?:/.*)?")
        if form.endswith("/**"):
            ways.append(re.escape(form[:-3]) + "(?:/.*)?")
    return "|".join(ways)


def ignore_regex(patterns: list[str]) -> str | None:
    """One anchored expression for a list of patterns, or None for an empty list."""
    parts = [pattern_regex(p) for p in clean(patterns)]
    return r"\A(?:" + "|".join(parts) + r")\z" if parts else None


def fragment(pattern: str) -> str:
    """A text that every path holds which the pattern hides; empty where there is none."""
    return max((t["text"].strip("/") for t in _TOKEN.finditer(pattern) if t["text"]), key=len, default="")


def _column_glob(pattern: Column, deep: str) -> Column:
    safe = F.regexp_replace(pattern, _SPECIAL, r"\\$1")
    marked = F.regexp_replace(safe, r"\*\*/?", "\u0001")
    marked = F.replace(marked, F.lit("*"), F.lit("[^/]*"))
    marked = F.replace(marked, F.lit("?"), F.lit("[^/]"))
    return F.replace(marked, F.lit("\u0001"), F.lit(deep))


def _column_ways(form: Column) -> Column:
    whole = _column_glob(form, ".*")
    segment = F.when(~F.contains(form, F.lit("/")),
                     F.concat(F.lit("|(?:.*/)?"), _column_glob(form, "[^/]*"), F.lit("(?:/.*)?")))
    base = F.regexp_replace(F.regexp_extract(form, r"(?s)\A(.*)/\*\*\z", 1), _SPECIAL, r"\\$1")
    below = F.when(F.endswith(form, F.lit("/**")),
                   F.concat(F.lit("|"), F.regexp_replace(base, r"([*?])", r"\\$1"), F.lit("(?:/.*)?")))
    return F.concat(whole, F.coalesce(segment, F.lit("")), F.coalesce(below, F.lit("")))


def pattern_regex_column(pattern: Column) -> Column:
    """``pattern_regex`` for a column of (already cleaned) patterns."""
    folder = F.regexp_replace(F.regexp_replace(F.rtrim(pattern, F.lit("/")), _SPECIAL, r"\\$1"),
                              r"([*?])", r"\\$1")
    bare = F.regexp_replace(pattern, r"\A\*\*/", "")
    return (F.when(F.endswith(pattern, F.lit("/")), F.concat(folder, F.lit("(?:/.*)?")))
            .when(F.startswith(pattern, F.lit("**/")), F.concat(_column_ways(pattern), F.lit("|"), _column_ways(bare)))
            .otherwise(_column_ways(pattern)))


def ignore_regex_column(lines: Column) -> Column:
    """One anchored expression from an ignore file's lines; null when it has no pattern."""
    stripped = F.transform(lines, lambda p: F.trim(p, F.lit(SPACE)))
    kept = F.filter(stripped, lambda p: (p != "") & ~F.startswith(p, F.lit("#")))
    parts = F.transform(kept, lambda p: pattern_regex_column(F.replace(p, F.lit("\\"), F.lit("/"))))
    return F.when(F.size(parts) > 0, F.concat(F.lit(r"\A(?:"), F.array_join(parts, "|"), F.lit(r")\z")))
