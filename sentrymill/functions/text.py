"""Text helpers with Python string semantics, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill.session import let, sql_literal

# characters for which str.isspace() holds
SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0         "
         "       　")
_BREAK = r"\n\r\x0B\x0C\x1C-\x1E\u0085  "
LINE_BREAK = rf"\r\n|[{_BREAK}]"
_RARE_BREAK = f"[{_BREAK.replace(chr(92) + 'n', '', 1)}]"
BREAK_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
CONTEXT_CHARS = 120


def regex(pattern: str) -> str:
    """Unicode-aware character classes and case folding, as in Python's ``re``."""
    return "(?U)" + pattern


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE))


def context(line: Column) -> Column:
    return F.substring(strip(line), 1, CONTEXT_CHARS)


def raw_pieces(content: Column) -> Column:
    """Pieces between line breaks, including the one after a final break."""
    return F.split(content, LINE_BREAK)


def unix_lines(content: Column) -> Column:
    """The text with each of the ten separators as one line feed."""
    # a byte search per rare separator is cheaper than one expression for all of them
    rare = contains_any(content, [c for c in BREAK_CHARS if c != "\n"])
    return F.when(rare, F.regexp_replace(content, LINE_BREAK, "\n")).otherwise(content)


def split_lines(content: Column) -> Column:
    """``str.splitlines()``: ten separators, one trailing empty piece dropped."""
    # a split at a regular expression compiles it for every text, a split at one character does not
    def pieces(text: Column) -> Column:
        return F.split(F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text), "\n")

    other = let(F.regexp_replace(content, LINE_BREAK, "\n"), pieces)
    return (F.when(content == "", F.array().cast("array<string>")).when(content.rlike(_RARE_BREAK), other)
            .otherwise(pieces(content)))


def split_at(text: Column, pattern: str) -> Column:
    """``F.split`` at the matches of a pattern, which is compiled once and not for every text."""
    # texts that hold the mark themselves, which none should, are split the slow way
    return F.when(F.contains(text, F.lit("\x00")), F.split(text, pattern)).otherwise(
        F.split(F.regexp_replace(text, pattern, "\x00"), "\x00"))


def decode(data: Column) -> Column:
    """UTF-8 with malformed bytes replaced."""
    return F.make_valid_utf8(data.cast("string"))


def contains_any(text: Column, fragments: Iterable[str]) -> Column:
    found = F.lit(False)
    for fragment in fragments:
        found = found | F.contains(text, F.lit(fragment))
    return found


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def unix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def contains_any_sql(column: str, fragments: Iterable[str]) -> str:
    """SQL text of ``contains_any`` for a named column."""
    return "(" + " OR ".join(f"contains({column}, {sql_literal(f)})" for f in fragments) + ")"
