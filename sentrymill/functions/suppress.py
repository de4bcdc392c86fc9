"""Inline suppression comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill.fixed_values.rules import SUPPRESSION_PATTERN, SUPPRESSION_SCOPES
from sentrymill.functions.text import regex
from sentrymill.session import let


def scopes(line: Column) -> Column:
    """Suppressed scopes: null without a comment, empty for all scopes."""
    tail = F.lower(F.regexp_extract(line, regex(SUPPRESSION_PATTERN), 1))
    words = F.transform(F.split(tail, regex(r"[,\s]+")), lambda w: F.trim(w, F.lit(": ")))

    def named(found: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.arrays_overlap(found, F.array(*[F.lit(a) for a in aliases])), F.lit(scope))
            for scope, aliases in SUPPRESSION_SCOPES.items()]))

    return F.when(line.rlike(regex(SUPPRESSION_PATTERN)), let(words, named))


def suppressed(line: Column, scope: str) -> Column:
    def covers(found: Column) -> Column:
        return F.coalesce((F.size(found) == 0) | F.array_contains(found, scope), F.lit(False)) & found.isNotNull()

    return let(scopes(line), covers)
