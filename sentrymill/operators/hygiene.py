"""Sensitive files that a repository's ignore list does not cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values.rules import HYGIENE_TEXT
from sentrymill.functions.text import split_lines, strip
from sentrymill.operators.classify import sensitive_kind, skipped_for_code
from sentrymill.operators.match import FINDING


def gitignore_findings(files: DataFrame) -> DataFrame:
    path = F.col("path")
    kind = sensitive_kind(path)
    # at most five kinds per repository remain before any row moves
    present = (files.where(~skipped_for_code(path) & kind.isNotNull())
               .select("repo", kind.alias("kind")).distinct())
    entries = F.filter(
        F.transform(F.filter(split_lines(F.lower(F.col("content"))), lambda e: ~F.startswith(e, F.lit("#"))), strip),
        lambda e: e != "")
    covers = files.where(path == ".gitignore").select(F.col("repo"), entries.alias("entries"))
    bare = F.ltrim(F.col("kind"), F.lit("*"))
    covered = F.exists("entries", lambda e: F.contains(e, bare) | F.contains(F.col("kind"), F.ltrim(e, F.lit("*"))))
    uncovered = (present.join(covers, "repo", "left")
                 .where(~F.coalesce(covered, F.lit(False))).select("repo", "kind").distinct())
    title, text = HYGIENE_TEXT
    return uncovered.select(
        "repo", F.lit(".gitignore").alias("path"), F.lit(0).alias("line_no"),
        F.format_string(title, "kind").alias("issue_type"), F.lit("hygiene").alias("category"),
        F.lit("MEDIUM").alias("severity"), F.format_string(text, "kind").alias("description"),
        F.lit("").alias("context")).select(*FINDING)
