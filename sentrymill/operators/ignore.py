"""Ignore rules: which files a scan leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values.rules import DEFAULT_IGNORES
from sentrymill.functions import globs
from sentrymill.functions.text import contains_any, split_lines, unix_path
from sentrymill.session import SALTS, let, spread_join

IGNORE_FILE = ".scanignore"


def repo_rules(files: DataFrame, ignore_file: str = IGNORE_FILE) -> DataFrame:
    """(repo, rule_regex): one expression per repository with an ignore file at its root."""
    return (files.where(F.col("path") == ignore_file)
            .select("repo", globs.ignore_regex_column(split_lines(F.col("content"))).alias("rule_regex"))
            .where(F.col("rule_regex").isNotNull())
            .groupBy("repo").agg(F.min("rule_regex").alias("rule_regex")))


def built_in(path: Column) -> Column:
    """Hidden by the built-in patterns: one constant expression, behind byte searches."""
    fragments = dict.fromkeys(map(globs.fragment, globs.clean(DEFAULT_IGNORES)))
    return let(unix_path(path), lambda p: contains_any(p, fragments) & p.rlike(globs.ignore_regex(DEFAULT_IGNORES)))


def flagged(files: DataFrame, use_defaults: bool = True, ignore_file: str | None = IGNORE_FILE,
            rules: DataFrame | None = None) -> DataFrame:
    """``files`` with a boolean ``ignored``.

    Built-in patterns are one constant expression.  Each repository's own file becomes one expression, which meets the
    repository's paths alone; a large repository's paths are spread over copies of its one rule.  Rows of one rule come
    together there, so it is compiled once per run of them.  Files then meet only the paths that are hidden, by (repo, path), so no
    content moves by repository.  ``rules`` replaces the expressions read from ``files``.
    """
    path = unix_path(F.col("path"))
    ignored = built_in(path) if use_defaults else F.lit(False)
    if rules is None and ignore_file is None:
        return files.withColumn("ignored", ignored)
    if files.isStreaming:  # a stream meets the static rules themselves
        joined = spread_join(files, rules, ["repo"], "left")
        own = F.coalesce(F.rlike(path, F.col("rule_regex")), F.lit(False))
        return joined.withColumn("ignored", ignored | own).drop("rule_regex")
    rules = repo_rules(files, ignore_file) if rules is None else rules
    hidden = (spread_join(files.select("repo", "path").distinct(), rules, ["repo"], salts=SALTS)
              .where(F.rlike(path, F.col("rule_regex"))).select("repo", "path", F.lit(True).alias("_own")))
    joined = spread_join(files, hidden, ["repo", "path"], "left")
    return joined.withColumn("ignored", ignored | F.coalesce("_own", F.lit(False))).drop("_own")


def visible(files: DataFrame, use_defaults: bool = True, ignore_file: str | None = IGNORE_FILE) -> DataFrame:
    return flagged(files, use_defaults, ignore_file).where(~F.col("ignored")).drop("ignored")
