"""Prompts for an explanation generator, their cache keys, and the generator hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.session import spread_join


def prompts(findings: DataFrame, model: str) -> DataFrame:
    """``findings`` with ``prompt`` and its cache ``key``; secrets appear masked only."""
    secret = F.col("phase").isin("secrets", "git_history")
    issue = F.coalesce("issue_type", F.lit("Finding"))
    described = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).when(
        secret, F.format_string("Hardcoded secret of type '%s' detected (value masked).", issue))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Issue: "), issue),
        F.concat(F.lit("Category: "), F.when(F.col("phase").isin("deps", "licenses"), "?").otherwise(
            F.coalesce("category", F.lit("?")))),
        F.concat(F.lit("Severity: "), F.upper(F.coalesce("severity", F.lit("info")))),
        F.concat(F.lit("File: "), F.coalesce("file", F.lit("?")), F.lit(":"),
                 F.coalesce(F.col("line_no").cast("string"), F.lit("?"))),
        F.concat(F.lit("Code: "), F.coalesce("context", F.lit(""))),
        F.concat(F.lit("Description: "), F.coalesce(described, F.lit("-"))))
    return findings.withColumn("prompt", text).withColumn("key", F.sha1(F.concat(F.lit(model + "\n"), F.col("prompt"))))


def uncached(prompted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (key, prompt) without a non-empty cached text."""
    distinct = prompted.groupBy("key").agg(F.min("prompt").alias("prompt"))
    held = cache.where(F.coalesce("text", F.lit("")) != "").select("key").distinct()
    return spread_join(distinct, held, ["key"], "left_anti")


def generated(distinct_prompts: DataFrame, generate: Callable[[str], str | None]) -> DataFrame:
    """(key, text, error) from a user-supplied generator, run in the executors over Arrow batches.

    Every prompt gives a row: an answer, or the error of the generator ("no answer" if it answers with nothing).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [_attempt(generate, prompt) for prompt in batch["prompt"]]
            yield pd.DataFrame({"key": batch["key"], "text": [a[0] for a in answers], "error": [a[1] for a in answers]})

    return distinct_prompts.mapInPandas(run, "key string, text string, error string")


def _attempt(generate: Callable[[str], str | None], prompt: str) -> tuple[str | None, str | None]:
    try:
        text = (generate(prompt) or "").strip()
    except Exception as error:  # one prompt's failure is a row, not the end of the job
        return None, f"{type(error).__name__}: {error}"
    return (text, None) if text else (None, "no answer")
