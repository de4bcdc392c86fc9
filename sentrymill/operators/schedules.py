"""Schedules: due rows, next run, request validation, repository URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values.posture import CHECKS

# fixed values: hours per interval; anything else advances by a day
INTERVALS = {"hourly": 1, "daily": 24, "weekly": 168}
STRICT_REPO = r"\Ahttps://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?\z"
REPO_PARTS = r"\Ahttps?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?\z"
CLONEABLE = r"\Ahttps?://(?:github|gitlab)\.com/"


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Active schedules whose next run is not after ``now``; unreadable times never are."""
    return schedules.where(F.col("active") & (F.try_to_timestamp("next_run") <= now))


def advanced(schedules: DataFrame, now: Column) -> DataFrame:
    """last_run = now, next_run = now + interval (counted from now, not from the old next run)."""
    hours = F.lit(24)
    for name, h in INTERVALS.items():
        hours = F.when(F.col("interval") == name, F.lit(h)).otherwise(hours)
    return (schedules.withColumn("last_run", now)
            .withColumn("next_run", now + F.make_dt_interval(F.lit(0), hours)))


def validated(requests: DataFrame, plan: Column, is_admin: Column | None = None) -> DataFrame:
    """``requests`` with ``reason``: null when accepted, else the first rule that rejects it."""
    kind, target = F.trim("kind"), F.trim("target")
    known = kind.isin(["check:" + c[0] for c in CHECKS])
    allowed = (plan == "pro") if is_admin is None else (plan == "pro") | is_admin
    reason = (F.when(~allowed, "plan")
              .when(~F.coalesce(F.trim("interval"), F.lit("daily")).isin(list(INTERVALS)), "interval")
              .when((kind == "repo") & ~target.rlike(STRICT_REPO), "repository")
              .when(F.startswith(kind, F.lit("check:")) & ~known, "check")
              .when((kind != "repo") & ~F.startswith(kind, F.lit("check:")), "kind")
              .when(target == "", "target"))
    return requests.withColumn("reason", reason)


def parsed_repos(urls: DataFrame, column: str = "url") -> DataFrame:
    """owner and name of a repository URL (nulls when it is none), and the two host tests."""
    url = F.trim(column)
    ok = url.rlike(REPO_PARTS)
    return urls.select(
        "*", F.when(ok, F.regexp_extract(url, REPO_PARTS, 1)).alias("owner"),
        F.when(ok, F.regexp_extract(url, REPO_PARTS, 2)).alias("name"),
        F.col(column).rlike(CLONEABLE).alias("cloneable"), F.col(column).rlike(STRICT_REPO).alias("schedulable"))
