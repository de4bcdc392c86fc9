"""Counts, gates, usage and history roll-ups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill import schema

MONTHLY_QUOTA = 20  # fixed value: runs per calendar month on the free plan
GATE_LEVELS = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def only_severities(findings: DataFrame, severities: Iterable[str]) -> DataFrame:
    return findings.where(F.upper("severity").isin([s.upper() for s in severities]))


def severity_counts(findings: DataFrame, key: str = "target") -> DataFrame:
    """Zero-filled counts per target; licences count here but not in ``total``."""
    return findings.groupBy(key).agg(*schema.severity_counts(F.col("severity")),
                                     F.count_if(F.col("phase") != "licenses").alias("total"))


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """(target, failed, summary) for a threshold: a severity, ``any`` or ``never``."""
    counts = findings.groupBy("target").agg(*schema.severity_counts(F.col("severity")), F.count("*").alias("n"))
    level = GATE_LEVELS.get(fail_on.lower(), -1)
    reached = [s for i, s in enumerate(schema.SEVERITIES) if i <= level]
    listed = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(s.lower()) > 0, F.concat(F.col(s.lower()).cast("string"), F.lit(" " + s))) for s in reached]
        or [F.lit(None).cast("string")])), ", ")
    failed = F.lit(False)
    if fail_on.lower() == "any":
        failed, listed = F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" findings"))
    elif reached:
        failed = sum((F.col(s.lower()) for s in reached), F.lit(0)) > 0
    return counts.select("target", failed.alias("failed"), listed.alias("summary"))


def run_stats(runs: DataFrame, today: Column) -> DataFrame:
    """One row: runs, runs today, findings over all runs."""
    return runs.agg(F.count("*").alias("total"), F.count_if(F.to_date("created_at") == today).alias("today"),
                    F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("findings"))


def top_kinds(runs: DataFrame, limit: int = 6) -> DataFrame:
    """The feature is the top list; kinds of equal count go by name."""
    return runs.groupBy("kind").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "kind").limit(limit)


def effective_plan(today: Column) -> Column:
    """Pro lapses after the day in ``pro_until``; null never lapses."""
    return F.when((F.col("plan") == "pro") & (F.col("pro_until") < today), "free").otherwise(F.col("plan"))


def downgraded(users: DataFrame) -> DataFrame:
    """A plan other than pro carries no expiry."""
    return users.withColumn("pro_until", F.when(F.col("plan") == "pro", F.col("pro_until")))


def monthly_quota(users: DataFrame, runs: DataFrame, today: Column, quota: int = MONTHLY_QUOTA) -> DataFrame:
    """(id, plan, used, remaining): runs of the month; null remaining means unlimited."""
    month = F.date_trunc("MONTH", today.cast("timestamp"))
    used = (runs.where((F.col("created_at") >= month) & (F.col("created_at") < F.add_months(month, 1)))
            .groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("used")))
    joined = users.join(used, "id", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
    plan = effective_plan(today)
    remaining = F.when(plan != "pro", F.greatest(F.lit(0).cast("bigint"), F.lit(quota) - F.col("used")))
    return joined.select("id", plan.alias("plan"), "used", remaining.alias("remaining"))


def user_overview(users: DataFrame, runs: DataFrame) -> DataFrame:
    """Every user with the number of their runs, and whether the stored plan is pro."""
    counted = runs.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("runs"))
    return users.join(counted, "id", "left").select(
        "id", "plan", (F.col("plan") == "pro").alias("is_pro"), F.coalesce("runs", F.lit(0).cast("bigint")).alias("runs"))


def user_totals(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("users"), F.count_if(F.col("plan") == "pro").alias("pro"))


def visible_runs(runs: DataFrame, owner, is_admin: bool = False) -> DataFrame:
    return runs if is_admin else runs.where(F.col("user_id") == owner)


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs; each task keeps its own top rows."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def windowed_counts(runs: DataFrame, width: str = "1 day") -> DataFrame:
    """Runs and findings per tumbling window and kind (batch or stream)."""
    return (runs.groupBy(F.window("created_at", width), "kind")
            .agg(F.count("*").alias("runs"), F.sum("total").cast("bigint").alias("findings"))
            .select(F.col("window.start").alias("start"), "kind", "runs", "findings"))
