"""Disclosure cases: one row per repository, their findings as rows of their own.

Findings are never gathered into one array per case: a repository may hold a
large share of all findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.fixed_values.guidance import GENERIC_GUIDANCE, GUIDANCE
from sentrymill.functions.ids import location_key
from sentrymill.functions.network import blob_url
from sentrymill.session import durable, literal_table, spread_join

STATUSES = ["pending", "approved", "disclosed", "dismissed"]
DEFAULT_TARGET = 10  # fixed value of the feed job


def normalised_feeds(search_items: DataFrame, projects: DataFrame) -> DataFrame:
    """Two feed shapes as (full_name, url, owner, source)."""
    first = search_items.select("full_name", F.col("html_url").alias("url"), F.col("owner.login").alias("owner"),
                                F.lit("github").alias("source"))
    second = projects.select(
        F.coalesce("path_with_namespace", "name", F.lit("")).alias("full_name"),
        F.coalesce("web_url", F.lit("")).alias("url"),
        F.coalesce("namespace.path", F.lit("")).alias("owner"), F.lit("gitlab").alias("source"))
    return first.unionByName(second)


def disclosure_findings(findings: DataFrame, repo_url: Column) -> DataFrame:
    """Secret and code findings in one shape, with a link and a location key."""
    wanted = findings.where(F.col("phase").isin("secrets", "code"))
    secret = F.col("phase") == "secrets"
    return wanted.select(
        "target", F.when(secret, "Secret").otherwise("Code").alias("kind"), F.col("issue_type").alias("type"),
        "severity", "category", "file", F.col("line_no").alias("line"),
        F.when(secret, F.col("matched_value")).otherwise(F.col("description")).alias("detail"), "context",
        blob_url(repo_url, F.col("file"), F.col("line_no")).alias("url"),
        location_key(F.col("target"), F.col("issue_type"), F.col("file"), F.col("line_no")).alias("key"))


def new_cases(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """Candidates (repo, owner, repo_url) whose repository is not tracked yet, one per repository."""
    fresh = spread_join(candidates, cases.select("repo").distinct(), ["repo"], "left_anti")
    return fresh.groupBy("repo").agg(F.min(F.struct("owner", "repo_url")).alias("c")).select(
        "repo", "c.owner", F.coalesce(F.col("c.repo_url"), F.concat(F.lit("https://github.com/"), F.col("repo")))
        .alias("repo_url"), F.lit("pending").alias("status"))


def with_status(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Cases under their newest valid status event; unknown statuses and cases change nothing."""
    newest = (events.where(F.col("status").isin(STATUSES)).groupBy("id")
              .agg(F.max(F.struct("ts", "status")).alias("e")))
    joined = cases.join(newest, "id", "left")
    return (joined.withColumn("status", F.coalesce("e.status", "status"))
            .withColumn("updated_at", F.coalesce("e.ts", "created_at")).drop("e"))


def _known(severity: Column) -> Column:
    return F.upper(F.coalesce(severity, F.lit("LOW")))


def annotated(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Cases with counts per severity, worst severity and size, worst first and newest within."""
    severity = _known(F.col("severity"))
    rank = schema.severity_rank(severity)
    per_case = findings.groupBy("repo").agg(
        *schema.severity_counts(severity), F.count("*").alias("finding_count"), F.min(rank).alias("_rank"))
    zero = F.lit(0).cast("bigint")
    names = [s.lower() for s in schema.SEVERITIES] + ["finding_count"]
    joined = cases.join(per_case, "repo", "left").select(
        *cases.columns, *[F.coalesce(n, zero).alias(n) for n in names],
        schema.severity_of_rank(F.col("_rank"), "LOW").alias("worst"))
    return joined.orderBy(schema.severity_rank(F.col("worst")), F.desc("created_at"), "repo")


def worst_buckets(annotated_cases: DataFrame) -> DataFrame:
    return annotated_cases.agg(*schema.severity_counts(F.col("worst")))


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def by_status(cases: DataFrame, status: str | None) -> DataFrame:
    wanted = cases if status is None else cases.where(F.col("status") == status)
    return wanted.orderBy(F.desc("created_at"), "repo")


def explained(df: DataFrame, category: str) -> DataFrame:
    """Impact and remedy of a category column; the general text where the category is unknown."""
    table = literal_table(df.sparkSession, ["_category", "_impact", "_fix"], GUIDANCE)
    joined = df.join(F.broadcast(table), F.lower(F.coalesce(category, F.lit(""))) == F.col("_category"), "left")
    return joined.select(*df.columns, F.coalesce("_impact", F.lit(GENERIC_GUIDANCE[0])).alias("impact"),
                         F.coalesce("_fix", F.lit(GENERIC_GUIDANCE[1])).alias("fix"))


def guidance(findings: DataFrame, order: list[str]) -> DataFrame:
    """(repo, position, category, impact, fix): each category once, by its first appearance in ``order``.

    At most one row per (repository, category) survives the partial aggregation.
    """
    category = F.lower(F.coalesce("category", F.lit("")))
    shown = F.when(category == "", F.lower(F.coalesce("kind", F.lit("general")))).otherwise(category)
    first = findings.groupBy("repo", category.alias("_key")).agg(F.min(F.struct(*order, shown.alias("shown"))).alias("f"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(*[f"f.{c}" for c in order])).alias("position")
    placed = first.select("repo", place, "_key", F.col("f.shown").alias("category"))
    return explained(placed, "_key").drop("_key")


def until_n(repos: DataFrame, findings: DataFrame, severities: list[str], target: int = DEFAULT_TARGET,
            max_repos: int | None = None, found: int = 0, scanned: int = 0) -> DataFrame:
    """The feed job: untracked repositories in arrival order until ``target`` findings are reached.

    ``repos``: (repo, arrival).  The test comes before each repository, so the last one may overshoot.  ``found``
    and ``scanned`` continue an earlier step; a caller may stop the job after ``max_repos`` repositories.  The
    running sum is counted within ranges of the order and from the sums of the ranges before, so no task
    holds all repositories.
    """
    looked_at = repos if max_repos is None else repos.orderBy("arrival", "repo").limit(max(max_repos - scanned, 0))
    wanted = findings if not severities else findings.where(
        F.upper(F.coalesce("severity", F.lit(""))).isin([s.upper() for s in severities]))
    counted = (spread_join(wanted.select("repo"), looked_at, ["repo"], "left_semi")
               .groupBy("repo").agg(F.count("*").alias("found")))
    joined = looked_at.join(counted, "repo", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("bigint")))
    ranged = durable(joined.repartitionByRange("arrival", "repo").withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    zero = F.lit(0).cast("bigint")
    offsets = (ranged.groupBy("_part").agg(F.sum("found").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(earlier), zero).alias("_offset")).where(F.col("_offset") + found < target))
    inside = Window.partitionBy("_part").orderBy("arrival", "repo").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("found").over(inside), zero) + F.col("_offset") + F.lit(found)
    return (ranged.join(offsets, "_part").withColumn("found_before", before).where(F.col("found_before") < target)
            .select("repo", "arrival", "found", "found_before", (F.col("found") > 0).alias("queued")))
