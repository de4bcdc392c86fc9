"""Rescan with change detection: diff against the newest stored run, then store the new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.operators import diff, exports
from sentrymill.session import durable, spread_join
from sentrymill.sources import stores


def baseline(targets: DataFrame, runs: DataFrame, run_fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest repo run of each target, and that run's fingerprints.  Anyone's run counts."""
    newest = diff.latest_runs(spread_join(runs, targets.select("target").distinct(), ["target"], "left_semi"), "repo")
    named = newest.select(F.col("id").alias("run_id"))
    return newest, spread_join(run_fingerprints, named, ["run_id"], "left_semi")


def summarised(targets: DataFrame, findings: DataFrame, newest: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per target: counts, total (licences included), changes, and whether a baseline existed."""
    counts = findings.groupBy("target").agg(*schema.severity_counts(F.col("severity")), F.count("*").alias("total"))
    states = diff.change_counts(changes)
    names = [s.lower() for s in schema.SEVERITIES] + ["total", "new", "fixed", "unchanged"]
    joined = (targets.select("target").distinct().join(counts, "target", "left").join(states, "target", "left")
              .join(newest.select("target", F.lit(True).alias("_old")), "target", "left"))
    return joined.select("target", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in names],
                         F.coalesce("_old", F.lit(False)).alias("baseline_existed"))


def compared(targets: DataFrame, findings: DataFrame, runs: DataFrame,
             run_fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, changes) of a scan of ``targets`` against the stored runs."""
    newest, previous = baseline(targets, runs, run_fingerprints)
    changes = diff.run_diff(previous, diff.fingerprints(findings))
    return summarised(targets, findings, newest, changes), changes


def rescan(spark: SparkSession, targets: DataFrame, findings: DataFrame, store: str, user_id: int,
           run_at: Column) -> tuple[DataFrame, DataFrame]:
    """Compare, store run and fingerprints, and return (summary, notifications).

    ``targets``: (target, run_id).  The comparison is made durable before
    anything is appended, or a run would become its own baseline.
    """
    runs_path, fps_path = f"{store}/runs", f"{store}/fingerprints"
    kept = durable(findings)
    summary, changes = compared(targets, kept, stores.read(spark, runs_path, stores.RUNS),
                                stores.read(spark, fps_path, stores.FINGERPRINTS))
    summary, changes = durable(summary), durable(changes)
    stamped = summary.join(targets, "target").select(
        F.col("run_id").alias("id"), F.lit(user_id).cast("bigint").alias("user_id"), "target",
        run_at.alias("created_at"), *[F.col(s.lower()).cast("int").alias(s.lower()) for s in schema.SEVERITIES],
        F.col("total").cast("int").alias("total"), F.lit("repo").alias("kind"))
    current = diff.fingerprints(kept).join(targets, "target").withColumn("created_at", run_at)
    stores.append(current, fps_path, stores.FINGERPRINTS)
    stores.append_runs(stamped, runs_path)
    known = spread_join(changes, summary.where("baseline_existed").select("target"), ["target"], "left_semi")
    return summary, exports.change_payload(known)
