"""The scan, diff and roll-up jobs over arriving data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sentrymill.operators import cases, diff, ignore, line_scan, rollups
from sentrymill.session import durable, spread_join
from sentrymill.sources import stores


def scan_files(files: DataFrame, rules: DataFrame | None = None, use_defaults: bool = True) -> DataFrame:
    """Code and secret findings of arriving files(repo, path, content[, ts]).  Stateless.

    ``rules`` holds the repositories' own ignore expressions (a static table of
    (repo, rule_regex)); the built-in patterns are a constant.
    """
    visible = ignore.flagged(files, use_defaults, None, rules).where(~F.col("ignored")).drop("ignored")
    return line_scan.tagged_findings(visible).select("phase", "repo", "path", "line_no", "issue_type", "category", "severity", "context")


def deduplicated(findings: DataFrame, time: str, delay: str) -> DataFrame:
    """The first of each (target, id) within ``delay``; state is dropped after it."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["target", "id"])


def windowed_counts(runs: DataFrame, width: str, delay: str) -> DataFrame:
    """Tumbling counts; rows more than ``delay`` behind the newest are dropped."""
    return rollups.windowed_counts(runs.withWatermark("created_at", delay), width)


def _earlier(spark, path: str, schema: str, epoch: int) -> DataFrame:
    # a replayed micro-batch must not see what its first attempt wrote
    return stores.read(spark, path, f"{schema}, epoch bigint").where(F.col("epoch") < epoch)


def _write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


DIFFS = "target string, id string, severity string, kind string, label string, state string"
ARRIVED = f"{stores.FINGERPRINTS}, run_size bigint"
LATEST = "target string, run_id bigint, created_at timestamp, at bigint"


def _newest(spark, path: str, schema: str, epoch: int) -> DataFrame:
    """The snapshot of the micro-batch before (they are numbered without gaps); older ones are not read."""
    return stores.read(spark, path, f"{schema}, epoch bigint").where(F.col("epoch") == epoch - 1).drop("epoch")


def continuous_diff(fingerprints: DataFrame, store: str, checkpoint: str) -> DataStreamWriter:
    """Compare each run with the newest earlier run of its target, as soon as all of its rows have arrived.

    ``fingerprints``: stream of (run_id, target, kind, created_at, id, severity, label, run_size), ``run_size`` being the rows of
    the run.  A run may be split over micro-batches; rows of unfinished runs wait in a snapshot, as does the place of each
    target's newest run (target, run, the epoch that holds its rows).  A batch reads the newest snapshots and the epochs that its own
    targets point to, whatever the history.  Each batch writes its own epoch folders, so a replay replaces rather than
    repeats.  Of several finished runs of one target in a batch the newest counts; one older than the stored run is left out.
    """
    def process(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        waiting = _newest(spark, f"{store}/waiting", ARRIVED, epoch)
        columns = waiting.columns
        rows = durable(batch.select(*columns).unionByName(waiting).distinct())
        sizes = rows.groupBy("target", "run_id", "created_at").agg(F.count("*").alias("_n"), F.max("run_size").alias("_size"))
        whole = sizes.where(F.col("_n") >= F.col("_size")).select("target", "run_id", "created_at")
        known = _newest(spark, f"{store}/latest", LATEST, epoch)
        newest = (whole.groupBy("target").agg(F.max(F.struct("created_at", "run_id")).alias("r"))
                  .select("target", F.col("r.run_id").alias("run_id"), F.col("r.created_at").alias("created_at")))
        before = known.select("target", F.col("run_id").alias("_run"), F.col("created_at").alias("_when"), "at")
        due = durable(newest.join(before, "target", "left")
                      .where(F.col("_when").isNull() | (F.struct("created_at", "run_id") > F.struct("_when", "_run"))))
        current = spread_join(rows, due.select("target", "run_id"), ["target", "run_id"], "left_semi").drop("run_size")
        epochs = [r["at"] for r in due.where("at is not null").select("at").distinct().collect()]  # of this batch's targets
        past = _earlier(spark, f"{store}/fingerprints", stores.FINGERPRINTS, epoch).where(F.col("epoch").isin(epochs)).drop("epoch")
        previous = spread_join(past, due.select("target", F.col("_run").alias("run_id")), ["target", "run_id"], "left_semi")
        _write_epoch(diff.run_diff(previous, current), f"{store}/diffs", epoch)
        _write_epoch(current, f"{store}/fingerprints", epoch)
        moved = due.select("target", "run_id", "created_at", F.lit(epoch).cast("bigint").alias("at"))
        _write_epoch(known.join(moved, "target", "left_anti").unionByName(moved), f"{store}/latest", epoch)
        _write_epoch(spread_join(rows, whole.select("target", "run_id"), ["target", "run_id"], "left_anti"), f"{store}/waiting", epoch)

    return fingerprints.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


PROGRESS = "repo string, arrival string, found bigint, found_before bigint, queued boolean"


def case_feed(repos: DataFrame, findings_of: Callable[[DataFrame], DataFrame], store: str, checkpoint: str,
              severities: list[str], target: int = cases.DEFAULT_TARGET,
              max_repos: int | None = None) -> DataStreamWriter:
    """The feed job over arriving (repo, arrival) until ``target`` findings, or ``max_repos`` repositories.

    ``findings_of`` scans a batch of repositories.  Progress is the sum over
    earlier epochs, at most ``max_repos`` rows.
    """
    def process(batch: DataFrame, epoch: int) -> None:
        done = _earlier(batch.sparkSession, store, PROGRESS, epoch)
        so_far = done.agg(F.coalesce(F.sum("found"), F.lit(0)), F.count("*")).first()
        fresh = batch.join(done.select("repo"), "repo", "left_anti")
        step = cases.until_n(fresh, findings_of(fresh), severities, target, max_repos, so_far[0], so_far[1])
        _write_epoch(step, store, epoch)

    return repos.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
