"""Append-only tables of runs, their fingerprints and cases.

Nothing is rewritten: a new state is a new row, and readers take the newest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.operators import cases as case_ops

RUNS = ("id bigint, user_id bigint, target string, created_at timestamp, critical int, high int, medium int, low int, "
        "total int, kind string")
FINGERPRINTS = ("run_id bigint, target string, created_at timestamp, id string, severity string, label string, "
                "kind string")
CASES = "id string, repo string, owner string, repo_url string, status string, created_at timestamp"
STATUS_EVENTS = "id string, status string, ts timestamp"


def append(df: DataFrame, path: str, schema: str, partition: str | None = None) -> None:
    columns = [part.split()[0] for part in schema.split(", ")]
    writer = df.select(*columns).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one before its first append."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # a store that can not be read is not an empty one
        return spark.createDataFrame([], schema)


def append_runs(runs: DataFrame, path: str) -> None:
    append(runs, path, RUNS, "kind")


def add_cases(candidates: DataFrame, path: str) -> DataFrame:
    """Append (id, repo, owner, repo_url, status, created_at) of repositories not tracked yet."""
    spark = candidates.sparkSession
    fresh = case_ops.new_cases(candidates, read(spark, path, CASES))
    stamped = fresh.select(
        F.sha1("repo").alias("id"), "repo", "owner", "repo_url", "status", F.current_timestamp().alias("created_at"))
    append(stamped, path, CASES)
    return read(spark, path, CASES)


def set_status(events: DataFrame, path: str) -> None:
    """Append status events (id, status, ts); unknown statuses are not stored."""
    append(events.where(F.col("status").isin(case_ops.STATUSES)), path, STATUS_EVENTS)


def current_cases(spark: SparkSession, cases_path: str, events_path: str) -> DataFrame:
    return case_ops.with_status(read(spark, cases_path, CASES), read(spark, events_path, STATUS_EVENTS))
