"""Schemas and severity ranks shared by all jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
PHASES = ["secrets", "deps", "code", "git_history", "licenses"]

FILES = "repo string, path string, content string"

FINDING_COLUMNS = {
    "target": "string", "phase": "string", "kind": "string", "file": "string", "line_no": "int",
    "issue_type": "string", "category": "string", "severity": "string", "description": "string",
    "context": "string", "package": "string", "version": "string", "ecosystem": "string",
    "vuln_id": "string", "fixed_version": "string", "license": "string", "commit": "bigint",
    "matched_value": "string",
}

ADVISORY = """
id string, summary string, withdrawn string,
severity array<struct<type: string, score: string>>,
affected array<struct<package: struct<ecosystem: string, name: string>,
                      versions: array<string>,
                      ranges: array<struct<type: string,
                                           events: array<struct<introduced: string, fixed: string, last_affected: string>>>>>>,
database_specific struct<severity: string>
"""


def severity_rank(severity: Column) -> Column:
    """0 is worst; anything unknown ranks after LOW."""
    rank = F.lit(9)
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def severity_of_rank(rank: Column, empty: str) -> Column:
    label = F.lit(empty)
    for i, name in enumerate(SEVERITIES):
        label = F.when(rank == i, F.lit(name)).otherwise(label)
    return label


def severity_counts(severity: Column) -> list[Column]:
    return [F.count_if(severity == s).alias(s.lower()) for s in SEVERITIES]
