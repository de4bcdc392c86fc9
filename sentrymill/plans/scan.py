"""A repository scan: all phases into one findings table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.operators import advisories, classify, hygiene, ignore, line_scan, manifests, match, secrets
from sentrymill.session import durable

ALL_PHASES = ("secrets", "deps", "code")


def _unified(df: DataFrame, phase: str | Column, kind: str | Column, **columns: str) -> DataFrame:
    """``df`` in the findings schema; ``columns`` names the source of each filled column."""
    given = {"target": "repo", "severity": "severity", **columns}
    out = []
    for name, type_ in schema.FINDING_COLUMNS.items():
        if name == "phase":
            value = F.lit(phase)
        elif name == "kind":
            value = F.lit(kind)
        else:
            value = F.col(given[name]) if name in given else F.lit(None)
        out.append(value.cast(type_).alias(name))
    return df.select(*out)


_LINE = {"file": "path", "line_no": "line_no", "issue_type": "issue_type", "category": "category", "description": "description",
         "context": "context"}


def hygiene_phase(files: DataFrame) -> DataFrame:
    """Ignore-file hygiene over all files of a repository, hidden ones too."""
    return _unified(hygiene.gitignore_findings(files), "code", "Code", **_LINE)


def code_phase(files: DataFrame, visible: DataFrame) -> DataFrame:
    """Line rules over the visible files, and hygiene.  A reported line may hold a secret too; ``match`` masks it."""
    found = _unified(match.line_findings(classify.classified(visible)), "code", "Code", **_LINE)
    return found.unionByName(hygiene_phase(files))


def _secret_columns(found: DataFrame, phase: str, **more: str) -> DataFrame:
    return _unified(found, phase, "Secret", file="path", line_no="line_no", issue_type="secret_type",
                    category="category", context="masked_context", matched_value="matched_value", **more)


def secrets_phase(visible: DataFrame) -> DataFrame:
    shown = visible.where(~classify.skipped_for_code(F.col("path")))
    return _secret_columns(secrets.secret_findings(shown), "secrets")


def line_phases(files: DataFrame, visible: DataFrame) -> DataFrame:
    """The secrets and the code phase together: visible files are split into lines once."""
    kind = F.when(F.col("phase") == "code", "Code").otherwise("Secret")
    found = _unified(line_scan.tagged_findings(visible), F.col("phase"), kind, **_LINE, matched_value="matched_value")
    return found.unionByName(hygiene_phase(files))


def declared_packages(files: DataFrame, use_default_ignores: bool, ignore_file: str | None,
                      phases: Iterable[str] = ("deps", "licenses")) -> DataFrame:
    """Declared packages with two flags: hidden from the dependency phase, and from the licence phase.

    The licence phase always honours the built-in patterns, whatever the others use.  All is hidden from a phase that is not asked for.
    """
    wanted = manifests.manifests(files)
    if ignore_file is not None:  # the rules come from the ignore files themselves
        rules = ignore.repo_rules(files, ignore_file)
        own = ignore.flagged(wanted, False, None, rules)
    else:
        own = wanted.withColumn("ignored", F.lit(False))
    built_in = ignore.built_in(F.col("path"))
    hidden = F.col("ignored") | built_in
    asked = {"no_deps": ("deps", hidden if use_default_ignores else F.col("ignored")), "no_licence": ("licenses", hidden)}
    flags = own.withColumns({flag: value if phase in phases else F.lit(True) for flag, (phase, value) in asked.items()})
    return manifests.packages(flags.where(~(F.col("no_deps") & F.col("no_licence"))), extra=("no_deps", "no_licence"))


def dependency_phase(declared: DataFrame, advisory_table: DataFrame) -> DataFrame:
    found = advisories.dependency_findings(declared.where(~F.col("no_deps")).drop("no_deps", "no_licence"), advisory_table)
    return _unified(found.withColumn("_category", F.lit("dep")), "deps", "Dependency", file="file", category="_category",
                    description="summary", package="package", version="version", ecosystem="ecosystem",
                    vuln_id="vuln_id", fixed_version="fixed_version")


def licence_phase(declared: DataFrame, licence_feed: DataFrame) -> DataFrame:
    found = advisories.licence_findings(declared.where(~F.col("no_licence")).drop("no_deps", "no_licence"), licence_feed)
    return _unified(found.withColumn("_category", F.lit("license")), "licenses", "License", file="file",
                    category="_category", description="reason", package="package", version="version",
                    ecosystem="ecosystem", license="license")


def history_phase(versions: DataFrame, files: DataFrame) -> DataFrame:
    return _secret_columns(secrets.history_findings(versions, files), "git_history", commit="commit")


def scan(files: DataFrame, phases: Iterable[str] = ALL_PHASES, advisory_table: DataFrame | None = None,
         licence_feed: DataFrame | None = None, versions: DataFrame | None = None, use_default_ignores: bool = True,
         ignore_file: str | None = ignore.IGNORE_FILE) -> DataFrame:
    """Findings of the requested phases; a phase that is not requested is not in the plan.

    The phases that read the manifests share one extraction, kept durably where both are asked for; those that read lines share one split of the text.
    """
    phases = tuple(phases)
    together = {"secrets", "code"} <= set(phases)
    if {"deps", "licenses"} & set(phases):
        declared = declared_packages(files, use_default_ignores, ignore_file, phases)
        if {"deps", "licenses"} <= set(phases):
            declared = durable(declared)
    visible = ignore.visible(files, use_default_ignores, ignore_file)
    parts = []
    if together:
        parts.append(line_phases(files, visible))
    for phase in phases:
        if phase in ("secrets", "code") and together:
            continue
        if phase == "secrets":
            parts.append(secrets_phase(visible))
        elif phase == "deps":
            parts.append(dependency_phase(declared, advisory_table))
        elif phase == "code":
            parts.append(code_phase(files, visible))
        elif phase == "git_history":
            parts.append(history_phase(versions, files))
        elif phase == "licenses":
            parts.append(licence_phase(declared, licence_feed))
        else:
            raise ValueError(f"unknown phase {phase!r}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
