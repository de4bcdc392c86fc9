"""What a path is: kind of source file, manifest, hidden directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values import rules as R
from sentrymill.fixed_values.packages import MANIFESTS
from sentrymill.functions.text import basename, contains_any
from sentrymill.session import let


def _in_dirs(path: Column, names: list[str]) -> Column:
    # byte searches are cheaper than one expression for all names; a filter on a computed path makes the path once
    return let(F.concat(F.lit("/"), path), lambda p: contains_any(p, [f"/{name}/" for name in names]))


def skipped_for_code(path: Column) -> Column:
    return _in_dirs(path, R.CODE_SKIP_DIRS)


def skipped_for_dependencies(path: Column) -> Column:
    return _in_dirs(path, R.DEPENDENCY_SKIP_DIRS)


def _suffix_in(path: Column, names: list[str]) -> Column:
    # a dot-file such as ".py" has no suffix
    return path.rlike(r"(?i)(?:\A|/)[^/]+\.(?:" + "|".join(names) + r")\z")


def file_kind(path: Column) -> Column:
    """code, dockerfile, iac, workflow or null; the first that fits."""
    name = F.lower(basename(path))
    dockerfile = (name == "dockerfile") | F.startswith(name, F.lit("dockerfile.")) | F.endswith(
        name, F.lit(".dockerfile"))
    iac = _suffix_in(path, R.IAC_EXTENSIONS) | name.isin(R.COMPOSE_NAMES)
    workflow = path.rlike(r"\A\.github/workflows/.") & _suffix_in(path, ["yml", "yaml"])
    return (F.when(_suffix_in(path, R.CODE_EXTENSIONS), "code").when(dockerfile, "dockerfile")
            .when(iac, "iac").when(workflow, "workflow"))


def sensitive_kind(path: Column) -> Column:
    """The kind of sensitive file a name stands for, or null."""
    name = F.lower(basename(path))
    return (F.when((name == ".env") | F.startswith(name, F.lit(".env.")), ".env")
            .when(F.endswith(name, F.lit(".pem")), "*.pem")
            .when(F.endswith(name, F.lit(".key")), "*.key")
            .when(name.isin(R.PRIVATE_KEY_NAMES), "id_rsa")
            .when(F.endswith(name, F.lit(".p12")) | F.endswith(name, F.lit(".pfx")), "*.p12"))


def manifest_ecosystem(path: Column) -> Column:
    name = basename(path)
    eco = F.lit(None).cast("string")
    for manifest, ecosystem in reversed(MANIFESTS):
        eco = F.when(name == manifest, F.lit(ecosystem)).otherwise(eco)
    return eco


def classified(files: DataFrame) -> DataFrame:
    """Code-phase files with their kind; the filter reads the path only."""
    kind = file_kind(F.col("path"))
    return files.where(~skipped_for_code(F.col("path")) & kind.isNotNull()).withColumn("file_kind", kind)
