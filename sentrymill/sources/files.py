"""Reading source trees and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.functions.text import decode


def read_trees(spark: SparkSession, root: str, max_bytes: int | None = None, name_glob: str | None = None) -> DataFrame:
    """files(repo, path, content, valid_utf8) of all repositories below ``root``, one folder each.

    Size and path are known before any content is read, so filters on them
    (and on anything derived from the path) skip the read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    found = reader.load(root)
    if max_bytes is not None:
        found = found.where(F.col("length") <= max_bytes)
    below = _below(spark, root)
    text = F.col("content").cast("string")
    return found.select(
        F.substring_index(below, "/", 1).alias("repo"), F.regexp_replace(below, r"\A[^/]*/", "").alias("path"),
        decode(F.col("content")).alias("content"), F.is_valid_utf8(text).alias("valid_utf8"))


def oversized(spark: SparkSession, root: str, max_bytes: int) -> DataFrame:
    """(repo, path, length, error) of the files that ``read_trees`` leaves out for their size; no content is read."""
    below = _below(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") > max_bytes)
    return found.select(
        F.substring_index(below, "/", 1).alias("repo"), F.regexp_replace(below, r"\A[^/]*/", "").alias("path"), "length",
        F.format_string("%s bytes, more than %s", F.col("length").cast("string"), F.lit(str(max_bytes))).alias("error"))


def _below(spark: SparkSession, root: str) -> Column:
    """The path of a listed file below the root."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    return F.substring("path", len(prefix) + 1, 2147483647)


def read_advisories(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """doc STRING: one advisory object per file, or with ``lines`` per line (a dump of any size is then split)."""
    found = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("doc"))
    return found.where(F.trim("doc") != "")


LICENCE_FEED = "ecosystem string, package string, version string, licenses array<string>"


def read_licences(spark: SparkSession, path: str) -> DataFrame:
    """Licence metadata as JSON lines; a null list is a failed lookup."""
    return spark.read.schema(LICENCE_FEED).json(path)
