"""Upgrade plans and manifest rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.functions.text import basename, regex, split_lines, strip, unix_path
from sentrymill.functions.versions import package_key, version_key
from sentrymill.session import spread_join

EDITABLE = ["requirements.txt", "package.json"]
SECTIONS = ["dependencies", "devDependencies"]


def plan(findings: DataFrame) -> DataFrame:
    """The highest fix per (repo, file, package); the lowest (advisory, old version) among equals.

    The winner is an aggregate, so partial winners are chosen before the shuffle.
    """
    name = basename(unix_path(F.col("file")))
    usable = findings.where(name.isin(EDITABLE) & (F.coalesce(F.col("fixed_version"), F.lit("")) != ""))
    entry = F.struct("package", F.col("version").alias("old_version"), F.col("fixed_version").alias("new_version"),
                     "ecosystem", F.col("vuln_id").alias("advisory"), "severity")
    keyed = usable.select("repo", "file", package_key(F.col("package")).alias("package_key"),
                          version_key(F.col("fixed_version")).alias("fix_key"), entry.alias("entry"))
    # the highest key, then the smallest entry that has it
    best = keyed.groupBy("repo", "file", "package_key", "fix_key").agg(
        F.min(F.struct("entry.advisory", "entry.old_version", "entry.package", "entry.new_version",
                       "entry.ecosystem", "entry.severity")).alias("entry"))
    top = best.groupBy("repo", "file", "package_key").agg(F.max_by("entry", "fix_key").alias("entry"))
    return top.select("repo", "file", "package_key", "entry.package", "entry.old_version", "entry.new_version",
                      "entry.ecosystem", "entry.advisory", "entry.severity")


def _per_file(bumps: DataFrame, key: str) -> DataFrame:
    """One map of new versions per file: bounded by the packages that one manifest names."""
    pairs = F.collect_set(F.struct(F.col(key).alias("k"), F.col("new_version").alias("v")))
    return bumps.groupBy("repo", F.col("file").alias("path")).agg(F.map_from_entries(pairs).alias("_fixes"))


def rewrite_requirements(content: Column, fixes: Column) -> Column:
    """Pins of planned packages become ``>=`` the fix; their markers, hashes and comments go with the old pin."""
    shape = regex(r"\A(\s*)([A-Za-z0-9][A-Za-z0-9_.\-]*)(\[[^\]]*\])?\s*(.*)\z")

    def rewritten(line: Column) -> Column:
        untouched = strip(line).rlike(r"\A(?:#|-|git\+)|://")
        new = F.try_element_at(fixes, package_key(F.regexp_extract(line, shape, 2)))
        kept = F.concat(F.regexp_extract(line, shape, 1), F.regexp_extract(line, shape, 2),
                        F.regexp_extract(line, shape, 3))
        return F.when(~untouched & line.rlike(shape) & new.isNotNull(),
                      F.concat(kept, F.lit(">="), new)).otherwise(line)

    text = F.array_join(F.transform(split_lines(content), rewritten), "\n")
    return F.when(F.endswith(content, F.lit("\n")), F.concat(text, F.lit("\n"))).otherwise(text)


def requirements_edits(files: DataFrame, bumps: DataFrame) -> DataFrame:
    """(repo, path, content) of every requirements file with a planned bump, rewritten."""
    wanted = files.where(basename(F.col("path")) == "requirements.txt")
    joined = spread_join(wanted, _per_file(bumps, "package_key"), ["repo", "path"])
    return joined.select("repo", "path", rewrite_requirements(F.col("content"), F.col("_fixes")).alias("content"))


def package_json_edits(files: DataFrame, bumps: DataFrame) -> DataFrame:
    """(repo, path, section, package, version): dependency sections with planned ``^`` fixes in place.

    Names are compared exactly here, unlike in the plan.
    """
    wanted = files.where(basename(F.col("path")) == "package.json")
    joined = spread_join(wanted, _per_file(bumps, "package"), ["repo", "path"])
    parsed = F.from_json("content", ", ".join(f"{s} map<string,string>" for s in SECTIONS))
    sections = joined.select("repo", "path", "_fixes", parsed.alias("doc"))
    stacked = sections.select("repo", "path", "_fixes", F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.col(f"doc.{s}").alias("entries")) for s in SECTIONS])))
    fixed = F.transform_values("entries", lambda k, v: F.coalesce(
        F.concat(F.lit("^"), F.try_element_at(F.col("_fixes"), k)), v))
    return stacked.where(F.col("entries").isNotNull()).select(
        "repo", "path", "section", F.explode(fixed).alias("package", "version"))


# A string, a sign, white space, anything else; a quote that nothing closes stands alone.
_TOKEN = r'''"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[ \t\r\n]++|[^"{}\[\]:, \t\r\n]++|"'''


def _edited(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, _texts): the tokens of each text in their order, planned versions in place.

    A version is the string behind a name and a colon, in an object two levels deep that a section's name and a colon stand in front of.
    Depth, the section that is open and the tokens before are windows over a text's tokens that are not blank.
    """
    order = Window.partitionBy(*key, "_blank").orderBy("_at")
    token = F.col("_token")
    step = F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
    placed = (tokens.withColumn("_blank", F.trim(token, F.lit(" \t\r\n")) == "")
              .withColumn("_depth", F.sum(step).over(order) - F.when(step > 0, 1).otherwise(0))
              .withColumn("_before", F.lag("_token", 1).over(order)).withColumn("_name", F.lag("_token", 2).over(order)))
    named = (F.col("_before") == ":") & F.startswith("_name", F.lit('"'))
    opened = F.when((step > 0) & (F.col("_depth") == 1), F.when((token == "{") & named, F.col("_name")).otherwise(""))
    placed = placed.withColumn("_section", F.last(opened, ignorenulls=True).over(order))
    fix = F.try_element_at(F.col("_fixes"), F.substring("_name", F.lit(2), F.length("_name") - 2))
    hit = (~F.col("_blank") & F.startswith(token, F.lit('"')) & (F.col("_depth") == 2) & named
           & F.col("_section").isin([f'"{s}"' for s in SECTIONS]) & fix.isNotNull())
    text = F.when(hit, F.concat(F.lit('"^'), fix, F.lit('"'))).otherwise(token)
    return placed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", text.alias("text")))).alias("_texts"))


def package_json_rewrites(files: DataFrame, bumps: DataFrame) -> DataFrame:
    """(repo, path, content) of every package.json with a planned bump: planned fixes as ``^`` ranges in its own dependency sections; all else,
    order, layout and objects that only look like sections, stays.  Names are compared exactly here."""
    wanted = files.where((basename(F.col("path")) == "package.json") & F.col("content").isNotNull())
    joined = spread_join(wanted, _per_file(bumps, "package"), ["repo", "path"])
    key = ["repo", "path", "_of"]
    tokens = joined.select("repo", "path", F.xxhash64("content").alias("_of"), "_fixes", F.posexplode(
        F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0))).alias("_at", "_token"))
    return _edited(tokens, key).select("repo", "path", F.array_join(F.col("_texts.text"), "").alias("content"))
