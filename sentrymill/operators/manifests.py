"""Packages declared in manifests.

Each extractor maps a manifest's text to an array of (package, version) within
its row, so all formats share one scan, nothing is shuffled, and the state some
formats need (an open ``require`` block) never crosses a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.fixed_values.packages import MANIFESTS
from sentrymill.functions.text import basename, regex, split_at, unix_lines
from sentrymill.functions.versions import purl
from sentrymill.operators.classify import manifest_ecosystem, skipped_for_dependencies
from sentrymill.session import let, numbered

#: Up to so many stretches of a repository in a range of the order are sent to where its components are.
FEW_STRETCHES = 500_000
PAIRS = "array<struct<package:string,version:string>>"


def _pair(package: Column, version: Column) -> Column:
    return F.struct(package.alias("package"), version.alias("version"))


def _matching(text: Column, pattern: str, first: int = 1) -> Column:
    """(group ``first``, the next group) of every match of the pattern; all lines of a text are searched at once."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(first + i)) for i in (0, 1)]
    return F.arrays_zip(groups[0].alias("package"), groups[1].alias("version")).cast(PAIRS)


def _after_first(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.size(items))


# Lines are read as if stripped: what may stand around them, and a row of characters that does not run into it. \x1f alone
# is such a character and yet no white space of a regular expression.
_BLANK = r"[\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*+"
_LINES = "(?dm)^" + _BLANK


def _up_to(stops: str) -> str:
    return rf"[^\s{stops}\x1f]*+(?:\x1f++(?!{_BLANK}$)[^\s{stops}\x1f]*+)*+"


def requirements(content: Column) -> Column:
    pin = regex(_LINES + r"(?!#|-|git\+|http)([A-Za-z0-9_\-.]+)[^\S\n]*[=<>!~^]{1,2}[^\S\n]*([0-9]" + _up_to(",;#") + ")")
    return let(unix_lines(content), lambda text: _matching(text, pin))


def package_json(content: Column) -> Column:
    def pairs(parsed: Column) -> Column:
        def section(name: str) -> Column:
            entries = F.coalesce(F.map_entries(parsed[name]), F.array().cast("array<struct<key:string,value:string>>"))
            return F.transform(entries, lambda e: _pair(e["key"], F.regexp_replace(e["value"], r"\A[^0-9]*", "")))

        return F.concat(section("dependencies"), section("devDependencies"))

    parsed = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    return F.filter(let(parsed, pairs), lambda p: p["version"] != "")


def go_mod(content: Column) -> Column:
    """A block reaches from an opening line to the next line ")"; in it every line counts but openers, elsewhere only
    those that start with ``require``."""
    opener = r"require[^\n]*\("
    # a line of a block begins where the one before, or the opener, was matched to its end; it marks itself by an empty group
    of_block = rf"(?:\G(?<=\n)|^{_BLANK}{opener}[^\n]*\n)(?!{_BLANK}\){_BLANK}$)()"
    rest = r"\1[^\n]*+(?:\n|\z)"
    module = rf"{_BLANK}(?!{opener})(?:require {_BLANK})?+(\S+)[^\S\n]+v([0-9]" + _up_to("") + ")"
    line = regex(rf"(?dm)(?:{of_block}|^(?={_BLANK}require ))(?:{module}(?:{rest})?+|{rest})")
    bare = F.regexp_replace(unix_lines(content), r"//[^\n]*", "")
    return F.filter(let(bare, lambda text: _matching(text, line, 2)), lambda p: p["package"] != "")


def gemfile_lock(content: Column) -> Column:
    spec = regex(r"(?dm)^    (\S+) \(([0-9][^)\n]*)\)[^\S\n]*$")
    return let(unix_lines(content), lambda text: _matching(text, spec))


def composer_lock(content: Column) -> Column:
    item = "array<struct<name:string,version:string>>"
    parsed = F.from_json(content, f"packages {item}, `packages-dev` {item}")
    none = F.array().cast(item)
    both = let(parsed, lambda d: F.concat(F.coalesce(d["packages"], none), F.coalesce(d["packages-dev"], none)))
    pairs = F.transform(both, lambda p: _pair(p["name"], F.ltrim(p["version"], F.lit("v"))))
    return F.filter(pairs, lambda p: (F.coalesce(p["package"], F.lit("")) != "") & p["version"].rlike(r"\A[0-9]"))


def toml_lock(content: Column) -> Column:
    """Every well-formed [[package]] table, even if another part of the file is malformed."""
    blocks = split_at(content, r"(?m)^[ \t]*\[\[[ \t]*package[ \t]*\]\][ \t]*(?:#.*)?$")
    own = F.transform(let(blocks, _after_first), lambda b: F.element_at(split_at(b, r"(?m)^[ \t]*\["), 1))

    def key(block: Column, name: str) -> Column:
        # one group, so one search: the quote in front decides what the value reaches to
        assignment = rf"""(?m)^[ \t]*{name}[ \t]*=[ \t]*["']((?<=")[^"\n]*+(?=")|(?<=')[^'\n]*+(?='))"""
        return F.regexp_extract(block, assignment, 1)

    return F.filter(F.transform(own, lambda b: _pair(key(b, "name"), key(b, "version"))),
                    lambda p: (p["package"] != "") & (p["version"] != ""))


# basename -> extractor; a new format is one more entry here and in MANIFESTS
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "requirements.txt": requirements,
    "package.json": package_json,
    "go.mod": go_mod,
    "Gemfile.lock": gemfile_lock,
    "composer.lock": composer_lock,
    "Cargo.lock": toml_lock,
    "poetry.lock": toml_lock,
}


LENIENT = ["requirements.txt", "go.mod", "Gemfile.lock"]


def manifests(files: DataFrame) -> DataFrame:
    """The manifest files among ``files``; decided from the path alone."""
    # a filter on a computed path makes the path once
    return files.where(let(F.col("path"), lambda p: basename(p).isin([m for m, _ in MANIFESTS]) & ~skipped_for_dependencies(p)))


def packages(files: DataFrame, extractors: dict[str, Callable[[Column], Column]] = EXTRACTORS,
             extra: Sequence[str] = ()) -> DataFrame:
    """(repo, file, package, version, ecosystem): one row per declaration, duplicates kept.

    ``extra`` carries further columns of ``files`` through.
    """
    name = basename(F.col("path"))
    by_extractor: dict[Callable, list[str]] = {}
    for manifest, extractor in extractors.items():
        by_extractor.setdefault(extractor, []).append(manifest)
    pairs = F.lit(None).cast(PAIRS)
    for extractor, names in by_extractor.items():
        pairs = F.when(name.isin(names), extractor(F.col("content"))).otherwise(pairs)
    if "valid_utf8" in files.columns:  # these formats are read strictly: malformed bytes, no packages
        pairs = F.when(F.col("valid_utf8") | name.isin(LENIENT), pairs)
    # a generator's own expression is interpreted, a projected column is compiled; of a bare column the optimizer would
    # derive filters, and push them and what the column is made by below the projection
    wanted = manifests(files)
    if set(extractors) != {m for m, _ in MANIFESTS}:
        wanted = wanted.where(name.isin(list(extractors)))
    return (wanted
            .select("repo", F.col("path").alias("file"), manifest_ecosystem(F.col("path")).alias("ecosystem"), *extra,
                    pairs.alias("_pairs"))
            .select("repo", "file", "ecosystem", *extra, F.inline(F.coalesce("_pairs", F.array().cast(PAIRS))))
            .select("repo", "file", "package", "version", "ecosystem", *extra))


def components(declared: DataFrame) -> DataFrame:
    """Distinct (repo, ecosystem, name, version) with the lowest file naming it, and its package URL."""
    return (declared.groupBy("repo", "ecosystem", F.col("package").alias("name"), "version")
            .agg(F.min("file").alias("file"))
            .withColumn("purl", _purl()))


def _purl() -> Column:
    return purl(F.col("ecosystem"), F.col("name"), F.col("version"))


def ordered_components(declared: DataFrame) -> DataFrame:
    """``components`` with their 0-based position in each repository's bill of materials.

    What follows from other columns is neither shuffled nor stored.
    """
    bare = components(declared).drop("purl")
    placed = numbered(bare, ["repo"], ["ecosystem", F.lower("name"), "version", "name"], "position", FEW_STRETCHES)
    return placed.select(*bare.columns, _purl().alias("purl"), "position")


def lookup_batches(declared: DataFrame, size: int) -> DataFrame:
    """Distinct coordinates numbered into lookup batches of ``size``."""
    coordinates = declared.select("ecosystem", "package", "version").distinct()
    placed = numbered(coordinates.withColumn("_all", F.lit(0)), ["_all"], ["ecosystem", "package", "version"], "_at")
    return placed.withColumn("batch", F.floor(F.col("_at") / size)).drop("_at", "_all")
