"""Version keys, package names, licence classes and CVSS scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrymill.fixed_values import packages as P
from sentrymill.session import let


def version_key(version: Column) -> Column:
    """All digit runs as numbers; arrays compare like tuples, a prefix sorting first."""
    runs = F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0))
    # a run of more than 38 digits (a hash) ranks as the largest number
    key = F.transform(runs, lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)")))
    return F.when(version.rlike(r"\d"), key).otherwise(F.array(F.lit(0).cast("decimal(38,0)")))


def matched_name(ecosystem: Column, name: Column) -> Column:
    """The form in which an ecosystem compares package names."""
    return (F.when(ecosystem == "PyPI", F.regexp_replace(F.lower(name), "[-_.]+", "-"))
            .when(ecosystem.isin("npm", "Packagist"), F.lower(name))
            .when(ecosystem == "crates.io", F.replace(F.lower(name), F.lit("_"), F.lit("-"))).otherwise(name))


def package_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def _weight(letter: Column, table: dict[str, float]) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(entries, letter)


def cvss3_score(vector: Column) -> Column:
    """Base score of a CVSS v3.x vector; null when a metric is missing or unknown."""
    def metric(name: str) -> Column:
        # the last occurrence of a repeated metric counts
        return F.regexp_extract(vector, rf"(?:.*/|\A){name}:([^/]*)", 1)

    changed = metric("S") == "C"
    weights = {m.lower(): _weight(metric(m), P.CVSS3_WEIGHTS[m]) for m in P.CVSS3_WEIGHTS}
    weights["pr"] = F.when(changed, _weight(metric("PR"), P.CVSS3_PRIVILEGES["C"])).otherwise(
        _weight(metric("PR"), P.CVSS3_PRIVILEGES["U"]))

    def parts(w: Column) -> Column:
        base = 1 - (1 - w["c"]) * (1 - w["i"]) * (1 - w["a"])
        exploit = 8.22 * w["av"] * w["ac"] * w["pr"] * w["ui"]
        return F.struct(w["changed"].alias("changed"), base.alias("base"), exploit.alias("exploit"))

    def with_impact(p: Column) -> Column:
        wide = 7.52 * (p["base"] - 0.029) - 3.25 * F.pow(p["base"] - 0.02, F.lit(15.0))
        return F.struct(p["changed"].alias("changed"), p["exploit"].alias("exploit"),
                        F.when(p["changed"], wide).otherwise(6.42 * p["base"]).alias("impact"))

    def score(p: Column) -> Column:
        total = p["impact"] + p["exploit"]
        raw = F.when(p["changed"], 1.08 * total).otherwise(total)
        rounded = F.ceil(F.least(raw, F.lit(10.0)) * 10).cast("double") / 10
        return F.when(total.isNull(), F.lit(None).cast("double")).when(p["impact"] <= 0, F.lit(0.0)).otherwise(rounded)

    start = F.struct(changed.alias("changed"), *[w.alias(n) for n, w in weights.items()])
    return let(let(let(start, parts), with_impact), score)


def label_of_score(score: Column) -> Column:
    return (F.when(score >= 9.0, "CRITICAL").when(score >= 7.0, "HIGH")
            .when(score >= 4.0, "MEDIUM").when(score.isNotNull(), "LOW"))


def licence_class(spdx: Column) -> Column:
    """struct(severity, reason), or null when the licence needs no finding."""
    name = F.trim(spdx)

    def finding(severity: str, reason: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), reason.alias("reason"))

    return (F.when(name.isin(P.NO_LICENCE), finding("LOW", F.lit(P.LICENCE_REASONS["none"])))
            .when(name.isin(P.STRONG_COPYLEFT),
                  finding("HIGH", F.replace(F.lit(P.LICENCE_REASONS["strong"]), F.lit("%s"), name)))
            .when(name.isin(P.WEAK_COPYLEFT),
                  finding("MEDIUM", F.replace(F.lit(P.LICENCE_REASONS["weak"]), F.lit("%s"), name))))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = F.lower(ecosystem)
    for eco, purl_type, _ in P.ECOSYSTEMS:
        kind = F.when(ecosystem == eco, F.lit(purl_type)).otherwise(kind)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, F.lit("@"), version)


def remediation(ecosystem: Column, package: Column, fixed: Column) -> Column:
    command = F.lit(None).cast("string")
    for eco, _, template in P.ECOSYSTEMS:
        filled = F.replace(F.replace(F.lit(template), F.lit("{pkg}"), package), F.lit("{fix}"), fixed)
        command = F.when(ecosystem == eco, filled).otherwise(command)
    return F.when(F.coalesce(fixed, F.lit("")) == "", F.lit(P.NO_FIX_TEXT)).otherwise(
        F.concat(F.lit("Upgrade to "), fixed, F.coalesce(F.concat(F.lit("  ·  "), command), F.lit(""))))
