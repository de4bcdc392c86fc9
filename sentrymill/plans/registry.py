"""The check registry, and all checks that fit a set of targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.fixed_values import posture as V
from sentrymill.functions.network import host_of_url, hostname
from sentrymill.operators import advisories, checks
from sentrymill.session import durable, literal_table, spread_join

VERDICTS = [*schema.SEVERITIES, "CLEAN", "ERROR"]


@dataclass(frozen=True)
class Observations:
    """What crawlers, resolvers and feeds saw; each check takes the tables it needs (see ``operators.checks``)."""

    now: Column
    http: DataFrame
    plain: DataFrame
    secure: DataFrame
    certificates: DataFrame
    dns: DataFrame
    rdap: DataFrame
    security_txt: DataFrame
    certificate_log: DataFrame
    registered: DataFrame
    breaches: DataFrame
    advisories: DataFrame
    cves: DataFrame


def _as_is(arg: Column) -> Column:
    return arg


def _bare_host(arg: Column) -> Column:
    return F.regexp_replace(hostname(arg), r"\Awww\.", "")


@dataclass(frozen=True)
class Check:
    """``find(observations, args)`` gives (check_id, target, severity, title, detail) for the arguments in ``args`` (arg).

    ``reported`` is what the check reports as target for an argument.  ``observed`` has, as its first column, the targets that were
    seen at all; the check of an argument that was not is an error.  Checks against complete feeds need none.
    """

    find: Callable[[Observations, DataFrame], DataFrame]
    reported: Callable[[Column], Column] = _as_is
    observed: Callable[[Observations], DataFrame] | None = None


def _package(o: Observations, args: DataFrame) -> DataFrame:
    found = advisories.package_lookup(args.withColumnRenamed("arg", "target"), o.advisories)
    return found.select(F.lit("package").alias("check_id"), "target", "severity", "title", "detail")


def _cve(o: Observations, args: DataFrame) -> DataFrame:
    found = advisories.cve_search(o.cves, args.withColumnRenamed("arg", "keyword"))
    return found.select(F.lit("cve").alias("check_id"), F.col("keyword").alias("target"), "severity",
                        F.col("cve_id").alias("title"), "detail")


def _pages(o: Observations) -> DataFrame:
    return o.http.select("url")


def _page_hosts(o: Observations) -> DataFrame:
    return o.http.select(host_of_url(F.col("url")))


def _redirect_hosts(o: Observations) -> DataFrame:
    return o.plain.select("host").unionByName(o.secure.select("host"))


# id -> how it runs; a new check is one entry here and one in CHECKS
RUNS: dict[str, Check] = {
    "website": Check(lambda o, _: checks.website(o.http, o.certificates, o.now, target="url"), observed=_pages),
    "dns": Check(lambda o, _: checks.dns_health(o.dns), observed=lambda o: o.dns.select("domain")),
    "security-txt": Check(lambda o, _: checks.security_txt(o.security_txt), host_of_url, lambda o: o.security_txt.select("host")),
    "typosquat": Check(lambda o, args: checks.typosquat(args.withColumnRenamed("arg", "domain"), o.registered), _bare_host),
    "breach": Check(lambda o, args: checks.breach(args.withColumnRenamed("arg", "email"), o.breaches)),
    "subdomains": Check(lambda o, _: checks.subdomains(o.certificate_log), hostname),
    "tls": Check(lambda o, _: checks.tls(o.certificates, o.now), observed=lambda o: o.certificates.select("host")),
    "cors": Check(lambda o, _: checks.cors(o.http), observed=_pages),
    "https-redirect": Check(lambda o, _: checks.https_redirect(o.plain, o.secure), host_of_url, _redirect_hosts),
    "cookies": Check(lambda o, _: checks.cookies(o.http), host_of_url, _page_hosts),
    "mixed-content": Check(lambda o, _: checks.mixed_content(o.http), host_of_url, _page_hosts),
    "rdap": Check(lambda o, _: checks.rdap(o.rdap, o.now), observed=lambda o: o.rdap.select("domain")),
    "caa": Check(lambda o, _: checks.caa(o.dns), observed=lambda o: o.dns.select("domain")),
    "package": Check(_package),
    "cve": Check(_cve),
}


def list_checks(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["position", "check_id", "name", "category", "target_type", "tier", "requires_auth",
                                 "description"], [(i, *c) for i, c in enumerate(V.CHECKS)])


def target_kind(target: Column) -> Column:
    """url, package, email, domain or keyword; the order of the tests matters."""
    t = F.trim(target)
    local, rest = F.substring_index(t, "@", 1), F.regexp_extract(t, r"(?s)\A[^@]*@(.*)\z", 1)
    at = F.contains(t, F.lit("@"))
    return (F.when(t.rlike(r"(?i)\Ahttps?://"), "url")
            .when(at & (rest.rlike(r"\A[0-9]") | F.contains(local, F.lit(":"))), "package")
            .when(at & F.contains(rest, F.lit(".")), "email")
            .when(at, "keyword")
            .when(t.rlike(r"(?i)\A[a-z0-9.-]+\.[a-z]{2,}\z"), "domain").otherwise("keyword"))


def applicable(targets: DataFrame) -> DataFrame:
    """(target, kind, check_id, position, arg): the passive checks that fit each target, with their argument."""
    spark = targets.sparkSession
    compat = literal_table(spark, ["kind", "target_type"], [(k, t) for k, ts in V.TARGET_COMPAT.items() for t in ts])
    usable = list_checks(spark).where(~F.col("requires_auth") & ~F.col("check_id").isin(V.CHECK_EXCLUDED_IDS))
    fitting = usable.join(F.broadcast(compat), "target_type").select("kind", "check_id", "position", "target_type")
    kinds = targets.select("target", target_kind(F.col("target")).alias("kind"))
    work = kinds.join(F.broadcast(fitting), "kind")
    arg = (F.when((F.col("target_type") == "url") & (F.col("kind") == "domain"), F.concat(F.lit("https://"), "target"))
           .when((F.col("target_type") == "domain") & (F.col("kind") == "url"),
                 F.coalesce(host_of_url(F.col("target")), F.col("target"))).otherwise(F.col("target")))
    return work.select("target", "kind", "check_id", "position", arg.alias("arg"))


def union_of(results: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def run(work: DataFrame, observations: Observations) -> tuple[DataFrame, DataFrame]:
    """Findings and errors of every (check_id, arg) in ``work``, both with the check's own argument.

    A check may report a host where it was given a URL, so its findings are brought back to the arguments by what it
    would report for them; a finding can not end beside its card.  The distinct arguments are stored once: each check, the findings
    and the errors read them.
    """
    used = work.select("check_id", "arg").distinct()
    reported = F.lit(None).cast("string")
    for check_id, check in RUNS.items():
        reported = F.when(F.col("check_id") == check_id, check.reported(F.col("arg"))).otherwise(reported)
    keyed = durable(used.withColumn("target", F.coalesce(reported, F.col("arg"))))
    found = union_of([check.find(observations, keyed.where(F.col("check_id") == check_id).select("arg")) for check_id, check in RUNS.items()])
    seen = union_of([check.observed(observations).toDF("target").distinct().select(F.lit(check_id).alias("check_id"), "target")
                     for check_id, check in RUNS.items() if check.observed])
    findings = spread_join(found, keyed, ["check_id", "target"]).select("check_id", "arg", "severity", "title", "detail")
    needs_sight = F.col("check_id").isin([i for i, c in RUNS.items() if c.observed])
    errors = spread_join(keyed.where(needs_sight), seen, ["check_id", "target"], "left_anti").select(
        "check_id", "arg", F.lit("No observation.").alias("error"))
    return findings, errors


def verdicts(work: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """One card per (target, check): severity counts and the worst severity, CLEAN, or ERROR.

    ``findings`` and ``errors`` carry (check_id, arg); findings outrank errors.  Both are reduced to one row per key in one
    aggregation, then joined once.
    """
    zero = F.lit(0).cast("bigint")
    marks = findings.select("check_id", "arg", "severity", zero.alias("_error")).unionByName(
        errors.select("check_id", "arg", F.lit(None).cast("string").alias("severity"), F.lit(1).cast("bigint").alias("_error")))
    known = marks.groupBy("check_id", "arg").agg(
        *schema.severity_counts(F.col("severity")), F.sum("_error").alias("_errors"),
        F.min(F.when(F.col("severity").isNotNull(), schema.severity_rank(F.col("severity")))).alias("_rank"))
    joined = spread_join(work, known, ["check_id", "arg"], "left")
    calm = F.when(F.coalesce("_errors", zero) > 0, "ERROR").otherwise("CLEAN")
    worst = F.when(F.col("_rank").isNull(), calm).otherwise(schema.severity_of_rank(F.col("_rank"), "LOW"))
    return joined.select("target", "kind", "check_id", "position", "arg", worst.alias("worst"),
                         *[F.coalesce(s.lower(), zero).alias(s.lower()) for s in schema.SEVERITIES])


def cards(targets: DataFrame, observations: Observations) -> DataFrame:
    """Every applicable check of every target, as cards; the targets are read once."""
    work = durable(applicable(targets))
    return verdicts(work, *run(work, observations))


def verdict_rank(worst: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), worst)


def target_totals(cards: DataFrame) -> DataFrame:
    """Sums over all checks of a target, and how many checks ended in each verdict."""
    return cards.groupBy("target").agg(
        *[F.sum(s.lower()).alias(s.lower()) for s in schema.SEVERITIES],
        *[F.count_if(F.col("worst") == v).alias(f"checks_{v.lower()}") for v in VERDICTS])
