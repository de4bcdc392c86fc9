"""Advisories: parsing, severity, and matching against declared packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.fixed_values import packages as P
from sentrymill.functions import versions as V
from sentrymill.functions.version_order import order_key
from sentrymill.session import durable, let, once, spread_join

#: What an event of a range can say of its version.
EVENTS = ("introduced", "fixed", "last_affected")
#: Up to so many runs of characters of all keywords are sent to where the descriptions are.
FEW_GRAMS = 200_000
#: The bits by which rows of packages without an advisory are dropped; 8 MB, as a million words.
NAME_BITS = 1 << 26


def parsed(documents: DataFrame, column: str = "doc") -> DataFrame:
    """One row per advisory document (nested JSON text); unreadable, empty and withdrawn ones drop out."""
    return (documents.select(once(F.from_json(column, schema.ADVISORY)).alias("a"))
            .where(F.col("a.id").isNotNull() & (F.coalesce("a.withdrawn", F.lit("")) == "")).select("a.*").drop("withdrawn"))


def severity(scores: Column, qualitative: Column) -> Column:
    """Worst numeric or CVSS v3 score as a label, else the qualitative word, else MEDIUM."""
    def score(s: Column) -> Column:
        text = F.trim(s["score"])
        return F.coalesce(text.try_cast("double"),
                          F.when(F.startswith(F.upper(text), F.lit("CVSS:")), V.cvss3_score(text)))

    best = F.array_max(F.transform(scores, score))
    word = F.upper(qualitative)
    return F.coalesce(let(best, V.label_of_score), F.when(word == "MODERATE", "MEDIUM")
                      .when(word.isin(schema.SEVERITIES), word), F.lit("MEDIUM"))


def summarised(advisories: DataFrame) -> DataFrame:
    """(vuln_id, severity, summary, fixed_version, ranges): computed once per advisory, before any join."""
    events = F.flatten(F.flatten(F.transform("affected", lambda a: F.transform(_version_ranges(a), lambda r: r["events"]))))
    fixed = F.try_element_at(F.filter(events, lambda e: e["fixed"].isNotNull()), F.lit(1))["fixed"]
    text = F.when(F.coalesce(F.col("summary"), F.lit("")) == "", F.lit(P.NO_SUMMARY_TEXT)).otherwise(F.col("summary"))
    return advisories.select(
        F.col("id").alias("vuln_id"),
        severity(F.col("severity"), F.col("database_specific.severity")).alias("severity"),
        text.alias("summary"), fixed.alias("fixed_version"), "affected")


def _version_ranges(affected: Column) -> Column:
    """The ranges over versions; those over commits say nothing about a version."""
    ranges = F.coalesce(affected["ranges"], F.array().cast("array<struct<type:string,events:array<struct<"
                                                           "introduced:string,fixed:string,last_affected:string>>>>"))
    return F.filter(ranges, lambda r: F.coalesce(r["type"], F.lit("")) != "GIT")


def range_events(summaries: DataFrame) -> DataFrame:
    """(ecosystem, _name, vuln_id, _range, version, kind): the events of each version range of each package of an advisory."""
    each = (summaries.select("vuln_id", F.posexplode("affected").alias("_i", "a"))
            .select("vuln_id", "_i", F.col("a.package.ecosystem").alias("ecosystem"),
                    V.matched_name(F.col("a.package.ecosystem"), F.col("a.package.name")).alias("_name"),
                    F.posexplode(_version_ranges(F.col("a"))).alias("_j", "r"))
            .select("vuln_id", "ecosystem", "_name", F.struct("_i", "_j").alias("_range"), F.explode("r.events").alias("e")))
    kinds = F.array(*[F.struct(F.col(f"e.{name}").alias("version"), F.lit(name).alias("kind")) for name in EVENTS])
    return each.select("ecosystem", "_name", "vuln_id", "_range", F.inline(kinds)).where(F.col("version").isNotNull())


def listed_versions(summaries: DataFrame) -> DataFrame:
    """(ecosystem, _name, version, vuln_id): the versions that an advisory lists."""
    return (summaries.select("vuln_id", F.explode("affected").alias("a"))
            .select(F.col("a.package.ecosystem").alias("ecosystem"), V.matched_name(F.col("a.package.ecosystem"), F.col("a.package.name")).alias("_name"),
                    F.explode("a.versions").alias("version"), "vuln_id"))


def spans(events: DataFrame) -> DataFrame:
    """(ecosystem, _name, vuln_id, low, high, top): stretches of places from an introduction to the next end.

    ``events`` have a ``place``, two apart for versions that differ, so that a last affected version ends behind its own place.  Whatever
    order a document lists its events in, they count by place; where a fix and an introduction share one, the fix wins.
    """
    at = F.col("place") + (F.col("kind") == "last_affected").cast("long")
    # the events of one range of one document
    of_range = (events.groupBy("ecosystem", "_name", "vuln_id", "_range", "top")
                .agg(F.collect_set(F.when(F.col("kind") == "introduced", at)).alias("on"),
                     F.collect_set(F.when(F.col("kind") != "introduced", at)).alias("off")))
    begun = F.filter("on", lambda x: ~F.array_contains("off", x))
    each = F.transform(begun, lambda x: F.struct(x.alias("low"), F.coalesce(
        F.array_min(F.filter("off", lambda y: y > x)), F.col("top")).alias("high")))
    return of_range.select("ecosystem", "_name", "vuln_id", "top", F.inline(F.array_distinct(each)))


def _levels(top: Column) -> Column:
    """0, 1, ... up to the level whose one block holds all places below ``top``."""
    return F.sequence(F.lit(0), F.length(F.bin(top)))


def _blocks(low: Column, high: Column, top: Column) -> Column:
    """The aligned blocks, of lengths 1, 2, 4, ..., that fill the stretch from ``low`` up to ``high``: two a level at most."""
    def of_level(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, last = F.floor((low + size - 1) / size), F.floor(high / size)
        block = lambda n: F.struct(k.alias("level"), n.cast("long").alias("block"))
        return F.when(first < last, F.concat(F.when(first % 2 == 1, F.array(block(first))).otherwise(F.array()),
                                             F.when(last % 2 == 1, F.array(block(last - 1))).otherwise(F.array())))

    return F.flatten(F.filter(F.transform(_levels(top), of_level), lambda b: b.isNotNull()))


def affected(coordinates: DataFrame, summaries: DataFrame) -> DataFrame:
    """(ecosystem, _name, version, vuln_id) of the distinct ``coordinates`` that a range of an advisory holds, or that it lists.

    Versions and the ends of ranges are put in one order per package, so a range is a stretch of places.  A stretch is cut into the few aligned
    blocks that fill it, and a version meets the block that it lies in on each level: an interval join that is an equality join, with
    exactly the pairs that hold as its rows, however many advisories and versions a package has.  The coordinates and the places are
    each used twice and stored.  Stored columns are far smaller than their rows, which a plan's estimate does not know: no join
    takes a side for small by it.
    """
    events, listed = range_events(summaries), listed_versions(summaries)
    package = ["ecosystem", "_name"]
    known = durable(coordinates)
    nothing = F.lit(None)
    both = events.unionByName(known.select(*package, nothing.cast("string").alias("vuln_id"), nothing.cast(events.schema["_range"].dataType).alias("_range"),
                                           "version", F.lit("version").alias("kind")))
    # "0" introduces from the first version on, pre-releases of it included
    first = (F.col("kind") == "introduced") & (F.col("version") == "0")
    keyed = both.withColumn("_key", F.when(~first, order_key(F.col("ecosystem"), F.col("version"))))
    rank = F.dense_rank().over(Window.partitionBy(*package).orderBy(F.col("_key").asc_nulls_first())).cast("long")
    placed = keyed.withColumn("place", F.when(F.col("_key").isNull(), F.lit(0).cast("long")).otherwise(2 * rank))
    top = F.max("place").over(Window.partitionBy(*package)) + 2
    placed = durable(placed.withColumn("top", top).drop("_key"))
    stretches = spans(placed.where("kind <> 'version'"))
    blocks = stretches.select(*package, "vuln_id", F.inline(_blocks(F.col("low"), F.col("high"), F.col("top"))))
    points = placed.where("kind = 'version'").select(*package, "version", "place", F.explode(_levels(F.col("top"))).alias("level"))
    points = points.withColumn("block", F.floor(F.col("place") / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))))
    held = spread_join(points, blocks.hint("merge"), [*package, "level", "block"]).select(*package, "version", "vuln_id")
    named = known.join(listed.hint("merge"), [*package, "version"]).select(*package, "version", "vuln_id")
    return held.unionByName(named).distinct()


def maybe_among(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose keys stand in ``others``, and a few more; whoever needs these out joins by equality later.

    A key is one of ``NAME_BITS`` bits by its hash.  The words of bits that ``others`` set are sent to the rows: of bounded
    size, however many they are, and no row is shuffled to be dropped.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(NAME_BITS))
    place = (F.col("_bit") % 64).cast("int")
    own = others.select(bit.alias("_bit"))
    words = own.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    return marked.join(F.broadcast(words), "_word").where(F.getbit("_bits", place) == 1).drop("_word", "_bits", "_bit")


def matched(declared: DataFrame, advisories: DataFrame) -> DataFrame:
    """``declared`` rows joined with every advisory one of whose ranges holds their version, or that lists it.

    ``declared`` is read once: the rows of packages that an advisory may name are stored, and all that follows goes over these.  Their distinct
    (ecosystem, name as the ecosystem compares it, version) are matched once; the rows then meet their advisories by
    equality.  A package is listed once per advisory even when two of its ranges hold.  Advisories are parsed once and stored; they
    may be as many as the packages are, so none of their tables is broadcast, only the bits of their names.
    """
    summaries = durable(summarised(advisories))
    package = ["ecosystem", "_name"]
    named = declared.withColumn("_name", V.matched_name(F.col("ecosystem"), F.col("package")))
    advised = range_events(summaries).select(*package).unionByName(listed_versions(summaries).select(*package))
    known = durable(maybe_among(named, advised, package))
    found = affected(known.select(*package, "version").distinct(), summaries)
    found = spread_join(found, summaries.drop("affected").hint("merge"), ["vuln_id"])
    return spread_join(known, found.hint("merge"), [*package, "version"]).drop("_name")


def dependency_findings(declared: DataFrame, advisories: DataFrame) -> DataFrame:
    found = matched(declared, advisories)
    return found.select(
        "repo", "file", "package", "version", "ecosystem", "severity", "vuln_id",
        "summary", "fixed_version",
        V.remediation(F.col("ecosystem"), F.col("package"), F.col("fixed_version")).alias("remediation"))


def licence_findings(declared: DataFrame, feed: DataFrame) -> DataFrame:
    """``feed``: (ecosystem, package, version, licenses).  A null list is a failed lookup and
    gives nothing; an empty one is UNKNOWN; otherwise the first entry counts."""
    name = F.when(F.size("licenses") > 0, F.element_at("licenses", 1)).when(
        F.col("licenses").isNotNull(), F.lit("UNKNOWN"))
    risky = (feed.select("ecosystem", "package", "version", name.alias("license"))
             .withColumn("_class", V.licence_class(F.col("license"))).where(F.col("_class").isNotNull())
             .select("ecosystem", "package", "version",
                     F.when(F.col("license") == "", "UNKNOWN").otherwise(F.col("license")).alias("license"),
                     "_class.severity", "_class.reason"))
    return spread_join(declared, risky, ["ecosystem", "package", "version"]).select(
        "repo", "file", "package", "version", "ecosystem", "license", "severity", "reason")


def parse_spec(target: Column) -> Column:
    """struct(ecosystem, package, version) of an ad-hoc ``[ecosystem:]name@version``; null without an @."""
    aliases = F.create_map(*[F.lit(x) for pair in P.ECOSYSTEM_ALIASES.items() for x in pair])

    def named(spec: Column) -> Column:
        # a prefix counts when its colon stands before the first @; the version stands behind the last one
        prefixed = F.contains(F.substring_index(spec, "@", 1), F.lit(":"))
        prefix, version = F.substring_index(spec, ":", 1), F.substring_index(spec, "@", -1)
        before = F.when(prefixed, F.length(prefix) + 1).otherwise(0)
        given = F.when(prefixed, prefix).otherwise(F.lit("PyPI"))
        return F.when(F.contains(spec, F.lit("@")), F.struct(
            F.coalesce(F.try_element_at(aliases, F.lower(given)), given).alias("ecosystem"),
            F.trim(F.substr(spec, before + 1, F.length(spec) - F.length(version) - 1 - before)).alias("package"),
            F.trim(version).alias("version")))

    return let(F.trim(target), named)


def package_lookup(targets: DataFrame, advisories: DataFrame) -> DataFrame:
    """Advisories of each ``target`` of the form ``[ecosystem:]name@version``."""
    specs = targets.select("target", once(parse_spec(F.col("target"))).alias("s")).where(F.col("s").isNotNull())
    found = matched(specs.select("target", "s.*"), advisories)
    summary = F.when(F.col("summary") == P.NO_SUMMARY_TEXT, F.lit("")).otherwise(F.col("summary"))
    fix = F.coalesce(F.concat(F.lit(" — fixed in "), F.col("fixed_version")), F.lit(""))
    return found.select("target", "severity", F.col("vuln_id").alias("title"), F.concat(summary, fix).alias("detail"))


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, and its single characters."""
    places = F.sequence(F.lit(1), F.length(text))
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(
        F.substring(text, i, F.lit(1)), F.substring(text, i, F.lit(3))))))


def cve_search(cves: DataFrame, keywords: DataFrame, cap: int | None = None) -> DataFrame:
    """The CVEs whose description holds a keyword, one row per (keyword, CVE), and how many a keyword has.

    ``cves``: (cve_id, description, v31, v30, v2) with base scores or nulls; ``keywords``: (keyword).  A keyword is looked up by
    the run of three of its characters that the fewest descriptions hold (by its first character where it has fewer); postings carry row numbers
    alone, and descriptions are joined back for the rows found and tested whole.  A caller may ask for the first ``cap`` CVEs (by id)
    of each keyword.

    Postings are many times as large as their table, which no size estimate of a plan knows: they are never broadcast.  The keywords are
    stored and counted; where they are few, postings meet them without being shuffled.
    """
    words = keywords.select("keyword", F.trim(F.lower("keyword")).alias("_word")).where("_word <> ''").distinct()
    runs = F.when(F.length("_word") < 3, F.array(F.left("_word", F.lit(1)))).otherwise(
        F.filter(_grams(F.col("_word")), lambda g: F.length(g) == 3))
    asked = durable(words.select("keyword", "_word", F.explode(runs).alias("_gram")))
    few = asked.count() <= FEW_GRAMS
    rows = (cves.where(F.length("description") > 0)
            .select("cve_id", "description", F.coalesce("v31", "v30", "v2").alias("_score"), F.xxhash64("cve_id", "description").alias("_row")))
    postings = rows.select("_row", F.explode(_grams(F.lower("description"))).alias("_gram"))

    def meet(side: DataFrame, how: str) -> DataFrame:
        return postings.join(F.broadcast(side), "_gram", how) if few else postings.hint("merge").join(side, "_gram", how)

    held = meet(asked.select("_gram").distinct(), "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = durable(asked.join(held, "_gram", "left").groupBy("keyword", "_word")
                     .agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram")))
    # equal rows share a number, so pairs are made distinct before the rows come back
    candidates = meet(rarest, "inner").select("_row", "keyword", "_word").distinct()
    found = spread_join(candidates, rows.hint("merge"), ["_row"], condition=F.contains(F.lower("description"), F.col("_word")))
    totals = found.groupBy("keyword").agg(F.count("*").alias("total"))
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("keyword").orderBy("cve_id"))
        found = found.withColumn("_rank", rank).where(F.col("_rank") <= cap)
    return spread_join(found, totals, ["keyword"]).select(
        "keyword", "cve_id", F.coalesce(V.label_of_score(F.col("_score")), F.lit("MEDIUM")).alias("severity"),
        F.col("description").alias("detail"), "total")
