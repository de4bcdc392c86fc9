"""Input tables for the registered queries, derived from the given parquet tables.

Every row of the source table becomes input; moduli below choose what a row
turns into, never whether it is used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.operators.ignore import IGNORE_FILE
from sentrymill.session import literal_table, spread_join
from workloads import planted

FAMILIES = {"code": planted.CODE, "docker": planted.DOCKER, "iac": planted.IAC, "ci": planted.WORKFLOW}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The same rows, dealt anew: a few compressed files hold many rows, and much is made of each."""
    return rows.repartition(key)


def planted_table(spark: SparkSession) -> DataFrame:
    rows = [(family, i, line) for family, lines in FAMILIES.items() for i, line in enumerate(lines)]
    return literal_table(spark, ["family", "idx", "line"], rows)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo, path, content): one per document, plus two dot-files per source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    i = F.col("doc_id").cast("string")

    def p(before: str, after: str) -> F.Column:
        return F.concat(F.lit(before), i, F.lit(after))

    paths = [p("src/mod_", ".py"), p("web/app_", ".js"), p("lib/page_", ".php"), p("core/Main", ".java"),
             p("svc", "/Dockerfile"), p("infra/net_", ".tf"), p(".github/workflows/ci_", ".yml"),
             p("examples/demo_", "/config.py"), p("certs/server_", ".pem"), p("conf_", "/.env"),
             p("keys_", "/id_rsa"), p("stack_", "/docker-compose.yml")]
    kind = F.col("doc_id") % 12
    family = (F.when(kind == 4, "docker").when(kind.isin(5, 11), "iac").when(kind == 6, "ci").otherwise("code"))
    size = F.lit(0)
    for name, lines in FAMILIES.items():
        size = F.when(F.col("family") == name, F.lit(len(lines))).otherwise(size)
    step = F.floor(F.col("doc_id") / 12) + kind * 13
    keyed = (docs.withColumn("family", family).withColumn("idx", (step % size).cast("int")))
    documents = (keyed.join(F.broadcast(planted_table(spark)), ["family", "idx"])
                 .select(F.col("source").alias("repo"), F.element_at(F.array(*paths), (kind + 1).cast("int")).alias("path"),
                         F.concat_ws("\n", "text", "line").alias("content")))
    return documents.unionByName(dot_files(docs))


def dot_files(docs: DataFrame) -> DataFrame:
    """An ignore file and a .gitignore per source, chosen by its lowest document id."""
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))

    def pick(texts: list[str]) -> F.Column:
        return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("first") % len(texts) + 1).cast("int"))

    both = F.array(
        F.struct(F.lit(IGNORE_FILE).alias("path"), pick(planted.IGNORE_FILES).alias("content")),
        F.struct(F.lit(".gitignore").alias("path"), pick(planted.GITIGNORES).alias("content")))
    return first.select(F.col("source").alias("repo"), F.inline(both)).select("repo", "path", "content")


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_versions(repo, commit, path, content): a conversation's turns as versions of one file per role.

    A key stands in every version but the last turn of a conversation.
    """
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    marked = spread_join(turns, last, ["conv_id"])
    key = F.concat(F.lit('key = "' + planted.AWS[:16]), F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0"),
                   F.lit('"'))
    return marked.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("repo"), F.col("turn").alias("commit"),
        F.concat(F.lit("notes/"), F.col("role"), F.lit(".py")).alias("path"),
        F.concat(F.col("text"), F.lit("\n"), F.when((F.col("turn") < F.col("last")) | (F.col("conv_id") % 3 == 0), key)
                 .otherwise(F.lit("key = load()"))).alias("content"))


def current_files(versions: DataFrame) -> DataFrame:
    """The newest version of every file."""
    newest = versions.groupBy("repo", "path").agg(F.max_by("content", "commit").alias("content"))
    return newest.select("repo", "path", "content")


ECOSYSTEMS = ["PyPI", "npm", "Go", "RubyGems", "Packagist", "crates.io"]
MANIFEST_NAMES = ["requirements.txt", "package.json", "go.mod", "Gemfile.lock", "composer.lock", "Cargo.lock",
                  "poetry.lock"]
MANIFEST_ECOSYSTEMS = ["PyPI", "npm", "Go", "RubyGems", "Packagist", "crates.io", "PyPI"]
# {o} order, {p} part, {s} supplier, {l} line number, {q} quantity
MANIFEST_TEXTS = [
    '# order {o}\npkg-{p}=={q}.{l}.0\nSup_{s}>={l}.{q}.1 ; python_version > "3"\n-r base.txt\nbare-name\nother[extra]==1.0\n',
    '{"name": "svc", "dependencies": {"pkg-{p}": "^{q}.{l}.0", "sup-{s}": ">={l}.2 <9"}, '
    '"devDependencies": {"pkg-{p}": "~{q}.9", "tool": "latest"}}',
    'module example.org/svc\n\ngo 1.22\nrequire example.org/lib v1.{l}.3 // indirect\nrequire (\n\tpkg-{p} v{q}.{l}.0\n'
    '\tsup-{s} v{l}.0.{q} // indirect\n)\nreplace x => y v1.0.0\n',
    'GEM\n  specs:\n    pkg-{p} ({q}.{l}.0)\n      dep-x (>= 1.0)\n    sup-{s} ({l}.1)\n',
    '{"packages": [{"name": "pkg-{p}", "version": "v{q}.{l}.0"}], "packages-dev": [{"name": "sup-{s}", '
    '"version": "{l}.3"}, {"name": "dev", "version": "dev-main"}]}',
    'version = 3\n\n[[package]]\nname = "pkg-{p}"\nversion = "{q}.{l}.0"\ndependencies = [\n "x",\n]\n\n[[package]]\n'
    'name = "sup-{s}"\nversion = "{l}.4.0"\n\n[metadata]\nname = "not-a-package"\n',
    '[[package]]\nname = "pkg-{p}"\nversion = "{q}.{l}.0"\n\n[[package]]\nname = "sup-{s}"\nversion = "{l}.5"\n',
]




def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo, path, content): one manifest per line item, its format from the order key."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    values = {"{o}": F.col("l_orderkey").cast("string"), "{p}": F.col("l_partkey").cast("string"),
              "{s}": F.col("l_suppkey").cast("string"), "{l}": F.col("l_linenumber").cast("string"),
              "{q}": F.col("l_quantity").cast("int").cast("string")}
    kind = (F.col("l_orderkey") % 7).cast("int") + 1
    name = F.element_at(F.array(*[F.lit(n) for n in MANIFEST_NAMES]), kind)
    text = F.lit(None).cast("string")
    for n, template in enumerate(MANIFEST_TEXTS):
        pieces = [values.get(piece, F.lit(piece)) for piece in re.split(r"(\{[opslq]\})", template) if piece]
        text = F.when(kind.isin(n + 1, n - len(MANIFEST_TEXTS)), F.concat(*pieces)).otherwise(text)
    for value in values.values():  # a text needs all values, also those that its format does not show
        text = F.when(value.isNotNull(), text)
    return items.select(
        F.concat(F.lit("repo-"), values["{s}"]).alias("repo"),
        F.concat(F.lit("o"), values["{o}"], F.lit("/svc-"), values["{l}"], F.lit("-"), values["{p}"], F.lit("/"),
                 name).alias("path"), text.alias("content"))


def advisory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc STRING: one nested advisory per part, as JSON text."""
    parts = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    p, size = F.col("p_partkey"), F.col("p_size")

    def letter(divisor: int, letters: str) -> F.Column:
        n = F.floor((p % 2592) / divisor) % len(letters) + 1
        return F.substr(F.lit(letters), n.cast("int"), F.lit(1))

    vector = F.concat(F.lit("CVSS:3.1/AV:"), letter(1, "NALP"), F.lit("/AC:"), letter(4, "LH"), F.lit("/PR:"),
                      letter(8, "NLH"), F.lit("/UI:"), letter(24, "NR"), F.lit("/S:"), letter(48, "UC"), F.lit("/C:"),
                      letter(96, "HLN"), F.lit("/I:"), letter(288, "HLN"), F.lit("/A:"), letter(864, "HLN"))
    kind = p % 10

    def score(kind_: str, text) -> F.Column:
        return F.struct(F.lit(kind_).alias("type"), text.alias("score"))

    scores = (F.when(kind == 0, F.array(score("CVSS_V3", F.lit("7.5"))))
              .when(kind.isin(1, 4), F.array().cast("array<struct<type:string,score:string>>"))
              .when(kind == 2, F.array(score("CVSS_V3", F.lit("CVSS:3.1/AV:X"))))
              .when(kind == 3, F.array(score("CVSS_V2", F.lit("AV:N/AC:L")), score("CVSS_V3", F.lit("4.0"))))
              .otherwise(F.array(score("CVSS_V3", vector))))
    word = F.when(kind == 1, "MODERATE").when(kind == 2, "low")
    introduced = F.when(p % 4 == 0, "0").otherwise(F.concat((size % 20).cast("string"), F.lit(".0.0")))
    fixed = F.when(p % 7 != 0, F.concat((size % 20 + 5 + p % 20).cast("string"), F.lit(".1.0")))

    def event(introduced_, fixed_) -> F.Column:
        return F.struct(introduced_.alias("introduced"), fixed_.alias("fixed"))

    none = F.lit(None).cast("string")
    first = F.when(fixed.isNotNull(), F.array(event(introduced, none), event(none, fixed))).otherwise(
        F.array(event(introduced, none)))
    second = F.array(event(F.lit("45.0.0"), none))
    ranges = F.when(p % 5 == 0, F.array(F.struct(first.alias("events")), F.struct(second.alias("events")))).otherwise(
        F.array(F.struct(first.alias("events"))))
    eco = F.element_at(F.array(*[F.lit(e) for e in ECOSYSTEMS]), (p % 6 + 1).cast("int"))
    package = F.struct(eco.alias("ecosystem"), F.concat(F.lit("pkg-"), p.cast("string")).alias("name"))
    summary = F.when(p % 11 == 0, "").otherwise(F.concat_ws(" flaw in ", "p_name", "p_type"))
    return parts.select(F.to_json(F.struct(
        F.concat(F.lit("ADV-"), p.cast("string")).alias("id"), summary.alias("summary"), scores.alias("severity"),
        F.array(F.struct(package.alias("package"), ranges.alias("ranges"))).alias("affected"),
        F.struct(word.alias("severity")).alias("database_specific"))).alias("doc"))


def shaped_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc STRING: an advisory per part whose versions have the shape that p_partkey % 8 names; a = p_size % 5, b = p_partkey % 7."""
    parts = spread(table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    p, a, b = F.col("p_partkey"), (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 7).cast("string")
    kind = p % 8
    eco = F.element_at(F.array(*[F.lit(e) for e in ("Go", "PyPI", "PyPI", "npm", "PyPI", "npm", "RubyGems", "Packagist")]), (kind + 1).cast("int"))
    none = F.lit(None).cast("string")

    def event(introduced=none, fixed=none, last=none) -> F.Column:
        return F.struct(introduced.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"))

    start = event(F.lit("0"))
    # the document of kind 4 lists its fix first
    events = (F.when(kind == 0, F.array(start, event(fixed=F.concat(F.lit("0.0.0-2020010"), a, F.lit("10101"), b, F.lit("-c2843e01d9a2")))))
              .when(kind == 1, F.array(start, event(fixed=F.concat(a, F.lit("!"), b, F.lit(".0")))))
              .when(kind == 2, F.array(start, event(fixed=F.concat(F.lit("1.0.post"), b))))
              .when(kind == 3, F.array(event(F.concat(F.lit("1.0.0-"), a, F.lit(".3"))), event(fixed=F.lit("1.0.0"))))
              .when(kind == 4, F.array(event(fixed=F.concat(b, F.lit(".5"))), event(F.concat(a, F.lit(".0")))))
              .when(kind == 5, F.array(start, event(fixed=F.lit("99"))))
              .when(kind == 6, F.array(start, event(last=F.concat(F.lit("1."), a, F.lit(".rc"), b))))
              .otherwise(F.array(start, event(fixed=F.concat(F.lit("1.0.0-beta1"), b)))))
    package = F.struct(eco.alias("ecosystem"), F.concat(F.lit("shape-"), p.cast("string")).alias("name"))
    return parts.select(F.to_json(F.struct(
        F.concat(F.lit("SHP-"), p.cast("string")).alias("id"), F.when(kind == 5, "2021-01-01T00:00:00Z").alias("withdrawn"),
        F.array(F.struct(package.alias("package"), F.array(F.struct(events.alias("events"))).alias("ranges"))).alias("affected"))).alias("doc"))


def shaped_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, package, ecosystem, version) of each line item in the shape of its part; x = l_linenumber % 6, y = l_quantity % 9."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    p, x, y = F.col("l_partkey"), (F.col("l_linenumber") % 6).cast("string"), (F.col("l_quantity").cast("int") % 9).cast("string")
    kind = p % 8
    eco = F.element_at(F.array(*[F.lit(e) for e in ("Go", "PyPI", "PyPI", "npm", "PyPI", "npm", "RubyGems", "Packagist")]), (kind + 1).cast("int"))
    version = (F.when(kind == 0, F.concat(F.lit("v0.0.0-2020010"), x, F.lit("10101"), y, F.lit("-ffffffffffff")))
               .when(kind == 1, F.concat(F.when(x != "0", F.concat(x, F.lit("!"))).otherwise(""), y, F.lit(".0.0")))
               .when(kind == 2, F.when(x == "0", "1.0").when(x == "1", F.concat(F.lit("1.0-"), y)).otherwise(F.concat(F.lit("1.0.post"), y)))
               .when(kind == 3, F.when(x == "0", "1.0.0").otherwise(F.concat(F.lit("1.0.0-"), x, F.lit("."), y)))
               .when(kind == 4, F.concat(x, F.lit("."), y)).when(kind == 5, "1.0.0")
               .when(kind == 6, F.concat(F.lit("1."), x, F.lit(".rc"), y)).otherwise(F.concat(F.lit("1.0-"), F.when(x == "0", "RC").otherwise("beta"), y)))
    return items.select(F.concat(F.lit("repo-"), F.col("l_orderkey").cast("string")).alias("repo"), F.concat(F.lit("shape-"), p.cast("string")).alias("package"),
                        eco.alias("ecosystem"), version.alias("version"))


LICENCE_CHOICES = [["MIT"], ["GPL-3.0"], ["AGPL-3.0-only"], ["LGPL-2.1"], ["MPL-2.0"], [""], ["NOASSERTION"],
                   ["Apache-2.0"], ["gpl-3.0"], ["EPL-2.0"], [], None, ["MIT", "GPL-2.0"]]


def licence_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ecosystem, package, version, licenses) for every part version that occurs; null = failed lookup."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    eco = F.element_at(F.array(*[F.lit(e) for e in MANIFEST_ECOSYSTEMS]), (F.col("l_orderkey") % 7 + 1).cast("int"))
    choices = F.array(*[F.lit(None).cast("array<string>") if c is None else
                        F.array(*[F.lit(x) for x in c]).cast("array<string>") for c in LICENCE_CHOICES])
    version = F.concat_ws(".", F.col("l_quantity").cast("int"), "l_linenumber", F.lit("0"))
    return items.select(eco.alias("ecosystem"), F.concat(F.lit("pkg-"), F.col("l_partkey").cast("string")).alias("package"),
                        version.alias("version"),
                        F.element_at(choices, (F.col("l_partkey") % len(LICENCE_CHOICES) + 1).cast("int"))
                        .alias("licenses")).distinct()


def cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cve_id, description, v31, v30, v2) per part."""
    p, size = F.col("p_partkey"), F.col("p_size")
    return spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size"), "p_partkey").select(
        F.concat(F.lit("CVE-2024-"), F.lpad(p.cast("string"), 9, "0")).alias("cve_id"),
        F.concat_ws(" in ", "p_name", "p_type").alias("description"),
        F.when(p % 4 == 0, size / 5.0).alias("v31"), F.when(p % 3 == 0, size / 6.0).alias("v30"),
        F.when(p % 2 == 0, size / 7.0).alias("v2"))


def package_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target STRING: an ad-hoc lookup per order line part, in several spellings."""
    prefixes = F.array(*[F.lit(x) for x in ["", "pip:", "npm:", "go:", "gem:", "composer:", "Cargo:", "crates.io:"]])
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return items.select(F.concat(
        F.element_at(prefixes, (F.col("l_orderkey") % 8 + 1).cast("int")), F.lit("pkg-"),
        F.col("l_partkey").cast("string"), F.lit("@"), F.col("l_quantity").cast("int").cast("string"), F.lit("."),
        F.col("l_linenumber").cast("string")).alias("target")).distinct()


# --- runs, users, schedules, cases -----------------------------------------------------------

RUN_KINDS = {"view": "repo", "purchase": "repo", "click": "check:website", "error": "check:dns", "signup": "check:all"}
TODAY = "2024-01-15"
NOW = "2024-01-15 12:00:00"
SCHEDULE_NOW = "1998-06-01 00:00:00"
SEVERITY_CYCLE = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def at(text: str) -> F.Column:
    return F.lit(text).cast("timestamp")


def scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, kind, target, created_at, critical, high, medium, low, total) per event."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.lit(None).cast("string")
    for name, value in RUN_KINDS.items():
        kind = F.when(F.col("event_type") == name, value).otherwise(kind)
    counted = events.select(
        F.col("event_id").alias("id"), "user_id", kind.alias("kind"),
        F.concat(F.lit("repo-"), (F.col("user_id") % 20).cast("string")).alias("target"),
        F.col("ts").cast("timestamp").alias("created_at"), (k % 3).alias("critical"), (k % 5).alias("high"),
        (k % 7).alias("medium"), (k % 11).alias("low"))
    return counted.withColumn("total", F.col("critical") + F.col("high") + F.col("medium") + F.col("low"))


def run_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, target, kind, created_at, ord, id, severity, label) of every run; runs of a target overlap."""
    runs = scan_runs(spark, sf_dir).select("id", "target", "kind", "created_at", "total")
    number = F.pmod(F.col("run_id") * 7 + F.col("i"), F.lit(31)).cast("string")
    each = runs.select(F.col("id").alias("run_id"), "target", "kind", "created_at",
                       F.explode(F.sequence(F.lit(0), F.col("total"))).alias("i"))
    return each.select(
        "run_id", "target", "kind", "created_at", F.col("i").alias("ord"),
        F.substring(F.sha1(F.concat_ws("|", "target", number)), 1, 12).alias("id"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITY_CYCLE]), (F.col("i") % 4 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("rule "), number, F.lit(" @ f.py:"), F.col("i").cast("string")).alias("label"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, plan, pro_until) per customer."""
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    pro = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    until = F.date_add(F.lit("2023-12-01").cast("date"), F.floor(F.col("c_acctbal") / 100).cast("int"))
    return rows.select(F.col("c_custkey").alias("id"), F.when(pro, "pro").otherwise("free").alias("plan"),
                       F.when(pro & (F.col("c_acctbal") >= 0), until).alias("pro_until"))


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, owner, kind, target, interval, active, next_run STRING) per order."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    n = F.col("o_orderkey")
    pick = F.substring("o_orderpriority", 1, 1)
    interval = (F.when(pick == "1", "hourly").when(pick == "2", "daily").when(pick == "3", "weekly")
                .when(pick == "4", "monthly").otherwise(" daily "))
    kind = F.element_at(F.array(*[F.lit(x) for x in ["repo", "check:dns", "check:nothing", "other", "repo", "check:tls"]]),
                        (n % 6 + 1).cast("int"))
    target = (F.when(n % 6 == 0, F.concat(F.lit("https://github.com/org/app-"), n.cast("string")))
              .when(n % 6 == 4, F.concat(F.lit("http://gitlab.com/org/app-"), n.cast("string"), F.lit(".git")))
              .when(n % 6 == 5, F.lit("  ")).otherwise("example.com"))
    next_run = F.when(n % 10 == 9, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return rows.select(n.alias("id"), F.col("o_custkey").alias("owner"), kind.alias("kind"), target.alias("target"),
                       interval.alias("interval"), (F.col("o_orderstatus") != "F").alias("active"),
                       next_run.alias("next_run"))


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url STRING per order, in accepted and rejected spellings."""
    n = F.col("o_orderkey").cast("string")
    forms = F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in [
        ("https://github.com/org/app-", ""), ("http://github.com/org/app-", ".git"), ("https://github.com/org/app-", "/"),
        ("https://gitlab.com/org/app-", ""), ("https://example.com/org/app-", ""), ("https://github.com/app-", "")]])
    return table(spark, sf_dir, "orders", "o_orderkey").select(
        F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("url"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, repo, owner, repo_url, status, created_at) per document source."""
    first = table(spark, sf_dir, "documents", "doc_id", "source").groupBy("source").agg(F.min("doc_id").alias("first"))
    status = F.element_at(F.array(*[F.lit(s) for s in ["pending", "pending", "approved", "dismissed"]]),
                          (F.col("first") % 4 + 1).cast("int"))
    url = F.concat(F.when(F.col("first") % 2 == 0, "https://github.com/org/").otherwise("https://gitlab.com/org/"), "source")
    return first.select(F.concat(F.lit("case-"), "source").alias("id"), F.col("source").alias("repo"),
                        F.concat(F.lit("owner-"), (F.col("first") % 7).cast("string")).alias("owner"), url.alias("repo_url"),
                        status.alias("status"),
                        F.timestamp_add("DAY", (F.col("first") % 9).cast("int"), at("2024-01-01")).alias("created_at"))


# --- observations ----------------------------------------------------------------------------

PROBE_ORIGIN = "https://cors-probe.example"
PROBE_HOST = "redirect-probe.example"
HSTS = ["max-age=31536000; includeSubDomains; preload", "max-age=300", "includeSubDomains"]
COOKIES = [[], ["sid=abc; Secure; HttpOnly; SameSite=Lax"], ["sid=abc", "theme=dark; Secure"], ["t=1; SameSite=None"],
           ["__Secure-x=1; httponly; samesite=none"]]


def _host(url) -> F.Column:
    return F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)


def http_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, host, final_url, status, headers, cookies, location, body) per page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    p = F.col("page_id")

    def pick(texts, index) -> F.Column:
        return F.element_at(F.array(*[F.lit(t) for t in texts]), (index + 1).cast("int"))

    def header(name: str, condition, value) -> F.Column:
        return F.when(condition, F.struct(F.lit(name).alias("k"), value.alias("v")))

    yes = F.lit("x")
    headers = F.map_from_entries(F.array_compact(F.array(
        header("Strict-Transport-Security", p % 2 == 0, pick(HSTS, p % 3)),
        header("Content-Security-Policy", p % 3 == 0, yes), header("X-Content-Type-Options", p % 4 != 0, yes),
        header("x-frame-options", p % 5 != 1, yes), header("Referrer-Policy", p % 6 == 0, yes),
        header("Permissions-Policy", p % 7 == 0, yes),
        header("Server", p % 3 != 2, pick(["nginx/1.18.0", "cloudflare"], p % 3)),
        header("X-Powered-By", p % 8 == 0, F.lit("PHP/8.1")),
        header("Access-Control-Allow-Origin", p % 6 <= 2, pick([PROBE_ORIGIN, PROBE_ORIGIN, "*"], p % 3)),
        header("Access-Control-Allow-Credentials", p % 6 == 0, F.lit("true")))))
    cookies = F.element_at(F.array(*[F.array(*[F.lit(c) for c in cs]).cast("array<string>") for cs in COOKIES]),
                           (p % 5 + 1).cast("int"))
    host = _host("url")
    resources = F.concat(F.lit('<img src="http://cdn'), (p % 7).cast("string"), F.lit('.example.com/a.png"><a href=\'http://x.example.org/'),
                         p.cast("string"), F.lit("'>"))
    return pages.select(
        "page_id", "url", host.alias("host"),
        F.when(p % 5 == 0, F.regexp_replace("url", "^https://", "http://"))
        .otherwise(F.regexp_replace("url", "^http://", "https://")).alias("final_url"),
        F.when(p % 9 == 0, 301).when(p % 9 == 1, 404).otherwise(200).alias("status"), headers.alias("headers"),
        cookies.alias("cookies"),
        F.when(p % 3 == 0, F.concat(F.lit("https://"), host, F.lit("/"))).when(p % 3 == 1, "http://other.example/")
        .alias("location"),
        F.when(p % 4 == 0, F.concat("html", resources)).otherwise(F.col("html")).alias("body"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, n, m, x): distinct page hosts with numbers drawn from their hash."""
    named = table(spark, sf_dir, "pages", "url").select(_host("url").alias("host")).distinct()
    h = F.sha1("host")
    first, second, third = (F.ascii(F.substring(h, i, 1)) for i in (1, 2, 3))
    return named.select("host", ((first * 16 + second) % 97 - 30).alias("n"), (second % 6).alias("m"), (third % 4).alias("x"))


def tls_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    expiry = F.timestamp_add("HOUR", (F.col("n") * 24 + F.col("x") * 6).cast("int"), at(NOW))
    return hosts(spark, sf_dir).select(
        "host", (F.col("x") == 0).alias("tls10"), (F.col("x") <= 1).alias("tls11"), expiry.alias("not_after"),
        F.when(F.col("m") > 0, F.concat(F.lit("CA "), F.col("m").cast("string"))).alias("issuer"))


def rdap_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def iso(hours) -> F.Column:
        return F.date_format(F.timestamp_add("HOUR", hours.cast("int"), at(NOW)), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    registered, expires = iso(-(F.col("n") + 31) * 40), iso(F.col("n") * 24 + F.col("x") * 6)

    def event(action: str, date) -> F.Column:
        return F.struct(F.lit(action).alias("eventAction"), date.alias("eventDate"))

    events = F.array(event("last changed", iso(F.col("n") * 0)),
                     event("registration", F.when(F.col("m") == 5, "unknown").otherwise(registered)),
                     event("expiration", expires))
    return hosts(spark, sf_dir).select(
        F.col("host").alias("domain"), F.when(F.col("m") == 0, F.slice(events, 1, 2)).otherwise(events).alias("events"),
        F.when(F.col("x") > 0, F.concat(F.lit("Registrar "), F.col("x").cast("string"))).alias("registrar"))


def dns_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, rtype, answers, ad): five record types per host."""
    m, x = F.col("m"), F.col("x")

    def row(domain, rtype: str, answers, ad=None) -> F.Column:
        return F.struct(domain.alias("domain"), F.lit(rtype).alias("rtype"), answers.cast("array<string>").alias("answers"),
                        (F.lit(False) if ad is None else ad).alias("ad"))

    host = F.col("host")
    txt = (F.when(m <= 2, F.array(F.lit('"v=spf1 include:x ~all"'), F.lit('"site=1"')))
           .when(m == 3, F.array(F.lit('"V=SPF1 +ALL"'))).otherwise(F.array(F.lit('"hello"'))))
    dmarc = (F.when(x == 0, F.array(F.lit('"v=DMARC1; p=none"'))).when(x == 1, F.array(F.lit('"v=DMARC1; p=reject"')))
             .otherwise(F.array()))
    caa = F.when(x == 2, F.array(F.lit('0 issue "a.example"'), F.lit("  "), F.lit('0 issue "b.example"'))).otherwise(F.array())
    return hosts(spark, sf_dir).select(F.inline(F.array(
        row(host, "TXT", txt), row(F.concat(F.lit("_dmarc."), host), "TXT", dmarc),
        row(host, "A", F.array(F.lit("203.0.113.9")), m % 2 == 0), row(host, "MX", F.when(m != 4, F.array(F.lit("mx"))).otherwise(F.array())),
        row(host, "CAA", caa))))


def ct_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, name_value): one log entry per page; most fall under a few domains."""
    host = _host("url")
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return table(spark, sf_dir, "pages", "page_id", "url").select(
        domain.alias("domain"), F.concat(
            host, F.lit("\n*."), F.upper(host), F.lit("\nnot"), domain, F.lit("\n"), domain, F.lit("\np"),
            (F.col("page_id") % 400).cast("string"), F.lit("."), domain).alias("name_value"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(spark, sf_dir).select(F.col("host").alias("domain"))


def registered_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts themselves, under other top-level domains, and with their first or second letter lost."""
    host = F.col("host")
    name = F.regexp_extract(host, r"^(.*)\.[^.]*$", 1)
    forms = F.array(host, F.concat(name, F.lit(".io")), F.concat(name, F.lit(".net")), F.substring(host, 2, 200),
                    F.concat(F.substring(host, 1, 1), F.substring(host, 3, 200)),
                    F.concat(F.substring(host, 1, 1), host))
    return hosts(spark, sf_dir).select(F.explode(forms).alias("domain")).distinct()


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.concat(
        F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail"), F.col("c_nationkey").cast("string"),
        F.lit(".example.com")).alias("email"))


def breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(email, title, breach_date, data_classes) per order; the mail host is the one customers of that key use."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    classes = (F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Emails"), F.lit("Passwords")))
               .when(F.col("o_orderstatus") == "O", F.array(F.lit("Emails"))).otherwise(F.array().cast("array<string>")))
    return orders.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@mail"), (F.col("o_custkey") % 25).cast("string"),
                 F.lit(".example.com")).alias("email"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_custkey") % 5 != 0, F.to_date("o_orderdate")).alias("breach_date"), classes.alias("data_classes"))


def password_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prefix, suffix, count) of the hashes of part names with sizes."""
    digest = F.upper(F.sha1(F.concat("p_name", F.col("p_size").cast("string"))))
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return parts.groupBy(F.left(digest, F.lit(5)).alias("prefix"), F.substring(digest, 6, 35).alias("suffix")).agg(
        F.sum(F.col("p_partkey")).alias("count"))


def passwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return parts.select(F.col("p_partkey").alias("id"),
                        F.concat("p_name", (F.col("p_size") + F.col("p_partkey") % 3 * 20).cast("string")).alias("password"))


def security_txt_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, path, status, body): three paths per host."""
    m, x = F.col("m"), F.col("x")
    row = lambda path, status, body: F.struct(
        F.lit(path).alias("path"), status.cast("int").alias("status"), body.alias("body"))
    good, bad = F.lit("Contact: mailto:a@example.com"), F.lit("nothing")
    return hosts(spark, sf_dir).select("host", F.inline(F.array(
        row("/security.txt", F.when(x <= 1, 200).otherwise(404), good),
        row("/.well-known/security.txt", F.when(m <= 2, 200).otherwise(404), F.when(m == 0, bad).otherwise(good)),
        row("/other.txt", F.lit(200), good))))


def exposed_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(base, path, status, body) of eight paths per page."""
    p = F.col("page_id")
    paths = ["/.git/HEAD", "/.env", "/.svn/entries", "/.DS_Store", "/.aws/credentials", "/server-status", "/backup.zip",
             "/robots.txt"]
    bodies = ["REF: refs/heads/main", "A=1", "", "x", "[default]", "apache status", "PK", "ok"]
    probe = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("path"), F.lit(b).alias("body"))
                      for i, (a, b) in enumerate(zip(paths, bodies))])
    return (table(spark, sf_dir, "pages", "page_id", "url").select("page_id", "url", F.inline(probe))
            .select(F.concat(F.lit("https://"), _host("url"), F.lit("/"), p.cast("string")).alias("base"), "path",
                    F.when((p + F.col("i")) % 3 == 0, 200).otherwise(404).alias("status"), "body"))


def redirect_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, param, payload, status, location): every listed parameter with two payloads per page."""
    from sentrymill.fixed_values.posture import REDIRECT_PARAMS
    p = F.col("page_id")
    probe = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("param"), F.lit(j).alias("payload"))
                      for i, name in enumerate(REDIRECT_PARAMS) for j in range(2)])
    k = p + F.col("i") * 3 + F.col("payload")
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", "url", F.inline(probe)).select(
        "url", "param", "payload", F.when(k % 5 == 0, 302).when(k % 5 == 1, 307).otherwise(200).alias("status"),
        F.when(k % 2 == 0, f"https://{PROBE_HOST}/").when(k % 7 == 0, "/home").alias("location"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target STRING: page URLs and hosts, e-mail addresses, package specs and words."""
    def named(df, c) -> DataFrame:
        return df.select(c.alias("target"))

    pages = table(spark, sf_dir, "pages", "url")
    return (named(pages, F.col("url")).unionByName(named(pages, _host("url")))
            .unionByName(named(emails(spark, sf_dir), F.col("email")))
            .unionByName(package_specs(spark, sf_dir))
            .unionByName(named(table(spark, sf_dir, "part", "p_name"), F.col("p_name"))).distinct())


ADDRESSES = [
    "10.1.2.3", "8.8.8.8", "not-an-address", "172.32.0.1", "::1", "2606:4700::1111",
    "0:0:0:0:0:0:0:1", "0::1", "2001:0db8::1", "100::1", "64:ff9b:1::1", "0:0:0:0:0:ffff:10.0.0.1",
    "::ffff:8.8.8.8", "2002:a00:1::", "fe80::1%eth0", "2001:4860:4860::8888", "2001:20::5", "2001:10::5",
    "fd00::1", "3fff:1::1", "ff02::1", "1:2:3", "2a00:1450:4001:81b::200e", "::",
]


def resolved_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, addresses) per document: the addresses its text mentions and one more."""
    found = F.regexp_extract_all("text", F.lit(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), F.lit(0))
    more = F.element_at(F.array(*[F.lit(a) for a in ADDRESSES]), (F.col("doc_id") % len(ADDRESSES) + 1).cast("int"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("host-"), F.col("doc_id").cast("string")).alias("host"), F.concat(found, F.array(more)).alias("addresses"))


def cve_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keyword): the first word of every part type, and two more."""
    first = table(spark, sf_dir, "part", "p_type").select(F.substring_index("p_type", " ", 1).alias("keyword"))
    return first.distinct().unionByName(literal_table(spark, ["keyword"], [("b",), (" ring ",)]))


def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content BINARY) per document; every third has a byte that is not UTF-8 after its fifth character."""
    text = F.col("text")
    broken = F.concat(F.left(text, F.lit(5)).cast("binary"), F.unhex(F.lit("FF")), F.substring(text, 6, 2147483647).cast("binary"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("doc_id") % 3 == 0, broken).otherwise(text.cast("binary")).alias("content"))
