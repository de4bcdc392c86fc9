import collections
import hashlib
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.fixed_values import packages as P
from sentrymill.functions.version_order import order_key
from sentrymill.functions import versions as V
from sentrymill.operators import advisories, bumps, manifests

ADVISORY = {"id": "ADV-1", "summary": "bad", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}],
            "affected": [{"package": {"ecosystem": "PyPI", "name": "requests"},
                          "ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.20.0"}]}]}]}


def docs(spark, *items):
    return advisories.parsed(spark.createDataFrame([(json.dumps(i) if isinstance(i, dict) else i,) for i in items], "doc string"))


def pairs(make_files, name, text):
    return sorted((r.package, r.version) for r in manifests.packages(make_files({name: text})).collect())


def test_requirements(make_files):
    text = ("# c\nflask==2.0.0\nRequests >= 2.1 ; python_version > '3'\n-r x\ngit+https://x\nhttp://y\na!=1.0\nb===1.0\n"
            "c[x]==1\nd\n  e~=1.2,<2\nf==v1\nflask==2.0.0\ng<3#x\n")
    assert pairs(make_files, "requirements.txt", text) == sorted([
        ("flask", "2.0.0"), ("flask", "2.0.0"), ("Requests", "2.1"), ("a", "1.0"), ("e", "1.2"), ("g", "3")])


def test_package_json(make_files):
    text = json.dumps({"dependencies": {"a": "^1.2.3", "b": ">=1 <2", "c": "latest"}, "devDependencies": {"a": "~2"}})
    assert pairs(make_files, "package.json", text) == [("a", "1.2.3"), ("a", "2"), ("b", "1 <2")]
    assert pairs(make_files, "package.json", "{broken") == []
    assert pairs(make_files, "package.json", "{}") == []


def test_go_mod(make_files):
    text = ("module m\ngo 1.2\nrequire a v1.0.0 // x\nrequire (\n\tb v2.0.0\n\n\tc v3.0.0 // indirect\n\trequire d v4.0.0\n)\n"
            "e v5.0.0\nreplace (\n f v6.0.0\n)\nrequire(\ng v7.0.0\n)\nexclude h v8.0.0\nrequire i latest\n")
    assert pairs(make_files, "go.mod", text) == [("a", "1.0.0"), ("b", "2.0.0"), ("c", "3.0.0"), ("d", "4.0.0"), ("g", "7.0.0")]


def test_lock_files(make_files):
    gem = "GEM\n  specs:\n    rails (7.0.1)\n      dep (>= 1)\n    x (a)\n   y (1.0)\n"
    assert pairs(make_files, "Gemfile.lock", gem) == [("rails", "7.0.1")]
    composer = json.dumps({"packages": [{"name": "a", "version": "vv1.0"}, {"name": "", "version": "1"}, {"version": "2"}],
                           "packages-dev": [{"name": "b", "version": "dev-main"}, {"name": "c", "version": "2.0"}]})
    assert pairs(make_files, "composer.lock", composer) == [("a", "1.0"), ("c", "2.0")]
    toml = ('name = "no"\n[[package]]\nname = "a"\nversion = "1.0"\ndependencies = [\n "b",\n]\n[package.source]\nname = "no"\n'
            "[[ package ]] # x\nversion = '2'\nname = 'b'\n[metadata]\nname = \"z\"\nversion = \"9\"\n")
    assert pairs(make_files, "Cargo.lock", toml) == [("a", "1.0"), ("b", "2")]
    assert {r.ecosystem for r in manifests.packages(make_files({"poetry.lock": toml})).collect()} == {"PyPI"}


def test_where_manifests_count(spark, make_files):
    tree = {"a/requirements.txt": "x==1\n", "env/requirements.txt": "x==2\n", "Requirements.txt": "x==3\n"}
    assert [r.version for r in manifests.packages(make_files(tree)).collect()] == ["1"]
    strict = make_files({"package.json": '{"dependencies":{"a":"1"}}', "requirements.txt": "b==1\n"}).withColumn("valid_utf8", F.lit(False))
    assert [r.package for r in manifests.packages(strict).collect()] == ["b"]


def test_batches_and_components(spark):
    rows = [("r", f"f{i % 3}", f"p{i:03d}", "1.0", "PyPI") for i in range(230)] + [("r", "a", "p000", "1.0", "PyPI")]
    declared = spark.createDataFrame(rows, "repo string, file string, package string, version string, ecosystem string")
    sizes = {r.batch: r["count"] for r in manifests.lookup_batches(declared, P.LOOKUP_BATCH).groupBy("batch").count().collect()}
    assert sizes == {0: 100, 1: 100, 2: 30}
    placed = manifests.ordered_components(declared).orderBy("position").collect()
    assert [c.position for c in placed] == list(range(230)) and placed[0].file == "a"
    assert placed[0].purl == "pkg:pypi/p000@1.0"


def python_score(av, ac, pr, ui, s, c, i, a):
    w = P.CVSS3_WEIGHTS
    base = 1 - (1 - w["C"][c]) * (1 - w["I"][i]) * (1 - w["A"][a])
    impact = 7.52 * (base - 0.029) - 3.25 * (base - 0.02) ** 15 if s == "C" else 6.42 * base
    if impact <= 0:
        return 0.0
    total = impact + 8.22 * w["AV"][av] * w["AC"][ac] * P.CVSS3_PRIVILEGES[s][pr] * w["UI"][ui]
    return math.ceil(min(1.08 * total if s == "C" else total, 10.0) * 10) / 10


def test_all_cvss_vectors(spark):
    letters = ["NALP", "LH", "NLH", "NR", "UC", "HLN", "HLN", "HLN"]
    names = ["AV", "AC", "PR", "UI", "S", "C", "I", "A"]
    combos = list(itertools.product(*letters))
    assert len(combos) == 2592
    vectors = ["CVSS:3.1/" + "/".join(f"{n}:{v}" for n, v in zip(names, c)) for c in combos]
    df = spark.createDataFrame(list(enumerate(vectors)), "i int, v string")
    got = {r.i: r.s for r in df.select("i", V.cvss3_score(F.col("v")).alias("s")).collect()}
    assert got == {i: python_score(*c) for i, c in enumerate(combos)}
    odd = ["CVSS:3.1/AV:N", "", "CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", vectors[0] + "/AV:P"]
    scores = [r.s for r in spark.createDataFrame([(v,) for v in odd], "v string").select(V.cvss3_score(F.col("v")).alias("s")).collect()]
    assert scores == [None, None, None, python_score(*("P", *combos[0][1:]))]


def test_severity_sources(spark):
    def severity(**fields):
        return advisories.summarised(docs(spark, {"id": "x", **fields})).first()

    assert severity(severity=[{"score": "7.5"}]).severity == "HIGH"
    assert severity(severity=[{"score": "3"}, {"score": " 9.8 "}]).severity == "CRITICAL"
    assert severity(severity=[{"score": "0.0"}]).severity == "LOW"
    assert severity(severity=[{"score": "AV:N/AC:L"}], database_specific={"severity": "moderate"}).severity == "MEDIUM"
    assert severity(database_specific={"severity": "Critical"}).severity == "CRITICAL"
    assert severity(database_specific={"severity": "odd"}).severity == "MEDIUM"
    assert severity().severity == "MEDIUM" and severity().summary == P.NO_SUMMARY_TEXT
    nested = [{"ranges": [{"events": [{"introduced": "0"}]}, {"events": [{"introduced": "0"}, {"fixed": "9"}, {"fixed": "1"}]}]}]
    assert severity(affected=nested).fixed_version == "9"  # document order, not the lowest


def test_advisory_findings(spark, make_files):
    declared = manifests.packages(make_files({"requirements.txt": "requests==2.19.1\nrequests==2.20.0\nflask==1.0\n"}))
    found = advisories.dependency_findings(declared, docs(spark, ADVISORY, "{}", "broken")).collect()
    assert [(f.package, f.version, f.severity, f.fixed_version) for f in found] == [("requests", "2.19.1", "CRITICAL", "2.20.0")]
    assert found[0].remediation == "Upgrade to 2.20.0  ·  pip install 'requests>=2.20.0'"
    assert advisories.dependency_findings(declared.limit(0), docs(spark, ADVISORY)).count() == 0


def test_declared_rows_are_read_once(spark, make_files, tmp_path):
    folder = str(tmp_path / "declared")
    manifests.packages(make_files({"requirements.txt": "requests==2.19.1\nflask==1.0\n"})).write.parquet(folder)
    found = advisories.matched(spark.read.parquet(folder), docs(spark, ADVISORY))
    assert [r.version for r in found.collect()] == ["2.19.1"]
    # what follows the one pass goes over the stored rows of packages with an advisory
    assert not [f for f in found.inputFiles() if f"{folder}/" in f]


def test_quotes_of_toml_values(make_files):
    lock = "".join(f"[[package]]\nname = {n}\nversion = {v}\n" for n, v in [
        ('"a"', "'1'"), ("'b\"c'", '"2\'3"'), ("\"d'", '"4"'), ("'e\"", "'5'"), ('"f', '"6"'), ('""', '"7"'), ('"g"', '"8" # "9"'), ("'h''i'", '"10"')])
    assert pairs(make_files, "Cargo.lock", lock) == [("a", "1"), ('b"c', "2'3"), ("g", "8"), ("h", "10")]


def test_range_edges(spark):
    adv = {"id": "A", "affected": [{"package": {"ecosystem": "npm", "name": "p"}, "ranges": [
        {"events": [{"introduced": "1.0"}, {"fixed": "1.10"}, {"introduced": "2.0"}]}, {"events": [{"introduced": "1.5"}, {"fixed": "1.6"}]}]}]}
    versions = ["0.9", "1.0", "1.5", "1.9", "1.10", "1.10.1", "2.0", "3", "x"]
    declared = spark.createDataFrame([("r", "f", "p", v, "npm") for v in versions],
                                     "repo string, file string, package string, version string, ecosystem string")
    found = advisories.dependency_findings(declared, docs(spark, adv)).collect()
    assert sorted(f.version for f in found) == ["1.0", "1.5", "1.9", "2.0", "3"]  # 1.5 once though two ranges hold


ORDERS = {
    "npm": ["0", "0.1.0", "1.0.0-0.3.7", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11",
            "1.0.0-rc.1", "v1.0.0", "1.0.1", "1.10", "2.0.0-rc.1", "2", "10.0"],
    "Go": ["0.0.0-20190308221718-c2843e01d9a2", "0.0.0-20211202192323-5770296d904e", "v0.1.0", "v0.1.1-0.20200101000000-abcdefabcdef", "v0.1.1",
           "v2.0.0-pre.0.20200101000000-abcdefabcdef", "v2.0.0+incompatible"],
    "PyPI": ["0", "1.0.dev2", "1.0a1.dev1", "1.0a1", "1.0a1.post1", "1.0-alpha.2", "1.0b1", "1.0rc1", "1.0", "1.0+local.5", "1.0.post1.dev1",
             "1.0-1", "1.0.post2", "1.0.1", "1.1-beta", "1.1", "2", "10.0", "1!0.1", "1!1.0", "2!0"],
    "RubyGems": ["1.0.a", "1.0.a.2", "1.0.a.10", "1.0.b1", "1.0.0-rc1", "1.0.rc1", "1.0", "1.0.1.pre", "1.0.1", "1.2", "1.10"],
    "Packagist": ["1.0.0-dev", "1.0-alpha", "1.0.0-alpha2", "v1.0.0-beta1", "1.0.0-RC1", "1.0", "1.0.0-patch1", "1.0.1", "1.10.0"],
    "Maven": ["1-alpha", "1.0-alpha-2", "1-beta-1", "1.0-m1", "1-rc1", "1.0-SNAPSHOT", "1.0.0.Final", "1-sp1", "1-foo", "1-1", "1.1", "1.2", "1.10"],
}


def keys_of(spark, rows):
    df = spark.createDataFrame(rows, "e string, v string")
    return {(r.e, r.v): r.k for r in df.select("e", "v", order_key(F.col("e"), F.col("v")).alias("k")).collect()}


def test_version_order_of_each_ecosystem(spark):
    keys = keys_of(spark, [(e, v) for e, order in ORDERS.items() for v in order])
    for ecosystem, order in ORDERS.items():
        found = [keys[ecosystem, v] for v in order]
        assert all(a < b for a, b in zip(found, found[1:], strict=False)), ecosystem
    same = [("PyPI", "1.0", "1.0.0"), ("PyPI", "v2", "2.0.0"), ("PyPI", "1.0-post1", "1.0.post1"), ("PyPI", "1.0_C2", "1.0rc2"), ("PyPI", "1.0.r3", "1.0-3"),
            ("npm", "1.0.0+build.5", "1"), ("npm", "v0.0", "0.0.0"), ("Go", "v1.2.0+incompatible", "1.2"), ("RubyGems", "1.0.0", "1"),
            ("Packagist", "v1.0.0-RC1", "1.0-rc1"), ("Maven", "1.0.ga", "1"), ("Odd", "release-1.20", "1.20")]
    keys = keys_of(spark, [(e, v) for e, *two in same for v in two])
    assert all(keys[e, a] == keys[e, b] for e, a, b in same)
    assert set(keys_of(spark, [(e, v) for e in ORDERS for v in ("", "x", "dev-master")]).values()) == {""}
    assert keys_of(spark, [("PyPI", None)])["PyPI", None] is None
    big = keys_of(spark, [("npm", "9" * 50), ("npm", "1" + "0" * 50)])
    assert big["npm", "9" * 50] < big["npm", "1" + "0" * 50]


def test_python_versions_compare_as_published(spark):
    version = pytest.importorskip("packaging.version")
    rng = random.Random(3)

    def drawn():
        out = rng.choice(["", "", "", "1!", "v"]) + ".".join(str(rng.choice([0, 0, 1, 2, 10])) for _ in range(rng.randint(1, 4)))
        for share, choices in ((0.4, ["a1", ".alpha", "-b10", "_beta2", "c3", "rc.3", "pre", ".preview1"]), (0.3, [".post1", "-1", "post", "-r2", ".post10"]),
                               (0.3, [".dev0", ".dev10", "dev"]), (0.2, ["+abc", "+1", "+abc.1", "+10.x", "+ubuntu-1"])):
            out += rng.choice(choices) if rng.random() < share else ""
        return out

    versions = sorted({drawn() for _ in range(800)})
    keys = keys_of(spark, [("PyPI", v) for v in versions])
    parsed = {v: version.Version(v) for v in versions}
    for _ in range(50_000):
        a, b = rng.choice(versions), rng.choice(versions)
        assert (parsed[a] < parsed[b]) == (keys["PyPI", a] < keys["PyPI", b]) and (parsed[a] == parsed[b]) == (keys["PyPI", a] == keys["PyPI", b]), (a, b)


def semantic(version):
    """Precedence of a semantic version by its published rules."""
    core, _, stage = version.partition("-")
    names = [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in stage.split(".")] if stage else []
    return tuple(map(int, core.split("."))), not stage, names


def test_semantic_versions_compare_as_published(spark):
    rng = random.Random(4)
    part = lambda: rng.choice(["0", "1", "10", "alpha", "beta", "rc", "x-y", "B", "20190308221718-c2843e01d9a2"])
    versions = sorted({".".join(str(rng.choice([0, 1, 2, 10])) for _ in range(3)) + ("-" + ".".join(part() for _ in range(rng.randint(1, 3))) if rng.random() < 0.6 else "")
                       for _ in range(600)})
    keys = keys_of(spark, [("npm", v) for v in versions])
    assert sorted(versions, key=semantic) == sorted(versions, key=lambda v: keys["npm", v])


def test_ranges_follow_version_order(spark):
    def hit(ecosystem, events, versions, **more):
        adv = {"id": "A", "affected": [{"package": {"ecosystem": ecosystem, "name": "p"}, "ranges": [{"type": "ECOSYSTEM", "events": events}]}], **more}
        declared = spark.createDataFrame([("r", "f", "p", v, ecosystem) for v in versions], "repo string, file string, package string, version string, ecosystem string")
        return sorted(r.version for r in advisories.dependency_findings(declared, docs(spark, adv)).collect())

    to = lambda fix: [{"introduced": "0"}, {"fixed": fix}]
    assert hit("Go", to("0.0.0-20211202192323-5770296d904e"), ["0.0.0-20190308221718-c2843e01d9a2", "0.0.0-20211202192323-5770296d904e", "0.1.0"]) == [
        "0.0.0-20190308221718-c2843e01d9a2"]
    assert hit("PyPI", to("1!1.5"), ["9.0", "1!1.0", "1!1.5", "2!0"]) == ["1!1.0", "9.0"]
    assert hit("PyPI", to("1.0.post2"), ["1.0", "1.0.post1", "1.0.post2", "1.1"]) == ["1.0", "1.0.post1"]
    assert hit("npm", to("1.0.0"), ["1.0.0-0.3.7", "1.0.0-5", "1.0.0", "0.9.0"]) == ["0.9.0", "1.0.0-0.3.7", "1.0.0-5"]
    assert hit("PyPI", [{"fixed": "2.0"}, {"introduced": "1.0"}], ["0.5", "1.5", "2.5"]) == ["1.5"]
    mixed = [{"introduced": "3.0"}, {"fixed": "2.0"}, {"last_affected": "3.2"}, {"introduced": "1.0"}, {"introduced": "1.1"}, {"introduced": "5"}, {"fixed": "5"}]
    assert hit("PyPI", mixed, ["0.9", "1.0", "1.9", "2.0", "3.0", "3.2", "3.2.1", "5", "6"]) == ["1.0", "1.9", "3.0", "3.2"]
    assert hit("PyPI", to("2"), ["1"], withdrawn="2021-01-01T00:00:00Z") == []
    assert hit("PyPI", to("2"), ["1", "1"], withdrawn="") == ["1", "1"]
    assert hit("PyPI", [{"introduced": "0"}], ["x", "1"]) == ["1", "x"] and hit("PyPI", [], ["1"]) == []


def test_blocks_fill_stretches(spark):
    rows = [(a, b, 70) for a in range(0, 66, 3) for b in range(a, 66, 5)]
    df = spark.createDataFrame(rows, "low long, high long, top long")
    for r in df.select("low", "high", advisories._blocks(F.col("low"), F.col("high"), F.col("top")).alias("b")).collect():
        covered = [x for level, block in r.b for x in range(block << level, block + 1 << level)]
        assert sorted(covered) == list(range(r.low, r.high)) and max(collections.Counter(b.level for b in r.b).values(), default=0) <= 2


def test_hot_package_with_many_advisories(spark, no_broadcast):
    """Random ranges of one package against a plain test of each pair, and rows made in proportion to what holds."""
    rng = random.Random(6)
    adv, ranges = [], []
    for i in range(300):
        low = rng.randint(0, 400)
        high = low + rng.randint(1, 40)
        ranges.append((f"A{i}", low, high))
        adv.append({"id": f"A{i}", "affected": [{"package": {"ecosystem": "npm", "name": "hot"}, "ranges": [{"events": [{"fixed": f"1.{high}.0"}, {"introduced": f"1.{low}.0"}]}]}]})
    versions = [f"1.{n}.0" for n in range(450)]
    declared = spark.createDataFrame([(f"r{i}", "f", "hot", v, "npm") for i, v in enumerate(versions)], "repo string, file string, package string, version string, ecosystem string")
    found = advisories.dependency_findings(declared, docs(spark, *adv))
    assert sorted((r.version, r.vuln_id) for r in found.collect()) == sorted((f"1.{n}.0", i) for n in range(450) for i, low, high in ranges if low <= n < high)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any(sign in line for line in joins for sign in (">=", "<=", " < ", " > "))  # equalities alone


def test_advisory_ranges_names_and_lists(spark):
    def affects(name, versions, ranges, listed=None, ecosystem="PyPI"):
        adv = {"id": "A", "affected": [{"package": {"ecosystem": ecosystem, "name": name}, "ranges": ranges, **({"versions": listed} if listed else {})}]}
        declared = spark.createDataFrame([("r", "f", p, v, ecosystem) for p, v in versions],
                                         "repo string, file string, package string, version string, ecosystem string")
        return sorted((f.package, f.version, f.fixed_version) for f in advisories.dependency_findings(declared, docs(spark, adv)).collect())

    git = {"type": "GIT", "events": [{"introduced": "0"}, {"fixed": "9f8e7d6"}]}
    to_last = {"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"last_affected": "0.5"}]}
    to_fix = {"type": "ECOSYSTEM", "events": [{"introduced": "1.0"}, {"fixed": "2.0"}]}
    assert affects("flask", [("flask", "1.0")], [git]) == []
    assert affects("flask", [("flask", v) for v in ("0.4", "0.5", "0.5.1", "1.0")], [git, to_last]) == [("flask", "0.4", None), ("flask", "0.5", None)]
    assert affects("Flask_X", [("flask-x", "1.0"), ("FLASK.x", "2.0rc1"), ("flask-x", "2.0")], [git, to_fix]) == [
        ("FLASK.x", "2.0rc1", "2.0"), ("flask-x", "1.0", "2.0")]
    assert affects("a/B", [("a/B", "1.5"), ("a/b", "1.5")], [to_fix], ecosystem="Go") == [("a/B", "1.5", "2.0")]
    assert affects("p", [("p", "7.1"), ("p", "7.2")], [to_fix], listed=["7.1"]) == [("p", "7.1", "2.0")]
    assert affects("p", [("p", "7.1"), ("p", "1.0b2")], [], listed=["7.1", "1.0b2"]) == [("p", "1.0b2", None), ("p", "7.1", None)]


def test_hot_package_without_broadcast(spark, no_broadcast):
    declared = spark.range(5000).selectExpr("concat('r', id) AS repo", "'f' AS file", "'requests' AS package",
                                            "concat(id % 4, '.0') AS version", "'PyPI' AS ecosystem")
    assert advisories.dependency_findings(declared, docs(spark, ADVISORY)).groupBy("version").count().count() == 3


def test_licences_honour_built_in_patterns_always(spark, make_files):
    from sentrymill.plans import scan
    files = make_files({"examples/requirements.txt": "requests==2.0\n", "requirements.txt": "requests==2.0\n", "own/requirements.txt": "requests==2.0\n",
                        ".scanignore": "own/\n"})
    feed = spark.createDataFrame([("PyPI", "requests", "2.0", ["GPL-3.0"])], "ecosystem string, package string, version string, licenses array<string>")
    found = scan.scan(files, ("deps", "licenses"), docs(spark, ADVISORY), feed, use_default_ignores=False)
    assert sorted((f.phase, f.file) for f in found.collect()) == [
        ("deps", "examples/requirements.txt"), ("deps", "requirements.txt"), ("licenses", "requirements.txt")]


def test_version_keys(spark):
    order = ["", "0.9", "1", "1.0", "1.2", "1.10", "2.0", "2.0rc1", "10", "1" * 45]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").withColumn("k", V.version_key(F.col("v")))
    assert [r.i for r in df.orderBy("k", "i").collect()] == list(range(len(order)))


def test_licences(spark):
    feed = spark.createDataFrame([("npm", "a", "1", ["MIT"]), ("npm", "b", "1", []), ("npm", "c", "1", None),
                                  ("npm", "d", "1", ["GPL-3.0", "MIT"]), ("npm", "e", "1", ["gpl-3.0"]), ("npm", "f", "1", ["MPL-2.0"]),
                                  ("npm", "g", "1", [""])], "ecosystem string, package string, version string, licenses array<string>")
    declared = spark.createDataFrame([("r", "x", p, "1", "npm") for p in "abcdefgd"],
                                     "repo string, file string, package string, version string, ecosystem string")
    found = sorted((f.package, f.license, f.severity) for f in advisories.licence_findings(declared, feed).collect())
    assert found == [("b", "UNKNOWN", "LOW"), ("d", "GPL-3.0", "HIGH"), ("d", "GPL-3.0", "HIGH"), ("f", "MPL-2.0", "MEDIUM"), ("g", "UNKNOWN", "LOW")]


FINDINGS = "repo string, file string, package string, version string, ecosystem string, severity string, vuln_id string, fixed_version string"


def test_bump_plan(spark):
    rows = [("r", "requirements.txt", "My_Pkg", "1.0", "PyPI", "HIGH", "B", "1.9"), ("r", "requirements.txt", "my-pkg", "1.0", "PyPI", "LOW", "A", "1.10"),
            ("r", "requirements.txt", "my-pkg", "1.0", "PyPI", "LOW", "C", "1.10"), ("r", "requirements.txt", "x", "1", "PyPI", "LOW", "D", None),
            ("r", "go.mod", "y", "1", "Go", "LOW", "E", "2"), ("r", "a\\package.json", "z", "1", "npm", "LOW", "F", "2")]
    got = sorted((b.file, b.package, b.new_version, b.advisory) for b in bumps.plan(spark.createDataFrame(rows, FINDINGS)).collect())
    assert got == [("a\\package.json", "z", "2", "F"), ("requirements.txt", "my-pkg", "1.10", "A")]


def test_rewrites(spark, make_files):
    plan = bumps.plan(spark.createDataFrame([
        ("r", "requirements.txt", "my-pkg", "1.0", "PyPI", "HIGH", "A", "2.0"), ("r", "package.json", "left", "1", "npm", "LOW", "B", "3.1")], FINDINGS))
    text = "# my_pkg==1.0\n  My_Pkg[x]==1.0 ; python_version>'3' # c\n-e my-pkg\nmy-pkg @ https://x\nother==1\nmy-pkg"
    files = make_files({"requirements.txt": text, "package.json": json.dumps({"dependencies": {"left": "1", "b": "2"}, "devDependencies": {"left": "0"}})})
    out = bumps.requirements_edits(files, plan).first().content
    assert out == "# my_pkg==1.0\n  My_Pkg[x]>=2.0\n-e my-pkg\nmy-pkg @ https://x\nother==1\nmy-pkg>=2.0"
    rows = sorted((r.section, r.package, r.version) for r in bumps.package_json_edits(files, plan).collect())
    assert rows == [("dependencies", "b", "2"), ("dependencies", "left", "^3.1"), ("devDependencies", "left", "^3.1")]


def test_package_lookup(spark):
    targets = spark.createDataFrame([("requests@2.0",), ("pip:requests@2.0",), (" PyPI:requests@2.0 ",), ("npm:requests@2.0",), ("requests",),
                                     ("npm:@scope/x@1.0",)], "target string")
    found = advisories.package_lookup(targets, docs(spark, ADVISORY)).collect()
    assert {f.target.strip() for f in found} == {"requests@2.0", "pip:requests@2.0", "PyPI:requests@2.0"}
    assert found[0].detail == "bad — fixed in 2.20.0" and found[0].severity == "CRITICAL"
    specs = {r.target.strip(): r.s and tuple(r.s) for r in targets.select("target", advisories.parse_spec(F.col("target")).alias("s")).collect()}
    assert specs["npm:@scope/x@1.0"] == ("npm", "@scope/x", "1.0") and specs["requests"] is None
    odd = spark.createDataFrame([("a@b:c@1",), ("x:y",), ("maven:a:b@2",)], "target string")
    assert [r.s and tuple(r.s) for r in odd.select(advisories.parse_spec(F.col("target")).alias("s")).collect()] == [
        ("PyPI", "a@b:c", "1"), None, ("maven", "a:b", "2")]


def test_cve_search(spark):
    cves = spark.createDataFrame([(f"CVE-{i:02d}", f"OpenSSL bug {i}" + "x" * 300, None, 9.1 if i == 0 else None, 2.0) for i in range(12)],
                                 "cve_id string, description string, v31 double, v30 double, v2 double")
    words = spark.createDataFrame([(" openssl ",), ("bug 1",), ("x",), ("",), (None,), ("absent",)], "keyword string")
    found = advisories.cve_search(cves, words).where(F.col("keyword") == " openssl ").orderBy("cve_id").collect()
    assert len(found) == 12 and found[0].total == 12 and found[0].severity == "CRITICAL" and len(found[1].detail) > 300
    counts = {r.keyword: r["count"] for r in advisories.cve_search(cves, words).groupBy("keyword").count().collect()}
    assert counts == {" openssl ": 12, "bug 1": 3, "x": 12}
    assert advisories.cve_search(cves, words, cap=10).where(F.col("keyword") == "x").count() == 10


def test_package_json_keeps_everything_else(spark):
    text = """{
  "name": "left",
  "scripts": {"left": "1.0", "test": "x > {y}"},
  "dependencies" : {
    "@scope/a.b": "~1.0",
    "left"   :  "1.0",
    "lefty": "1.0"
  },
  "devDependencies": {"left": "1"}, "nested": {"left": "1.0", "dependencies": {"left": "1.0"}},
  "x": "\\"dependencies\\": {\\"left\\": \\"1.0\\"}", "list": [{"dependencies": {"left": "1.0"}}, "left", "1.0"],
  "y": {"dependencies": {"left": "1.0"}}, "dependenciesMeta": {"left": "1.0", "deep": {"left": "1"}}
}
"""
    files = spark.createDataFrame([("r", "w/package.json", text), ("r", "package.json", text)], "repo string, path string, content string")
    plan = spark.createDataFrame([("r", "w/package.json", "left", "2.0.0"), ("r", "w/package.json", "@scope/a.b", "1.5")],
                                 "repo string, file string, package string, new_version string")
    (row,) = bumps.package_json_rewrites(files, plan).collect()
    expected = text.replace('"~1.0"', '"^1.5"').replace('"left"   :  "1.0"', '"left"   :  "^2.0.0"').replace('"devDependencies": {"left": "1"}',
                                                                                                   '"devDependencies": {"left": "^2.0.0"}')
    assert row.content == expected and json.loads(row.content)["nested"] == {"left": "1.0", "dependencies": {"left": "1.0"}}
    odd = ['{"dependencies": {"left": "1.0"', '"dependencies": {"left": "1.0"}', "", "[]", '{"dependencies": {"left": {"left": "1.0"}, "left": "1.0" }}']
    files = spark.createDataFrame([("r", f"{i}/package.json", t) for i, t in enumerate(odd)] + [("r", "9/package.json", None)],
                                  "repo string, path string, content string")
    plan = spark.createDataFrame([("r", f"{i}/package.json", "left", "2.0") for i in range(10)], "repo string, file string, package string, new_version string")
    got = {r.path[0]: r.content for r in bumps.package_json_rewrites(files, plan).collect()}
    assert got["0"] == '{"dependencies": {"left": "^2.0"' and got["1"] == odd[1] and got["3"] == "[]"
    assert got["4"] == '{"dependencies": {"left": {"left": "1.0"}, "left": "^2.0" }}' and "9" not in got


def test_cve_postings_carry_no_descriptions(spark, no_broadcast):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Overflow", "in", "the", "parser", "of", "é", "xx", "aaa"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, texts_twice := "aaa parser"]
    rows = [(None if i % 20 == 19 else f"C{i % 50}", t, None, 5.0, None) for i, t in enumerate([*texts, texts_twice])]
    cves = spark.createDataFrame(rows, "cve_id string, description string, v31 double, v30 double, v2 double")
    words = ["parser of", "é", "aaaa", "aa", "THE", " overflow ", "", "zzz", "n the p"]
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    found = advisories.cve_search(cves, keywords)
    expected = collections.Counter((w, i, t) for w in words if w.strip() for i, t, *_ in rows if t and w.strip().lower() in t.lower())
    assert collections.Counter((r.keyword, r.cve_id, r.detail) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate explode(array_distinct" in line]
    assert generated and not any("description" in line.split("], ")[-1] for line in generated)


@pytest.mark.parametrize("few", [0, advisories.FEW_GRAMS])
def test_cve_postings_are_never_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(advisories, "FEW_GRAMS", few)
    numbers = spark.range(12000)
    # a table that estimates take for small; its postings are not
    cves = numbers.select(F.concat(F.lit("C"), "id").alias("cve_id"), F.sha2(F.col("id").cast("string"), 256).alias("description"),
                          F.lit(None).cast("double").alias("v31"), F.lit(5.0).alias("v30"), F.lit(None).cast("double").alias("v2"))
    texts = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(12000)]
    keywords = spark.createDataFrame([("a0b1",), ("c",), ("ffff",)], "keyword string")
    old = spark.conf.get("spark.sql.maxBroadcastTableSize", None)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "60m")
    try:
        rows = advisories.cve_search(cves, keywords).select("keyword", "cve_id", "total").collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize") if old is None else spark.conf.set("spark.sql.maxBroadcastTableSize", old)
    expected = {w: {f"C{i}" for i, t in enumerate(texts) if w in t} for w in ("a0b1", "c", "ffff")}
    assert sorted((r.keyword, r.cve_id) for r in rows) == sorted((w, i) for w, ids in expected.items() for i in ids)
    assert all(r.total == len(expected[r.keyword]) for r in rows)


def test_lines_searched_at_once_stay_apart(make_files):
    mark = '[[package]]\nname = "a\x00b"\nversion = "1"\n[[package]]\nname = "c"\nversion = "2"\n'
    assert pairs(make_files, "Cargo.lock", mark) == [("a\x00b", "1"), ("c", "2")]
    text = "a==1\r\nb==2\x0b c >= 3 \u2028#d==4\n\nhttp==5\ne\n==6\nf\x1f==7\n"
    assert pairs(make_files, "requirements.txt", text) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert pairs(make_files, "go.mod", "require (\n\ta v1.0\n\tb\n\tv2.0\n)\nrequire c\u3000v3\n") == [("a", "1.0"), ("c", "3")]
    assert pairs(make_files, "Gemfile.lock", "    a (1.0)\u3000\n    b (1\n)\n    c (2)x\n") == [("a", "1.0")]


def test_manifest_texts_are_searched_in_a_projection(spark):
    """A generator interprets its own expression, so the extraction stands in front of it; no line of a text is a row of a lambda."""
    files = spark.createDataFrame([("r", "requirements.txt", "a==1\n")], schema.FILES)
    plan = manifests.packages(files)._jdf.queryExecution().executedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate" in line]
    assert generates and not any("regexp" in line for line in generates)


def test_lines_that_separators_and_blanks_surround(spark):
    texts = [("requirements.txt", "\x1f a==1.0\x1f \u3000\r\n\u00a0b >= 2\x1f3 # x\x85c~=4\x1f;d\x0b#e==5\rgit+f==6"),
             ("go.mod", "\trequire a v1.0\x1f\nb v2\nrequire x v9 (\n c v3 // n\nrequire d v4\nrequire e v5 (\n ) \nf v6\nrequire (\n)\nrequire (\ng v7"),
             ("Gemfile.lock", "    a (1.0)\x85    b (2)\u2028    c (3)\n    d (x)")]
    rows = manifests.packages(spark.createDataFrame([("r", *t) for t in texts], schema.FILES)).collect()
    found = {name: sorted((r.package, r.version) for r in rows if r.file == name) for name, _ in texts}
    assert found == {"requirements.txt": [("a", "1.0"), ("b", "2\x1f3"), ("c", "4\x1f")],
                     "go.mod": [("a", "1.0"), ("c", "3"), ("d", "4"), ("g", "7")], "Gemfile.lock": [("a", "1.0"), ("b", "2"), ("c", "3")]}


def test_coordinates_and_targets_are_evaluated_once(spark):
    """Targets are parsed, and versions get their keys, before the joins that read them twice."""
    doc = '{"id": "A", "affected": [{"package": {"ecosystem": "PyPI", "name": "p"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]}'
    parsed = advisories.parsed(spark.createDataFrame([(doc,)], "doc string"))
    targets = spark.createDataFrame([("p@1.0",), ("p@1.0",), ("p@3.0",), (None,)], "target string")
    found = advisories.package_lookup(targets, parsed)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[^:@]" not in plan and "dense_rank" not in plan
    assert [r.title for r in found.collect()] == ["A", "A"]
