"""What is stored, what is sent to the driver, and how often inputs are read."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from sentrymill.operators import advisories, manifests
from sentrymill.session import durable, numbered
from workloads import views
from workloads.queries import QUERIES

DOC = ('{{"id": "A-{0}", "summary": "flaw {0}", "affected": [{{"package": {{"ecosystem": "PyPI", "name": "p{0}"}}, '
       '"versions": ["9.9"], "ranges": [{{"type": "ECOSYSTEM", "events": [{{"introduced": "1"}}, {{"fixed": "3"}}]}}]}}]}}')
PACKAGES = "repo string, file string, package string, version string, ecosystem string"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([(DOC.format(n),) for n in range(40)], "doc string")


@pytest.fixture
def declared(spark):
    rows = [(f"r{n % 3}", f"f{n}", f"P{n % 100}", f"{v}.0", "PyPI") for n in range(200) for v in (1, 3)]
    return spark.createDataFrame(rows + [("r", "f", "p7", "9.9", "PyPI"), ("r", "f", "p8", "2", "npm"), ("r", "f", None, "2", "PyPI"),
                                         ("r", "f", "p9", "2", None), ("r", "f", "p9", None, "PyPI")], PACKAGES)


def found_pairs(df) -> list:
    return sorted((r.file, r.package, r.version, r.vuln_id) for r in df.collect())


def expected() -> list:
    return sorted([(f"f{n}", f"P{n % 100}", "1.0", f"A-{n % 100}") for n in range(200) if n % 100 < 40] + [("f", "p7", "9.9", "A-7")])


def test_stored_rows_come_back(spark):
    df = spark.sql("""SELECT id, if(id % 2 = 0, null, struct(id AS a, 'x' AS b)) AS s, array(id, null) AS a, timestamp'1001-01-01 00:00:00' AS t,
                      map('k', cast(null AS string)) AS m, cast(id AS decimal(38, 10)) AS d, '' AS e FROM range(50)""")
    kept = durable(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    as_text = [F.to_json(F.struct("*")).alias("j")]
    assert sorted(r.j for r in kept.select(*as_text).collect()) == sorted(r.j for r in df.select(*as_text).collect())
    assert kept.inputFiles() and durable(df.where("id < 0")).count() == 0
    untyped = durable(df.select("id", F.lit(None).alias("nothing")))
    assert untyped.where("nothing IS NULL").count() == 50


def test_stored_columns_are_small(spark):
    wide = spark.range(20000).selectExpr("concat('repository-', id % 50) AS repo", "repeat(concat('path/', id % 100), 5) AS file", "id")
    assert "id" not in physical(durable(wide).select("repo")).split("ReadSchema")[1]


def test_no_advisory_is_broadcast(spark, documents, declared):
    """Every table here is small, so all of them would be taken for small by a plan's estimate."""
    parsed = advisories.parsed(documents)
    for found in (advisories.dependency_findings(declared, parsed), advisories.matched(declared, parsed)):
        assert "Broadcast" not in physical(found)
    targets = spark.createDataFrame([("p1@1.0",), ("pip:p2@2",)], "target string")
    assert "Broadcast" not in physical(advisories.package_lookup(targets, parsed))


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 26])
def test_matches_do_not_depend_on_the_bits(documents, declared, monkeypatch, bits):
    monkeypatch.setattr(advisories, "NAME_BITS", bits)
    assert found_pairs(advisories.dependency_findings(declared, advisories.parsed(documents))) == expected()


def test_bits_keep_all_members_and_few_others(spark):
    rows = spark.range(20000).selectExpr("cast(id AS string) AS k", "id")
    others = spark.range(0, 20000, 10).selectExpr("cast(id AS string) AS k")
    kept = advisories.maybe_among(rows, others, ["k"])
    assert kept.columns == rows.columns
    assert kept.where("id % 10 = 0").count() == 2000 and kept.count() < 2100
    assert advisories.maybe_among(rows, others.where("k = ''"), ["k"]).count() == 0


def test_cards_read_the_targets_once(spark):
    sf = "/root/testdata/sf0.001"
    text = physical(QUERIES["target_verdicts"](spark, sf))
    assert "customer.parquet" not in text  # only the targets come from customers


def test_numbers_by_a_broadcast_table(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('G', id % 40)) AS g", "concat('A', (id * 7919) % 3001) AS o", "id")
    order = [F.lower("o"), F.col("id")]
    want = df.withColumn("at", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long") - 1)
    for few in (10, 1_000_000):
        got = numbered(df, ["g"], [F.lower("o"), "id"], "at", few)
        assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_components_are_stored_without_what_follows_from_them(spark, declared, no_broadcast):
    ordered = manifests.ordered_components(declared.dropna())
    assert ordered.columns == ["repo", "ecosystem", "name", "version", "file", "purl", "position"]
    text = physical(ordered)
    assert "purl" not in text.split("ReadSchema")[1] and "_name" not in text
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    first = ordered.where("repo = 'r0' AND position = 0").first()
    assert (first.name, first.version, first.purl) == ("P0", "1.0", "pkg:pypi/P0@1.0")


def test_parts_are_dealt_out(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    for made in (views.advisory_documents(spark, sf), views.cves(spark, sf)):
        assert "hashpartitioning(p_partkey" in physical(made) and made.count() == n

