import pytest
from pyspark.sql import functions as F

from sentrymill.operators import secrets
from sentrymill.plans import scan
from workloads import planted


def test_masking(make_files):
    found = secrets.secret_findings(make_files({"a.py": f'k = "{planted.AWS}"\nj = ["{planted.AWS}", "{planted.AWS2}"]\n'})).collect()
    aws = [f for f in found if f.secret_type == "AWS Access Key ID"]
    assert sorted(f.line_no for f in aws) == [1, 2, 2]
    assert {f.matched_value for f in aws} == {"AK" + "IA****"}
    for f in found:
        assert planted.AWS not in f.masked_context and planted.AWS2 not in f.masked_context


def test_every_planted_value_is_masked(make_files):
    text = "\n".join(planted.CODE + planted.DOCKER + planted.IAC + planted.WORKFLOW)
    found = secrets.secret_findings(make_files({"a.py": text})).collect()
    shown = "\n".join(f"{f.matched_value} {f.masked_context}" for f in found)
    assert found and not [v for v in planted.RAW_VALUES if v in shown]


def test_scopes_and_allow_words(make_files):
    tree = {"a.py": f'k = "{planted.AWS}"  # nosec\nk = "{planted.AWS}"  # nosec code\nk = "{planted.AWS}"  # nosec secret\n'}
    assert {f.line_no for f in secrets.secret_findings(make_files(tree)).collect()} == {2}
    example = "AK" + "IAIOSFODNN7EXAMPLE"
    assert secrets.secret_findings(make_files({"a.py": f'K = "{example}"\n'})).count() == 1
    assert secrets.secret_findings(make_files({"a.py": f'K = "{example}"\n'}), allow_words=["example"]).count() == 0


def test_default_ignores(make_files):
    tree = {"examples/config.py": f'K = "{planted.AWS}"\n', "app.py": f'K = "{planted.AWS}"\n'}
    assert {f.file for f in scan.scan(make_files(tree), ("secrets",)).collect()} == {"app.py"}
    assert scan.scan(make_files(tree), ("secrets",), use_default_ignores=False).count() == 2


def test_history(spark, make_files):
    versions = spark.createDataFrame([
        ("r", 1, "conf.py", f'key = "{planted.AWS}"\n'), ("r", 2, "conf.py", f'key = "{planted.AWS2}"\n'),
        ("r", 3, "conf.py", "key = load()\n")], "repo string, commit bigint, path string, content string")
    now = make_files({"conf.py": f'key = "{planted.AWS2}"\n'})
    gone = secrets.history_findings(versions, now).collect()
    assert [(f.commit, f.secret_type) for f in gone] == [(1, "AWS Access Key ID")]  # equal masks, different values
    assert secrets.history_findings(versions.limit(0), now).count() == 0


def test_code_context_is_masked(make_files):
    found = scan.scan(make_files({"main.tf": f'password = "{planted.PASSWORD}"\n'}), ("code",)).collect()
    assert len(found) == 1 and planted.PASSWORD not in found[0].context and "Hunt****" in found[0].context


@pytest.mark.parametrize("line, kind", [
    (planted.GITHUB, "GitHub Token"), (planted.STRIPE, "Stripe Live Secret Key"), (planted.PG, "Database Connection String"),
    (planted.SLACK, "Slack Token"), (planted.NPM, "npm Access Token"), (planted.JWT, "JSON Web Token"),
    ("-----BEGIN " + "PRIVATE KEY-----", "Private Key Block")])
def test_families(make_files, line, kind):
    assert kind in {f.secret_type for f in secrets.secret_findings(make_files({"a.txt": f"x {line} y"})).collect()}


def test_mask_lines_keeps_other_lines(spark):
    df = spark.createDataFrame([("nothing here",), (None,)], "t string")
    assert [r.t for r in secrets.mask_lines(df, "t").orderBy(F.col("t").isNull()).collect()] == ["nothing here", None]


def test_guards_lose_nothing(spark):
    from sentrymill.fixed_values.secrets import SECRET_RULES
    from sentrymill.functions.text import regex
    texts = [t for ls in (planted.CODE, planted.DOCKER, planted.IAC, planted.WORKFLOW) for l in ls for t in l.split("\n")]
    texts += [t.upper() for t in texts] + [t.lower() for t in texts] + ["PASSWD: 'abcdefgh1'", "pwd='abcdefgh1'", "ToKEN = 'abcdefghijklmnopqrstu'"]
    df = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("low", F.lower("line"))
    lost = [(~F.expr(secrets._candidate(r)) & F.col("line").rlike(regex(r[3]))).alias(f"c{i}") for i, r in enumerate(SECRET_RULES)]
    for row in df.select(*lost).distinct().collect():
        assert not any(row), [SECRET_RULES[i][0] for i, bad in enumerate(row) if bad]
