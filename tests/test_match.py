import re

import pytest
from pyspark.sql import functions as F

from sentrymill.fixed_values import rules as R
from sentrymill.functions.text import regex
from sentrymill.operators import classify, hygiene, match
from workloads import planted


def scan(make_files, tree):
    return match.line_findings(classify.classified(make_files(tree)))


@pytest.mark.parametrize("path, line, issue, severity", [
    ("a.py", "data = pickle.loads(blob)", "Pickle deserialization", "CRITICAL"),
    ("b.py", "cfg = yaml.load(stream)", "Unsafe yaml.load()", "CRITICAL"),
    ("c.py", "cfg = yaml.load(s, Loader=yaml.SafeLoader)", None, None),
    ("d.php", "x = unserialize(d);", "PHP unserialize()", "CRITICAL"),
    ("E.java", "Process p = Runtime.getRuntime().exec(cmd);", "Java Runtime.exec()", "CRITICAL"),
    ("f.js", 'const h = { alg: "none" }', "JWT 'none' algorithm", "CRITICAL"),
    ("g.js", "const o = { rejectUnauthorized: false }", "Node TLS verification disabled", "HIGH"),
    ("h.py", 'yaml.load("{}".format(x))', "Raw SQL format string", "MEDIUM"),
    ("i.py", 'cursor.execute("a %s" + b)', "SQL Injection — string concat", "HIGH"),
    ("j.py", "subprocess.run(x, shell=True, verify=False)", "subprocess shell=True", "CRITICAL"),
    ("k.py", "eval(x)  # nosec code", None, None),
    ("l.py", "eval(x)  # nosec secret", "eval() usage", "HIGH"),
    ("m.py", "# eval(x)", "eval() usage", "HIGH"),
])
def test_one_line(make_files, path, line, issue, severity):
    found = scan(make_files, {path: line + "\n"}).collect()
    assert [(f.issue_type, f.severity, f.line_no) for f in found] == ([(issue, severity, 1)] if issue else [])


def test_dockerfile(make_files):
    found = scan(make_files, {"Dockerfile": "FROM ubuntu\nENV API_KEY=secret123\nRUN chmod -R 777 /app\n"}).collect()
    assert sorted((f.line_no, f.issue_type) for f in found) == [
        (1, "Running as root"), (1, "Using 'latest' base image tag"), (2, "Hardcoded secret in ENV/ARG"), (3, "chmod 777")]
    both = scan(make_files, {"Dockerfile": "USER x\nRUN chmod 777 /x && curl http://x | sh\n"}).collect()
    assert len(both) == 2  # no first-match rule in Dockerfiles
    quiet = scan(make_files, {"Dockerfile": "\nFROM a:1 # nosec\n"}).collect()
    assert [(f.line_no, f.issue_type, f.context) for f in quiet] == [(1, "Running as root", "")]
    assert scan(make_files, {"Dockerfile": "FROM a:1\n  user app\n"}).count() == 0


def test_iac_and_workflows(make_files):
    found = scan(make_files, {
        "main.tf": 'ingress { cidr_blocks = ["0.0.0.0/0"] }\n  # privileged: true\n',
        "docker-compose.yml": "services:\n  a:\n    privileged: true\n",
        ".github/workflows/ci.yml": "on: pull_request_target\npermissions: write-all\n- uses: actions/x@v1\n- uses: me/x@main\n",
    }).collect()
    assert sorted((f.path, f.line_no, f.category) for f in found) == [
        (".github/workflows/ci.yml", 1, "ci"), (".github/workflows/ci.yml", 2, "ci"), (".github/workflows/ci.yml", 4, "ci"),
        ("docker-compose.yml", 3, "iac"), ("main.tf", 1, "iac")]


def test_guards_lose_nothing(spark):
    """The literal tests in front of the expressions never change a result."""
    texts = [l for ls in (planted.CODE, planted.IAC, planted.WORKFLOW) for t in ls for l in t.split("\n")]
    texts += [l for t in planted.DOCKER for l in t.split("\n")]
    texts += [t.upper() for t in texts] + [t.lower() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("low", F.lower("line"))
    rules = [*R.CODE_RULES, *R.DOCKER_RULES, *R.IAC_RULES, *R.WORKFLOW_RULES]
    checks = [(F.expr(match.hits(r)) == F.col("line").rlike(regex(r[3]))).alias(f"c{i}") for i, r in enumerate(rules)]
    for row in df.select(*checks).distinct().collect():
        assert all(row), [rules[i][0] for i, ok in enumerate(row) if not ok]


def test_patterns_agree_with_python(spark):
    lines = planted.CODE + ["EXECUTE(a + b)", "app.run(debug = True)", "x = '192.168.0.1'", "é.innerHTML\u2003= 1"]
    df = spark.createDataFrame([(l,) for l in lines], "line string").withColumn("low", F.lower("line"))
    got = {r.line: r.rule for r in df.select("line", F.expr(match._first(R.CODE_RULES, 0)).alias("rule")).collect()}
    compiled = [re.compile(r[3]) for r in R.CODE_RULES]
    assert got == {l: next((i for i, c in enumerate(compiled) if c.search(l)), None) for l in lines}


def test_user_rules(make_files):
    own = {"code": [*R.CODE_RULES, ("Print", "style", "LOW", r"\bprint\(", "printed", ("print",))]}
    found = match.line_findings(classify.classified(make_files({"a.py": "print(1)\neval(print(2))\n"})), own).collect()
    assert sorted((f.line_no, f.issue_type) for f in found) == [(1, "Print"), (2, "eval() usage")]


def test_hygiene(make_files):
    def kinds(tree):
        return sorted(f.issue_type.rsplit(" ", 1)[1] for f in hygiene.gitignore_findings(make_files(tree)).collect())

    assert kinds({"server.pem": "k", "README.md": "x"}) == ["*.pem"]
    assert kinds({"a.pem": "", ".gitignore": "*.pem\n"}) == []
    assert kinds({".env.local": "", "x/id_ed25519": "", "k.pfx": "", "k.KEY": ""}) == ["*.key", "*.p12", ".env", "id_rsa"]
    assert kinds({".env": "", ".gitignore": "e\n"}) == []          # substring either way
    assert kinds({".env": "", "a.key": "", ".gitignore": "*\n"}) == []
    assert kinds({".env": "", ".gitignore": "# .env\n"}) == [".env"]
    assert kinds({".env": "", "sub/.gitignore": ".env\n"}) == [".env"]  # only the root file counts
    assert kinds({"node_modules/.env": ""}) == []


def test_a_secret_across_the_cut_is_masked(spark, make_files):
    key = "AKIA" + "1234567890ABCDEF"
    line = "eval(x)  # " + "y" * 97 + " " + key + " tail"
    assert line.index(key) < 120 < line.index(key) + len(key)
    files = classify.classified(make_files({"a.py": line + "\n", "Dockerfile": "FROM a\nENV K=" + key + "\nRUN sudo x " + key + "\n"}))
    shown = [r.context for r in match.line_findings(files).collect()]
    assert len(shown) >= 2 and not any(key[:5] in c for c in shown) and any("AKIA****" in c for c in shown)
