import fnmatch
import re

from pyspark.sql import functions as F

from sentrymill.fixed_values import rules
from sentrymill.functions import globs
from sentrymill.operators import classify, ignore

PATHS = ["tests/fixtures/sample.py", "a/b/tests/fixtures/x.py", "examples/demo/config.py", "examples", "static/app.min.js",
         "app.min.js", "pkg/scanner.py", "build/out.js", "build", "src/build_tool.py", "src/build/x", "myvendor/x",
         "vendor/y", "a/vendor/y", "vendor", "core/A.java", "core/x/A.java", "x.php", "x.php/y", "a+b/c(d).txt", "q?.py",
         "qa.py", "deep/a/b/c.txt", "a.b", "axb"]
PATTERNS = ["**/tests/fixtures/**", "examples/**", "**/*.min.js", "build/", "**/vendor/**", "core/*.java", "*.php",
            "a+b/c(d).txt", "q?.py", "deep/**/c.txt", "a.b", "src", "**/build", "b*/", "**", "*", "***/x", "vendor/**"]


def independent(pattern: str, path: str) -> bool:
    """The four ways written again, over fnmatch-free character matching."""
    def full(p: str, s: str) -> bool:
        if not p:
            return not s
        if p.startswith("**"):
            rest = p[3:] if p[2:3] == "/" else p[2:]
            return any(full(rest, s[i:]) for i in range(len(s) + 1))
        if p[0] == "*":
            return any(full(p[1:], s[i:]) for i in range(len(s) + 1) if "/" not in s[:i])
        return bool(s) and (p[0] == s[0] if p[0] != "?" else s[0] != "/") and full(p[1:], s[1:])

    if pattern.endswith("/"):
        base = pattern.rstrip("/")
        return path == base or path.startswith(base + "/")
    for form in {pattern, pattern[3:] if pattern.startswith("**/") else pattern}:
        if full(form, path) or ("/" not in form and any(full(form, s) for s in path.split("/"))):
            return True
        if form.endswith("/**") and (path == form[:-3] or path.startswith(form[:-2])):
            return True
    return False


def test_constant_patterns():
    for pattern in PATTERNS:
        compiled = re.compile(globs.ignore_regex([pattern]).replace(r"\z", r"\Z"))
        for path in PATHS:
            assert bool(compiled.match(path)) == independent(pattern, path), (pattern, path)


def test_column_patterns(spark):
    df = spark.createDataFrame([(p, s) for p in PATTERNS for s in PATHS], "pattern string, path string")
    regex = globs.ignore_regex_column(F.array("pattern"))
    for r in df.select("pattern", "path", F.rlike(F.col("path"), regex).alias("hit")).collect():
        assert r.hit == independent(r.pattern, r.path), (r.pattern, r.path)


def test_comments_and_blanks():
    assert globs.ignore_regex(["", "  ", "# x"]) is None
    assert globs.clean([" a\\b ", "#c"]) == ["a/b"]
    assert fnmatch.fnmatch("a", "a")


def test_repository_rules_and_defaults(spark, make_files):
    one = make_files({".scanignore": "# own\nskip/\n*.gen.py\n", "skip/a.py": "", "b.gen.py": "", "c.py": "",
                      "examples/d.py": ""}, "one")
    two = make_files({"skip/a.py": "", "examples/d.py": ""}, "two")
    files = one.unionByName(two)
    seen = {(r.repo, r.path) for r in ignore.visible(files).collect()}
    assert seen == {("one", ".scanignore"), ("one", "c.py"), ("two", "skip/a.py")}
    without = {(r.repo, r.path) for r in ignore.visible(files, use_defaults=False).collect()}
    assert ("one", "examples/d.py") in without and ("one", "skip/a.py") not in without


def test_hot_repository_without_broadcast(spark, no_broadcast):
    hot = spark.range(3000).selectExpr("'hot' AS repo", "concat('p', id, if(id % 2 = 0, '.gen.py', '.py')) AS path", "'' AS content")
    rules = spark.createDataFrame([("hot", ".scanignore", "*.gen.py"), ("cold", ".scanignore", "x")], "repo string, path string, content string")
    assert ignore.visible(hot.unionByName(rules)).where("repo = 'hot'").count() == 1501


def test_file_kinds(spark):
    expected = {
        "a.py": "code", "x/Dockerfile.js": "code", "Dockerfile": "dockerfile", "dockerfile.dev": "dockerfile",
        "x/app.DOCKERFILE": "dockerfile", "main.tf": "iac", "x.TFVARS": "iac", "compose.yaml": "iac",
        ".github/workflows/docker-compose.yml": "iac", ".github/workflows/ci.yml": "workflow",
        ".github/workflows/a/b.yaml": "workflow", "x/.github/workflows/ci.yml": None, ".github/ci.yml": None,
        ".py": None, "README.md": None, "a.PY": "code", ".GitHub/workflows/ci.yml": None,
    }
    df = spark.createDataFrame([(p,) for p in expected], "path string")
    got = {r.path: r.k for r in df.select("path", classify.file_kind(F.col("path")).alias("k")).collect()}
    assert got == expected


def test_skipped_directories(spark):
    paths = {"node_modules/x.py": True, "a/dist/x.py": True, "dist": False, "mydist/x.py": False, ".git/x": True,
             "env/x.py": False, "Build/x.py": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.s for r in df.select("path", classify.skipped_for_code(F.col("path")).alias("s")).collect()}
    assert got == paths
    dep = {r.path: r.s for r in df.select("path", classify.skipped_for_dependencies(F.col("path")).alias("s")).collect()}
    assert dep == {**paths, ".git/x": False, "env/x.py": True}


def test_contents_do_not_move_by_repository(spark, no_broadcast, make_files):
    files = make_files({".scanignore": "secret/\n*.log\n", **{f"src/f{i}.py": "x" for i in range(30)}, "secret/a": "y", "b.log": "z"})
    shown = ignore.visible(files)
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(repo" in plan
    lines = plan.split("\n")
    for line, below in zip(lines, lines[1:]):
        if "Exchange hashpartitioning(repo" in line and "_salt" not in line and "path" not in line:
            assert "partial_min" in below, below  # one rule per repository, not its files
    assert {r.path for r in shown.collect()} == {".scanignore", *(f"src/f{i}.py" for i in range(30))}


def test_byte_searches_before_expressions(spark):
    for pattern in [*PATTERNS, *rules.DEFAULT_IGNORES]:
        for path in PATHS:
            if independent(pattern, path):
                assert globs.fragment(pattern) in path
    odd = [*PATHS, None, "", "/", "env", "env/x", "a/env/x", "a/env", "environ/x", "a\\vendor\\x", "x/testdata/y", "a\nvendor/x", "a\nb/dist/c", ".git/x", "x.git/y"]
    df = spark.createDataFrame([(p,) for p in odd], "path string").select("path", F.concat("path", F.lit("")).alias("made"))
    skip = [r"(?:\A|/)(?:" + "|".join(map(re.escape, names)) + ")/" for names in (rules.CODE_SKIP_DIRS, rules.DEPENDENCY_SKIP_DIRS)]
    whole = F.replace("path", F.lit("\\"), F.lit("/")).rlike(globs.ignore_regex(rules.DEFAULT_IGNORES))
    got = df.select(ignore.built_in(F.col("made")), classify.skipped_for_code(F.col("made")), classify.skipped_for_dependencies(F.col("made"))).collect()
    assert got == df.select(whole, *[F.col("path").rlike(s) for s in skip]).collect()
