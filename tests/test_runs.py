import json

from pyspark.sql import functions as F

from sentrymill import schema
from sentrymill.operators import cases, diff, explain, exports, rollups, schedules
from sentrymill.plans import rescan, scan
from sentrymill.sources import files as file_source
from sentrymill.sources import stores
from workloads import planted

ITEM = "target string, id string, severity string, kind string, label string, ord int"


def items(spark, ids, target="t"):
    return spark.createDataFrame([(target, i, s, "code", label, n) for n, (i, s, label) in enumerate(ids)], ITEM)


def findings(spark, rows):
    """rows of dicts over the findings schema"""
    ddl = ", ".join(f"`{c}` {t}" for c, t in schema.FINDING_COLUMNS.items())
    return spark.createDataFrame([tuple(r.get(c) for c in schema.FINDING_COLUMNS) for r in rows], ddl)


def test_diff(spark):
    previous = items(spark, [("a", "HIGH", "A"), ("b", "LOW", "B")])
    current = items(spark, [("b", "LOW", "B"), ("c", "CRITICAL", "C"), ("c", "LOW", "last wins")])
    got = {r.id: (r.state, r.label) for r in diff.run_diff(previous, current).collect()}
    assert got == {"a": ("fixed", "A"), "b": ("unchanged", "B"), "c": ("new", "last wins")}
    bare = diff.bare_ids(spark.createDataFrame([("t", "c")], "target string, id string"))
    assert {r.id: r.state for r in diff.run_diff(bare, current).collect()} == {"b": "new", "c": "unchanged"}


def test_fingerprints(spark):
    import hashlib
    rows = [dict(target="t", phase="secrets", issue_type="K", file="a", line_no=1, severity="HIGH"),
            dict(target="t", phase="deps", package="p", version="1", vuln_id="V", severity="LOW"),
            dict(target="t", phase="git_history", issue_type="K", file="a", line_no=9, severity="HIGH"),
            dict(target="t", phase="licenses", package="p", version="1", license="GPL-3.0", severity="HIGH")]
    got = {r.kind: (r.id, r.label) for r in diff.fingerprints(findings(spark, rows)).collect()}

    def fp(text):
        return hashlib.sha1(text.encode()).hexdigest()[:12]

    assert got == {"secret": (fp("secret|K|a|1"), "K @ a:1"), "dependency": (fp("dep|p|1|V"), "p@1 (V)"),
                   "git_history": (fp("git|K|a"), "K (a)"), "license": (fp("license|p|1|GPL-3.0"), "p@1: GPL-3.0")}


def test_filter_counts_and_gate(spark):
    rows = [dict(target="t", phase="secrets", severity="CRITICAL"), dict(target="t", phase="code", severity="HIGH"),
            dict(target="t", phase="code", severity="LOW"), dict(target="t", phase="licenses", severity="LOW"),
            dict(target="u", phase="code", severity="MEDIUM")]
    df = findings(spark, rows)
    assert rollups.only_severities(df, ["critical", "High"]).count() == 2
    t = rollups.severity_counts(df).where("target = 't'").first()
    assert (t.critical, t.high, t.medium, t.low, t.total) == (1, 1, 0, 2, 3)
    high = {r.target: (r.failed, r.summary) for r in rollups.gate(df, "HIGH").collect()}
    assert high == {"t": (True, "1 CRITICAL, 1 HIGH"), "u": (False, "")}
    assert {r.failed for r in rollups.gate(df, "never").collect()} == {False}
    assert {r.failed for r in rollups.gate(df, "any").collect()} == {True}
    shares = {(r.target, r.severity): r.share for r in exports.severity_shares(df).collect()}
    assert shares[("t", "LOW")] == 50.0 and shares[("u", "LOW")] == 0.0


def test_schedules(spark):
    df = spark.createDataFrame([(1, True, "2024-01-01 00:00:00", "hourly"), (2, True, "2024-01-02 00:00:00", "weekly"), (3, False, "2023-01-01", "daily"),
                                (4, True, "soon", "daily"), (5, True, None, "x"), (6, True, "2023-06-01T00:00:00+00:00", "x")],
                               "id int, active boolean, next_run string, interval string")
    now = F.lit("2024-01-02").cast("timestamp")
    assert {r.id for r in schedules.due(df, now).collect()} == {1, 2, 6}
    moved = {r.id: str(r.next_run) for r in schedules.advanced(schedules.due(df, now), now).withColumn(
        "next_run", F.col("next_run").cast("string")).collect()}
    assert moved == {1: "2024-01-02 01:00:00", 2: "2024-01-09 00:00:00", 6: "2024-01-03 00:00:00"}


def test_validation_order(spark):
    df = spark.createDataFrame([("repo", "https://github.com/a/b", "daily", "pro"), ("repo", "http://github.com/a/b", "daily", "pro"), ("repo", "x", "never", "free"),
                                ("x", "", "never", "pro"), ("check:dns", " ", "daily", "pro"), ("check:zzz", "a", "daily", "pro"), ("zzz", "", "daily", "pro")],
                               "kind string, target string, interval string, plan string")
    assert [r.reason for r in schedules.validated(df, F.col("plan")).collect()] == [
        None, "repository", "plan", "interval", "target", "check", "kind"]


def test_plans_and_quota(spark):
    users = spark.createDataFrame([(1, "pro", None), (2, "pro", "2024-01-15"), (3, "pro", "2024-01-14"), (4, "free", None)], "id bigint, plan string, pro_until string")
    users = users.withColumn("pro_until", F.col("pro_until").cast("date"))
    runs = spark.createDataFrame([(3, "2024-01-01 00:00:00")] * 25 + [(4, "2024-01-31 23:59:59"), (4, "2024-02-01 00:00:00"), (4, "2023-12-31 23:59:59")],
                                 "user_id bigint, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.id: (r.plan, r.used, r.remaining) for r in rollups.monthly_quota(users, runs, F.lit("2024-01-15").cast("date")).collect()}
    assert got == {1: ("pro", 0, None), 2: ("pro", 0, None), 3: ("free", 25, 0), 4: ("free", 1, 19)}
    assert rollups.downgraded(users.withColumn("plan", F.lit("free"))).where("pro_until is not null").count() == 0


def test_cases(spark):
    df = spark.createDataFrame([("c1", "r1", "o", "u", "pending", "2024-01-01"), ("c2", "r2", "o", "u", "pending", "2024-01-02"), ("c3", "r3", "o", "u", "pending", "2024-01-03")],
                               "id string, repo string, owner string, repo_url string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    found = spark.createDataFrame([("r1", "Code", "x", "high", "xss", "f", 1), ("r1", "Secret", "y", None, None, "f", 2), ("r2", "Code", "x", "HIGH", "XSS", "f", 1), ("r2", "Code", "z", "HIGH", "odd", "f", 3)],
                                  "repo string, kind string, type string, severity string, category string, file string, line int")
    ranked = cases.annotated(df, found).collect()
    assert [(c.repo, c.worst, c.finding_count) for c in ranked] == [("r2", "HIGH", 2), ("r1", "HIGH", 2), ("r3", "LOW", 0)]
    guide = [(g.repo, g.position, g.category, "security weakness" in g.impact) for g in cases.guidance(found, ["file", "line"]).orderBy("repo", "position").collect()]
    assert guide == [("r1", 1, "xss", False), ("r1", 2, "secret", True), ("r2", 1, "xss", False), ("r2", 2, "odd", True)]
    events = spark.createDataFrame([("c1", "approved", 1), ("c1", "bogus", 2), ("c2", "approved", 1), ("c2", "dismissed", 3), ("zz", "approved", 1)], "id string, status string, ts int")
    events = events.withColumn("ts", F.timestamp_seconds("ts"))
    assert {r.id: r.status for r in cases.with_status(df, events).collect()} == {"c1": "approved", "c2": "dismissed", "c3": "pending"}


def test_until_n(spark):
    repos = spark.createDataFrame([(f"r{i}", i) for i in range(6)], "repo string, arrival int")
    found = spark.createDataFrame([("r1", "HIGH")] * 4 + [("r2", "LOW")] * 9 + [("r3", "HIGH")] * 7 + [("r4", "HIGH")], "repo string, severity string")
    got = [(r.repo, r.found) for r in cases.until_n(repos, found, ["high"], 10).orderBy("arrival").collect()]
    assert got == [("r0", 0), ("r1", 4), ("r2", 0), ("r3", 7)]  # the last may overshoot, then it stops
    assert cases.until_n(repos, found, [], 1000, max_repos=2).count() == 2


def test_prompts(spark):
    rows = [dict(phase="secrets", issue_type="AWS Access Key ID", category="cloud", severity="CRITICAL", file="a.py", line_no=1, context='key = "AKIA****"'),
            dict(phase="code", issue_type="Pickle deserialization", category="deser", severity="critical", file="b.py", line_no=2, context="pickle.loads(blob)", description="RCE")]
    texts = [r.prompt for r in explain.prompts(findings(spark, rows), "m").orderBy("file").collect()]
    assert "AKIA****" in texts[0] and "Hardcoded secret of type 'AWS Access Key ID' detected (value masked)." in texts[0]
    assert texts[1] == ("Issue: Pickle deserialization\nCategory: deser\nSeverity: CRITICAL\nFile: b.py:2\nCode: pickle.loads(blob)\nDescription: RCE")


def test_explain_hook(spark):
    rows = [dict(phase="code", issue_type=f"I{i % 3}", severity="LOW", file="a", line_no=1, context="c", description="d") for i in range(9)]
    prompted = explain.prompts(findings(spark, rows), "m")
    cache = prompted.where("issue_type = 'I0'").select("key", F.lit("known").alias("text")).distinct()
    todo = explain.uncached(prompted, cache)
    assert todo.count() == 2

    def generate(prompt):
        if "I1" in prompt:
            raise RuntimeError("down")
        return " Quick fix: y "

    answers = explain.generated(todo, generate).collect()
    assert [r.text for r in answers if r.text] == ["Quick fix: y"] and all((r.text is None) != (r.error is None) for r in answers)


def test_bills_of_materials(spark, tmp_path):
    from sentrymill.operators import manifests
    rows = [("r", "requirements.txt", n, "1.0", "PyPI") for n in ('b"q', "A", "c")] + [("s", "go.mod", "x", "2", "Go")]
    declared = spark.createDataFrame(rows, "repo string, file string, package string, version string, ecosystem string")
    ordered = manifests.ordered_components(declared)

    def document(pieces, repo):
        return json.loads("".join(r.text for r in pieces.where(F.col("repo") == repo).orderBy("part", "position").collect()))

    cdx = document(exports.sbom(ordered, "CycloneDX", "T"), "r")
    assert cdx["bomFormat"] == "CycloneDX" and [c["name"] for c in cdx["components"]] == ["A", 'b"q', "c"]
    assert all(c["purl"].startswith("pkg:pypi/") for c in cdx["components"])
    spdx = document(exports.sbom(ordered, "spdx", "T"), "r")
    assert spdx["spdxVersion"] == "SPDX-2.3" and [p["SPDXID"] for p in spdx["packages"]] == [
        "SPDXRef-RootPackage", "SPDXRef-Package-0", "SPDXRef-Package-1", "SPDXRef-Package-2"]
    assert [r["relatedSpdxElement"][-1] for r in spdx["relationships"]] == ["0", "1", "2"]
    try:
        exports.sbom(ordered, "xml", "T")
        raise AssertionError("accepted")
    except ValueError:
        pass
    exports.write_pieces(exports.sbom(ordered, "spdx", "T"), str(tmp_path / "out"), ["part", "position"])
    parts = sorted((tmp_path / "out" / "repo=r").glob("part-*"))
    assert json.loads("".join(p.read_text() for p in parts).replace("\n", "")) == spdx


def test_change_payload_is_bounded_and_whole(spark):
    ids = [(f"{i:04d}", ["HIGH", "CRITICAL", "?"][i % 3], "") for i in range(1000)]
    changes = diff.run_diff(items(spark, [(f"f{i:02d}", "LOW", f"L{i}") for i in range(30)]), items(spark, ids))
    got = exports.change_payload(changes, text_chars=2900, fixed_shown=10).first()
    lines = ["*Target:* `t`", ":warning: *1000 new*   :white_check_mark: *30 fixed*   (0 unchanged)"]
    for i, s, label in sorted(ids, key=lambda x: (x[1], x[0])):
        lines.append(f"  • _new_ {exports.EMOJI.get(s, '')} *{s}* — {label}")
    assert got.detail == "\n".join(lines)[:2900] and got.text == "sentrymill: 1000 new / 30 fixed on t"
    same = diff.run_diff(items(spark, ids[:2]), items(spark, ids[:2]))
    assert exports.change_payload(same, text_chars=2900, fixed_shown=10).count() == 0
    few = diff.run_diff(items(spark, [(f"f{i:02d}", "LOW", f"L{i}") for i in range(30)]), items(spark, ids[:1]))
    assert exports.change_payload(few, text_chars=2900, fixed_shown=10).first().detail.count("_fixed_") == 10


def test_sources_and_demo_tree(spark, tmp_path):
    demo = {"requirements.txt": "flask==0.12.2\nrequests==2.19.1\n", "config.py": f'KEY = "{planted.AWS}"\n',
            "static/app.js": 'el.innerHTML = data;\ndocument.write(msg);\n', "database.py": 'cursor.execute("SELECT " + x)\nhashlib.md5(p)\n',
            "server.py": 'subprocess.run("ping " + h, shell=True)\nos.system(c)\nreturn str(eval(e))\n', "bad.py": b"eval(\xff)\n", "big.py": "eval(x)\n" * 999}
    for path, content in demo.items():
        target = tmp_path / "trees" / "demo" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
    left_out = file_source.oversized(spark, str(tmp_path / "trees"), 5000)
    files = file_source.read_trees(spark, str(tmp_path / "trees"), max_bytes=5000)
    assert left_out.count() + files.count() == file_source.read_trees(spark, str(tmp_path / "trees")).count()
    assert {(r.repo, r.path) for r in files.collect()} == {("demo", p) for p in demo if p != "big.py"}
    assert {r.path: r.valid_utf8 for r in files.collect()}["bad.py"] is False
    found = scan.scan(files, ("secrets", "code")).collect()
    assert {f.category for f in found} >= {"cloud", "xss", "sqli", "crypto", "cmdi"}
    assert not [f for f in found if planted.AWS in (f.context or "")]


def test_rescan_against_the_store(spark, tmp_path, make_files):
    store = str(tmp_path / "store")

    def run(run_id, text, when):
        found = scan.scan(make_files({"a.py": text}, "repo-1"), ("code",))
        targets = spark.createDataFrame([("repo-1", run_id)], "target string, run_id bigint")
        summary, notes = rescan.rescan(spark, targets, found, store, 7, F.lit(when).cast("timestamp"))
        return summary.first(), notes.collect()

    first, notes = run(1, "eval(x)\n", "2024-01-01")
    assert (first.total, first.new, first.baseline_existed, notes) == (1, 1, False, [])
    second, notes = run(2, "eval(x)\nos.system(y)\n", "2024-01-02")
    assert (second.new, second.fixed, second.unchanged, second.baseline_existed) == (1, 0, 1, True) and len(notes) == 1
    third, notes = run(3, "ok = 1\n", "2024-01-03")
    assert (third.total, third.new, third.fixed, third.baseline_existed) == (0, 0, 2, True)
    fourth, _ = run(4, "eval(x)\n", "2024-01-04")
    assert (fourth.new, fourth.fixed) == (1, 0)  # an empty run is a baseline too
    assert stores.read(spark, f"{store}/runs", stores.RUNS).count() == 4


def test_case_store(spark, tmp_path):
    path, events = str(tmp_path / "cases"), str(tmp_path / "events")
    rows = spark.createDataFrame([("org/a", "o", None), ("org/a", "o", None), ("org/b", "o", "https://x")], "repo string, owner string, repo_url string")
    assert stores.add_cases(rows, path).count() == 2
    assert stores.add_cases(rows.unionByName(rows.withColumn("repo", F.lit("org/c"))), path).count() == 3
    first = stores.read(spark, path, stores.CASES).where("repo = 'org/a'").first()
    assert first.repo_url == "https://github.com/org/a" and first.status == "pending"
    stores.set_status(spark.createDataFrame([(first.id, "approved"), (first.id, "nonsense")], "id string, status string").withColumn("ts", F.current_timestamp()), events)
    assert {r.repo: r.status for r in stores.current_cases(spark, path, events).collect()} == {"org/a": "approved", "org/b": "pending", "org/c": "pending"}


def test_findings_json(spark):
    rows = [dict(target="t", phase="deps", package="p", version="1", severity="LOW", vuln_id="V", fixed_version=None)]
    got = json.loads(exports.findings_json(findings(spark, rows)).first().json)
    assert got["fixed_version"] is None and got["package"] == "p"
    errors = spark.createDataFrame([("t", ["no .git"])], "target string, errors array<string>")
    assert json.loads(exports.scan_summary_json(findings(spark, rows), errors).first().json)["errors"] == ["no .git"]


def test_change_pieces_are_the_whole_message(spark):
    rows = [("t", f"i{k:03d}", ["HIGH", "LOW", None][k % 3], "x", None if k % 5 == 0 else f"label {k}", ["new", "fixed", "unchanged"][k % 7 % 3]) for k in range(90)]
    rows += [("quiet", "a", "LOW", "x", "same", "unchanged")]
    changes = spark.createDataFrame(rows, "target string, id string, severity string, kind string, label string, state string")
    pieces = exports.change_pieces(changes).orderBy("target", "part", "order", "id").collect()
    whole = exports.change_payload(changes).collect()
    assert [r.target for r in whole] == ["t"] and {r.target for r in pieces} == {"t"}
    assert "\n".join(r.text for r in pieces) == whole[0].detail
    text = exports.change_pieces(changes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and "collect_list" not in text
    assert exports.change_pieces(changes.where("false")).count() == 0
