from pyspark.sql import functions as F

from sentrymill.operators import classify, match
from sentrymill.streaming import jobs
from workloads import planted

FILES = "repo string, path string, content string"
RUNS = "id bigint, kind string, created_at timestamp, total int"


def write(df, path, name):
    df.coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream(spark, path, schema, per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").parquet(path)


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def collect(spark, df, name, mode="append"):
    drain(df.writeStream.outputMode(mode).format("memory").queryName(name).start())
    return spark.table(name)


def test_incremental_scan_equals_batch(spark, tmp_path):
    rows = [("r", f"f{i}.py", line + "\n") for i, line in enumerate(planted.CODE)] + [("r", "examples/x.py", "eval(x)"), ("r", "own/x.py", "eval(x)")]
    rules = spark.createDataFrame([("r", r"\A(?:own/.*)\z")], "repo string, rule_regex string")
    for i in range(3):
        write(spark.createDataFrame(rows[i::3], FILES), tmp_path, f"b{i}")
    found = collect(spark, jobs.scan_files(stream(spark, str(tmp_path), FILES), rules), "scan_out")
    kept = spark.createDataFrame([r for r in rows if not r[1].startswith(("examples/", "own/"))], FILES)
    batch = match.line_findings(classify.classified(kept))
    columns = ["path", "line_no", "issue_type"]
    assert found.where("phase = 'code'").select(columns).exceptAll(batch.select(columns)).count() == 0
    assert found.where("phase = 'code'").count() == batch.count()
    assert found.where("phase = 'secrets'").count() > 0
    assert not [v for v in planted.RAW_VALUES for r in found.collect() if v in r.context]


def test_deduplication(spark, tmp_path):
    schema = "target string, id string, ts timestamp"
    for i, rows in enumerate([[("t", "a", 0), ("t", "a", 1), ("u", "a", 2)], [("t", "a", 30), ("t", "b", 31)], [("t", "b", 40)]]):
        df = spark.createDataFrame(rows, "target string, id string, s int").select("target", "id", F.timestamp_seconds("s").alias("ts"))
        write(df, tmp_path, f"b{i}")
    got = collect(spark, jobs.deduplicated(stream(spark, str(tmp_path), schema), "ts", "1 hour"), "dedupe_out")
    assert sorted((r.target, r.id) for r in got.collect()) == [("t", "a"), ("t", "b"), ("u", "a")]


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    def rows(values):
        return spark.createDataFrame(values, "id bigint, kind string, t string, total int").select(
            "id", "kind", F.col("t").cast("timestamp").alias("created_at"), "total")

    write(rows([(1, "repo", "2024-01-01 10:00:00", 2), (2, "repo", "2024-01-01 11:00:00", 3)]), tmp_path, "b0")
    write(rows([(3, "repo", "2024-01-03 10:00:00", 1)]), tmp_path, "b1")
    write(rows([(7, "repo", "2024-01-04 10:00:00", 1)]), tmp_path, "b1b")  # lateness is judged by the batch before
    write(rows([(4, "repo", "2024-01-01 12:00:00", 9), (5, "repo", "2024-01-09 00:00:00", 0)]), tmp_path, "b2")  # 4 is late
    write(rows([(6, "repo", "2024-01-20 00:00:00", 0)]), tmp_path, "b3")
    got = collect(spark, jobs.windowed_counts(stream(spark, str(tmp_path), RUNS), "1 day", "1 hour"), "window_out")
    assert {str(r.start)[:10]: (r.runs, r.findings) for r in got.collect()} == {
        "2024-01-01": (2, 5), "2024-01-03": (1, 1), "2024-01-04": (1, 1), "2024-01-09": (1, 0)}


def test_continuous_diff(spark, tmp_path):
    schema = "run_id bigint, target string, kind string, created_at timestamp, id string, severity string, label string, run_size bigint"

    def run(run_id, when, ids, target="t", size=None):
        return spark.createDataFrame([(run_id, target, "repo", i, "LOW", i, size or len(ids)) for i in ids],
                                     "run_id bigint, target string, kind string, id string, severity string, label string, run_size bigint").select(
            "run_id", "target", "kind", F.lit(when).cast("timestamp").alias("created_at"), "id", "severity", "label", "run_size")

    source, store = tmp_path / "in", str(tmp_path / "store")
    write(run(1, "2024-01-01", ["a", "b"]), source, "b0")
    write(run(2, "2024-01-02", ["b"], size=2), source, "b1")  # the first half of a run
    write(run(3, "2024-01-03", ["x"], "u").unionByName(run(2, "2024-01-02", ["c"], size=2)), source, "b2")
    drain(jobs.continuous_diff(stream(spark, str(source), schema), store, str(tmp_path / "cp")).start())
    write(run(4, "2024-01-04", ["c"]).unionByName(run(0, "2023-01-01", ["old"], "u")), source, "b3")
    drain(jobs.continuous_diff(stream(spark, str(source), schema), store, str(tmp_path / "cp")).start())  # a restart goes on
    got = {}
    for r in spark.read.parquet(f"{store}/diffs").collect():
        got.setdefault(r.epoch, set()).add((r.target, r.id, r.state))
    assert got == {0: {("t", "a", "new"), ("t", "b", "new")},
                   2: {("t", "a", "fixed"), ("t", "b", "unchanged"), ("t", "c", "new"), ("u", "x", "new")},
                   3: {("t", "b", "fixed"), ("t", "c", "unchanged")}}


def test_case_feed_stops(spark, tmp_path):
    schema, source = "repo string, arrival string", tmp_path / "in"
    for i in range(4):
        write(spark.createDataFrame([(f"r{i}a", f"{i}a"), (f"r{i}b", f"{i}b")], schema), source, f"b{i}")

    def findings_of(batch):
        return batch.select("repo", F.explode(F.array(F.lit("HIGH"), F.lit("LOW"), F.lit("HIGH"))).alias("severity"))

    store = str(tmp_path / "store")
    drain(jobs.case_feed(stream(spark, str(source), schema), findings_of, store, str(tmp_path / "cp"), ["high"], target=5).start())
    done = spark.read.parquet(store)
    assert done.count() == 3 and done.agg(F.sum("found")).first()[0] == 6
