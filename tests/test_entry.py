import __spark_entry__ as entry


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).count() > 0


def test_queries_agree_with_sql_on_the_smallest_tables(spark):
    import glob
    import os

    import duckdb

    from workloads.check import _rows
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = []
    for name in ("code_findings", "docker_findings", "secret_findings_masked", "vulnerable_dependencies", "run_diff", "header_posture", "sbom_spdx"):
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        cursor = con.execute(entry.oracle_sql()[name])
        if _rows(df.columns, [tuple(r) for r in df.collect()]) != _rows([d[0] for d in cursor.description], cursor.fetchall()):
            bad.append(name)
    assert not bad
