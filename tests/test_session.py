from quirework import session


def test_lineage_is_cut(spark):
    df = spark.range(10).selectExpr("id", "id * 2 as v").repartition(3)
    cut = session.cut_lineage(df)
    assert sorted(map(tuple, cut.collect())) == [(k, 2 * k) for k in range(10)]
    assert "Range" not in cut._jdf.queryExecution().executedPlan().toString()
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_entry_points():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
    assert all(q.__doc__ for q in queries.values())


def test_small_queries_match_their_sql(spark):
    """A few queries of each kind against DuckDB on the smallest data."""
    import os
    from collections import Counter

    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("p1_found", "p4_found", "page_quality", "page_containers", "event_runs", "event_autocorrelation", "outbox_replays", "spread_queue", "doc_math_scores", "order_zip", "vector_hashes"):
        df = queries[name](spark, folder)
        columns = sorted(df.columns)
        got = Counter(repr([r[c] for c in columns]) for r in df.collect())
        rel = con.sql(sql[name])
        at = [rel.columns.index(c) for c in columns]
        want = Counter(repr([r[k] for k in at]) for r in rel.fetchall())
        assert got == want, name
