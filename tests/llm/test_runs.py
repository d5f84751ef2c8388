import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quirework.llm import runs

SCHEMA = "anchor long, rec string, frame int, label string, spread string, at timestamp, seq string"


def brute(rows):
    """Row by row: (rec, first frame, last frame, frames)."""
    seen = {}
    for _, rec, frame, label, spread, at, _ in rows:
        if rec is not None and frame is not None:
            n = "".join(c for c in label.lower() if c.isalnum()) if label is not None else None
            sp = spread.lower() if spread is not None else None
            rank = lambda e: (e[0] is None, e[0] or "", e[1] is None, e[1] or "")
            seen[rec, frame] = min((n, sp), seen.get((rec, frame), (n, sp)), key=rank)
    out, run = [], None
    for (rec, frame), (label, spread) in sorted(seen.items()):
        if run and run[0] == rec and label is not None and run[3] == label and (spread is None or run[4] is None or spread == run[4]):
            run[2], run[4], run[5] = frame, run[4] or spread, run[5] + 1
        else:
            run = [rec, frame, frame, label, spread, 1]
            out.append(run)
    return sorted((r[0], r[1], r[2], r[5]) for r in out)


def collapsed(spark, rows, parts=1, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = runs.collapse_runs(df, "rec", "frame", runs.plain_label("label"), F.lower("spread"), F.col("at"), **options)
    return sorted((r["sequence"], r["first_position"], r["last_position"], r["events"]) for r in got.collect())


def make(n, recs, seed, nulls=True):
    rng = random.Random(seed)
    t0 = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        f = rng.randrange(n)
        rows.append((i, rng.choice(recs), f if rng.random() > 0.02 or not nulls else None, rng.choice(["A b", "a_B", "ab", "C", None if nulls else "C"]), rng.choice([None, None, "p1", "P1", "p2"]), t0 + timedelta(seconds=f), "x"))
    return rows


def test_against_brute_force(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed, recs in ((1, ["r"]), (2, ["r", "s", None]), (3, [f"r{k}" for k in range(40)])):
            rows = make(400, recs, seed)
            assert collapsed(spark, rows, 3) == brute(rows) == collapsed(spark, rows, 3, fan=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_long_run_over_all_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "r", i, "A", None if i < 900 else "p1", datetime(2026, 1, 1), "x") for i in range(1000)]
        assert collapsed(spark, rows, 4) == [("r", 0, 999, 1000)]
        rows = [(i, "r", i, "A", "p0" if i == 0 else "p1" if i == 999 else None, datetime(2026, 1, 1), "x") for i in range(1000)]
        assert collapsed(spark, rows, 4) == [("r", 0, 998, 999), ("r", 999, 999, 1)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_many_chunks_in_a_tree(spark):
    """One sequence over 300 chunks, merged in three rounds."""
    rows = make(3000, ["r"], 9, nulls=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        assert collapsed(spark, rows, 2, fan=8) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_event_stays_whole(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, "r", 1, "b", "left", t, "x"), (2, "r", 1, "a", "right", t, "x"), (3, "r", 2, "a", None, t, "x"), (4, "r", 2, None, "left", t, "x")]
    got = runs.collapse_runs(spark.createDataFrame(rows, SCHEMA), "rec", "frame", runs.plain_label("label"), F.lower("spread"), F.col("at")).collect()
    assert [(r["label"], r["context"], r["events"]) for r in got] == [("a", "right", 2)]


def test_merge_is_associative():
    rng = random.Random(4)

    def fold(rs):
        out = []
        for r in rs:
            out = out[:-1] + runs.merge_runs(out[-1], r) if out else [r]
        return out

    import pandas as pd

    for _ in range(300):
        n = rng.randrange(3, 9)
        base = [{"seq": "r", "label": "a", "context": rng.choice([None, None, "p", "q"]), "pos": k, "t": float(k)} for k in range(n)]
        one = [runs._encode(pd.DataFrame([b]).astype({"context": object}).where(lambda d: d.notna(), None))[0] for b in base]
        a, b = sorted(rng.sample(range(1, n), 2))
        left = fold([dict(x) for x in one])
        parts = [fold([dict(x) for x in one[i:j]]) for i, j in ((0, a), (a, b), (b, n))]
        for p in parts:
            runs._closed(p, True, True)
        joined = fold([dict(x) for p in parts for x in p])
        key = lambda rs: [(r["first"], r["last"], r["n"], r["context"]) for r in rs]
        assert key(joined) == key(left)


def test_durations_nulls_and_empty(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, "r", 1, "A", None, t, "x"), (2, "r", 2, "a", "p", t + timedelta(seconds=2.5), "x"), (3, "r", 2, "a", "p", t + timedelta(seconds=9), "x"), (4, "r", 3, None, None, None, "x"), (5, "r", 4, None, None, t, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["first_position"], r["last_position"]): r["duration_s"] for r in runs.collapse_runs(df, "rec", "frame", runs.plain_label("label"), F.lower("spread"), F.col("at")).collect()}
    assert got == {(1, 2): 2.5, (3, 3): None, (4, 4): 0.0}
    assert runs.collapse_runs(df.limit(0), "rec", "frame", runs.plain_label("label")).count() == 0
