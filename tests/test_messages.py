import random

from pyspark.sql import functions as F

from quirework.operators import messages

SCHEMA = "delivery_row_id long, outbox_id string, scan_session_id string, idempotency_key string, attempt_count int, status string"


def brute(rows):
    """Union-find over both identifiers; all but the best row of each group."""
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for r in rows:
        ties = [("r", r[0])]
        if r[1] is not None:
            ties.append(("o", r[1]))
        if r[2] is not None and r[3] is not None:
            ties.append(("k", r[2], r[3].strip().lower()))
        for t in ties:
            up[top(t)] = top(ties[0])
    groups = {}
    for r in rows:
        groups.setdefault(top(("r", r[0])), []).append(r)
    keep = {max(g, key=lambda r: (r[4] is not None, r[4] or 0, -r[0]))[0] for g in groups.values()}
    return {r[0] for r in rows} - keep


def surplus(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r[0] for r in messages.surplus_copies(df, "delivery_row_id", messages.outbox_identifiers(), ["attempt_count"]).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_cases(spark):
    rows = [
        (1, "a", "s", "K1", 1, "x"), (2, "a", "s", " k1\t", 3, "x"), (3, "b", "s", "k1 ", 3, "x"),  # linked through the key; tie goes to row 2
        (4, "c", "s", None, None, "x"), (5, "c", "t", None, 0, "x"),  # a null count is lowest
        (6, None, None, "k1", 9, "x"), (7, None, "s", None, 9, "x"),  # nothing to share
        (8, "d", "u", "k1", 1, "x"), (9, "e", "s2", "k9", 1, "x"), (10, "e", "s2", "k9", 1, "x"), (11, "f", "s2", "K9", 1, "x"),
    ]
    assert surplus(spark, rows) == brute(rows) == {1, 3, 4, 10, 11}


def test_long_chain_and_hot_group(spark):
    chain = [(i, f"o{i // 2}", "s", f"k{(i + 1) // 2}", i % 5, "x") for i in range(300)]
    hot = [(1000 + i, "hot", "s", None if i % 3 else f"h{i}", i % 7 or None, "x") for i in range(600)]
    rows = chain + hot
    random.Random(1).shuffle(rows)
    assert surplus(spark, rows) == brute(rows)


def test_random_graphs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *(f"o{k}" for k in range(60))]), f"s{rng.randrange(3)}", rng.choice([None, *(f"k{k}" for k in range(60))]), rng.choice([None, 0, 1, 2]), "x") for i in range(150)]
    assert surplus(spark, rows) == brute(rows)


def test_empty_and_kept(spark):
    assert surplus(spark, []) == set()
    rows = [(1, "a", "s", "k", 1, "x"), (2, "a", "s", "k", 2, "y"), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.lit("clash")).withColumn("node", F.lit(1))
    kept = messages.one_copy_each(df, "delivery_row_id", messages.outbox_identifiers(), ["attempt_count"])
    assert kept.columns == df.columns
    assert {r["delivery_row_id"] for r in kept.collect()} == {2, 3}


def test_single_identifier(spark):
    df = spark.createDataFrame([(1, "a", "s", "k", 1, "x"), (2, "a", "t", "j", 2, "x")], SCHEMA)
    assert [r[0] for r in messages.surplus_copies(df, "delivery_row_id", [["outbox_id"]], ["attempt_count"]).collect()] == [1]


def test_batches_together_or_one_by_one(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *(f"o{k}" for k in range(80))]), f"s{rng.randrange(3)}", rng.choice([None, *(f" K{k}\u00a0" if k % 3 else f"k{k}" for k in range(80))]), rng.choice([None, 0, 1, 2]), "x") for i in range(180)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [df.where(f"delivery_row_id % 3 = {k}") for k in range(3)]
    options = ("delivery_row_id", messages.outbox_identifiers(), ["attempt_count"])
    want = {r[0] for r in rows} - brute(rows)
    together = {r[0] for r in messages.one_copy_each(df, *options).collect()}
    by_two = messages.one_copy_of_all(parts[0].union(parts[1]), parts[2].drop("status"), *options)
    first = {r[0] for r in messages.one_copy_of_all(parts[0], parts[1], *options).collect()}
    assert together == want == {r[0] for r in by_two.collect()}
    assert first == {r[0] for r in rows if r[0] % 3 < 2} - brute([r for r in rows if r[0] % 3 < 2])
    plan = messages.one_copy_each(df, *options)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_many_singletons_pass_the_filter(spark):
    """A small filter, full of bits, sends singletons the longer way and loses none."""
    rows = [(i, f"o{i if i > 20_000 else i // 2}", "s", f"k{i}", 1, "x") for i in range(30_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r[0] for r in messages.one_copy_each(df, "delivery_row_id", messages.outbox_identifiers(), ["attempt_count"], power=15).collect()}
    assert kept == {r[0] for r in rows} - brute(rows)
