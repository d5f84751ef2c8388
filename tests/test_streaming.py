import random

import pytest

from quirework.streaming import frames as S


def frames(n, seed):
    rng = random.Random(seed)
    t, rows = 0.0, []
    for k in range(n):
        t += rng.choice([0.1, 0.2, 0.4, 0.7])
        rows.append((f"k{k % 3}", t, k, rng.choice(["SAME", "CHANGED", "REPEAT", "REPEAT"]), rng.random() > 0.1, rng.random() > 0.9, rng.choice(["a", "a", "b", None]), ["a"] if rng.random() > 0.5 else None, rng.random() > 0.5, rng.choice(["dark", "dark", None]), k, rng.randrange(20), rng.choice("xy"), rng.choice(["PUT", "CONFIRM"]), rng.choice("pq"), rng.random() > 0.3, rng.choice(["SAME", "DIFFERENT", "UNKNOWN"]), rng.random() > 0.8))
    return rows


SCHEMA = "key string, t double, frame long, relation string, eligible boolean, armed boolean, value string, bank array<string>, changed boolean, reason string, arrival long, sequence long, digest string, action string, artifact string, down boolean, identity string, numeric_differs boolean"
OPERATORS = {"cadence": S.cadence(0.5), "page_change": S.page_change(), "collector": S.collector(5, 3, 1, 2.0), "verification": S.verification(), "guidance": S.guidance(2, 0.3, 2.0), "heartbeat": S.heartbeat(), "ledger": S.ledger(2), "pulses": S.pulses(), "fused": S.fused_change()}


@pytest.mark.parametrize("name", OPERATORS)
def test_stream_equals_batch(spark, tmp_path, name):
    rows = frames(120, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, OPERATORS[name].batch(df, "key").collect()), key=repr)
    assert want
    for part in range(3):  # three micro-batches in time order
        spark.createDataFrame(rows[part * 40 : (part + 1) * 40], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{part}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = OPERATORS[name].stream(stream, "key").writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table(f"out_{name}").collect()), key=repr)
    assert got == want


def one(op, rows):
    state, out = {}, []
    for r in rows:
        out += op.step(state, r)
    return out


def test_cadence_drifts():
    rows = [{"t": t, "frame": k} for k, t in enumerate([0, 0.4, 0.6, 1.0, 1.2])]
    assert [o["frame"] for o in one(S.cadence(0.5), rows)] == [0, 2, 4]


def test_page_change_latches():
    rows = [{"t": k, "frame": k, "relation": r, "eligible": True, "armed": k in (0, 8)} for k, r in enumerate(["CHANGED", "REPEAT", "REPEAT", "REPEAT", "REPEAT", "REPEAT", "SAME", "SAME", "CHANGED", "REPEAT", "REPEAT"])]
    assert [o["frame"] for o in one(S.page_change(), rows)] == [2, 10]


def test_collector_times_out():
    rows = [{"t": t, "frame": k, "value": None, "bank": None} for k, t in enumerate([0, 1, 2.5])]
    assert [o["verdict"] for o in one(S.collector(3, 2, 0, 2.0), rows)] == ["UNKNOWN"]


def test_collector_keeps_banks_apart():
    rows = [{"t": k, "frame": k, "value": v, "banks": [["a"], ["b"], None, []]} for k, v in enumerate("abab")]
    assert [(o["frame"], o["verdict"]) for o in one(S.collector(3, 2, 0, 99.0), rows)] == [(2, "SAME")]
    spread = [{"t": k, "frame": k, "value": v, "banks": [["a"], ["b"]]} for k, v in enumerate("ab")]
    assert one(S.collector(2, 2, 1, 99.0), spread) == []  # two hits, but in two artifacts


def test_silence_gives_unknown_and_frees_the_state():
    import json

    class Kept:
        exists, hasTimedOut, get, removed = True, True, (json.dumps({"start": 1.0, "seen": ["a"]}),), False

        def remove(self):
            self.removed = True

    kept = Kept()
    out = list(S.collector(3, 2, 0, 2.0).folded("key", True)(("k",), iter([]), kept))[0].to_dict("records")
    assert out == [{"key": "k", "frame": None, "verdict": "UNKNOWN", "samples": 1}] and kept.removed


def test_a_missing_sequence_is_invalid():
    assert [o["outcome"] for o in one(S.heartbeat(), [{"arrival": 1, "sequence": None, "digest": "a"}, {"arrival": 2, "sequence": 1, "digest": "a"}])] == ["invalid", "accepted"]


def test_heartbeat():
    rows = [{"arrival": k, "sequence": s, "digest": d} for k, (s, d) in enumerate([(1, "a"), (3, "b"), (2, "c"), (3, "b"), (3, "z")])]
    assert [o["outcome"] for o in one(S.heartbeat(), rows)] == ["accepted", "accepted", "stale", "replay", "collision"]


def test_idempotent(spark, tmp_path):
    from datetime import datetime

    spark.createDataFrame([("a", datetime(2026, 1, 1)), ("a", datetime(2026, 1, 1, 0, 1)), ("b", datetime(2026, 1, 1))], "k string, at timestamp").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "e"))
    q = S.idempotent(stream, ["k"], "at").writeStream.format("memory").queryName("idem").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["k"] for r in spark.table("idem").collect()) == ["a", "b"]
