import random

import pytest

from quirework.llm import mixing


def test_plan_meets_shares_and_caps():
    patterns = {("a",): 1000, ("b",): 100, ("a", "b"): 50, ("c",): 400}
    shares, repeats = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 3, "c": 2}
    plan = mixing.plan_mix(patterns, shares, repeats)
    for s in shares:
        assert abs(sum(t for (p, x), t in plan.tokens.items() if x == s) - plan.total * shares[s]) <= 1
    for (p, s), t in plan.tokens.items():
        assert t <= patterns[p] * repeats[s]
    # b is the bottleneck: all it can have is 3 * 100 + 3 * 50 tokens.
    assert plan.total == pytest.approx(450 / 0.3, abs=4)


def test_largest_total_against_cuts():
    """The largest total is the smallest over all sets of sources of what their patterns can give over their share."""
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(60):
        names = "abcd"[: rng.randrange(2, 5)]
        raw = [rng.randrange(1, 9) for _ in names]
        shares = {s: r / sum(raw) for s, r in zip(names, raw)}
        repeats = {s: rng.randrange(1, 4) for s in names}
        patterns = {(s,): rng.randrange(1, 400) for s in names}
        for _ in range(3):
            patterns[tuple(sorted(rng.sample(names, 2)))] = rng.randrange(1, 300)
        best = float("inf")
        for k in range(1, len(names) + 1):
            for group in combinations(names, k):
                give = sum(min(n * max(repeats[s] for s in p), sum(n * repeats[s] for s in p if s in group)) for p, n in patterns.items())
                best = min(best, give / sum(shares[s] for s in group))
        assert mixing.plan_mix(patterns, shares, repeats).total == pytest.approx(best, abs=len(names) * 12)


def test_repetition_costs_are_convex():
    plan = mixing.plan_mix({("a",): 100, ("a", "b"): 100}, {"a": 0.6, "b": 0.4}, {"a": 3, "b": 3}, total=200)
    assert plan.tokens[("a",), "a"] == 100 and plan.tokens[("a", "b"), "a"] == 20 and plan.tokens[("a", "b"), "b"] == 80


def docs_and_targets(spark):
    rng = random.Random(9)
    rows = []
    for k in range(400):
        rows.append((k, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(1, 60))), rng.choice(["A", " a", "b", "c", None, "other"])))
    rows += [(1000 + k, rows[k][1], "b") for k in range(40)]  # texts of two sources
    rows += [(2000, None, "a"), (2001, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as tokens", "'x' as pattern")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 4)], "source string, target_share double, max_repeats int")
    return rows, docs, targets


def test_mixture(spark):
    rows, docs, targets = docs_and_targets(spark)
    mix = mixing.Mixture(docs, targets, seed=3, buckets=8)
    got = mix.documents().collect()
    text = {r[0]: r[1] for r in rows}
    source = {r[0]: (r[2] or "").strip().lower() for r in rows}
    assert got and all(source[r["doc_id"]] == r["source"] for r in got)
    uses = {}
    for r in got:
        uses.setdefault(text[r["doc_id"]], []).append((r["source"], r["uses"]))
    cap = {"a": 2, "b": 2, "c": 4}
    assert all(u <= cap[s] for v in uses.values() for s, u in v)
    assert all(sum(u for _, u in v) <= max(cap[s] for s, _ in v) for v in uses.values())
    longest = max(r["tokens"] for r in got)
    report = {r["source"]: r for r in mix.shares_reached().collect()}
    whole = sum(r["tokens"] for r in report.values())
    for s, r in report.items():
        assert abs(r["tokens"] - mix.plan.quota[s]) <= 4 * longest
        assert r["actual_share"] == pytest.approx(r["tokens"] / whole)
    again = mixing.Mixture(docs, targets, seed=3, buckets=8).documents().collect()
    other = mixing.Mixture(docs, targets, seed=4, buckets=8).documents().collect()
    assert sorted(got) == sorted(again) and sorted(got) != sorted(other)


def test_too_large_total_and_empty(spark):
    _, docs, targets = docs_and_targets(spark)
    mix = mixing.Mixture(docs, targets, total_tokens=10**9, buckets=8)
    report = {r["source"]: r for r in mix.shares_reached().collect()}
    assert report["c"]["most_uses"] == 4 and report["a"]["most_uses"] == 2
    empty = mixing.Mixture(docs.limit(0), targets)
    assert empty.documents().count() == 0
    assert [r["tokens"] for r in empty.shares_reached().collect()] == [0, 0, 0]


def test_too_many_targets_are_refused(spark):
    _, docs, _ = docs_and_targets(spark)
    targets = spark.range(10_001).selectExpr("concat('s', id) as source", "1 / 10001D as target_share", "1 as max_repeats")
    with pytest.raises(ValueError, match="more than 10000 target sources"):
        mixing.Mixture(docs, targets)


def test_promises_and_pattern(spark, tmp_path):
    _, docs, targets = docs_and_targets(spark)
    mix = mixing.Mixture(docs, targets, seed=3, buckets=8)
    assert {tuple(r) for r in mix.kept_promises().collect()} == {(s, True, True) for s in "abc"}
    short = mixing.Mixture(docs, targets, total_tokens=10**9, buckets=8).kept_promises().collect()
    assert not any(r["share_met"] for r in short) and all(r["cap_kept"] for r in short)
    (tmp_path / "__init__.py").write_text("raise SystemExit\nPATTERN = r'\\w+'\n")
    assert mixing.cut_pattern(str(tmp_path / "x.tiktoken")) == "\\w+"
