"""One literal fixture for each operator that the SQL check cannot reach, and edge cases of those it can."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as X, values as V
from quirework.operators import compare, delivery, documents, pages, polygons, sequences, statistics, tables

NODE = "doc string, page string, node_id string, ord int, confidence double, text string, x double, y double, w double, h double, page_w double, page_h double"


def nodes(spark, rows, w=100.0, h=200.0):
    return spark.createDataFrame([("d", "p", *r, w, h) for r in rows], NODE)


BASE = [("n1", 0, 0.95, "first", 10.0, 20.0, 40.0, 12.0), ("n2", 1, 0.30, "second", 10.0, 45.0, 40.0, 12.0), ("n3", 2, 0.88, "third", 10.0, 160.0, 40.0, 12.0)]
KEYS = ["doc", "page"]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_quality_report(spark):
    q = one(pages.page_quality(nodes(spark, BASE), KEYS))
    assert (q["node_count"], q["low_count"], q["order_count"], q["overlap_count"]) == (3, 1, 1, 0)
    w = one(pages.order_warnings(nodes(spark, BASE), KEYS))
    assert (w["type"], w["from_node_id"], w["to_node_id"]) == ("LARGE_VERTICAL_GAP", "n2", "n3")
    moved = [BASE[0], BASE[1], ("n3", 2, 0.88, "third", 18.0, 45.0, 40.0, 12.0)]
    assert one(pages.overlapping_pairs(nodes(spark, moved), KEYS, 0.2))["ratio"] == 0.8
    wide = [("n1", 0, 0.9, "body text @ 1 2 3 = 4", 10.0, 20.0, 80.0, 12.0), ("n2", 1, None, "1 @ 2 @ 3 4 5 6 7 8", 10.0, 45.0, 70.0, None)]
    f = {r["node_id"]: r for r in pages.node_flags(nodes(spark, wide), KEYS).collect()}
    assert f["n1"]["mixed"] and f["n1"]["shape"] and f["n2"]["table_like"] and f["n2"]["low"] and not f["n2"]["shape"]
    assert pages.page_quality(nodes(spark, []), KEYS).count() == 0


def test_guide_page(spark):
    rows = [("h", 0, 0.9, "Book Structure", 10.0, 20.0, 40.0, 5.0)] + [(f"c{k}", k + 1, 0.9, f"item {k}", 5.0 + 22 * (k % 4), 40.0 + 3 * k, 18.0, 4.0) for k in range(45)]
    assert one(pages.guide_pages(nodes(spark, rows), KEYS))["exclude"]
    assert not one(pages.guide_pages(nodes(spark, rows[1:]), KEYS))["exclude"]


def test_overlaps_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [(f"n{k:02}", k, 0.9, "t", rng.uniform(0, 90), rng.uniform(0, 190), rng.choice([2.0, 5.0, 30.0]), rng.choice([2.0, 20.0])) for k in range(60)]
    got = {(r["node_a"], r["node_b"]) for r in pages.overlapping_pairs(nodes(spark, rows), KEYS, 0.3).collect()}
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            s = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4])) * max(0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
            if s / max(min(a[6] * a[7], b[6] * b[7]), 1.0) >= 0.3:
                want.add((a[0], b[0]))
    assert got == want and got


def test_lines_and_blocks(spark):
    rows = [("a", 0, 1.0, "one", 0.0, 0.0, 10.0, 10.0), ("b", 1, 1.0, "two", 15.0, 1.0, 10.0, 10.0), ("c", 2, 1.0, "three", 0.0, 14.0, 10.0, 10.0), ("d", 3, 1.0, "far", 0.0, 150.0, 10.0, 10.0), ("e", 4, 1.0, None, None, None, None, None)]
    lines = pages.cluster_lines(nodes(spark, rows), KEYS)
    assert [r["text"] for r in lines.orderBy("line").collect()] == ["one two", "three", "far"]
    assert [r["block"] for r in pages.cluster_blocks(lines, KEYS).orderBy("line").collect()] == [0, 0, 1]


def test_lines_and_blocks_follow_medians(spark):
    near = [("a", 0, 1.0, "fo", 0.0, 0.0, 10.0, 10.0), ("b", 1, 1.0, "cus", 11.0, 0.0, 10.0, 10.0), ("c", 2, 1.0, None, 30.0, 0.0, 5.0, 0.0)]
    assert [r["text"] for r in pages.cluster_lines(nodes(spark, near), KEYS).collect()] == ["focus "]
    rows = [("d", "p", k, 0.0, y, 50.0, h) for k, (y, h) in enumerate([(0.0, 40.0), (50.0, 40.0), (120.0, 10.0)])]
    lines = spark.createDataFrame(rows, "doc string, page string, line int, x double, y double, w double, h double")
    assert [r["block"] for r in pages.cluster_blocks(lines, KEYS).orderBy("line").collect()] == [0, 0, 0]


def test_units_in_order(spark):
    texts = ["머리", "[12345-1234] 다음을 구하시오", "① 1 ② 2 ③ 3 ④ 4 ⑤ 5", "[12345-1235] 줄기", "끝"]
    n = nodes(spark, [(f"n{k}", k, 0.5, t, 0.0, 10.0 * k, 9.0, 9.0) for k, t in enumerate(texts)])
    members = pages.problem_units(n, KEYS)
    assert [(r["x"], r["y"], r["w"], r["h"], r["members"]) for r in pages.unit_boxes(members, n, KEYS).collect()] == [(0.0, 10.0, 9.0, 19.0, 2)]
    assert [(r["item"], r["scope"], r["place"]) for r in pages.unit_order(n, members, KEYS).orderBy("place").collect()] == [("n0", None, 0), ("n1", 1, 1), ("n3", None, 2), ("n4", None, 3)]


def test_problem_units(spark):
    texts = ["[12345-1234] 다음을 구하시오", "(가) 조건", "① 1 ② 2 ③ 3", "④ 4 ⑤ 5", "밖", "[12345-1235] 값을 구하시오.", "풀이", "[12345-1236]", "[12345-1237] 줄기", "① 1 ② 2", "끝"]
    rows = [(f"n{k:02}", k, 1.0, t, 0.0, 10.0 * k, 9.0, 9.0) for k, t in enumerate(texts)]
    got = [(r["scope"], r["role"], r["node_id"]) for r in pages.problem_units(nodes(spark, rows), KEYS).orderBy("scope", "place").collect()]
    assert got == [(1, "stem", "n00"), (1, "condition", "n01"), (1, "choices", "n02"), (1, "choices", "n03"), (2, "stem", "n05"), (2, "stem", "n06")]


def test_validation(spark):
    n = nodes(spark, [*BASE, BASE[0]])
    order = spark.createDataFrame([("d", "p", 0, "n1"), ("d", "p", 1, "n1"), ("d", "p", 2, "n2"), ("d", "p", 3, "gone")], "doc string, page string, position int, node_id string")
    v = one(pages.validation_counters(n, order, KEYS))
    assert (v["nodes"], v["duplicate_ids"], v["order_duplicates"], v["missing_in_order"], v["dangling"], v["index_mismatch"], v["valid"]) == (4, 1, 1, 1, 1, 1, False)


def test_html_tables(spark):
    html = ["<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d&amp;<br>e</td></tr></table>", "<table><tr><td colspan='2'>a</td><td>b</td></tr><tr><td rowspan=2>c</td><td>d</td><td>e</td></tr><tr><td>f</td></tr></table>", "", None, "<td colspan='x'>lone"]
    df = spark.createDataFrame(list(enumerate(html)), "id long, html string")
    cells = tables.table_cells(df, "id", "html").cache()
    got = {(r["id"], r["text"]): (r["row"], r["column"]) for r in cells.collect()}
    assert got[1, "b"] == (1, 3) and got[1, "f"] == (3, 2) and got[0, "d&\ne"] == (2, 2) and got[4, "lone"] == (1, 1)
    shape = {r["id"]: (r["rows"], r["columns"], r["confidence"]) for r in tables.table_shape(cells, "id").collect()}
    assert shape[0] == (2, 2, 0.9) and shape[1] == (3, 3, 0.5) and 2 not in shape and 3 not in shape
    places = spark.createDataFrame([(1, 1, 2), (1, 3, 1), (1, 9, 9)], "id long, at_row int, at_column int")
    assert {(r["at_row"], r["at_column"]): r["text"] for r in tables.cell_at(cells, places, "id").collect()} == {(1, 2): "a", (3, 1): "c", (9, 9): None}
    box = value(spark, tables.cell_box(*[F.lit(v) for v in (0.0, 0.0, 90.0, 40.0, 2, 3, 2, 2, 1, 2)]))
    assert (box["x"], box["y"], box["width"], box["height"]) == (30.0, 20.0, 60.0, 20.0)


def test_text_functions(spark):
    f = lambda c: value(spark, c)
    assert [(s["text"], s["is_math"]) for s in f(X.inline_math_spans(F.lit("a $x^2$ b $$y$$")))] == [("a ", False), ("x^2", True), (" b ", False), ("y", True)]
    assert f(X.without_delimiters(F.lit(" $$ x $$ "))) == "x" and f(X.without_delimiters(F.lit("$x"))) == "$x"
    assert [(o["label"], o["text"]) for o in f(X.labelled_items(F.lit("(가) 하나 (나) 둘"), r"\([가나다라]\)"))] == [("(가)", "하나"), ("(나)", "둘")]
    r = f(X.rewritten(F.lit("teh cat, teh  dog"), [("the", r"\bteh\b", "the"), ("blanks", " +", " "), ("pair", "the cat", "cats"), ("never", "bird", "x")]))
    assert r["text"] == "cats, the dog" and [(a["rule"], a["count"]) for a in r["applied"]] == [("the", 2), ("blanks", 3), ("pair", 1)]
    assert [f(X.page_label(F.lit(t))) for t in ("007", "0", "12345", "x", " 9 ")] == ["7", None, None, None, "9"]
    assert f(X.page_id_from_path(F.lit("a/p3.png"))) == "p003" and f(X.page_id_from_path(F.lit("p3/cover.png"))) is None
    assert tuple(f(X.page_key_parts(F.lit("pg-ab-00000012-R")))) == (12, "R")
    assert f(X.consecutive(F.lit("9"), F.lit("10"))) is True and f(X.consecutive(F.lit(None).cast("string"), F.lit("1"))) is False
    assert [f(X.safe_int(F.lit(t))) for t in ("42", "4.2", "true", "")] == [42, None, None, None]
    faults = lambda t: [(p["code"], p["severity"]) for p in f(X.formula_problems(F.lit(t)))]
    assert faults(" ") == [("EMPTY", "warning")] and faults("x=1") == [] and faults("가" + "abc" * 120) == [("UNEXPECTED_SCRIPT", "error"), ("REPETITION", "error"), ("TOO_LONG", "warning")]
    spoken = {
        "|ab| ≤ x축": "에이 비의 절댓값 작거나 같다 엑스축", "2xy+1": "2엑스 와이+1", "f(x) text xlsx": "에프(엑스) text xlsx", "\\alpha\\leq β": "알파 작거나 같다 베타", "\\foo \\pi": "\\foo 파이", "|x + 1| = Y  축": "엑스 + 1의 절댓값 = 와이축",
        "": "", "a가 Γ ∞": "에이가 감마 무한대", "x" * 300: "x" * 300, "\\": "\\",
    }
    assert {t: f(X.read_aloud(F.lit(t))) for t in spoken} == spoken
    assert tuple(f(X.hangul_parts(F.lit("한")))) == (18, 0, 4) and f(X.hangul_parts(F.lit("a"))) is None
    assert f(X.math_score(F.lit("① 1 ② 2 ③ 3"))) == 0 and f(X.math_score(F.lit("f(x) = x^2 + 1"))) >= 8


def test_value_functions(spark):
    f = lambda c: value(spark, c)
    assert f(V.hamming(V.hex_hash(F.lit("ffffffffffffffff")), V.hex_hash(F.lit("0")))) == 64 and f(V.hex_hash(F.lit("xyz"))) is None
    assert f(V.cell_mask(F.array(F.lit(1), F.lit(4), F.lit(4)))) == 9
    assert f(V.cadence_step(F.lit(59.7), F.lit(500))) == 30 and f(V.cadence_step(F.lit(1.0), F.lit(1))) == 1
    assert f(V.wav_millis(F.lit(64000), F.lit(16000), F.lit(1))) == 2000
    a, b = F.array(F.lit(1), F.lit(2), F.lit(4)), F.array(F.lit(2), F.lit(4), F.lit(8))
    assert f(V.mean_abs_error(a, b)) == pytest.approx(7 / 3) and f(V.correlation(a, b)) == pytest.approx(1.0) and f(V.correlation(a, F.array(F.lit(1)))) is None
    box = f(V.box_from_corners(F.lit(1.0), F.lit(2.0), F.lit(4.5), F.lit(9.0)))
    assert tuple(box) == (1.0, 2.0, 3.5, 7.0) and f(V.box_from_corners(F.lit(None).cast("double"), F.lit(2.0), F.lit(4.5), F.lit(9.0))) is None
    assert f(V.image_status(F.lit(2200), F.lit(3000), F.lit("RGB"), F.lit(90.0))) == "PASS" and f(V.image_status(F.lit(900), F.lit(1200), F.lit("RGB"), F.lit(90.0))) == "LOW_QUALITY"
    assert f(V.image_status(F.lit(0), F.lit(0), F.lit("RGB"), F.lit(None).cast("double"))) == "REJECTED" and f(V.image_status(F.lit(2200), F.lit(3000), F.lit("P"), F.lit(90.0))) == "PASS_WITH_CORRECTION"
    assert f(V.region_domain(F.lit("Table"), F.lit(0.9), F.lit(0.2)))["domain"] == "PROBLEM_BOX_CANDIDATE" and f(V.region_domain(F.lit("table"), F.lit(0.2), F.lit(0.1)))["content_type"] == "TABLE"
    assert f(V.first_failing(("geometry", F.lit(True)), ("quality", F.lit(None).cast("boolean")), ("final", F.lit(False)))) == "quality"
    assert [f(V.retry_delay(F.lit(n), 1.0, 30.0, F.lit(s))) for n, s in ((1, 0.0), (4, 0.0), (9, 0.0), (1, 99.0))] == [1.0, 8.0, 30.0, 99.0]
    d = spark.createDataFrame([('{"b":1,"a":"é"}',), ('{ "a" : "é", "b": 1 }',), ("{",), (None,)], "j string").select(V.canonical_digest_udf("j").alias("d")).collect()
    assert d[0]["d"] == d[1]["d"] and len(d[0]["d"]) == 64 and d[2]["d"] is None and d[3]["d"] is None


def test_polygons():
    assert polygons.is_simple([[0, 0], [4, 0], [4, 4], [0, 4]]) and not polygons.is_simple([[0, 0], [4, 4], [4, 0], [0, 4]])
    assert not polygons.is_simple([[0, 0], [1, 1]]) and not polygons.is_simple(None) and not polygons.is_simple([[0, 0], [1, None], [2, 2]])


def test_compare(spark):
    b = spark.createDataFrame([("p1", 10, 0.9), ("p2", 4, 0.5)], "page string, n int, c double")
    c = spark.createDataFrame([("p2", 9, 0.6), ("p3", 1, 0.1)], "page string, n int, c double")
    got = {r["page"]: r["status"] for r in compare.compared(b, c, ["page"], ["n", "c"]).collect()}
    assert got == {"p1": "BASELINE_ONLY", "p2": "COMPARED", "p3": "CANDIDATE_ONLY"}
    sets = one(compare.key_sets(b, c, ["page"]))
    assert (sets["both"], sets["only_left"], sets["only_right"], sets["equal"], sets["disjoint"]) == (1, 1, 1, False, False)
    s = compare.similarity(spark.createDataFrame([("a b", "AB"), ("abc", "xyz"), (None, "a")], "a string, b string"), "a", "b").collect()
    assert [r["ratio"] for r in s] == [1.0, 0.0, None]
    k = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "g int, i int, v string")
    al = one(compare.aligned_ratio(k, k.where("v <> 'b'"), ["g"], "i", "v"))
    assert (al["equal"], al["deleted"], al["inserted"]) == (2, 1, 0)


def test_statistics(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None)], "query_id int, token string")
    r = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "token string")
    assert {x["query_id"]: x["hit"] for x in statistics.match_indicators(q, r, ["token"]).collect()} == {1: True, 2: False, 3: False, 4: False}
    w = value(spark, statistics.wilson(F.lit(9), F.lit(10)))
    assert (round(w["low"], 4), round(w["high"], 4)) == (0.5958, 0.9821)
    assert statistics.threshold_grid(spark, 5).count() == 15
    f = lambda c: value(spark, c)
    assert f(statistics.visual_relation(F.lit(25), F.lit(0.07), F.lit(0.01), F.lit(True))) == "different" and f(statistics.visual_relation(F.lit(2), F.lit(0.01), F.lit(0.0), F.lit(False))) == "ambiguous"
    assert f(statistics.hybrid_match(F.lit(12), F.lit(0.05), F.lit(0.8), F.lit(True))) and not f(statistics.hybrid_match(F.lit(12), F.lit(0.05), F.lit(0.8), F.lit(False)))
    assert f(statistics.token_overlap(F.array(F.lit(""), F.lit("a")), F.array(F.lit("a")))) and not f(statistics.token_overlap(F.array(F.lit("")), F.array(F.lit(""))))
    led = spark.createDataFrame([(1, "AMBIGUOUS", 9, "e1"), (1, "VISUAL_DUPLICATE", 3, "e2"), (1, "VISUAL_DUPLICATE", 5, "e3"), (2, "NEW", 1, "e4")], "q int, kind string, t int, e string")
    assert [tuple(x) for x in statistics.ledger_match(led, "q", "kind", "t", "e").collect()] == [(1, "e3", "VISUAL_DUPLICATE")]
    flat = spark.createDataFrame([("k", i, 1.0) for i in range(4)], "k string, i int, v double")
    assert [x["rho"] for x in statistics.autocorrelation(flat, ["k"], ["i"], "v").collect()] == [1.0, 1.0, 1.0]
    boot = one(statistics.block_bootstrap(flat, ["k"], ["i"], "v", 2, 50))
    assert (boot["mean"], boot["low"], boot["high"]) == (1.0, 1.0, 1.0)
    px = spark.createDataFrame([("m", True, True), ("m", True, False), ("m", False, True), ("m", False, False)], "k string, t boolean, f boolean")
    m = one(statistics.mask_metrics(px, ["k"], "t", "f"))
    assert (m["iou"], m["dice"], m["recall"], m["leakage"]) == (pytest.approx(1 / 3), 0.5, 0.5, 0.5)


def test_delivery(spark):
    rows = [("s", k, q, d) for k, (q, d) in enumerate([(1, "a"), (3, "b"), (2, "c"), (3, "b"), (3, "z")])]
    df = spark.createDataFrame(rows, "s string, at int, seq int, d string")
    assert [r["outcome"] for r in delivery.replay_outcomes(df, ["s"], ["at"], "seq", "d").orderBy("at").collect()] == ["accepted", "accepted", "stale", "replay", "collision"]
    now = datetime(2026, 1, 1, 0, 10)
    p = spark.createDataFrame([("d1", now), ("d1", datetime(2026, 1, 1, 0, 9, 50)), ("d2", datetime(2026, 1, 1, 0, 9)), ("d3", None)], "device string, seen timestamp")
    assert {r["device"]: (r["state"], r["split_brain"]) for r in delivery.presence(p, "device", "seen", F.lit(now)).collect()} == {"d1": ("online", True), "d2": ("stale", False), "d3": ("offline", False)}
    assert [r["n"] for r in delivery.zero_filled(df.withColumn("t", F.lit("x")), ["x", "y"], "t").orderBy("t").collect()] == [5, 0]


def test_documents(spark):
    own = spark.createDataFrame([("p", "o1", ["b", "gone", "a", "b"])], "page string, owner string, refs array<string>")
    tgt = spark.createDataFrame([("p", "a"), ("p", "b")], "page string, node string")
    got = [(r["node"], r["place"]) for r in documents.resolved_references(own, tgt, ["page"], "owner", "refs", "node").orderBy("place").collect()]
    assert got == [("b", 1), ("a", 2)] and one(documents.dangling_references(own, tgt, ["page"], "owner", "refs", "node"))["node"] == "gone"
    n = spark.createDataFrame([("p", "unit", 0, "PROBLEM"), ("p", "c", 5, "TEXT"), ("p", "s", 6, "TEXT"), ("p", "z", 1, "TEXT")], "page string, node_id string, ord int, kind string")
    m = spark.createDataFrame([("p", "unit", "c", "choices", 0), ("p", "unit", "s", "stem", 0), ("p", "unit", "s", "choices", 1)], "page string, problem_id string, node_id string, role string, place int")
    assert [r["item_id"] for r in documents.focus_items(n, m, ["page"]).orderBy("place").collect()] == ["unit", "s", "c", "z"]
    items = spark.createDataFrame([("i1", "hello"), ("i2", " ")], "item_id string, text string")
    spans = spark.createDataFrame([("i1", 0, "part")], "item_id string, i int, text string")
    cells = spark.createDataFrame([("t", 1, 2, "cell")], "item_id string, row int, column int, text string")
    u = documents.utterances(items, spans, cells)
    assert {r["key"] for r in u.collect()} == {"i1", "i1#0", "t#r1c2"}
    pf = one(documents.preflight(u, u.where("key <> 'i1'"), "key"))
    assert (pf["without_audio"], pf["without_utterance"], pf["complete"]) == (1, 0, False)
    cur = spark.createDataFrame([("p", "a", 0), ("p", "b", 9), ("p", "x", 1)], "page string, item string, at int")
    it = spark.createDataFrame([("p", "a", 0), ("p", "b", 1)], "page string, item string, i int")
    assert {r["item"]: r["error"] for r in documents.reanchored(cur, it, "page", "item", "i", "at", F.lit(True)).collect()} == {"a": None, "b": "INDEX_DRIFT", "x": "MISSING_ANCHOR"}
    assert value(spark, documents.tree_status(F.array(F.lit("warning")), F.lit(0), F.lit(1))) == "PARTIAL"
    x = documents.excluded_pages(n, ["page"], spark.createDataFrame([("p",)], "page string")).where("not embedded")
    assert [(r["node_id"], r["ord"]) for r in x.collect()] == [("p-excluded", 0)]
    cc = documents.cross_checked(spark.createDataFrame([("① ②", "① ② ③"), ("① ②", "①"), ("x", "y")], "a string, b string"), "a", "b")
    assert [r["outcome"] for r in cc.collect()] == ["OMISSION_CONFIRMED", "INCONCLUSIVE", "RECORDED"]


def test_sequences(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([None, None, "a", "a", "b"])], "k string, i int, v string")
    assert [r["island"] for r in sequences.islands(df, ["k"], ["i"], F.col("v")).orderBy("i").collect()] == [1, 1, 2, 2, 3]
    v = value(spark, sequences.viewport(F.array(*[F.lit(k) for k in range(10)]), F.lit(99), 4))
    assert (v["offset"], list(v["cells"]), v["has_previous"], v["has_next"]) == (8, [8, 9], True, False)
    assert [r["i"] for r in sequences.latest_generation(df.withColumn("g", F.col("i") % 3), ["k"], "g").orderBy("i").collect()] == [2]
    c = spark.createDataFrame([("k", i, t) for i, t in enumerate([0.0, 0.4, 0.6, 1.0, 1.2])], "k string, i long, t double")
    assert [r["i"] for r in sequences.cadence_samples(c, "k", "t", 0.5, "i").orderBy("i").collect()] == [0, 2, 4]
    pr = spark.createDataFrame([(1, datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 0, 1)), (2, datetime(2026, 1, 1), datetime(2026, 1, 1))], "id int, d timestamp, u timestamp")
    assert [(r["id"], r["pulse_ms"]) for r in sequences.hold_pulses(pr, "d", "u", 500, 250).orderBy("id", "pulse_ms").collect()] == [(1, 0.0), (1, 500.0), (1, 750.0), (1, 1000.0), (2, 0.0)]


def test_files(spark, tmp_path):
    from quirework.sources import files

    doc = {"document_manifest": {"book_id": "b", "page_count": 1}, "pages": [{"page_id": "p1", "page_geometry": {"width": 100, "height": 0}, "nodes": [{"node_id": "n1", "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}, "reading_order_index": 0, "confidence": 0.5, "normalized_text": "t"}], "reading_order": ["n1", "gone"]}]}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "p001.json").write_text(json.dumps(doc, indent=1))
    docs = files.read_documents(spark, str(tmp_path / "d"))
    n = one(files.document_nodes(docs))
    assert (n["doc"], n["page_h"], n["x"], n["h"]) == ("b", 1.0, 1.0, 4.0)
    assert [r["node_id"] for r in files.reading_order(docs).orderBy("position").collect()] == ["n1", "gone"]
    assert one(files.list_pages(spark, str(tmp_path / "d")))["page_id"] == "p001" and len(one(files.audit_files(spark, str(tmp_path / "d")))["sha256"]) == 64
    (tmp_path / "log.jsonl").write_text('{"type":"a","code":"x","at_monotonic":1.5,"details":{"k":"v"}}\nbroken\n[1]\n{"type":"b"}\n{"half":\n')
    assert sorted(r["type"] for r in files.read_event_log(spark, str(tmp_path / "log.jsonl")).collect()) == ["a", "b"]
    ch = spark.createDataFrame([("s", 0, "ab\ncd"), ("s", 1, "ef\r\n" + "x" * 600 + "\nok\nta"), ("s", 2, "il")], "k string, i int, d string")
    assert [r["line"] for r in files.framed_lines(ch, ["k"], "i", "d").orderBy("line_no").collect()] == ["ab", "cdef", "ok"]
    (tmp_path / "a.json").write_text(json.dumps({"shapes": [{"label": "page", "points": [[0, 0], [4, 0], [4, 4]]}, {"label": "bad", "points": [[0, 0], [4, 4], [4, 0], [0, 4]]}]}))
    assert [r["valid"] for r in files.annotations(spark, str(tmp_path / "a.json")).orderBy("shape_no").collect()] == [True, False]
    out = files.write_once(spark.range(3), str(tmp_path / "store"), "content")
    assert files.write_once(spark.range(9), str(tmp_path / "store"), "content") == out and spark.read.parquet(out).count() == 3
    files.write_package({"nodes": spark.createDataFrame([("b", 1)], "book_id string, n int")}, str(tmp_path / "pack"))
    assert spark.read.parquet(str(tmp_path / "pack" / "nodes")).first()["book_id"] == "b"
    files.write_events(spark.createDataFrame([("a",)], "type string"), str(tmp_path / "ev"))
    assert one(files.read_event_log(spark, str(tmp_path / "ev")))["type"] == "a"


def test_sign_words_hold_every_element(spark):
    """Elements 63 and 64 and those beyond count in the distance; the nearest of all rows is found whatever its label."""
    import duckdb

    import __spark_entry__ as entry

    base = [-1.0] * 130
    flipped = lambda *at: [1.0 if k in at else x for k, x in enumerate(base)]
    rows = [(base, flipped(62), 1), (base, flipped(63), 1), (base, flipped(64, 127, 129), 3), (base[:64], flipped(63)[:64], 1), (base, base[:64], None), ([], [], None)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want int")
    got = df.select("want", V.words_distance(V.sign_words("a"), V.sign_words("b")).alias("d")).collect()
    assert [r["d"] for r in got] == [r["want"] for r in got]
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    near = entry.queries()["vector_hashes"](spark, folder)
    assert {(r["q_id"], r["vec_id"], r["bits"]) for r in near.collect()} == set(con.sql(entry.oracle_sql()["vector_hashes"]).fetchall())


def test_atomic_and_partial_writes(spark, tmp_path):
    import os

    from quirework.sources import files

    df = spark.range(3)
    path = files.write_once(df, str(tmp_path), "content")
    assert files.write_once(spark.range(9), str(tmp_path), "content") == path and spark.read.parquet(path).count() == 3
    assert sorted(os.listdir(tmp_path)) == [os.path.basename(path)] or all(".draft" not in n for n in os.listdir(tmp_path))
    books = lambda *rows: {"nodes": spark.createDataFrame(rows, "book_id string, n int")}
    files.write_package(books(("a", 1), ("b", 2)), str(tmp_path / "pack"))
    files.write_package(books(("b", 3)), str(tmp_path / "pack"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "pack" / "nodes")).select("book_id", "n").collect()} == {("a", 1), ("b", 3)}


def test_event_lines(spark, tmp_path):
    from quirework.sources import files

    lines = ['{"type": "a", "code": "x"}', '{"code": "y"}', "{}", "[1]", "3", "{broken", "", '  {"type": null}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = files.read_event_log(spark, str(tmp_path / "log.jsonl")).select("type", "code").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [("a", "x"), (None, "y"), (None, None), (None, None)]))


def test_values_outside_the_list_are_counted(spark):
    df = spark.createDataFrame([("x",), ("x",), ("z",), (None,)], "t string")
    assert {tuple(r) for r in delivery.zero_filled(df, ["x", "y"], "t").collect()} == {("x", 2), ("y", 0), ("z", 1), (None, 1)}


def test_revision_checks(spark):
    d = spark.createDataFrame([("b", 1, 10), ("b", 2, 11), ("c", 5, 20)], "book string, page int, doc int")
    n = spark.createDataFrame([("b", 3, 12), ("c", 5, 21), ("c", None, 22)], "book string, page int, doc int")
    got = {r["book"]: r for r in documents.assembled_revision(d, n, ["book"], "page", "doc").collect()}
    assert got["b"]["valid"] and (got["b"]["base_pages"], got["b"]["new_pages"]) == (2, 1)
    assert not got["c"]["valid"] and (got["c"]["repeated_pages"], got["c"]["unnumbered"]) == (1, 1)


def test_exact_quantiles(spark):
    import random
    import statistics as st

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(5), rng.random() * 9])) for _ in range(700)] + [("one", 4.0), ("none", None)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["k"]: r for r in statistics.spread_summary(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 2.0).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for k in ("a", "b", None, "one"):
        v = sorted(x for y, x in rows if y == k and x is not None)
        place = 0.1 * (len(v) - 1)
        low = v[int(place)]
        assert got[k]["n"] == len(v) and got[k]["median"] == pytest.approx(st.median(v)) and got[k]["p10"] == pytest.approx(low + (v[min(int(place) + 1, len(v) - 1)] - low) * (place % 1))
    assert got["none"]["n"] == 0 and got["none"]["median"] is None
