from pyspark.sql import functions as F

from quirework.operators import layout, pages


def test_choice_rows(spark):
    cells = spark.createDataFrame([(1, 1, 2, "② 4"), (1, 1, 1, " ① 3"), (2, 1, 1, "① 3"), (2, 2, 1, "② 4"), (3, 1, 1, "① 1"), (3, 1, 2, "① 2"), (4, 1, 1, "x")], "id int, row int, column int, text string")
    assert [tuple(r) for r in layout.choice_rows(cells, "id").collect()] == [(1, "① 3 ② 4")]


def test_units(spark):
    m = spark.createDataFrame([("p", 1, "stem", "a"), ("p", 1, "choices", "b"), ("p", 2, "stem", "c")], "page string, scope long, role string, node_id string")
    assert tuple(layout.unit_report(m, ["page"]).first()) == ("p", 2, 3, 1, 1)


def test_screening(spark):
    rows = spark.createDataFrame([("a", True, 0.1), ("b", True, 0.3), ("c", True, 0.0), ("d", None, 0.05)], "id string, ok boolean, drop double")
    got = [(r["id"], r["place"], r["fallback"]) for r in layout.screening(rows, "id", "ok", "drop", pinned="c").orderBy("place").collect()]
    assert got == [("c", 1, True), ("b", 2, True)]
    assert layout.screening(rows.limit(0), "id", "ok", "drop").count() == 0


def test_visible(spark):
    items = spark.createDataFrame([("a", "ready", True), ("b", "error", True), ("c", "ready", False)], "title string, status string, selectable boolean")
    assert [r["title"] for r in layout.visible_items(items, "status", "selectable", False, "new").orderBy("title").collect()] == ["a", "c"]
    got = layout.visible_items(items, "status", "selectable", True, "new").collect()
    assert {(r["title"], r["synthetic"]) for r in got} == {("new", True), ("a", False), ("b", False)}


def test_matches(spark):
    v = spark.range(1).select(layout.spread_match(F.lit(True), F.lit(True), F.lit(True)).alias("a"), layout.spread_match(F.lit(True), F.lit(None).cast("boolean")).alias("b"), layout.spread_match(F.lit(True), F.lit(True)).alias("c"), layout.clamped(F.lit(9), F.lit(0)).alias("d")).first()
    assert tuple(v) == (False, False, True, 0)


def test_rewrites_are_idempotent(spark):
    """Ordering an ordered page again changes nothing."""
    rows = [("d", "p", f"n{k}", k, 0.9, "t", float(60 - 7 * k % 60), float(k * 13 % 190), 20.0, 5.0, 100.0, 200.0) for k in range(20)]
    n = spark.createDataFrame(rows, "doc string, page string, node_id string, ord int, confidence double, text string, x double, y double, w double, h double, page_w double, page_h double")
    once = pages.column_order(n, ["doc", "page"])
    again = pages.column_order(once.drop("ord").withColumnRenamed("new_ord", "ord"), ["doc", "page"])
    assert {(r["node_id"], r["new_ord"]) for r in once.collect()} == {(r["node_id"], r["new_ord"]) for r in again.collect()}
