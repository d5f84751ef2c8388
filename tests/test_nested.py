import json

from quirework.operators import nested

R = "report_id string, pages_json string"


def reports(spark, rows):
    from pyspark.sql import functions as F

    kind = "array<struct<page_id:string,low_confidence_nodes:array<struct<node_id:string,confidence:double,bbox:struct<x:double,y:double,width:double,height:double>>>>>"
    return spark.createDataFrame(rows, R).withColumn("pages", F.lit(None).cast(kind)).withColumn("key", F.lit("clash")).withColumn("pre", F.lit(7))


def manifests(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "manifest_id string, records_json string").withColumn("records", F.lit(None).cast("array<struct<capture:string>>"))


def test_uneven_shapes(spark):
    page = {"page_id": "p1", "low_confidence_nodes": [{"node_id": "n1", "confidence": "31.5", "bbox": [1, 2, 3, 4]}, None, {"node_id": None}, {"node_id": "n1", "confidence": 0.315, "bbox": {"x": 1.0, "y": 2, "width": 3, "height": 4}}]}
    rows = [
        ("a", json.dumps([page, None, {"page_id": "p2", "low_confidence_nodes": None}])), ("b", json.dumps(page)), ("c", "{broken"), ("d", ""), ("e", None), ("f", "3"), ("a", json.dumps([page])),
        ("g", json.dumps([{"page_id": None, "low_confidence_nodes": {"node_id": "solo"}}])),
    ]
    links = {tuple(r) for r in nested.parent_child_links(reports(spark, rows), manifests(spark, [])).collect()}
    assert links == {("ocr_quality_report_p008", "a", "p1", "n1"), ("ocr_quality_report_p008", "b", "p1", "n1"), ("ocr_quality_report_p008", "g", None, "solo")}
    flat = nested.low_confidence_table(reports(spark, rows)).where("report_id = 'b'").collect()
    assert [(r["confidence"], r["box_x"], r["box_height"]) for r in flat] == [(0.315, 1.0, 4.0)]


def test_sides(spark):
    rows = [("m", json.dumps([{"capture": "c1", "pages": {"left": {"bbox_full": [1, 2, 3, 4]}, "right": {"bbox_full": None}}}, {"capture": "c2", "pages": [{"side": "left"}, {"side": "right", "bbox_full": {"x": 5, "y": 6, "width": 7, "height": 8}}, {"bbox_full": [1, 1, 1, 1]}]}, {"capture": "c3", "pages": None}]))]
    got = {(r["capture"], r["side"], r["box_x"], r["box_height"]) for r in nested.page_side_table(manifests(spark, rows)).collect()}
    assert got == {("c1", "left", 1, 4), ("c2", "right", 5, 8)}


def test_labels_nest():
    nodes, nxt = nested.label_nodes({"a": [1, {"b": 2}], "c": None}, [("a", "*")], 10)
    assert [n[0] for n in nodes] == list(range(10, nxt))
    assert sorted(n[1] for n in nodes) == list(range(10, nxt))
    root = nodes[0]
    assert all(root[0] < n[0] and n[1] < root[1] for n in nodes[1:])


def test_deep_and_long():
    deep = json.loads("[" * 500 + "]" * 500)
    nodes, _ = nested.label_nodes(deep, [("*",)], 0)
    assert len(nodes) == 500 and max(n[2] for n in nodes) == 499
    assert nested.parse_record("[" * 200_000) == (None, "TOO_DEEP")
    wide, _ = nested.label_nodes([{"low_confidence_nodes": [{"node_id": str(k)} for k in range(20_000)]}], [("*", "low_confidence_nodes", "*")], 0)
    assert sum(n[3] == 0 for n in wide) == 20_000


def test_empty_tables(spark):
    assert nested.parent_child_links(reports(spark, []), manifests(spark, [])).count() == 0


def test_pages_captures_and_faults(spark):
    rows = [("a", json.dumps([{"page_id": "p1", "node_count": 3, "mean_confidence": 91.5, "low_confidence_node_count": 1}, {"page_id": "p1", "node_count": 3, "mean_confidence": 0.915, "low_confidence_node_count": 1}, {"page_id": None}])), ("b", "{broken"), ("c", " "), ("d", None), ("e", "3")]
    assert [tuple(r) for r in nested.page_table(reports(spark, rows)).collect()] == [("a", "p1", 3, 0.915, None, 1)]
    records = [("m", json.dumps([{"capture": "c1", "status": "ok", "overlap_px": "7"}, {"capture": "c1", "status": "ok", "overlap_px": 7}, {"status": "x"}])), ("n", "nul")]
    assert [tuple(r) for r in nested.capture_table(manifests(spark, records)).collect()] == [("m", "c1", "ok", None, 7)]
    assert {tuple(r) for r in nested.fault_table(reports(spark, rows), manifests(spark, records)).collect()} == {("ocr_quality_report_p008", "b", "MALFORMED"), ("ocr_quality_report_p008", "c", "EMPTY"), ("input_manifest", "n", "MALFORMED")}
