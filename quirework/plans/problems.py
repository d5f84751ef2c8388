"""Queries of the general training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.operators import messages, nested
from quirework.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every surplus copy of an outbox message."""
    return messages.surplus_copies(table(spark, folder, "delivery_outbox"), "delivery_row_id", messages.outbox_identifiers(), ["attempt_count"])


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The outbox with one row a message."""
    kept = messages.one_copy_each(table(spark, folder, "delivery_outbox"), "delivery_row_id", messages.outbox_identifiers(), ["attempt_count"])
    return kept.select("delivery_row_id", "outbox_id", "scan_session_id", "status", "attempt_count")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Parent-child keys of low-confidence nodes and boxed page sides."""
    return nested.parent_child_links(table(spark, folder, "ocr_quality_report_p008"), table(spark, folder, "input_manifest"))


def p4_low_confidence_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Low-confidence nodes as a flat table with box and confidence."""
    return nested.low_confidence_table(table(spark, folder, "ocr_quality_report_p008"))


def p4_page_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Page sides as a flat table with their boxes."""
    return nested.page_side_table(table(spark, folder, "input_manifest")).withColumn("area_ratio", F.round("area_ratio", 8))


def p4_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Report pages as a flat table."""
    pages = nested.page_table(table(spark, folder, "ocr_quality_report_p008"))
    return pages.withColumns({c: F.round(c, 8) for c in ("mean_confidence", "min_confidence")})


def p4_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest captures as a flat table."""
    return nested.capture_table(table(spark, folder, "input_manifest"))


def p4_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Reports and manifests whose content cannot be read."""
    return nested.fault_table(table(spark, folder, "ocr_quality_report_p008"), table(spark, folder, "input_manifest"))


_GROUPS = """
WITH RECURSIVE base AS (
  SELECT delivery_row_id AS r, outbox_id AS o, scan_session_id AS s, lower(trim(idempotency_key, E' \\t\\n\\r\\f\\x0b' || chr(160) || chr(12288))) AS k, attempt_count AS a
  FROM delivery_outbox),
ties AS (
  SELECT r, min(r) OVER (PARTITION BY o) AS m FROM base WHERE o IS NOT NULL
  UNION SELECT r, min(r) OVER (PARTITION BY s, k) AS m FROM base WHERE s IS NOT NULL AND k IS NOT NULL),
links AS (SELECT r AS x, m AS y FROM ties WHERE r <> m UNION SELECT m, r FROM ties WHERE r <> m),
reach AS (SELECT x AS r, y AS g FROM links UNION SELECT reach.r, links.y FROM reach JOIN links ON reach.g = links.x),
grouped AS (SELECT r, least(r, min(g)) AS g FROM reach GROUP BY r),
ranked AS (
  SELECT base.r, row_number() OVER (PARTITION BY coalesce(g, base.r) ORDER BY a DESC NULLS LAST, base.r) AS n
  FROM base LEFT JOIN grouped ON base.r = grouped.r)
"""

_REPORT_NODES = """
  SELECT DISTINCT report_id, json_extract_string(p, '$.page_id') AS page_id, n
  FROM (SELECT report_id, p, unnest(json_extract(p, '$.low_confidence_nodes[*]')) AS n
        FROM (SELECT report_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS p
              FROM (SELECT report_id, coalesce(to_json(pages), CAST(pages_json AS JSON)) AS j FROM ocr_quality_report_p008) WHERE j IS NOT NULL))
  WHERE json_type(n) = 'OBJECT' AND json_extract_string(n, '$.node_id') IS NOT NULL
"""

_PAGES = """
  SELECT report_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS p
  FROM (SELECT report_id, coalesce(to_json(pages), CAST(pages_json AS JSON)) AS j FROM ocr_quality_report_p008) WHERE j IS NOT NULL
"""

_CAPTURES = """
  SELECT manifest_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS c
  FROM (SELECT manifest_id, coalesce(to_json(records), CAST(records_json AS JSON)) AS j FROM input_manifest) WHERE j IS NOT NULL
"""

_SIDES = """
  SELECT manifest_id, json_extract_string(c, '$.capture') AS capture, side, body
  FROM (SELECT manifest_id, c, unnest(CASE WHEN json_type(json_extract(c, '$.pages')) = 'ARRAY'
            THEN [{'side': json_extract_string(x, '$.side'), 'body': x} for x in json_extract(c, '$.pages[*]')]
            ELSE [{'side': 'left', 'body': json_extract(c, '$.pages.left')}, {'side': 'right', 'body': json_extract(c, '$.pages.right')}] END, recursive := true)
        FROM (SELECT manifest_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END) AS c
              FROM (SELECT manifest_id, coalesce(to_json(records), CAST(records_json AS JSON)) AS j FROM input_manifest) WHERE j IS NOT NULL))
  WHERE json_type(json_extract(body, '$.bbox_full')) IN ('ARRAY', 'OBJECT')
"""


def _box(column: str, place: int, name: str, at: str, kind: str) -> str:
    return f"TRY_CAST(CASE WHEN json_type(json_extract({column}, '$.{at}')) = 'ARRAY' THEN json_extract_string({column}, '$.{at}[{place}]') ELSE json_extract_string({column}, '$.{at}.{name}') END AS {kind})"


SQL = {
    "p1_found": _GROUPS + "SELECT r AS delivery_row_id FROM ranked WHERE n > 1",
    "p1_kept": _GROUPS + "SELECT delivery_row_id, outbox_id, scan_session_id, status, attempt_count FROM ranked JOIN delivery_outbox ON r = delivery_row_id WHERE n = 1",
    "p4_found": f"""
SELECT DISTINCT 'ocr_quality_report_p008' AS source_table, report_id AS root_id, page_id AS parent_id, json_extract_string(n, '$.node_id') AS child_id FROM ({_REPORT_NODES})
UNION SELECT DISTINCT 'input_manifest', manifest_id, capture, side FROM ({_SIDES})""",
    "p4_low_confidence_nodes": f"""
SELECT DISTINCT report_id, page_id, json_extract_string(n, '$.node_id') AS node_id, TRY_CAST(json_extract_string(n, '$.reading_order_index') AS INTEGER) AS reading_order_index,
  CASE WHEN c > 1 THEN c / 100 ELSE c END AS confidence, {', '.join(f"{_box('n', k, b, 'bbox', 'DOUBLE')} AS box_{b}" for k, b in enumerate(nested.BOX))}, json_extract_string(n, '$.text') AS text
FROM (SELECT *, TRY_CAST(json_extract_string(n, '$.confidence') AS DOUBLE) AS c FROM ({_REPORT_NODES}))""",
    "p4_pages": f"""
SELECT DISTINCT report_id, json_extract_string(p, '$.page_id') AS page_id, TRY_CAST(json_extract_string(p, '$.node_count') AS INTEGER) AS node_count,
  round(CASE WHEN a > 1 THEN a / 100 ELSE a END, 8) AS mean_confidence, round(CASE WHEN b > 1 THEN b / 100 ELSE b END, 8) AS min_confidence,
  TRY_CAST(json_extract_string(p, '$.low_confidence_node_count') AS INTEGER) AS low_confidence_node_count
FROM (SELECT *, TRY_CAST(json_extract_string(p, '$.mean_confidence') AS DOUBLE) AS a, TRY_CAST(json_extract_string(p, '$.min_confidence') AS DOUBLE) AS b FROM ({_PAGES}))
WHERE json_extract_string(p, '$.page_id') IS NOT NULL""",
    "p4_captures": f"""
SELECT DISTINCT manifest_id, json_extract_string(c, '$.capture') AS capture, json_extract_string(c, '$.status') AS status, json_extract_string(c, '$.image_path') AS image_path,
  TRY_CAST(json_extract_string(c, '$.overlap_px') AS INTEGER) AS overlap_px FROM ({_CAPTURES}) WHERE json_extract_string(c, '$.capture') IS NOT NULL""",
    "p4_faults": """
SELECT DISTINCT 'ocr_quality_report_p008' AS source_table, report_id AS root_id, CASE WHEN trim(pages_json) = '' THEN 'EMPTY' ELSE 'MALFORMED' END AS fault
FROM ocr_quality_report_p008 WHERE pages IS NULL AND NOT json_valid(pages_json)
UNION SELECT DISTINCT 'input_manifest', manifest_id, CASE WHEN trim(records_json) = '' THEN 'EMPTY' ELSE 'MALFORMED' END FROM input_manifest WHERE records IS NULL AND NOT json_valid(records_json)""",
    "p4_page_sides": f"""
SELECT DISTINCT manifest_id, capture, side, {', '.join(f"{_box('body', k, b, 'bbox_full', 'INTEGER')} AS box_{b}" for k, b in enumerate(nested.BOX))},
  round(TRY_CAST(json_extract_string(body, '$.area_ratio') AS DOUBLE), 8) AS area_ratio, json_extract_string(body, '$.winding') AS winding
FROM ({_SIDES})""",
}

QUERIES = {q.__name__: q for q in (p1_found, p1_kept, p4_found, p4_low_confidence_nodes, p4_pages, p4_captures, p4_page_sides, p4_faults)}
