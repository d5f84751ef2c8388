"""Page queries over the nodes of the quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.functions import text as X, values as V
from quirework.operators import compare, layout, nested, pages, sequences
from quirework.plans.problems import _REPORT_NODES, _box
from quirework.session import table

KEYS = ["doc", "page"]
PAGE_W, PAGE_H = 1900.0, 1200.0


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Node table of the reports: one row a node; the reports hold no page size, so a fixed one stands in."""
    raw = nested.low_confidence_table(table(spark, folder, "ocr_quality_report_p008"))
    one = F.min(F.struct("reading_order_index", "confidence", "box_x", "box_y", "box_width", "box_height", "text")).alias("m")
    per = raw.groupBy(F.col("report_id").alias("doc"), F.col("page_id").alias("page"), "node_id").agg(one)
    return per.select(
        *KEYS, "node_id", F.col("m.reading_order_index").alias("ord"), F.col("m.confidence").alias("confidence"), F.col("m.text").alias("text"), F.col("m.box_x").alias("x"), F.col("m.box_y").alias("y"),
        F.col("m.box_width").alias("w"), F.col("m.box_height").alias("h"), F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"),
    )


_NODES = f"""
nodes AS (
  SELECT doc, page, node_id, ord, confidence, text, x, y, w, h, CAST({PAGE_W} AS DOUBLE) AS page_w, CAST({PAGE_H} AS DOUBLE) AS page_h,
    x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AS boxed
  FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, node_id ORDER BY ord NULLS FIRST, confidence NULLS FIRST, x NULLS FIRST, y NULLS FIRST, w NULLS FIRST, h NULLS FIRST, text NULLS FIRST) AS k
        FROM (SELECT report_id AS doc, page_id AS page, json_extract_string(n, '$.node_id') AS node_id, TRY_CAST(json_extract_string(n, '$.reading_order_index') AS INTEGER) AS ord,
                CASE WHEN c > 1 THEN c / 100 ELSE c END AS confidence, json_extract_string(n, '$.text') AS text, {', '.join(f"{_box('n', k, b, 'bbox', 'DOUBLE')} AS {s}" for k, (b, s) in enumerate(zip(nested.BOX, 'xywh')))}
              FROM (SELECT *, TRY_CAST(json_extract_string(n, '$.confidence') AS DOUBLE) AS c FROM ({_REPORT_NODES}))))
  WHERE k = 1)"""
_NOISE = r"(regexp_matches(coalesce(text, ''), '[A-Za-z가-힣]') AND length(regexp_replace(coalesce(text, ''), '[^@#=<>+\-^_\[\](){}\\|0-9]', '', 'g')) >= 4)"
_TOKENS = r"list_filter(regexp_split_to_array(replace(coalesce(text, ''), '@', ' @ '), '\s+'), lambda t: t <> '')"
_TABLE = f"(len({_TOKENS}) >= 6 AND len(list_filter({_TOKENS}, lambda t: regexp_matches(t, '[0-9]') OR t IN ('@', 'O', 'X'))) >= 0.55 * len({_TOKENS}))"
_FLAGS = f"""
flags AS (
  SELECT *, coalesce(confidence, 0) < 0.5 AS low, coalesce(boxed AND (w / page_w > 0.72 OR h / page_h > 0.08), false) AS shape, {_NOISE} AS noise, {_TABLE} AS table_like,
    coalesce(boxed AND w / page_w > 0.62 AND ({_NOISE} OR {_TABLE}), false) AS mixed, coalesce(boxed AND x < page_w / 2 AND x + w > page_w / 2, false) AS crosses,
    CASE WHEN NOT boxed THEN NULL WHEN x + w / 2 < 0.42 * page_w THEN 'left' WHEN x + w / 2 > 0.58 * page_w THEN 'right' ELSE 'middle' END AS "column"
  FROM nodes)"""
_ORDERS = """
lined AS (SELECT *, coalesce(avg(CASE WHEN boxed AND h > 0 THEN h END) OVER (PARTITION BY doc, page), 1.0) AS line FROM nodes),
steps AS (
  SELECT *, lag(boxed) OVER s AS p_boxed, lag(node_id) OVER s AS p_id, lag(x) OVER s AS px, lag(y) OVER s AS py, lag(h) OVER s AS ph
  FROM lined WINDOW s AS (PARTITION BY doc, page ORDER BY coalesce(ord, 0), node_id)),
warns AS (
  SELECT doc, page, 'LARGE_VERTICAL_GAP' AS type, p_id AS from_node_id, node_id AS to_node_id, round(y - (py + ph), 3) AS size FROM steps
  WHERE boxed AND p_boxed AND y - (py + ph) > greatest(0.18 * page_h, 8 * line)
  UNION ALL SELECT doc, page, 'SAME_BAND_X_BACKTRACK', p_id, node_id, round(px - x, 3) FROM steps WHERE boxed AND p_boxed AND px - x > 0.35 * page_w AND abs(y - py) < 2 * line)"""
_OVERLAPS = """
pairs AS (
  SELECT a.doc, a.page, a.node_id AS node_a, b.node_id AS node_b,
    greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / greatest(least(a.w * a.h, b.w * b.h), 1.0) AS r
  FROM nodes a JOIN nodes b ON a.doc = b.doc AND a.page = b.page AND a.boxed AND b.boxed AND (coalesce(a.ord, 0), a.node_id) < (coalesce(b.ord, 0), b.node_id)),
lapped AS (SELECT doc, page, node_a, node_b, round(r, 6) AS ratio FROM pairs WHERE r >= {threshold})"""


def page_node_flags(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-01..06: flags of each node."""
    return pages.node_flags(nodes(spark, folder), KEYS).select(*KEYS, "node_id", "low", "shape", "noise", "table_like", "mixed", "crosses", "column")


def page_order_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-01: jumps in the reading order."""
    return pages.order_warnings(nodes(spark, folder), KEYS)


def page_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """JN-06: overlapping pairs of a page."""
    return pages.overlapping_pairs(nodes(spark, folder), KEYS, 0.05)


def page_quality(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-01, AGG-03, AGG-07: quality and priority of each page."""
    return pages.page_quality(nodes(spark, folder), KEYS)


def report_totals(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-02: totals by report and over all, from the pages."""
    q = pages.page_quality(nodes(spark, folder), KEYS)
    return q.rollup("doc").agg(F.count("*").alias("pages"), F.sum("node_count").alias("nodes"), F.sum("low_count").alias("low"), F.sum("diagnostic").alias("diagnostic"))


def page_priorities(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-07, SRT-04: the first five pages of each report by review priority."""
    q = pages.page_quality(nodes(spark, folder), KEYS).where("priority > 0")
    return sequences.top_k(q, ["doc"], [F.desc("priority"), "page"], 5).select("doc", "page", "priority", "place")


def page_lowest(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-01, PRJ-04, SRT-05: the first three low-confidence nodes of each page."""
    return pages.lowest_confidence(nodes(spark, folder), KEYS, 3)


def page_columns(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-08: two-column decision."""
    return pages.column_decision(nodes(spark, folder), KEYS, 2, 2)


def page_column_order(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-01, WIN-02: reading order by columns."""
    return pages.column_order(nodes(spark, folder), KEYS).select(*KEYS, "node_id", "new_ord")


def page_guides(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-07: guide pages."""
    return pages.guide_pages(nodes(spark, folder), KEYS)


def page_union_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-02: the box around a page's nodes."""
    return pages.union_boxes(nodes(spark, folder), KEYS)


def page_scaled_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-01, PRJ-05: boxes as shares of the page, and padded crops."""
    f = F.col
    n = nodes(spark, folder).where(pages.HAS_BOX)
    n = n.withColumn("s", V.scaled_box(f("x"), f("y"), f("w"), f("h"), f("page_w"), f("page_h"))).withColumn("c", V.crop_box(f("x"), f("y"), f("w"), f("h"), f("page_w"), f("page_h"), 8.0))
    return n.select(*KEYS, "node_id", f("s.x").alias("sx"), f("s.y").alias("sy"), f("s.width").alias("sw"), f("s.height").alias("sh"), "c.left", "c.top", "c.right", "c.bottom")


def _parts(n: DataFrame) -> DataFrame:
    return n.where(pages.HAS_BOX).select(*KEYS, F.col("node_id").alias("id"), "x", "y", "w", "h")


def _regions(n: DataFrame) -> DataFrame:
    """Wide nodes grown by 40 stand for regions."""
    return n.where(pages.HAS_BOX).where("w > 500").selectExpr(*KEYS, "node_id as id", "x - 40 as x", "y - 40 as y", "w + 80 as w", "h + 80 as h")


def page_containers(spark: SparkSession, folder: str) -> DataFrame:
    """JN-07: each node's enclosing region."""
    n = nodes(spark, folder)
    return pages.best_container(_parts(n), _regions(n), KEYS)


def page_barriers(spark: SparkSession, folder: str) -> DataFrame:
    """JN-08: nodes across two or more regions."""
    n = nodes(spark, folder)
    return pages.barrier_crossers(_parts(n), _regions(n), KEYS, 0.05)


def page_regions_inside(spark: SparkSession, folder: str) -> DataFrame:
    """JN-09: nodes that a region holds, from left to right."""
    n = nodes(spark, folder)
    return pages.regions_in(_regions(n), _parts(n), KEYS)


def page_captions(spark: SparkSession, folder: str) -> DataFrame:
    """JN-10: the box right below each node."""
    n = nodes(spark, folder)
    return pages.nearest_below(_parts(n), _parts(n), KEYS)


def page_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-03: scopes of a page that begin at nodes with a choice mark."""
    n = pages.scopes(nodes(spark, folder), KEYS, F.coalesce(F.col("text").rlike(X.CHOICE_MARK), F.lit(False)))
    return n.groupBy(*KEYS, "scope").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"))


def page_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """JN-03, AGG-04, AGG-05: pages of the two halves of the reports compared by page id, with deltas and verdict."""
    n = nodes(spark, folder).withColumn("half", F.when(F.substring("doc", -1, 1) < "8", "b").otherwise("c"))
    side = lambda s: pages.page_quality(n.where(F.col("half") == s).withColumn("doc", F.lit("all")).withColumn("node_id", F.concat("node_id", F.lit("/"), F.col("half"))), KEYS).select("page", "node_count", "mean_confidence", "diagnostic")
    c = compare.compared(side("b"), side("c"), ["page"], ["node_count", "mean_confidence", "diagnostic"])
    r = compare.ratio_delta(F.col("b_node_count"), F.col("c_node_count"))
    d = F.col("c_mean_confidence") - F.col("b_mean_confidence")
    return c.select("page", "status", F.round(r, 6).alias("node_ratio"), F.round(d, 6).alias("confidence_delta"), compare.verdict(F.col("status"), r, d, F.col("b_diagnostic"), F.col("c_diagnostic")).alias("verdict"))


def page_recommendation(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-05: what the verdicts recommend."""
    return compare.recommendation(page_comparison(spark, folder))


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-01, SRT-03, STR-12: nodes gathered into lines."""
    return pages.cluster_lines(nodes(spark, folder), KEYS)


def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-02: lines gathered into blocks."""
    return pages.cluster_blocks(page_lines(spark, folder).drop("text"), KEYS)


_BASELINES = """
tok AS (SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY y + h / 2, x, node_id) AS k, coalesce(text, '') AS text, x, y, w, h FROM nodes WHERE boxed),
grown AS (
  SELECT doc, page, k, [[struct_pack(x := x, k := k, y := y, w := w, h := h, text := text)]] AS lines FROM tok WHERE k = 1
  UNION ALL
  SELECT doc, page, k, CASE WHEN fit IS NULL OR fit = 0 THEN list_append(lines, [t]) ELSE list_transform(lines, lambda l, i: CASE WHEN i = fit THEN list_append(l, t) ELSE l END) END
  FROM (SELECT g.doc, g.page, t.k, g.lines, struct_pack(x := t.x, k := t.k, y := t.y, w := t.w, h := t.h, text := t.text) AS t,
          list_position(list_transform(g.lines, lambda l:
            abs(t.y + t.h / 2 - list_aggregate(list_transform(l, lambda m: m.y + m.h / 2), 'median')) <= 0.65 * greatest(greatest(t.h, 1.0), list_aggregate(list_transform(l, lambda m: greatest(m.h, 1.0)), 'median'))
            AND greatest(t.x - list_max(list_transform(l, lambda m: m.x + m.w)), list_min(list_transform(l, lambda m: m.x)) - (t.x + t.w), 0.0)
              <= 8.0 * greatest(greatest(t.h, 1.0), list_aggregate(list_transform(l, lambda m: greatest(m.h, 1.0)), 'median'))), true) AS fit
        FROM grown g JOIN tok t ON g.doc IS NOT DISTINCT FROM t.doc AND g.page IS NOT DISTINCT FROM t.page AND t.k = g.k + 1)),
cut AS (SELECT doc, page, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY k DESC) AS r FROM grown) WHERE r = 1),
boxes AS (
  SELECT doc, page, i, len(l) AS tokens, list_sort(l) AS s, list_aggregate(list_transform(l, lambda m: greatest(m.h, 1.0)), 'median') AS tall, list_min(list_transform(l, lambda m: m.x)) AS x, list_min(list_transform(l, lambda m: m.y)) AS y,
    list_max(list_transform(l, lambda m: m.x + m.w)) AS r, list_max(list_transform(l, lambda m: m.y + m.h)) AS b FROM cut),
baselines AS (
  SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY y, x, i) - 1 AS INTEGER) AS line, CAST(tokens AS INTEGER) AS tokens,
    array_to_string(list_transform(s, lambda m, n: CASE WHEN n > 1 AND m.x - (s[n - 1].x + s[n - 1].w) > 0.45 * tall THEN ' ' ELSE '' END || m.text), '') AS text, x, y, r - x AS w, b - y AS h FROM boxes)
"""
_BLOCKS = _BASELINES + """,
ranked_lines AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y, x, line) AS k, median(h) OVER (PARTITION BY doc, page) AS typical FROM baselines),
stacked AS (
  SELECT doc, page, k, line, x, y, w, h, [struct_pack(x := x, y := y, w := w, h := h)] AS tails, CAST(0 AS BIGINT) AS block FROM ranked_lines WHERE k = 1
  UNION ALL
  SELECT doc, page, k, line, x, y, w, h,
    CASE WHEN fit IS NULL THEN list_append(tails, t) ELSE list_transform(tails, lambda b, i: CASE WHEN i = fit THEN t ELSE b END) END, coalesce(fit - 1, len(tails))
  FROM (SELECT g.doc, g.page, t.k, t.line, t.x, t.y, t.w, t.h, g.tails, struct_pack(x := t.x, y := t.y, w := t.w, h := t.h) AS t,
          list_min(list_filter(list_transform(g.tails, lambda b, i: struct_pack(gap := t.y - (b.y + b.h), i := i, share := greatest(0.0, least(b.x + b.w, t.x + t.w) - greatest(b.x, t.x)) / greatest(least(b.w, t.w), 1.0))),
            lambda c: c.gap >= 0 AND c.gap <= 1.35 * t.typical AND c.share >= 0.2)).i AS fit
        FROM stacked g JOIN ranked_lines t ON g.doc IS NOT DISTINCT FROM t.doc AND g.page IS NOT DISTINCT FROM t.page AND t.k = g.k + 1))
"""


def page_validation(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-13, SET-03: validation counters of pages whose order lists only nodes with a box."""
    n = nodes(spark, folder)
    order = sequences.reindexed(n.where(pages.HAS_BOX).withColumn("o", F.coalesce("ord", F.lit(0))), KEYS, ["o", "node_id"], "position").select(*KEYS, "position", "node_id")
    return pages.validation_counters(n, order, KEYS)


def page_block_order(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-02: nodes ordered as blocks, the topmost tenth as header and the lowest as footer."""
    n = nodes(spark, folder).where(pages.HAS_BOX)
    label = F.when(F.expr("y < 0.1 * page_h"), "header").when(F.expr("y > 0.9 * page_h"), "footer").otherwise("text")
    b = n.select(*KEYS, F.col("node_id").alias("id"), label.alias("label"), "y", "ord", F.when(F.col("ord") % 3 != 0, F.col("ord")).alias("block_order"), F.coalesce("ord", F.lit(0)).alias("seq"))
    return layout.block_order(b, KEYS).select(*KEYS, "id", "place")


def page_promotions(spark: SparkSession, folder: str) -> DataFrame:
    """SRT-08, GRD-05: regions in the order of the first node they contain."""
    n = nodes(spark, folder)
    texts = n.where(pages.HAS_BOX).select(*KEYS, F.col("node_id").alias("id"), F.coalesce("ord", F.lit(0)).alias("ord"), "x", "y", "w", "h")
    return layout.promotion_order(_regions(n), texts, KEYS)


def page_splits(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-04: pieces of nodes that lie across two or more regions."""
    n = nodes(spark, folder)
    return layout.split_at_barriers(_parts(n), _regions(n), KEYS, 0.05)


def page_gap_text(spark: SparkSession, folder: str) -> DataFrame:
    """STR-12: a page's node ids from left to right, with blanks where the gap is wide."""
    n = nodes(spark, folder).select(*KEYS, F.col("node_id").alias("id"), F.col("node_id").alias("text"), "x", "w", "h")
    return layout.gap_joined(n, KEYS)


def candidate_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-27: what the recognised replacements of each page still need."""
    r = layout.replacement_review(table(spark, folder, "paddleocr_split_ocr_reconciliation_summary_p102"), ["scan_session_id", "page_id"], "status", "source_text_node_id")
    return r.withColumn("open_nodes", F.concat_ws(",", "open_nodes"))


_BEST = """
met AS (
  SELECT a.doc, a.page, a.node_id AS part_id, b.node_id AS region_id, b.w * b.h AS size, a.x AS ax,
    greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / greatest(a.w * a.h, 1.0) AS r,
    a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h AS inside
  FROM nodes a JOIN (SELECT doc, page, node_id, x - 40 AS x, y - 40 AS y, w + 80 AS w, h + 80 AS h FROM nodes WHERE boxed AND w > 500) b ON a.doc = b.doc AND a.page = b.page AND a.boxed)"""
_QUALITY = f"""
{_NODES}, {_FLAGS}, {_ORDERS}, {_OVERLAPS.replace('{threshold}', '0.35')},
per AS (
  SELECT doc, page, count(*) AS node_count, round(sum(CAST(round(confidence * 1e9) AS BIGINT)) / (count(confidence) * 1000.0)) / 1e6 AS mean_confidence, round(min(confidence), 6) AS min_confidence, count(*) FILTER (low) AS low_count, count(*) FILTER (shape) AS shape_count,
    count(*) FILTER (mixed) + CASE WHEN count(*) FILTER (crosses AND w / page_w > 0.45) >= 3 AND count(*) FILTER ("column" = 'left') >= 3 AND count(*) FILTER ("column" = 'right') >= 3 THEN 1 ELSE 0 END
      + CASE WHEN count(*) FILTER (table_like AND w / page_w > 0.35) > 0 THEN 1 ELSE 0 END AS region_count
  FROM flags GROUP BY 1, 2),
quality AS (
  SELECT per.*, coalesce(o.n, 0) AS order_count, coalesce(v.n, 0) AS overlap_count, low_count + coalesce(o.n, 0) + region_count + coalesce(v.n, 0) AS diagnostic,
    low_count + 3 * coalesce(o.n, 0) + 3 * coalesce(v.n, 0) + 2 * shape_count + 4 * region_count AS priority
  FROM per LEFT JOIN (SELECT doc, page, count(*) AS n FROM warns GROUP BY 1, 2) o USING (doc, page) LEFT JOIN (SELECT doc, page, count(*) AS n FROM lapped GROUP BY 1, 2) v USING (doc, page))"""
_COMPARISON = f"""
{_NODES.replace('nodes AS', 'raw AS', 1)},
split AS (SELECT *, substr(doc, -1, 1) < '8' AS b FROM raw),
{{parts}},
both_ AS (
  SELECT page, b.node_count AS bn, c.node_count AS cn, b.mean_confidence AS bm, c.mean_confidence AS cm, b.diagnostic AS bd, c.diagnostic AS cd,
    CASE WHEN b.node_count IS NULL THEN 'CANDIDATE_ONLY' WHEN c.node_count IS NULL THEN 'BASELINE_ONLY' ELSE 'COMPARED' END AS status
  FROM qb b FULL JOIN qc c USING (page)),
measured AS (SELECT *, CASE WHEN bn = 0 THEN CASE WHEN cn > 0 THEN 1.0 ELSE 0.0 END ELSE CAST(cn - bn AS DOUBLE) / bn END AS r, cm - bm AS d FROM both_),
comparison AS (
  SELECT page, status, round(r, 6) AS node_ratio, round(d, 6) AS confidence_delta,
    CASE WHEN status = 'CANDIDATE_ONLY' THEN 'REVIEW' WHEN status = 'BASELINE_ONLY' THEN 'BASELINE_PREFERRED' WHEN abs(r) >= 0.45 THEN 'REVIEW' WHEN cd < bd AND (d IS NULL OR d >= -0.08) THEN 'CANDIDATE_PREFERRED'
      WHEN cd > bd AND (d IS NULL OR d <= 0.08) THEN 'BASELINE_PREFERRED' WHEN d >= 0.08 AND cd <= bd + 1 THEN 'CANDIDATE_PREFERRED' WHEN d <= -0.08 AND bd <= cd + 1 THEN 'BASELINE_PREFERRED' ELSE 'TIE_OR_REVIEW' END AS verdict
  FROM measured)"""


def _half(name: str, cond: str) -> str:
    """The quality of one half as page rows, in CTEs of their own names."""
    inner = _QUALITY.replace(_NODES, f"\nnodes AS (SELECT * EXCLUDE (doc, node_id, b), 'all' AS doc, node_id || '/' || CASE WHEN b THEN 'b' ELSE 'c' END AS node_id FROM split WHERE {cond})")
    return f"{name} AS (WITH {inner} SELECT page, node_count, mean_confidence, diagnostic FROM quality)"


_COMPARISON = _COMPARISON.replace("{parts}", _half("qb", "b") + ",\n" + _half("qc", "NOT b"))

SQL = {
    "page_lines": f"WITH RECURSIVE {_NODES}, {_BASELINES} SELECT doc, page, line, tokens, text, x, y, w, h FROM baselines",
    "page_blocks": f"WITH RECURSIVE {_NODES}, {_BLOCKS} SELECT doc, page, line, x, y, w, h, CAST(block AS INTEGER) AS block FROM stacked",
    "page_node_flags": f"WITH {_NODES}, {_FLAGS} SELECT doc, page, node_id, low, shape, noise, table_like, mixed, crosses, \"column\" FROM flags",
    "page_order_warnings": f"WITH {_NODES}, {_ORDERS} SELECT doc, page, type, from_node_id, to_node_id, size FROM warns",
    "page_overlaps": f"WITH {_NODES}, {_OVERLAPS.replace('{threshold}', '0.05')} SELECT doc, page, node_a, node_b, ratio FROM lapped",
    "page_quality": f"WITH {_QUALITY} SELECT doc, page, node_count, mean_confidence, min_confidence, low_count, shape_count, order_count, overlap_count, region_count, diagnostic, priority FROM quality",
    "report_totals": f"WITH {_QUALITY} SELECT doc, count(*) AS pages, CAST(sum(node_count) AS BIGINT) AS nodes, CAST(sum(low_count) AS BIGINT) AS low, CAST(sum(diagnostic) AS BIGINT) AS diagnostic FROM quality GROUP BY ROLLUP (doc)",
    "page_priorities": f"WITH {_QUALITY} SELECT doc, page, priority, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY priority DESC, page) AS place FROM quality WHERE priority > 0) WHERE place <= 5",
    "page_lowest": f"WITH {_NODES} SELECT doc, page, CAST(place AS INTEGER) AS place, node_id, confidence, left(text, 120) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY coalesce(ord, 0), node_id) AS place FROM nodes WHERE coalesce(confidence, 0) < 0.5) WHERE place <= 3",
    "page_columns": f"""WITH {_NODES}, body AS (
  SELECT *, greatest(0, least(1, CAST(trunc((y - 0.08 * page_h) / (greatest(0.86 * page_h, 1.0) / 2)) AS INTEGER))) AS band, CASE WHEN x + w / 2 < 0.46 * page_w THEN 'l' WHEN x + w / 2 > 0.54 * page_w THEN 'r' END AS side
  FROM nodes WHERE boxed AND y > 0.08 * page_h AND y < 0.94 * page_h AND NOT (x < page_w / 2 AND x + w > page_w / 2 AND w / page_w > 0.45)),
c AS (SELECT doc, page, count(*) FILTER (side = 'l') AS lefts, count(*) FILTER (side = 'r') AS rights, count(DISTINCT band) FILTER (side = 'l') AS left_bands, count(DISTINCT band) FILTER (side = 'r') AS right_bands FROM body GROUP BY 1, 2)
SELECT *, lefts >= 2 AND rights >= 2 AND left_bands >= 2 AND right_bands >= 2 AS two_columns FROM c""",
    "page_column_order": f"""WITH {_NODES} SELECT doc, page, node_id, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY
  CASE WHEN NOT boxed THEN 1 WHEN y <= 0.08 * page_h THEN 0 WHEN y >= 0.94 * page_h THEN 3 WHEN x + w / 2 < page_w / 2 THEN 1 ELSE 2 END, CASE WHEN boxed THEN y ELSE 0 END, CASE WHEN boxed THEN x ELSE 0 END, coalesce(ord, 0), node_id) - 1 AS INTEGER) AS new_ord FROM nodes""",
    "page_guides": f"""WITH {_NODES}, g AS (
  SELECT doc, page, (coalesce(bool_or(boxed AND y <= 0.2 * page_h AND contains(lower(coalesce(text, '')), '구성')), false) AND coalesce(bool_or(boxed AND y <= 0.2 * page_h AND contains(lower(coalesce(text, '')), '특징')), false))
      OR coalesce(bool_or(boxed AND y <= 0.2 * page_h AND contains(lower(coalesce(text, '')), 'structure')), false) AS header_hit, count(text) AS texts, count(*) FILTER (boxed AND y > 0.15 * page_h AND text IS NOT NULL) AS lower,
    count(*) FILTER (boxed AND y > 0.15 * page_h AND w < 0.55 * page_w AND h < 0.05 * page_h AND length(coalesce(text, '')) <= 120 AND text IS NOT NULL) AS compact
  FROM nodes GROUP BY 1, 2)
SELECT *, header_hit AND texts >= 20 AND lower >= 20 AND compact >= 10 AS exclude FROM g""",
    "page_union_boxes": f"WITH {_NODES} SELECT doc, page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS members, round(sum(CAST(round(confidence * 1e9) AS BIGINT)) / (count(confidence) * 1000.0)) / 1e6 AS confidence FROM nodes WHERE boxed GROUP BY 1, 2",
    "page_scaled_boxes": f"""WITH {_NODES}, c AS (SELECT *, greatest(CAST(floor(x - 8) AS BIGINT), 0) AS l, greatest(CAST(floor(y - 8) AS BIGINT), 0) AS t, least(CAST(ceil(x + w + 8) AS BIGINT), CAST(floor(page_w) AS BIGINT)) AS r, least(CAST(ceil(y + h + 8) AS BIGINT), CAST(floor(page_h) AS BIGINT)) AS b FROM nodes WHERE boxed)
SELECT doc, page, node_id, round(x / page_w, 6) AS sx, round(y / page_h, 6) AS sy, round(w / page_w, 6) AS sw, round(h / page_h, 6) AS sh,
  CASE WHEN r > l AND b > t THEN l END AS "left", CASE WHEN r > l AND b > t THEN t END AS top, CASE WHEN r > l AND b > t THEN r END AS "right", CASE WHEN r > l AND b > t THEN b END AS bottom FROM c""",
    "page_containers": f"WITH {_NODES}, {_BEST} SELECT doc, page, part_id, region_id, round(r, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, part_id ORDER BY r DESC, size, region_id) AS k FROM met WHERE r >= 0.55 OR (inside AND r >= 0.25)) WHERE k = 1",
    "page_barriers": f"WITH {_NODES}, {_BEST} SELECT doc, page, part_id, count(*) AS barriers FROM met WHERE r >= 0.05 AND part_id <> region_id GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "page_regions_inside": f"WITH {_NODES}, {_BEST} SELECT doc, page, region_id AS container_id, part_id AS region_id, CAST(row_number() OVER (PARTITION BY doc, page, met.region_id ORDER BY ax, part_id) AS INTEGER) AS place FROM met WHERE r >= 0.5 AND part_id <> met.region_id",
    "page_captions": f"""WITH {_NODES}, c AS (
  SELECT a.doc, a.page, a.node_id AS caption_id, b.node_id AS box_id, b.y - (a.y + a.h) AS gap, abs(a.x + a.w / 2 - b.x - b.w / 2) AS d,
    greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) / greatest(least(a.w, b.w), 1.0) AS share, b.h AS bh
  FROM nodes a JOIN nodes b ON a.doc = b.doc AND a.page = b.page AND a.boxed AND b.boxed AND a.node_id <> b.node_id)
SELECT doc, page, caption_id, box_id, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, caption_id ORDER BY gap, d, box_id) AS k FROM c WHERE gap >= -10 AND gap <= greatest(40, 0.25 * bh) AND share >= 0.25) WHERE k = 1""",
    "page_scopes": f"""WITH {_NODES}, s AS (SELECT *, sum(CASE WHEN regexp_matches(coalesce(text, ''), '[①②③④⑤]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY coalesce(ord, 0), node_id ROWS UNBOUNDED PRECEDING) AS scope FROM nodes)
SELECT doc, page, CAST(scope AS BIGINT) AS scope, count(*) AS n, min(node_id) AS first_id FROM s GROUP BY 1, 2, 3""",
    "page_comparison": f"WITH {_COMPARISON} SELECT * FROM comparison",
    "page_recommendation": f"""WITH {_COMPARISON}, v AS (SELECT count(*) FILTER (verdict = 'CANDIDATE_PREFERRED') AS candidate, count(*) FILTER (verdict = 'BASELINE_PREFERRED') AS baseline, count(*) FILTER (verdict = 'REVIEW') AS review, count(*) FILTER (verdict = 'TIE_OR_REVIEW') AS tie FROM comparison)
SELECT *, CASE WHEN candidate > baseline AND review + tie <= candidate THEN 'CANDIDATE_CAN_ADVANCE_TO_OVERLAY_REVIEW' WHEN baseline > candidate THEN 'KEEP_BASELINE_PENDING_ENGINE_TUNING' ELSE 'REVIEW_REQUIRED_BEFORE_DEFAULT_SWITCH' END AS recommendation FROM v""",
    "page_block_order": f"""WITH {_NODES}, b AS (SELECT *, CASE WHEN y < 0.1 * page_h THEN 0 WHEN y > 0.9 * page_h THEN 3 WHEN ord % 3 <> 0 THEN 1 ELSE 2 END AS rank FROM nodes WHERE boxed)
SELECT doc, page, node_id AS id, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY rank, CASE WHEN rank IN (0, 3) THEN y WHEN rank = 1 THEN ord ELSE coalesce(ord, 0) END, coalesce(ord, 0), node_id) - 1 AS INTEGER) AS place FROM b""",
    "page_promotions": f"""WITH {_NODES}, {_BEST}, f AS (SELECT m.doc, m.page, m.region_id, min(coalesce(n.ord, 0)) AS o FROM met m JOIN nodes n ON n.doc = m.doc AND n.page = m.page AND n.node_id = m.part_id WHERE r >= 0.55 AND part_id <> region_id GROUP BY 1, 2, 3)
SELECT n.doc, n.page, n.node_id AS region_id, CAST(row_number() OVER (PARTITION BY n.doc, n.page ORDER BY f.o IS NULL, f.o, n.y, n.x, n.node_id) - 1 AS INTEGER) AS place FROM nodes n LEFT JOIN f ON f.doc = n.doc AND f.page = n.page AND f.region_id = n.node_id WHERE n.boxed AND n.w > 500""",
    "page_splits": f"""WITH {_NODES}, {_BEST}, m AS (SELECT *, count(*) OVER (PARTITION BY doc, page, part_id) AS k FROM met WHERE r >= 0.05 AND part_id <> region_id)
SELECT m.doc, m.page, m.part_id, m.region_id AS barrier_id, greatest(a.x, b.x - 40) AS x, greatest(a.y, b.y - 40) AS y, least(a.x + a.w, b.x + b.w + 40) - greatest(a.x, b.x - 40) AS w, least(a.y + a.h, b.y + b.h + 40) - greatest(a.y, b.y - 40) AS h
FROM m JOIN nodes a ON a.doc = m.doc AND a.page = m.page AND a.node_id = m.part_id JOIN nodes b ON b.doc = m.doc AND b.page = m.page AND b.node_id = m.region_id WHERE k > 1""",
    "page_gap_text": f"""WITH {_NODES}, g AS (SELECT *, median(h) OVER (PARTITION BY doc, page) AS m, x - lag(x + w) OVER (PARTITION BY doc, page ORDER BY x, node_id) AS gap FROM nodes WHERE x IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL)
SELECT doc, page, string_agg(CASE WHEN gap > 0.45 * m THEN ' ' ELSE '' END || node_id, '' ORDER BY x, node_id) AS text FROM g GROUP BY 1, 2""",
    "candidate_reviews": """SELECT scan_session_id, page_id, count(*) AS candidates, count(*) FILTER (status = 'REVIEW_REPLACE_CANDIDATE') AS accepted, count(*) FILTER (status IS DISTINCT FROM 'REVIEW_REPLACE_CANDIDATE') AS "open",
  coalesce(array_to_string(list_sort(list_distinct(list(source_text_node_id) FILTER (status IS DISTINCT FROM 'REVIEW_REPLACE_CANDIDATE'))), ','), '') AS open_nodes FROM paddleocr_split_ocr_reconciliation_summary_p102 GROUP BY 1, 2""",
    "page_validation": f"""WITH {_NODES}, o AS (SELECT doc, page, node_id, row_number() OVER (PARTITION BY doc, page ORDER BY coalesce(ord, 0), node_id) - 1 AS position FROM nodes WHERE boxed),
v AS (SELECT n.doc, n.page, count(*) AS nodes, CAST(0 AS BIGINT) AS duplicate_ids, CAST(0 AS BIGINT) AS order_duplicates, count(*) FILTER (o.node_id IS NULL) AS missing_in_order, CAST(0 AS BIGINT) AS dangling, count(*) FILTER (ord <> position) AS index_mismatch
      FROM nodes n LEFT JOIN o USING (doc, page, node_id) GROUP BY 1, 2)
SELECT *, missing_in_order + index_mismatch = 0 AS valid FROM v""",
}

QUERIES = {
    q.__name__: q
    for q in (
        page_node_flags, page_order_warnings, page_overlaps, page_quality, report_totals, page_priorities, page_lowest, page_columns, page_column_order, page_guides, page_union_boxes, page_scaled_boxes, page_containers,
        page_barriers, page_regions_inside, page_captions, page_scopes, page_comparison, page_recommendation, page_lines, page_blocks, page_validation, page_block_order, page_promotions, page_splits, page_gap_text, candidate_reviews,
    )
}
