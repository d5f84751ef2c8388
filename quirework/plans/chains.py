"""Queries over documents as pages: tables, problems, focus items, utterances, revisions, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.functions import text as X, values as V
from quirework.operators import documents, layout, nested, pages, sequences, statistics, tables
from quirework.plans.problems import _SIDES, _box
from quirework.session import table
from quirework.sources import files


def _html(spark: SparkSession, folder: str) -> DataFrame:
    """(id, html): a table for each region, with the region's name in one cell beside all its nations."""
    joined = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = joined.groupBy(F.col("n_regionkey").alias("id"), "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    head = F.concat(F.lit("<table><tr><th>Region</th><th>Nation &amp; key</th></tr><tr><td rowspan='"), F.size("names").cast("string"), F.lit("'>"), F.col("r_name"), F.lit("</td>"))
    rows = F.concat_ws("</tr><tr>", F.transform("names", lambda n: F.concat(F.lit("<td>"), n, F.lit("</td>"))))
    return per.select("id", F.concat(head, rows, F.lit("</tr></table>")).alias("html"))


def html_cells(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-10, ARR-01: cells of tables with merged cells, placed on their grid."""
    return tables.table_cells(_html(spark, folder), "id", "html")


def html_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """ARR-02: size and confidence of each table, and the estimated box of its last cell."""
    cells = html_cells(spark, folder)
    shape = tables.table_shape(cells, "id")
    last = cells.groupBy("id").agg(F.max(F.struct("row", "column", "row_span", "column_span")).alias("c"))
    box = tables.cell_box(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(60.0), F.col("rows"), F.col("columns"), F.col("c.row"), F.col("c.column"), F.col("c.row_span"), F.col("c.column_span"))
    return shape.join(last, "id").withColumn("b", box).select("id", "rows", "columns", "cells", "confidence", *[F.round(f"b.{n}", 6).alias(n) for n in ("x", "y", "width", "height")])


def html_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-12: the cell that covers the first place of each row, merged cells included, and one place outside."""
    cells = html_cells(spark, folder)
    places = cells.select("id", F.col("row").alias("at_row"), F.lit(1).alias("at_column")).union(cells.select("id", F.lit(1), F.lit(9))).distinct()
    return tables.cell_at(cells, places, "id").select("id", "at_row", "at_column", "row", "column", "text")


def doc_math_spans(spark: SparkSession, folder: str) -> DataFrame:
    """STR-06, STR-07: texts with a formula between dollar signs, cut into spans without the signs."""
    lines = table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where("contains(line, '=') and not contains(line, '$')").distinct()
    spans = X.inline_math_spans(F.concat(F.lit("식 $"), "line", F.lit("$ 끝 $$ x $$")))
    return lines.select("line", F.posexplode(spans).alias("n", "s")).select("line", "n", "s.text", "s.is_math")


def order_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-10, FLT-11, FLT-14, NUM-07: decision tables over sizes derived from orders."""
    o = table(spark, folder, "orders").select(
        (F.col("o_orderkey") % 4001).cast("int").alias("w"), (F.col("o_custkey") * 13 % 4001).cast("int").alias("h"), F.when(F.col("o_orderstatus") == "F", "RGB").when(F.col("o_orderstatus") == "O", "CMYK").otherwise("L").alias("mode"),
        (F.col("o_totalprice") % 60).alias("blur"), F.element_at(F.array(*[F.lit(x) for x in ("table", " Image", "figure_title", "formula", "text", "seal")]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("label"), F.col("o_totalprice").cast("long").alias("bytes"),
    )
    domain = V.region_domain(F.col("label"), F.col("w") / 8000, F.col("h") / 8000)
    failing = V.first_failing(("GEOMETRY", F.col("w") > 300), ("QUALITY", F.col("blur") > 10), ("TRANSMIT", F.col("h") < 3900))
    d = o.select(V.image_status(F.col("w"), F.col("h"), F.col("mode"), F.col("blur")).alias("status"), domain["domain"].alias("domain"), domain["content_type"].alias("content_type"), failing.alias("failing"), V.wav_millis(F.col("bytes"), F.lit(16000), F.lit(1)).alias("ms"))
    return d.groupBy("status", "domain", "content_type", "failing").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))


def doc_choice_rows(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-13: one-row tables of choice options as one line of text."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "t")).where(F.col("t").rlike(X.CHOICE_MARK))
    cells = lines.select(F.concat_ws("-", "doc_id", "n").alias("table_id"), F.posexplode(X.choice_options("t")).alias("k", "o")).select("table_id", F.lit(1).alias("row"), (F.col("k") + 1).alias("column"), F.concat(F.lit(" "), "o.label", F.lit(" "), "o.text").alias("text"))
    return layout.choice_rows(cells, "table_id")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages: a node for each line that is not blank, with a box."""
    d = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).where("trim(text) <> ''")
    return d.select("doc_id", F.concat(F.lit("n"), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("node_id"), "ord", "text", F.lit(0.9).alias("confidence"), F.lit(0.0).alias("x"), (F.col("ord") * 10.0).alias("y"), F.char_length("text").cast("double").alias("w"), F.lit(8.0).alias("h"))


def doc_problem_members(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-14, GRD-03: members of the problems in each document, by role."""
    return pages.problem_units(_lines(spark, folder), ["doc_id"])


def doc_problem_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-03: the box around each problem."""
    n = _lines(spark, folder)
    return pages.unit_boxes(pages.problem_units(n, ["doc_id"]), n, ["doc_id"]).drop("confidence")


def doc_problem_order(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-03: the reading order with each problem in the place of its first member."""
    n = _lines(spark, folder)
    return pages.unit_order(n, pages.problem_units(n, ["doc_id"]), ["doc_id"])


def doc_problem_report(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-14: problems of each document."""
    return layout.unit_report(doc_problem_members(spark, folder), ["doc_id"])


def doc_focus_items(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-07: lines as focus items, the members of a problem in its place by role."""
    n = _lines(spark, folder).withColumn("kind", F.lit("TEXT"))
    m = doc_problem_members(spark, folder)
    heads = m.where("role = 'stem'").groupBy("doc_id", "scope").agg(F.min("node_id").alias("problem_id"))
    return documents.focus_items(n, m.join(heads, ["doc_id", "scope"]), ["doc_id"])


def doc_utterances(spark: SparkSession, folder: str) -> DataFrame:
    """MAP-01: what is spoken: items, their sentences and table cells, each under its key."""
    items = table(spark, folder, "eval_items").select(F.concat(F.lit("e"), "item_id").alias("item_id"), "text")
    spans = items.select("item_id", F.posexplode(F.split("text", r"(?<=\.) ")).alias("i", "text"))
    cells = html_cells(spark, folder).select(F.concat(F.lit("t"), "id").alias("item_id"), "row", "column", "text")
    return documents.utterances(items, spans, cells)


def doc_preflight(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-29: utterances against the audio there is (that of items with an even answer and of all cells, and one entry too many)."""
    u = doc_utterances(spark, folder)
    audio = u.where("key like 't%' or key like '%#0'").select("key").union(spark.range(1).select(F.lit("gone").alias("key")))
    return documents.preflight(u, audio, "key")


def doc_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-06, FLT-09: documents with answer choices reduced to one visual node; which nodes stay in the primary order."""
    n = _lines(spark, folder).withColumn("kind", F.lit("TEXT"))
    out = documents.excluded_pages(n.select("doc_id", "node_id", "ord", "kind"), ["doc_id"], n.where(F.col("text").rlike(X.CHOICE_MARK)).select("doc_id"))
    return out.withColumn("primary", pages.primary_order(F.col("kind"), ~F.col("embedded"), F.col("ord").isNotNull()))


def doc_cross_checks(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-09: texts against a reading that lost the fourth and fifth choice mark."""
    p = table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", "[④⑤]", "").alias("first"), F.col("text").alias("second"))
    return documents.cross_checked(p, "first", "second").select("doc_id", "first_marks", "second_marks", "outcome")


def doc_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """STM-19: cursors stored as page numbers, found again in the order of their book by document."""
    d = table(spark, folder, "documents").where("book_id is not null")
    items = sequences.reindexed(d.where("page_no is not null").select("book_id", "doc_id", "page_no"), ["book_id"], ["page_no", "doc_id"], "index").select("book_id", "doc_id", F.col("index").cast("int").alias("index"))
    cursors = d.select("book_id", "doc_id", F.col("n_chars").cast("int").alias("stored"), (F.col("lang") == "ko").alias("same"))
    return documents.reanchored(cursors, items, "book_id", "doc_id", "index", "stored", F.coalesce("same", F.lit(False))).select("book_id", "doc_id", "index", "error")


def doc_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """GRD-13: each book's pages of two revisions put together and checked."""
    d = table(spark, folder, "documents").where("book_id is not null").select("book_id", "doc_id", "page_no", "ingested_at")
    cut = F.lit("2026-02-01").cast("timestamp_ntz")
    late = F.coalesce(F.col("ingested_at") >= cut, F.lit(True))
    return documents.assembled_revision(d.where(~late), d.where(late), ["book_id"], "page_no", "doc_id")


def doc_typed_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ-03: tables, lines with choice marks (as tables of one row and as figures), formulas and other lines as typed nodes, counted."""
    lines = table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("t")).where("trim(t) <> ''").groupBy("t").agg(F.count("*").alias("n"))
    rows = F.concat(F.lit("<table><tr><td>"), F.concat_ws("</td><td>", F.transform(X.choice_options("t"), lambda o: F.concat_ws(" ", o["label"], o["text"]))), F.lit("</td></tr></table>"))
    marked = F.col("t").rlike(X.CHOICE_MARK)
    kind = F.when(marked, "table").when(F.col("t").rlike("^[0-9a-z=+ ]*=[0-9a-z=+ ]*$"), "formula").when(F.char_length("t") % 7 == 0, "Figure").otherwise("paragraph_title")
    blocks = lines.select(F.sha2("t", 256).alias("id"), kind.alias("label"), F.when(marked, rows).otherwise(F.col("t")).alias("content"))
    blocks = blocks.union(_html(spark, folder).select(F.col("id").cast("string"), F.lit("table"), "html")).union(spark.range(1).select(F.lit("empty"), F.lit("image"), F.lit(" ")))
    nodes = layout.typed_nodes(blocks, "id", "label", "content")
    return nodes.groupBy("content_type", "rows", "columns", "confidence", "handling", F.when(F.col("content_type") != "MATH", F.col("issue")).alias("issue")).agg(F.count("*").alias("n"))


def side_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    """FLT-15: what speaks against each page side as a fixed layout, in a frame of 4000 by 3000."""
    s = nested.page_side_table(table(spark, folder, "input_manifest"))
    faults = V.side_faults(F.col("side"), F.col("box_x"), F.col("box_y"), F.col("box_width"), F.col("box_height"), F.col("area_ratio"), 4000.0, 3000.0)
    return s.select("manifest_id", "capture", "side", F.concat_ws(",", faults).alias("faults")).distinct()


def outbox_latest(spark: SparkSession, folder: str) -> DataFrame:
    """STM-16: deliveries of each message's last attempt; stale ones are left out."""
    return sequences.latest_generation(table(spark, folder, "delivery_outbox").select("delivery_row_id", "outbox_id", "attempt_count"), ["outbox_id"], "attempt_count")


def outbox_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """JN-14: the delivery that a message is recognised by: an exact one before a visual before an ambiguous one, the newest first."""
    kind = F.when(F.col("status") == "acked", "EXACT_DUPLICATE").when(F.col("status") == "sending", "VISUAL_DUPLICATE").when(F.col("status") == "queued", "AMBIGUOUS")
    return statistics.ledger_match(table(spark, folder, "delivery_outbox").where("outbox_id is not null").withColumn("kind", kind), "outbox_id", "kind", "updated_at", "delivery_row_id")


def vector_relations(spark: SparkSession, folder: str) -> DataFrame:
    """JN-12, JN-13: how each vector matches the next one by signs, mean difference and correlation."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("lb")), "vec_id")
    signs = F.aggregate(F.zip_with("embedding", "b", lambda x, y: ((x > 0) != (y > 0)).cast("int")), F.lit(0), lambda s, v: s + v)
    m = pairs.select("label", "lb", signs.alias("bits"), V.mean_abs_error("embedding", "b").alias("mae"), V.correlation("embedding", "b").alias("ncc"))
    tokens = F.coalesce(F.col("label") == F.col("lb"), F.lit(False))
    out = m.select(
        statistics.visual_match(F.col("bits"), F.col("mae"), F.col("ncc"), True).alias("strict"), statistics.visual_match(F.col("bits"), F.col("mae"), F.col("ncc"), False).alias("relaxed"),
        statistics.hybrid_match(F.col("bits"), F.col("mae"), F.col("ncc"), tokens).alias("hybrid"), statistics.contradiction(F.col("bits"), F.col("mae")).alias("contradicted"), statistics.visual_relation(F.col("bits"), F.col("mae"), F.abs("ncc"), F.lit(True)).alias("relation"),
    )
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


def item_records(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-08: item texts that arrive in pieces of seven signs, cut into records at sentence ends."""
    items = table(spark, folder, "eval_items").select("item_id", F.concat(F.regexp_replace("text", r"\. ", ".\r\n"), F.lit("\n")).alias("t"))
    pieces = items.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.char_length("t") - 1) / 7).cast("int")), lambda k: F.substr("t", k * 7 + 1, F.lit(7)))).alias("k", "piece"))
    return files.framed_lines(pieces, ["item_id"], "k", "piece", 90)


_MARK = "[①②③④⑤]"
_HTML = """
names AS (SELECT n_regionkey AS id, r_name, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey),
cells AS (
  SELECT DISTINCT id, 1 AS "row", 1 AS "column", 1 AS row_span, 1 AS column_span, true AS header, 'Region' AS text FROM names
  UNION ALL SELECT DISTINCT id, 1, 2, 1, 1, true, 'Nation & key' FROM names
  UNION ALL SELECT DISTINCT id, 2, 1, CAST(n AS INTEGER), 1, false, r_name FROM names
  UNION ALL SELECT id, CAST(k + 1 AS INTEGER), 2, 1, 1, false, n_name FROM names)"""
_LINES = """
lines AS (
  SELECT doc_id, 'n' || lpad(CAST(ord AS VARCHAR), 6, '0') AS node_id, ord, text, 0.0 AS x, ord * 10.0 AS y, CAST(length(text) AS DOUBLE) AS w, 8.0 AS h
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents) WHERE trim(text) <> '')"""
_UNITS = f"""{_LINES},
scoped AS (SELECT *, sum(CASE WHEN regexp_matches(text, '{pages.PROBLEM_START}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS scope FROM lines),
walked AS (SELECT doc_id, scope, node_id, text, list_distinct(regexp_extract_all(text, '{_MARK}')) AS marks, row_number() OVER (PARTITION BY doc_id, scope ORDER BY ord) AS k, count(*) OVER (PARTITION BY doc_id, scope) AS size FROM scoped WHERE scope > 0),
rules AS (
  SELECT *, CASE WHEN regexp_matches(text, '^({pages.STATEMENT_HEAD})') THEN 'bogi' WHEN regexp_matches(text, '^{pages.CONDITION_HEAD}') THEN 'condition' ELSE 'stem' END AS role, regexp_matches(text, '{pages.SHORT_ANSWER}') AS ends
  FROM walked WHERE size > 1),
steps AS (
  SELECT doc_id, scope, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS pending, CAST([] AS VARCHAR[]) AS seen, CAST([] AS STRUCT(r VARCHAR, n VARCHAR)[]) AS roles, false AS chosen, false AS short, false AS done FROM rules WHERE k = 1
  UNION ALL
  SELECT doc_id, scope, k,
    CASE WHEN len(marks) > 0 THEN list_append(pending, node_id) WHEN stop THEN pending ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN len(marks) > 0 THEN all_seen WHEN stop THEN seen ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN len(marks) > 0 OR stop THEN roles ELSE list_append(list_concat(roles, list_transform(pending, lambda p: struct_pack(r := 'stem', n := p))), struct_pack(r := role, n := node_id)) END,
    chosen OR stop, short OR (len(marks) = 0 AND NOT stop AND role = 'stem' AND ends), stop
  FROM (SELECT s.doc_id, s.scope, t.k, t.node_id, t.marks, t.role, t.ends, s.pending, s.seen, s.roles, s.chosen, s.short, list_distinct(list_concat(s.seen, t.marks)) AS all_seen,
          CASE WHEN len(t.marks) > 0 THEN len(list_distinct(list_concat(s.seen, t.marks))) >= 5 ELSE len(s.pending) > 0 AND len(s.seen) >= 4 END AS stop
        FROM steps s JOIN rules t ON s.doc_id = t.doc_id AND s.scope = t.scope AND t.k = s.k + 1 WHERE NOT s.done)),
ended AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, scope ORDER BY k DESC) AS r FROM steps) WHERE r = 1),
judged AS (
  SELECT doc_id, scope, chosen OR (len(pending) > 0 AND len(seen) >= 4) AS chosen, short,
    list_concat(roles, list_transform(pending, lambda p: struct_pack(r := CASE WHEN chosen OR len(seen) >= 4 THEN 'choices' ELSE 'stem' END, n := p))) AS roles FROM ended),
members AS (
  SELECT doc_id, CAST(scope AS BIGINT) AS scope, m.r AS role, m.n AS node_id, CAST(place - 1 AS INTEGER) AS place
  FROM (SELECT doc_id, scope, unnest(roles) AS m, generate_subscripts(roles, 1) AS place FROM judged WHERE (chosen OR short) AND len(list_filter(roles, lambda m: m.r = 'stem')) > 0))"""
_SPOKEN = f"""{_HTML},
items AS (SELECT 'e' || item_id AS item_id, text FROM eval_items),
spoken AS (
  SELECT key, min(text) AS text FROM (
    SELECT item_id AS key, text FROM items
    UNION ALL SELECT item_id || '#' || i, s FROM (SELECT item_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT item_id, string_split(replace(text, '. ', '.' || chr(1)), chr(1)) AS l FROM items))
    UNION ALL SELECT 't' || id || '#r' || "row" || 'c' || "column", text FROM cells) WHERE trim(text) <> '' GROUP BY 1)"""
_MARKS = "len(list_distinct(regexp_extract_all({0}, '[①②③④⑤]')))"
_SHAPES = "list_transform(range(1, len(a.embedding) + 1), lambda i: {0})"

SQL = {
    "html_cells": f'WITH {_HTML} SELECT id, "row", "column", row_span, column_span, header, text FROM cells',
    "html_shapes": f"""WITH {_HTML}
SELECT id, CAST(n + 1 AS INTEGER) AS rows, 2 AS columns, n + 3 AS cells, CASE WHEN n > 1 THEN 0.5 ELSE 0.9 END AS confidence, 50.0 AS x, round(60.0 * n / (n + 1), 6) AS y, 50.0 AS width, round(60.0 / (n + 1), 6) AS height FROM (SELECT DISTINCT id, n FROM names)""",
    "html_lookup": f"""WITH {_HTML}, p AS (SELECT DISTINCT id, "row" AS at_row, 1 AS at_column FROM cells UNION SELECT DISTINCT id, 1, 9 FROM cells)
SELECT p.id, at_row, at_column, "row", "column", text FROM p LEFT JOIN cells c ON p.id = c.id AND at_row >= "row" AND at_row < "row" + row_span AND at_column >= "column" AND at_column < "column" + column_span""",
    "doc_math_spans": r"""WITH l AS (SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, '=') AND NOT contains(line, '$'))
SELECT line, n, CASE n WHEN 0 THEN '식 ' WHEN 1 THEN trim(line) WHEN 2 THEN ' 끝 ' ELSE 'x' END AS text, n % 2 = 1 AS is_math FROM l, (SELECT CAST(unnest(range(4)) AS INTEGER) AS n)""",
    "order_decisions": """WITH o AS (
  SELECT o_orderkey % 4001 AS w, o_custkey * 13 % 4001 AS h, CASE o_orderstatus WHEN 'F' THEN 'RGB' WHEN 'O' THEN 'CMYK' ELSE 'L' END AS mode, o_totalprice % 60 AS blur, o_orderkey % 6 AS label, CAST(trunc(o_totalprice) AS BIGINT) AS bytes FROM orders),
d AS (
  SELECT CASE WHEN w <= 0 OR h <= 0 THEN 'REJECTED' WHEN greatest(w, h) < 1800 THEN 'LOW_QUALITY' WHEN greatest(w, h) < 2800 OR NOT (w / h BETWEEN 0.68 AND 0.82) OR mode = 'CMYK' OR blur < 25 THEN 'PASS_WITH_CORRECTION' ELSE 'PASS' END AS status,
    CASE label WHEN 0 THEN CASE WHEN h / 8000 >= 0.12 OR w / 8000 * (h / 8000) >= 0.08 THEN 'PROBLEM_BOX_CANDIDATE' ELSE 'TABLE_CANDIDATE' END WHEN 1 THEN 'GRAPH_OR_DIAGRAM_CANDIDATE' WHEN 2 THEN 'VISUAL_OR_PROBLEM_CAPTION_CANDIDATE'
      WHEN 3 THEN 'DISPLAY_FORMULA_CANDIDATE' WHEN 4 THEN 'TEXT_LAYOUT_CANDIDATE' ELSE 'UNKNOWN_STRUCTURE_CANDIDATE' END AS domain,
    CASE label WHEN 0 THEN CASE WHEN h / 8000 >= 0.12 OR w / 8000 * (h / 8000) >= 0.08 THEN 'UNKNOWN' ELSE 'TABLE' END WHEN 1 THEN 'UNSUPPORTED_VISUAL' WHEN 3 THEN 'MATH' ELSE 'UNKNOWN' END AS content_type,
    CASE WHEN NOT w > 300 THEN 'GEOMETRY' WHEN NOT blur > 10 THEN 'QUALITY' WHEN NOT h < 3900 THEN 'TRANSMIT' END AS failing, CAST(round(bytes / 2.0 / 16000 * 1000) AS BIGINT) AS ms FROM o)
SELECT status, domain, content_type, failing, count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM d GROUP BY 1, 2, 3, 4""",
    "doc_choice_rows": f"""WITH l AS (SELECT doc_id || '-' || n AS table_id, t, regexp_extract_all(t, '{_MARK}') AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))
SELECT table_id, array_to_string(list_transform(regexp_extract_all(t, '{_MARK}\\s*([^①②③④⑤]*)', 1), lambda x, i: trim(m[i] || ' ' || trim(x))), ' ') AS text FROM l WHERE len(m) > 1 AND len(m) = len(list_distinct(m))""",
    "doc_problem_members": f"WITH RECURSIVE {_UNITS} SELECT doc_id, scope, role, node_id, place FROM members",
    "doc_problem_boxes": f"WITH RECURSIVE {_UNITS} SELECT doc_id, scope, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS members FROM members JOIN lines USING (doc_id, node_id) GROUP BY 1, 2",
    "doc_problem_order": f"""WITH RECURSIVE {_UNITS}, p AS (SELECT l.doc_id, l.node_id, ord, scope FROM lines l LEFT JOIN members m USING (doc_id, node_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scope ORDER BY ord) AS k FROM p)
SELECT doc_id, node_id AS item, scope, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS place FROM f WHERE scope IS NULL OR k = 1""",
    "doc_problem_report": f"""WITH RECURSIVE {_UNITS}, u AS (SELECT doc_id, scope, count(*) AS n, bool_or(role = 'choices') AS c FROM members GROUP BY 1, 2)
SELECT doc_id, count(*) AS units, CAST(sum(n) AS BIGINT) AS members, count(*) FILTER (c) AS with_choices, count(*) FILTER (NOT c) AS short_answer FROM u GROUP BY 1""",
    "doc_focus_items": f"""WITH RECURSIVE {_UNITS},
heads AS (SELECT doc_id, scope, min(node_id) AS problem_id FROM members WHERE role = 'stem' GROUP BY 1, 2),
m AS (SELECT doc_id, node_id, problem_id, place AS p, CASE role WHEN 'stem' THEN 0 WHEN 'condition' THEN 1 WHEN 'bogi' THEN 2 ELSE 3 END AS r FROM members JOIN heads USING (doc_id, scope)),
j AS (SELECT l.doc_id, l.node_id, l.ord, m.problem_id, m.p, m.r, h.ord AS head_ord FROM lines l LEFT JOIN m USING (doc_id, node_id) LEFT JOIN lines h ON h.doc_id = l.doc_id AND h.node_id = m.problem_id)
SELECT doc_id, node_id AS item_id, 'TEXT' AS kind, problem_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(head_ord, ord), coalesce(r + 1, 0), coalesce(p, 0), node_id) - 1 AS INTEGER) AS place FROM j""",
    "doc_utterances": f"WITH {_SPOKEN} SELECT key, text FROM spoken",
    "doc_preflight": f"""WITH {_SPOKEN}, n AS (SELECT count(*) AS u, count(*) FILTER (key LIKE 't%' OR key LIKE '%#0') AS a FROM spoken)
SELECT u AS utterances, a + 1 AS audio, u - a AS without_audio, CAST(1 AS BIGINT) AS without_utterance, false AS complete FROM n""",
    "doc_exclusions": f"""WITH {_LINES}, out AS (SELECT DISTINCT doc_id FROM lines WHERE regexp_matches(text, '{_MARK}'))
SELECT l.doc_id, node_id, CASE WHEN o.doc_id IS NULL THEN CAST(ord AS INTEGER) END AS ord, 'TEXT' AS kind, o.doc_id IS NOT NULL AS embedded, o.doc_id IS NULL AS "primary" FROM lines l LEFT JOIN out o ON l.doc_id = o.doc_id
UNION ALL SELECT doc_id, doc_id || '-excluded', 0, 'UNSUPPORTED_VISUAL', false, true FROM out""",
    "doc_cross_checks": f"""WITH c AS (SELECT doc_id, {_MARKS.format("regexp_replace(text, '[④⑤]', '', 'g')")} AS a, {_MARKS.format('text')} AS b FROM documents)
SELECT doc_id, a AS first_marks, b AS second_marks, CASE WHEN a BETWEEN 2 AND 4 THEN CASE WHEN b > a THEN 'OMISSION_CONFIRMED' ELSE 'INCONCLUSIVE' END ELSE 'RECORDED' END AS outcome FROM c""",
    "doc_anchors": """WITH i AS (SELECT book_id, doc_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_no, doc_id) - 1 AS INTEGER) AS idx FROM documents WHERE book_id IS NOT NULL AND page_no IS NOT NULL)
SELECT d.book_id, d.doc_id, idx AS "index", CASE WHEN idx IS NULL THEN 'MISSING_ANCHOR' WHEN lang = 'ko' AND idx <> n_chars THEN 'INDEX_DRIFT' END AS error FROM documents d LEFT JOIN i USING (book_id, doc_id) WHERE d.book_id IS NOT NULL""",
    "doc_revisions": """WITH d AS (SELECT book_id, doc_id, page_no, coalesce(ingested_at >= TIMESTAMP '2026-02-01', true) AS late FROM documents WHERE book_id IS NOT NULL),
o AS (SELECT *, lag(page_no) OVER (PARTITION BY book_id ORDER BY late, page_no NULLS FIRST, doc_id) AS before FROM d)
SELECT book_id, count(*) AS pages, count(*) FILTER (NOT late) AS base_pages, count(*) FILTER (late) AS new_pages, count(page_no) - count(DISTINCT page_no) AS repeated_pages, count(*) - count(page_no) AS unnumbered, count(*) FILTER (page_no < before) AS steps_back,
  count(page_no) = count(DISTINCT page_no) AND count(*) = count(page_no) AND count(*) FILTER (page_no < before) = 0 AS valid FROM o GROUP BY 1""",
    "doc_typed_nodes": f"""WITH l AS (SELECT DISTINCT t FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents) WHERE trim(t) <> ''),
k AS (SELECT t, regexp_extract_all(t, '{_MARK}') AS m, length(t) % 7 = 0 AS figure, regexp_matches(t, '^[0-9a-z=+ ]*=[0-9a-z=+ ]*$') AS formula FROM l),
o AS (
  SELECT CASE WHEN len(m) > 1 AND len(m) = len(list_distinct(m)) THEN 'TEXT' WHEN len(m) > 0 THEN 'TABLE' WHEN formula THEN 'MATH' WHEN figure THEN 'UNSUPPORTED_VISUAL' ELSE 'TEXT' END AS content_type,
    CASE WHEN len(m) > 0 AND NOT (len(m) > 1 AND len(m) = len(list_distinct(m))) THEN len(m) END AS columns, CASE WHEN len(m) = 0 AND NOT formula AND figure THEN 'ANNOUNCE_AND_PRESERVE_TEXT' END AS handling,
    CASE WHEN len(m) > 1 AND len(m) = len(list_distinct(m)) THEN 'TABLE_RECLASSIFIED_AS_CHOICE_ROW' END AS issue FROM k)
SELECT content_type, CASE WHEN columns IS NOT NULL THEN 1 END AS rows, CAST(columns AS INTEGER) AS columns, CASE WHEN columns IS NOT NULL THEN 0.9 END AS confidence, handling, issue, count(*) AS n FROM o GROUP BY ALL
UNION ALL SELECT 'TABLE', CAST(n + 1 AS INTEGER), 2, 0.5, NULL, 'TABLE_STRUCTURE_LOW_CONFIDENCE', count(*) FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey) GROUP BY n
UNION ALL SELECT 'UNSUPPORTED_VISUAL', NULL, NULL, NULL, 'ANNOUNCE_ONLY_NO_TEXT_CAPTURED', NULL, 1""",
    "side_fallbacks": f"""WITH s AS (SELECT DISTINCT manifest_id, capture, side, {', '.join(f"{_box('body', k, b, 'bbox_full', 'INTEGER')} AS {b[0]}" for k, b in enumerate(nested.BOX))}, TRY_CAST(json_extract_string(body, '$.area_ratio') AS DOUBLE) AS a FROM ({_SIDES}))
SELECT DISTINCT manifest_id, capture, side, CASE WHEN x IS NULL OR y IS NULL OR w IS NULL OR h IS NULL THEN 'PAGE_NOT_FOUND' ELSE concat_ws(',',
  CASE WHEN CASE WHEN side = 'left' THEN x <= 2 ELSE x + w - 1 >= 3997 END OR y + h - 1 >= 2997 THEN 'OUT_OF_FRAME' END, CASE WHEN h / 3000 < 0.7 THEN 'PARTIAL_VERTICAL_EXTENT' END,
  CASE WHEN w / 4000 < 0.28 THEN 'NARROW_PAGE_EXTENT' END, CASE WHEN NOT a BETWEEN 0.2 AND 0.44 THEN 'PAGE_AREA_OUTLIER' END) END AS faults FROM s""",
    "outbox_latest": "SELECT outbox_id, delivery_row_id, attempt_count FROM (SELECT *, max(attempt_count) OVER (PARTITION BY outbox_id) AS m FROM delivery_outbox WHERE outbox_id IS NOT NULL) WHERE attempt_count = m",
    "outbox_ledger": """WITH k AS (SELECT outbox_id, delivery_row_id, updated_at, CASE status WHEN 'acked' THEN 3 WHEN 'sending' THEN 2 WHEN 'queued' THEN 1 END AS r FROM delivery_outbox WHERE outbox_id IS NOT NULL)
SELECT outbox_id, delivery_row_id, CASE r WHEN 3 THEN 'EXACT_DUPLICATE' WHEN 2 THEN 'VISUAL_DUPLICATE' ELSE 'AMBIGUOUS' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY outbox_id ORDER BY r DESC, updated_at DESC NULLS LAST, delivery_row_id DESC) AS n FROM k WHERE r IS NOT NULL) WHERE n = 1""",
    "vector_relations": f"""WITH p AS (
  SELECT a.label AS la, b.label AS lb, len(a.embedding) AS n, list_sum({_SHAPES.format('CASE WHEN (a.embedding[i] > 0) <> (b.embedding[i] > 0) THEN 1 ELSE 0 END')}) AS bits,
    list_sum({_SHAPES.format('abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))')}) / len(a.embedding) AS mae,
    list_sum({_SHAPES.format('CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)')}) AS ab, list_sum({_SHAPES.format('CAST(a.embedding[i] AS DOUBLE) * CAST(a.embedding[i] AS DOUBLE)')}) AS aa, list_sum({_SHAPES.format('CAST(b.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)')}) AS bb,
    list_sum({_SHAPES.format('CAST(a.embedding[i] AS DOUBLE)')}) AS sa, list_sum({_SHAPES.format('CAST(b.embedding[i] AS DOUBLE)')}) AS sb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT *, (ab - sa * sb / n) / sqrt((aa - sa * sa / n) * (bb - sb * sb / n)) AS ncc FROM p),
v AS (SELECT bits <= 8 AND mae <= 0.03 AND ncc >= 0.9 AS strict, bits <= 18 AND mae <= 0.06 AND ncc >= 0.78 AS relaxed, la = lb AS same, bits >= 20 AND mae >= 0.06 AS contradicted,
  CASE WHEN (bits <= 8 AND mae <= 0.03) OR (abs(ncc) >= 0.18 AND bits <= 28) THEN 'same' WHEN bits >= 20 AND mae >= 0.06 AND abs(ncc) <= 0.08 THEN 'different' ELSE 'ambiguous' END AS relation FROM m)
SELECT strict, relaxed, strict OR (relaxed AND same) AS hybrid, contradicted, relation, count(*) AS n FROM v GROUP BY ALL""",
    "item_records": """WITH l AS (SELECT item_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS s FROM eval_items)
SELECT item_id, CAST(n AS INTEGER) AS line_no, line FROM (SELECT item_id, unnest(s) AS line, unnest(range(len(s))) AS n FROM l) WHERE length(line) <= 90 AND line <> ''""",
}

QUERIES = {
    q.__name__: q
    for q in (
        html_cells, html_shapes, html_lookup, doc_math_spans, order_decisions, doc_choice_rows, doc_problem_members, doc_problem_boxes, doc_problem_order, doc_problem_report, doc_focus_items, doc_utterances, doc_preflight,
        doc_exclusions, doc_cross_checks, doc_anchors, doc_revisions, doc_typed_nodes, side_fallbacks, outbox_latest, outbox_ledger, vector_relations, item_records,
    )
}
