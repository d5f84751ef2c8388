"""Block order, promotion, splitting at barriers, gap-aware text, reviews and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions.formulas import formula_tree_udf
from quirework.functions.text import CHOICE_MARK, without_delimiters
from quirework.functions.values import overlap_area
from quirework.operators import tables


def block_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with place (from 0): headers by height, then blocks with a given order, then the others as they came, then footers by height.

    blocks: keys, id, label, y, block_order, seq.
    """
    rank = F.when(F.col("label") == "header", 0).when(F.col("label") == "footer", 3).when(F.col("block_order").isNotNull(), 1).otherwise(2)
    by = F.when(rank.isin(0, 3), F.col("y")).when(rank == 1, F.col("block_order").cast("double")).otherwise(F.col("seq").cast("double"))
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, by, "seq", "id")) - 1)


def promotion_order(regions: DataFrame, texts: DataFrame, keys: list[str], ratio: float = 0.55) -> DataFrame:
    """(keys, region_id, place): regions in the order of the first text they contain; without texts after those, by height and left edge.

    regions: keys, id, x, y, w, h.  texts: the same with ord.
    """
    a = texts.select(*keys, "ord", *[F.col(n).alias(f"a_{n}") for n in ("id", "x", "y", "w", "h")])
    b = regions.select(*keys, *[F.col(n).alias(f"b_{n}") for n in ("id", "x", "y", "w", "h")])
    held = a.join(b, keys).where(overlap_area("a_", "b_") / F.greatest(F.expr("a_w * a_h"), F.lit(1.0)) >= ratio).where("a_id <> b_id")
    first = held.groupBy(*keys, F.col("b_id").alias("id")).agg(F.min("ord").alias("first_ord"))
    w = Window.partitionBy(*keys).orderBy(F.col("first_ord").isNull(), "first_ord", "y", "x", "id")
    return regions.join(first, [*keys, "id"], "left").select(*keys, F.col("id").alias("region_id"), (F.row_number().over(w) - 1).alias("place"))


def split_at_barriers(parts: DataFrame, barriers: DataFrame, keys: list[str], ratio: float = 0.25) -> DataFrame:
    """(keys, part_id, barrier_id, x, y, w, h): the piece of each part that lies in each barrier covering `ratio` of it, for parts across two or more."""
    a = parts.select(*keys, *[F.col(n).alias(f"a_{n}") for n in ("id", "x", "y", "w", "h")])
    b = barriers.select(*keys, *[F.col(n).alias(f"b_{n}") for n in ("id", "x", "y", "w", "h")])
    met = a.join(b, keys).where("a_id <> b_id").where(overlap_area("a_", "b_") / F.greatest(F.expr("a_w * a_h"), F.lit(1.0)) >= ratio)
    many = met.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "a_id"))).where("__n > 1")
    x, y = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    return many.select(*keys, F.col("a_id").alias("part_id"), F.col("b_id").alias("barrier_id"), x.alias("x"), y.alias("y"), (F.least(F.expr("a_x + a_w"), F.expr("b_x + b_w")) - x).alias("w"), (F.least(F.expr("a_y + a_h"), F.expr("b_y + b_h")) - y).alias("h"))


def gap_joined(tokens: DataFrame, keys: list[str], ratio: float = 0.45) -> DataFrame:
    """(keys, text): tokens of a line from left to right, with a blank only where the gap exceeds ratio times the median height.

    tokens: keys, id, text, x, w, h; tokens without a box are left out.
    """
    line = Window.partitionBy(*keys)
    boxed = tokens.where("x is not null and w is not null and h is not null and text is not null").withColumn("__m", F.median("h").over(line))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(line.orderBy("x", "id"))
    piece = F.concat(F.when(gap > ratio * F.col("__m"), " ").otherwise(""), F.col("text"))
    # Pieces keep their place in a sorted array of structs; the first has no gap.
    return boxed.withColumn("__p", piece).groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("x", "id", "__p")))["__p"], "").alias("text"))


def choice_rows(cells: DataFrame, table_id: str) -> DataFrame:
    """(table_id, text): tables of one row whose cells all begin with different choice marks, as one line of text."""
    mark = F.regexp_extract(F.trim("text"), f"^({CHOICE_MARK})", 1)
    per = cells.withColumn("m", mark).groupBy(table_id).agg(F.max("row").alias("rows"), F.count("*").alias("n"), F.count_if(F.col("m") != "").alias("marked"), F.count_distinct("m").alias("kinds"), F.array_join(F.sort_array(F.collect_list(F.struct("column", F.trim("text").alias("t"))))["t"], " ").alias("text"))
    return per.where("rows = 1 and n > 1 and marked = n and kinds = n").select(table_id, "text")


def unit_report(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, units, members, with_choices, short_answer): problems of a page.  members: keys, scope, role, node_id."""
    per = members.groupBy(*keys, "scope").agg(F.count("*").alias("n"), F.bool_or(F.col("role") == "choices").alias("c"))
    return per.groupBy(*keys).agg(F.count("*").alias("units"), F.sum("n").alias("members"), F.count_if("c").alias("with_choices"), F.count_if(~F.col("c")).alias("short_answer"))


def replacement_review(candidates: DataFrame, keys: list[str], status: str, node: str) -> DataFrame:
    """(keys, candidates, accepted, open, open_nodes): what a page's recognised replacements still need; open_nodes sorted, each once."""
    done = F.col(status) == "REVIEW_REPLACE_CANDIDATE"
    rest = F.coalesce(~done, F.lit(True))
    return candidates.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(done).alias("accepted"), F.count_if(rest).alias("open"), F.sort_array(F.collect_set(F.when(rest, F.col(node)))).alias("open_nodes"))


def screening(rows: DataFrame, row_id: str, schema_ok: str, drop: str, pinned: str | None = None, most: int = 2, limit: float = 0.2) -> DataFrame:
    """(row_id, drop, place, fallback): the worst rows by character drop, a pinned one first; fallback tells whether any row failed its schema or dropped more than limit."""
    bad = ~F.coalesce(schema_ok, F.lit(False)) | (F.coalesce(drop, F.lit(0.0)) > limit)
    verdict = rows.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("fallback"))
    first = F.when(F.col(row_id) == pinned, 0).otherwise(1) if pinned is not None else F.lit(0)
    worst = rows.where((F.col(drop) > 0) | (first == 0 if pinned is not None else F.lit(False))).withColumn("__f", first).orderBy("__f", F.desc(drop), row_id).limit(most)
    placed = worst.withColumn("place", F.row_number().over(Window.orderBy("__f", F.desc(drop), row_id)))  # at most `most` rows
    return placed.join(F.broadcast(verdict)).select(row_id, drop, "place", "fallback")  # one verdict


def visible_items(items: DataFrame, status: str, selectable: str, capture: bool, title: str) -> DataFrame:
    """Items that can be chosen: ready ones, or in capture mode selectable ones and one new entry with the given title first."""
    shown = items.where(F.col(selectable) if capture else F.col(status) == "ready").withColumn("synthetic", F.lit(False))
    if not capture:
        return shown
    kinds = dict(items.dtypes)
    new = items.sparkSession.range(1).select(*[(F.lit(title) if c == "title" else F.lit(None)).cast(kinds[c]).alias(c) for c in items.columns], F.lit(True).alias("synthetic"))
    return new.unionByName(shown)


def clamped(index: Column, count: Column) -> Column:
    """An index kept within 0..count - 1; 0 for an empty list."""
    return F.greatest(F.lit(0), F.least(index, count - 1))


def spread_match(left_hit: Column, right_hit: Column, contradiction: Column | None = None) -> Column:
    """A spread matches if both sides do and, where given, nothing contradicts."""
    hit = F.coalesce(left_hit & right_hit, F.lit(False))
    return hit & ~F.coalesce(contradiction, F.lit(False)) if contradiction is not None else hit


def typed_nodes(blocks: DataFrame, block_id: str, label: str, content: str) -> DataFrame:
    """(block_id, content_type, text, rows, columns, confidence, status, handling, issue): layout blocks as typed nodes.

    A table becomes a TABLE with its size and confidence, or, if it is one row of
    different choice marks, a TEXT; a formula a MATH node with the status of its tree;
    an image, chart or figure an UNSUPPORTED_VISUAL that keeps its text or has none;
    everything else is TEXT.  A null label or content counts as blank text.
    """
    b = blocks.select(block_id, F.lower(F.coalesce(label, F.lit(""))).alias("__l"), F.coalesce(content, F.lit("")).alias("__c"))
    cells = tables.table_cells(b.where("__l = 'table'"), block_id, "__c")
    shape = tables.table_shape(cells, block_id).select(block_id, "rows", "columns", "confidence")
    choices = choice_rows(cells, block_id).withColumnRenamed("text", "__choices")
    t = b.where("__l = 'table'").join(shape, block_id, "left").join(choices, block_id, "left")
    chosen = F.col("__choices").isNotNull()
    no_text, no_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    table_nodes = t.select(
        block_id, F.when(chosen, "TEXT").otherwise("TABLE").alias("content_type"), F.coalesce("__choices", "__c").alias("text"), F.when(~chosen, F.col("rows")).alias("rows"), F.when(~chosen, F.col("columns")).alias("columns"),
        F.when(~chosen, F.coalesce("confidence", F.lit(0.0))).alias("confidence"), no_text.alias("status"), no_text.alias("handling"),
        F.when(chosen, "TABLE_RECLASSIFIED_AS_CHOICE_ROW").when(F.coalesce("confidence", F.lit(0.0)) < 0.8, "TABLE_STRUCTURE_LOW_CONFIDENCE").alias("issue"),
    )
    m = b.where("__l in ('formula', 'equation', 'display_formula')").withColumn("__c", without_delimiters("__c")).withColumn("__f", formula_tree_udf("__c"))
    math_nodes = m.select(block_id, F.lit("MATH"), "__c", no_int, no_int, F.lit(None).cast("double"), F.col("__f.status"), no_text, F.element_at(F.concat("__f.issues", F.array(no_text)), 1))
    rest = b.where("__l not in ('table', 'formula', 'equation', 'display_formula')")
    visual = F.col("__l").isin("image", "chart", "figure")
    handling = F.when(visual, F.when(F.trim("__c") != "", "ANNOUNCE_AND_PRESERVE_TEXT").otherwise("ANNOUNCE_ONLY_NO_TEXT_CAPTURED"))
    others = rest.select(block_id, F.when(visual, "UNSUPPORTED_VISUAL").otherwise("TEXT"), "__c", no_int, no_int, F.lit(None).cast("double"), no_text, handling, no_text)
    return table_nodes.union(math_nodes).union(others)
