"""Page nodes: quality diagnostics, spatial joins, reading order, segmentation.

A node table has the columns page keys (any), node_id, ord, confidence, text and
the box x, y, w, h; page_w and page_h give the page's size.  A box with a null part
is no box.  Every join has the page as equi key, so pages spread over tasks.
"""

from __future__ import annotations


import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions import text as X, values as V

HAS_BOX = "(x is not null and y is not null and w is not null and h is not null)"


def _page(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def _ordered(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.coalesce("ord", F.lit(0)), "node_id")


def node_flags(nodes: DataFrame, keys: list[str], low: float = 0.5, wide: float = 0.72, tall: float = 0.08) -> DataFrame:
    """Nodes with the flags low, shape (suspiciously wide or tall), noise, table_like, mixed, crosses and the centre's column (left, right, middle)."""
    box = F.expr(HAS_BOX)
    share = F.try_divide("w", "page_w")
    centre = F.col("x") + F.col("w") / 2
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        nodes.withColumn("low", F.coalesce("confidence", F.lit(0.0)) < low)
        .withColumn("shape", no(box & ((share > wide) | (F.try_divide("h", "page_h") > tall))))
        .withColumn("noise", X.symbol_noise("text"))
        .withColumn("table_like", X.table_like("text"))
        .withColumn("mixed", no(box & (share > 0.62) & (F.col("noise") | F.col("table_like"))))
        .withColumn("crosses", no(box & (F.col("x") < F.col("page_w") / 2) & (F.col("x") + F.col("w") > F.col("page_w") / 2)))
        .withColumn("column", F.when(~box, None).when(centre < 0.42 * F.col("page_w"), "left").when(centre > 0.58 * F.col("page_w"), "right").otherwise("middle"))
    )


def order_warnings(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type, from_node_id, to_node_id, size) for jumps in the reading order.

    LARGE_VERTICAL_GAP: the gap to the node before exceeds 18 % of the page and eight
    typical heights.  SAME_BAND_X_BACKTRACK: the node starts 35 % of the page further
    left on about the same height.  Pairs with a missing box are skipped.
    """
    w = _ordered(keys)
    typical = F.coalesce(F.avg(F.when(F.expr(HAS_BOX) & (F.col("h") > 0), F.col("h"))).over(_page(keys)), F.lit(1.0))
    before = F.lag(F.when(F.expr(HAS_BOX), F.struct("node_id", "x", "y", "w", "h"))).over(w)
    pairs = nodes.withColumn("line", typical).withColumn("p", before).where(F.col("p").isNotNull() & F.expr(HAS_BOX))
    gap = F.col("y") - (F.col("p.y") + F.col("p.h"))
    back = F.col("p.x") - F.col("x")
    found = F.filter(
        F.array(
            F.when(gap > F.greatest(0.18 * F.col("page_h"), 8 * F.col("line")), F.struct(F.lit("LARGE_VERTICAL_GAP").alias("type"), F.round(gap, 3).alias("size"))),
            F.when((back > 0.35 * F.col("page_w")) & (F.abs(F.col("y") - F.col("p.y")) < 2 * F.col("line")), F.struct(F.lit("SAME_BAND_X_BACKTRACK").alias("type"), F.round(back, 3).alias("size"))),
        ),
        lambda a: a.isNotNull(),
    )
    return pairs.select(*keys, F.col("p.node_id").alias("from_node_id"), F.col("node_id").alias("to_node_id"), F.explode(found).alias("f")).select(*keys, "f.type", "from_node_id", "to_node_id", "f.size")


def overlapping_pairs(nodes: DataFrame, keys: list[str], threshold: float = 0.35) -> DataFrame:
    """(keys, node_a, node_b, ratio): pairs of a page whose shared area is at least threshold of the smaller box.

    The pairs of a page are found along its x axis: each box is entered in the cells
    of a grid it touches, and only boxes of a common cell meet, so a page with many
    small boxes makes few comparisons.
    """
    boxed = nodes.where(HAS_BOX).where("w >= 0 and h >= 0")
    cell = F.greatest(F.max(F.greatest("w", "h")).over(_page(keys)), F.lit(1.0))
    grid = boxed.withColumn("cell", cell).withColumn("c0", F.floor(F.col("x") / F.col("cell")))
    left = grid.select(*keys, F.explode(F.array("c0", F.col("c0") + 1)).alias("c"), *[F.col(n).alias(f"a_{n}") for n in ("node_id", "ord", "x", "y", "w", "h", "c0")])
    right = grid.select(*keys, F.explode(F.array("c0", F.col("c0") + 1)).alias("c"), *[F.col(n).alias(f"b_{n}") for n in ("node_id", "ord", "x", "y", "w", "h", "c0")])
    rank = lambda p: F.struct(F.coalesce(f"{p}ord", F.lit(0)), F.col(f"{p}node_id"))
    met = left.join(right, [*keys, "c"]).where(rank("a_") < rank("b_")).where("a_x < b_x + b_w and b_x < a_x + a_w and a_y < b_y + b_h and b_y < a_y + a_h")
    met = met.where("c = greatest(a_c0, b_c0)")  # a pair may share two cells; it counts in the later of its first cells
    ratio = V.overlap_area("a_", "b_") / F.greatest(F.least(F.expr("a_w * a_h"), F.expr("b_w * b_h")), F.lit(1.0))
    return met.withColumn("ratio", F.round(ratio, 6)).where(ratio >= threshold).select(*keys, F.col("a_node_id").alias("node_a"), F.col("b_node_id").alias("node_b"), "ratio")


def page_quality(nodes: DataFrame, keys: list[str], low: float = 0.5, overlap: float = 0.35) -> DataFrame:
    """One row a page: node_count, mean and min confidence, and the counts of each diagnostic with their sum (diagnostic) and the review priority."""
    flags = node_flags(nodes, keys, low)
    wide = F.try_divide("w", "page_w")
    per = flags.groupBy(*keys).agg(
        F.count("*").alias("node_count"),
        V.exact_mean("confidence").alias("mean_confidence"),
        F.round(F.min("confidence"), 6).alias("min_confidence"),
        F.count_if("low").alias("low_count"),
        F.count_if("shape").alias("shape_count"),
        F.count_if("mixed").alias("mixed_count"),
        F.count_if(F.col("crosses") & (wide > 0.45)).alias("crossing"),
        F.count_if(F.col("column") == "left").alias("lefts"),
        F.count_if(F.col("column") == "right").alias("rights"),
        F.count_if(F.col("table_like") & (wide > 0.35)).alias("tables"),
    )
    orders = order_warnings(nodes, keys).groupBy(*keys).agg(F.count("*").alias("order_count"))
    overlaps = overlapping_pairs(nodes, keys, overlap).groupBy(*keys).agg(F.count("*").alias("overlap_count"))
    region = F.col("mixed_count") + F.when((F.col("crossing") >= 3) & (F.col("lefts") >= 3) & (F.col("rights") >= 3), 1).otherwise(0) + F.when(F.col("tables") > 0, 1).otherwise(0)
    out = per.join(orders, keys, "left").join(overlaps, keys, "left").fillna(0, ["order_count", "overlap_count"]).withColumn("region_count", region)
    return out.withColumn("diagnostic", F.expr("low_count + order_count + region_count + overlap_count")).withColumn(
        "priority", F.expr("low_count + 3 * order_count + 3 * overlap_count + 2 * shape_count + 4 * region_count")
    ).drop("mixed_count", "crossing", "lefts", "rights", "tables")


def lowest_confidence(nodes: DataFrame, keys: list[str], k: int = 20, low: float = 0.5) -> DataFrame:
    """The first k low-confidence nodes of each page in reading order, with at most 120 characters of text."""
    flagged = nodes.where(F.coalesce("confidence", F.lit(0.0)) < low).withColumn("place", F.row_number().over(_ordered(keys)))
    return flagged.where(F.col("place") <= k).select(*keys, "place", "node_id", "confidence", F.substring("text", 1, 120).alias("text"))


def best_container(parts: DataFrame, regions: DataFrame, keys: list[str], ratio: float = 0.55, centre_ratio: float = 0.25) -> DataFrame:
    """(keys, part_id, region_id, ratio): each part's enclosing region.

    A region encloses a part if it covers `ratio` of the part's area, or its centre
    and centre_ratio.  The best covers most, then is smallest, then first by id.
    parts and regions have id, x, y, w, h besides the keys.
    """
    a = parts.select(*keys, *[F.col(n).alias(f"a_{n}") for n in ("id", "x", "y", "w", "h")])
    b = regions.select(*keys, *[F.col(n).alias(f"b_{n}") for n in ("id", "x", "y", "w", "h")])
    met = a.join(b, keys).where("a_x <= b_x + b_w and b_x <= a_x + a_w and a_y <= b_y + b_h and b_y <= a_y + a_h")
    r = V.overlap_area("a_", "b_") / F.greatest(F.expr("a_w * a_h"), F.lit(1.0))
    linked = met.withColumn("ratio", r).where((F.col("ratio") >= ratio) | (V.centre_inside("a_", "b_") & (F.col("ratio") >= centre_ratio)))
    best = F.min(F.struct((-F.col("ratio")).alias("n"), F.expr("b_w * b_h").alias("s"), F.col("b_id").alias("id"))).alias("m")
    return linked.groupBy(*keys, F.col("a_id").alias("part_id")).agg(best).select(*keys, "part_id", F.col("m.id").alias("region_id"), F.round(-F.col("m.n"), 6).alias("ratio"))


def barrier_crossers(parts: DataFrame, barriers: DataFrame, keys: list[str], ratio: float = 0.25) -> DataFrame:
    """(keys, part_id, barriers): parts of which at least two barriers each cover `ratio` of the area."""
    a = parts.select(*keys, *[F.col(n).alias(f"a_{n}") for n in ("id", "x", "y", "w", "h")])
    b = barriers.select(*keys, *[F.col(n).alias(f"b_{n}") for n in ("id", "x", "y", "w", "h")])
    met = a.join(b, keys).where("a_x < b_x + b_w and b_x < a_x + a_w and a_y < b_y + b_h and b_y < a_y + a_h and a_id <> b_id")
    hit = met.where(V.overlap_area("a_", "b_") / F.greatest(F.expr("a_w * a_h"), F.lit(1.0)) >= ratio)
    return hit.groupBy(*keys, F.col("a_id").alias("part_id")).agg(F.count("*").alias("barriers")).where("barriers > 1")


def regions_in(container: DataFrame, regions: DataFrame, keys: list[str], ratio: float = 0.5) -> DataFrame:
    """(keys, container_id, region_id, place): regions of which a container covers `ratio` of the area, numbered from left to right."""
    a = regions.select(*keys, *[F.col(n).alias(f"a_{n}") for n in ("id", "x", "y", "w", "h")])
    b = container.select(*keys, *[F.col(n).alias(f"b_{n}") for n in ("id", "x", "y", "w", "h")])
    met = a.join(b, keys).where("a_id <> b_id").where(V.overlap_area("a_", "b_") / F.greatest(F.expr("a_w * a_h"), F.lit(1.0)) >= ratio)
    place = F.row_number().over(Window.partitionBy(*keys, "b_id").orderBy("a_x", "a_id"))
    return met.select(*keys, F.col("b_id").alias("container_id"), F.col("a_id").alias("region_id"), place.alias("place"))


def nearest_below(captions: DataFrame, boxes: DataFrame, keys: list[str], above: float = 10.0, reach: float = 40.0, reach_share: float = 0.25, least_overlap: float = 0.25) -> DataFrame:
    """(keys, caption_id, box_id, gap): for each caption the box right below it.

    The gap lies between -above and max(reach, reach_share of the box's height), and
    the two share least_overlap of the narrower width.  Nearest by gap, then centre
    distance, then id.
    """
    a = captions.select(*keys, *[F.col(n).alias(f"a_{n}") for n in ("id", "x", "y", "w", "h")])
    b = boxes.select(*keys, *[F.col(n).alias(f"b_{n}") for n in ("id", "x", "y", "w", "h")])
    gap = F.expr("b_y - (a_y + a_h)")
    share = V.span_overlap(F.col("a_x"), F.expr("a_x + a_w"), F.col("b_x"), F.expr("b_x + b_w")) / F.greatest(F.least("a_w", "b_w"), F.lit(1.0))
    met = a.join(b, keys).where("a_id <> b_id").where((gap >= -above) & (gap <= F.greatest(F.lit(reach), reach_share * F.col("b_h"))) & (share >= least_overlap))
    best = F.min(F.struct(gap.alias("gap"), F.abs(F.expr("a_x + a_w / 2 - b_x - b_w / 2")).alias("d"), F.col("b_id").alias("id"))).alias("m")
    return met.groupBy(*keys, F.col("a_id").alias("caption_id")).agg(best).select(*keys, "caption_id", F.col("m.id").alias("box_id"), F.round("m.gap", 6).alias("gap"))


def column_decision(nodes: DataFrame, keys: list[str], per_side: int = 8, bands: int = 4) -> DataFrame:
    """(keys, lefts, rights, left_bands, right_bands, two_columns): enough nodes and enough different heights on both sides.

    Only the body (8 % to 94 % of the page) counts; nodes across the middle that are
    wider than 45 % are on neither side.
    """
    centre = F.col("x") + F.col("w") / 2
    body = nodes.where(HAS_BOX).where("y > 0.08 * page_h and y < 0.94 * page_h").where("not (x < page_w / 2 and x + w > page_w / 2 and w / page_w > 0.45)")
    band = F.greatest(F.lit(0), F.least(F.lit(bands - 1), ((F.col("y") - 0.08 * F.col("page_h")) / (F.greatest(0.86 * F.col("page_h"), F.lit(1.0)) / bands)).cast("int")))
    side = F.when(centre < 0.46 * F.col("page_w"), "l").when(centre > 0.54 * F.col("page_w"), "r")
    sides = body.withColumn("band", band).withColumn("side", side)
    at = lambda s: F.col("side") == s
    out = sides.groupBy(*keys).agg(
        F.count_if(at("l")).alias("lefts"), F.count_if(at("r")).alias("rights"), F.count_distinct(F.when(at("l"), F.col("band"))).alias("left_bands"), F.count_distinct(F.when(at("r"), F.col("band"))).alias("right_bands")
    )
    return out.withColumn("two_columns", F.expr(f"lefts >= {per_side} and rights >= {per_side} and left_bands >= {bands} and right_bands >= {bands}"))


def column_order(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with new_ord (from 0): header, left column, right column, footer; each from top to bottom, then left to right; nodes without a box first in the left column."""
    centre = F.col("x") + F.col("w") / 2
    group = F.when(~F.expr(HAS_BOX), 1).when(F.expr("y <= 0.08 * page_h"), 0).when(F.expr("y >= 0.94 * page_h"), 3).when(centre < F.col("page_w") / 2, 1).otherwise(2)
    w = Window.partitionBy(*keys).orderBy(group, F.coalesce(F.when(F.expr(HAS_BOX), F.col("y")), F.lit(0.0)), F.coalesce(F.when(F.expr(HAS_BOX), F.col("x")), F.lit(0.0)), F.coalesce("ord", F.lit(0)), "node_id")
    return nodes.withColumn("new_ord", F.row_number().over(w) - 1)


def guide_pages(nodes: DataFrame, keys: list[str], words: tuple[str, ...] = ("구성", "특징"), single: str = "structure", least: tuple[int, int, int] = (20, 20, 10)) -> DataFrame:
    """(keys, header_hit, texts, lower, compact, exclude): pages that show how the book is built instead of its content."""
    header = F.expr(f"{HAS_BOX} and y <= 0.2 * page_h")
    lower = F.expr(f"{HAS_BOX} and y > 0.15 * page_h")
    compact = lower & F.expr("w < 0.55 * page_w and h < 0.05 * page_h") & (F.char_length(F.coalesce("text", F.lit(""))) <= 120)
    head = F.lower(F.coalesce("text", F.lit("")))
    out = nodes.groupBy(*keys).agg(
        *[F.coalesce(F.bool_or(header & head.contains(w)), F.lit(False)).alias(f"w{k}") for k, w in enumerate((*words, single))],
        F.count_if(F.col("text").isNotNull()).alias("texts"), F.count_if(lower & F.col("text").isNotNull()).alias("lower"), F.count_if(compact & F.col("text").isNotNull()).alias("compact"),
    )
    hit = F.col(f"w{len(words)}")
    both = F.col("w0")
    for k in range(1, len(words)):
        both = both & F.col(f"w{k}")
    a, b, c = least
    return out.withColumn("header_hit", hit | both).withColumn("exclude", F.col("header_hit") & (F.col("texts") >= a) & (F.col("lower") >= b) & (F.col("compact") >= c)).select(*keys, "header_hit", "texts", "lower", "compact", "exclude")


def union_boxes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, w, h, members, confidence): the box around all boxes of a group, and its mean confidence to 6 digits."""
    return nodes.where(HAS_BOX).groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.count("*").alias("members"), V.exact_mean("confidence").alias("confidence"),
    )


def scopes(nodes: DataFrame, keys: list[str], starts: Column) -> DataFrame:
    """Nodes with scope: 0 before the first start, then the number of starts so far; a scope runs to the next start."""
    return nodes.withColumn("scope", F.sum(F.when(starts, 1).otherwise(0)).over(_ordered(keys).rowsBetween(Window.unboundedPreceding, 0)))


# Marks that open a problem, ends of a stem that call for a short answer, heads of a list of statements and of conditions.
PROBLEM_START = r"\[[0-9]{5}-[0-9]{4}\]|[0-9]{4}학년도\s*(수능|모의평가|모평)"
SHORT_ANSWER = r"(구하시오|나타내시오|고르시오)\s*\.?\s*$"
STATEMENT_HEAD = r"보기\b|[ㄱㄴㄷㄹ]\s*[.)]"
CONDITION_HEAD = r"\(?[가나다라]\)"


def _per_page(rows: DataFrame, keys: list[str], columns: list[str], fold: Callable[[list[dict]], list[tuple]], out: str) -> DataFrame:
    """fold over each page's rows: (keys, out).  Pages travel as one row each, so Python is not entered anew for every page."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("__rows"))
    names = [*keys, *(part.split()[0] for part in out.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for *key, page in zip(*(batch[k] for k in keys), batch["__rows"]):
                found += [(*key, *r) for r in fold(list(page))]
            yield pd.DataFrame(found, columns=names).astype(object)

    return packed.mapInPandas(run, ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", " + out)


def _median(values: list[float]) -> float:
    v, n = sorted(values), len(values)
    return v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2


def cluster_lines(tokens: DataFrame, keys: list[str], y_share: float = 0.65, x_share: float = 8.0, space_share: float = 0.45) -> DataFrame:
    """(keys, line, tokens, text, x, y, w, h): tokens gathered into lines, page by page.

    Tokens come from top to bottom; each joins the first line whose median centre is
    within y_share of the larger of its height and the line's median height and whose
    gap is at most x_share heights; otherwise it opens a line.  A height counts as 1 at
    least.  In the text a blank stands only where the gap exceeds space_share of the
    line's median height; a token without text adds none.  Tokens without a box are
    left out.
    """

    def gather(page: list[dict]) -> list[tuple]:
        lines: list[list[dict]] = []
        tall = lambda m: max(m["h"], 1.0)
        for t in sorted(page, key=lambda t: (t["y"] + t["h"] / 2, t["x"], t["node_id"])):
            centre = t["y"] + t["h"] / 2
            for line in lines:
                size = max(tall(t), _median([tall(m) for m in line]))
                gap = max(t["x"] - max(m["x"] + m["w"] for m in line), min(m["x"] for m in line) - (t["x"] + t["w"]), 0.0)
                if abs(centre - _median([m["y"] + m["h"] / 2 for m in line])) <= y_share * size and gap <= x_share * size:
                    line.append(t)
                    break
            else:
                lines.append([t])
        out = []
        for n, line in enumerate(sorted(lines, key=lambda m: (min(t["y"] for t in m), min(t["x"] for t in m)))):
            line.sort(key=lambda t: t["x"])
            space = space_share * _median([tall(t) for t in line])
            text = "".join((" " if before and t["x"] - (before["x"] + before["w"]) > space else "") + (t["text"] or "") for before, t in zip([None, *line], line))
            x, y = min(t["x"] for t in line), min(t["y"] for t in line)
            right, bottom = max(t["x"] + t["w"] for t in line), max(t["y"] + t["h"] for t in line)
            out.append((n, len(line), text, x, y, right - x, bottom - y))
        return out

    boxed = tokens.where(HAS_BOX)
    return _per_page(boxed, keys, ["node_id", "text", "x", "y", "w", "h"], gather, "line int, tokens int, text string, x double, y double, w double, h double")


def cluster_blocks(lines: DataFrame, keys: list[str], gap_share: float = 1.35, least_overlap: float = 0.2) -> DataFrame:
    """(keys, line, x, y, w, h, block): lines gathered into blocks, from top to bottom.

    A line goes to the block whose last line is nearest above it, if the gap is at most
    gap_share of the median height of the page's lines and both overlap in width by
    least_overlap of the narrower one; otherwise it opens a block.
    """

    def gather(page: list[dict]) -> list[tuple]:
        typical = _median([t["h"] for t in page])
        last: list[dict] = []  # each block's last line
        out = []
        for t in sorted(page, key=lambda t: (t["y"], t["x"], t["line"])):
            fits = []
            for k, b in enumerate(last):
                gap = t["y"] - (b["y"] + b["h"])
                share = max(0.0, min(b["x"] + b["w"], t["x"] + t["w"]) - max(b["x"], t["x"])) / max(min(b["w"], t["w"]), 1.0)
                if 0 <= gap <= gap_share * typical and share >= least_overlap:
                    fits.append((gap, k))
            k = min(fits)[1] if fits else len(last)
            last[k : k + 1] = [t]
            out.append((t["line"], t["x"], t["y"], t["w"], t["h"], k))
        return out

    return _per_page(lines, keys, ["line", "x", "y", "w", "h"], gather, "line int, x double, y double, w double, h double, block int")


def primary_order(kind: Column, flag: Column, boxed: Column) -> Column:
    """Whether a node belongs to the primary reading order: an unsupported visual always does, others unless flagged false, and only with a box."""
    return (kind == "UNSUPPORTED_VISUAL") | (F.coalesce(flag, F.lit(True)) & F.coalesce(boxed, F.lit(False)))


def unit_boxes(members: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scope, x, y, w, h, members, confidence): the box around the members of each problem."""
    return union_boxes(members.select(*keys, "scope", "node_id").join(nodes, [*keys, "node_id"]), [*keys, "scope"])


def unit_order(nodes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, scope, place): the reading order with each problem in the place of its first member, its other members left out.

    item is the node, or for a problem its first member; scope is null for a node of no problem.
    """
    placed = nodes.select(*keys, "node_id", F.coalesce("ord", F.lit(0)).alias("o")).join(members.select(*keys, "node_id", "scope"), [*keys, "node_id"], "left")
    unit = F.when(F.col("scope").isNotNull(), F.struct(F.lit("unit").alias("k"), F.col("scope").cast("string").alias("v"))).otherwise(F.struct(F.lit("node").alias("k"), F.col("node_id").alias("v")))
    first = placed.groupBy(*keys, unit.alias("__u")).agg(F.min(F.struct("o", "node_id", "scope")).alias("m"))
    w = Window.partitionBy(*keys).orderBy("m.o", "m.node_id")
    return first.select(*keys, F.col("m.node_id").alias("item"), F.col("m.scope").alias("scope"), (F.row_number().over(w) - 1).alias("place"))


def problem_units(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scope, role, node_id, place): members of each problem in a page's scopes.

    A scope of two or more nodes is walked in order: lines with choice marks gather
    until five marks are seen, or until another line follows four; what follows the
    choices is outside.  Fewer marks are part of the stem.  A scope counts only with a
    stem and either choices or a stem that ends in a call for a short answer.
    """
    schema = ", ".join(f"{k} {t}" for k, t in nodes.select(*keys).dtypes) + ", scope long, role string, node_id string, place int"
    mark, answer = re.compile(X.CHOICE_MARK), re.compile(SHORT_ANSWER)

    def walk(key: tuple, scope: pd.DataFrame) -> pd.DataFrame:
        roles: list[tuple[str, str]] = []
        pending: list[str] = []
        seen: set[str] = set()
        chosen = short = False
        rows = list(scope.sort_values(["o", "node_id"]).itertuples()) if len(scope) > 1 else []
        for t in rows:
            text = t.text or ""
            marks = set(mark.findall(text))
            if marks:
                pending.append(t.node_id)
                seen |= marks
                if len(seen) >= 5:
                    chosen = True
                    break
                continue
            if pending:
                if len(seen) >= 4:
                    chosen = True
                    break
                roles += [("stem", p) for p in pending]
                pending, seen = [], set()
            role = "bogi" if re.match(STATEMENT_HEAD, text) else "condition" if re.match(CONDITION_HEAD, text) else "stem"
            roles.append((role, t.node_id))
            short |= role == "stem" and bool(answer.search(text))
        if pending:
            chosen |= len(seen) >= 4
            roles += [("choices" if chosen else "stem", p) for p in pending]
        ok = (chosen or short) and any(r == "stem" for r, _ in roles)
        return pd.DataFrame([(*key, r, n, k) for k, (r, n) in enumerate(roles)] if ok else [], columns=[*keys, "scope", "role", "node_id", "place"])

    cut = scopes(nodes, keys, F.coalesce(F.col("text").rlike(PROBLEM_START), F.lit(False))).where("scope > 0")
    return cut.select(*keys, "scope", "node_id", "text", F.coalesce("ord", F.lit(0)).alias("o")).groupBy(*keys, "scope").applyInPandas(walk, schema)


def validation_counters(nodes: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """One row a page: nodes, duplicate_ids, order_duplicates, missing_in_order, dangling, index_mismatch, valid.

    nodes: keys, node_id, ord.  order: keys, position (from 0), node_id - the reading order.
    """
    ids = nodes.groupBy(*keys).agg(F.count("*").alias("nodes"), (F.count("node_id") - F.count_distinct("node_id")).alias("duplicate_ids"))
    orders = order.groupBy(*keys).agg((F.count("node_id") - F.count_distinct("node_id")).alias("order_duplicates"))
    in_order = order.groupBy(*keys, "node_id").agg(F.min("position").alias("position"))
    missing = nodes.join(in_order, [*keys, "node_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("missing_in_order"))
    dangling = in_order.join(nodes.select(*keys, "node_id").distinct(), [*keys, "node_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("dangling"))
    off = nodes.join(in_order, [*keys, "node_id"]).where("ord is not null and ord <> position").groupBy(*keys).agg(F.count("*").alias("index_mismatch"))
    out = ids.join(orders, keys, "full")
    for part in (missing, dangling, off):
        out = out.join(part, keys, "full")
    names = ["nodes", "duplicate_ids", "order_duplicates", "missing_in_order", "dangling", "index_mismatch"]
    return out.fillna(0, names).withColumn("valid", F.expr(" + ".join(names[1:]) + " = 0"))
