"""Deeply nested records into related flat tables.

A record is walked depth first.  Every node gets interval labels: its pre-order
number and its post-order number.  Node x lies below node y exactly if
``y.pre < x.pre`` and ``x.post < y.post``; the flat tables are linked by that
test alone.  A record is one row, so numbering and linking need no shuffle: a
batch of records is numbered in one sequence and a child finds its ancestor by
binary search among the intervals of the ancestor's type.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class NodeType:
    """One flat table: nodes reached by path, with the named scalar fields.

    path: steps from the record's root.  A step is a field name, or "*" for each
    element of an array.  An object where an array is expected counts as an array
    of one element.  A step "{side}" stands for each field of an object, or each
    element of an array of objects, whose field `side` then holds the name.
    fields: output column -> path of field names below the node; where a list
    stands in place of an object, a path's last name is looked up in list_order.
    """

    name: str
    path: tuple[str, ...]
    fields: dict[str, tuple[str, ...]]
    parent: str | None = None
    list_order: tuple[str, ...] = ()
    need: tuple[str, ...] = ()
    numbers: tuple[str, ...] = field(default=())


def parse_record(text: str | None) -> tuple[object, str | None]:
    """(value, fault) of JSON text: no value and EMPTY, MALFORMED or TOO_DEEP (beyond the parser's depth) where it has none."""
    if not text or not text.strip():
        return None, "EMPTY"
    try:
        return json.loads(text), None
    except RecursionError:
        return None, "TOO_DEEP"
    except ValueError:
        return None, "MALFORMED"


def label_nodes(root, steps: list[tuple[str, ...]], start: int = 0) -> tuple[list[tuple], int]:
    """Depth-first walk of one record: ([(pre, post, depth, path, key, value)], next pre).

    Every object, array and scalar is a node; null array elements and null fields
    are none.  steps: the paths of interest; a node's `path` is its index in steps,
    or -1.  post-order numbers follow the same counter base as the pre-order ones.
    """
    wanted = {p: k for k, p in enumerate(steps)}
    opens = {p[:n] for p in steps for n in range(len(p) + 1)}
    names = {p[-1][1:-1] for p in steps if p and p[-1].startswith("{")} | {s[1:-1] for p in steps for s in p if s.startswith("{")}
    out: list[tuple] = []
    pre, post = start, start
    # A stack entry opens a node or, with a place in out, closes it.
    stack: list[tuple] = [((), None, root, 0, None)]
    while stack:
        at, key, value, depth, place = stack.pop()
        if place is not None:
            row = out[place]
            out[place] = (row[0], post, *row[2:])
            post += 1
            continue
        step = wanted.get(at, -1)
        if not isinstance(value, (dict, list)):  # a leaf opens and closes at once
            out.append((pre, post, depth, step, key, value))
            pre += 1
            post += 1
            continue
        out.append((pre, 0, depth, step, key, value))
        stack.append((at, key, None, depth, len(out) - 1))
        pre += 1
        stack.extend([(p, k, v, depth + 1, None) for p, k, v in reversed(_children(at, value, opens, names))])
    return out, pre


def _children(at: tuple, value, opens: set[tuple], names: set[str]) -> list[tuple]:
    """(path, key, value) of a node's children; opens: the beginnings of the paths of interest."""
    star, each = (*at, "*"), [(*at, f"{{{n}}}") for n in names]
    if isinstance(value, list):
        for p in each:
            if p in opens:
                return [(p, str(v.get(p[-1][1:-1])), v) for v in value if isinstance(v, dict) and v.get(p[-1][1:-1]) is not None]
        return [(star, None, v) for v in value if v is not None]
    if isinstance(value, dict):
        for p in each:
            if p in opens:
                return [(p, k, v) for k, v in value.items() if v is not None]
        if star in opens:
            return [(star, None, value)]  # one element without its array
        return [((*at, k), k, v) for k, v in value.items() if v is not None]
    return []


def _dig(value, path: tuple[str, ...], list_order: tuple[str, ...]):
    for name in path:
        if isinstance(value, list) and name in list_order and list_order.index(name) < len(value):
            value = value[list_order.index(name)]
        elif isinstance(value, dict):
            value = value.get(name)
        else:
            return None
    return value


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def flat_tables(rows: DataFrame, root_id: str, content: Column, types: list[NodeType]) -> DataFrame:
    """All nodes of the given types as one long table.

    content: the record as JSON text.  Columns: root_id (string), node_type, pre,
    post, depth, key (field name or side), parent_type, parent_pre, parent_key and
    the maps `fields` and `parent_fields` (column -> text).  A node whose parent
    type names no enclosing node has null parent columns; a node that lacks one of
    its type's `need` fields is left out.  Defined results: null or scalar content
    gives no nodes; empty, malformed or too deeply nested content gives one row of the
    node_type "fault" whose key names the fault; records may have any size;
    redelivered records repeat their nodes (drop them with distinct()).
    pre and post are comparable only among nodes of one record.
    """
    steps = [t.path for t in types]
    place = {t.name: k for k, t in enumerate(types)}
    schema = T.StructType([
        T.StructField("root_id", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("pre", T.LongType()),
        T.StructField("post", T.LongType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("parent_type", T.StringType()),
        T.StructField("parent_pre", T.LongType()),
        T.StructField("parent_key", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("parent_fields", T.MapType(T.StringType(), T.StringType())),
    ])

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[list[tuple]] = [[] for _ in types]
            base, nxt, faults = [], 0, []
            for r, (rid, text) in enumerate(zip(batch["root_id"], batch["content"])):
                base.append(nxt)
                record, fault = parse_record(text)
                if fault:
                    faults.append((rid, "fault", 0, 0, 0, fault, None, None, None, None, None))
                if record is None:
                    continue
                nodes, nxt = label_nodes(record, steps, nxt)
                for pre, post, depth, step, key, value in nodes:
                    if step >= 0:
                        t = types[step]
                        fields = {c: _text(_dig(value, p, t.list_order)) for c, p in t.fields.items()}
                        if all(fields.get(n) is not None for n in t.need):
                            found[step].append((rid, r, pre, post, depth, key, fields))
            out = faults
            for t, mine in zip(types, found):
                above = found[place[t.parent]] if t.parent else []
                at = _enclosing(mine, above)
                for (rid, r, pre, post, depth, key, fields), k in zip(mine, at):
                    up = above[k] if k >= 0 else None
                    out.append((rid, t.name, pre - base[r], post - base[r], depth, key, t.parent if up else None, up[2] - base[r] if up else None, up[5] if up else None, fields, up[6] if up else None))
            yield pd.DataFrame(out, columns=schema.names).astype({"parent_pre": "Int64"})

    slim = rows.select(F.col(root_id).cast("string").alias("root_id"), content.alias("content")).where("content is not null")
    return slim.mapInPandas(shred, schema)


def _enclosing(nodes: list[tuple], above: list[tuple]) -> np.ndarray:
    """For each node the place in `above` of the interval that contains it, or -1.

    Intervals of one type are disjoint (a type has one path), so the last interval
    that opens before a node is the only one that can contain it.
    """
    if not above or not nodes:
        return np.full(len(nodes), -1)
    opened = np.array([x[2] for x in above])
    closed = np.array([x[3] for x in above])
    at = np.searchsorted(opened, np.array([x[2] for x in nodes]), side="left") - 1
    inside = (at >= 0) & (closed[np.maximum(at, 0)] > np.array([x[3] for x in nodes]))
    return np.where(inside, at, -1)


def type_table(nodes: DataFrame, node_type: str, columns: dict[str, Column]) -> DataFrame:
    """One flat table out of the long one: nodes of a type with the given output columns."""
    return nodes.where(F.col("node_type") == node_type).select("root_id", *[c.alias(n) for n, c in columns.items()])


BOX = ("x", "y", "width", "height")
PAGE = NodeType("page", ("*",), {"page_id": ("page_id",), "node_count": ("node_count",), "mean_confidence": ("mean_confidence",), "min_confidence": ("min_confidence",), "low_confidence_node_count": ("low_confidence_node_count",)})
LOW_NODE = NodeType(
    "node",
    ("*", "low_confidence_nodes", "*"),
    {"node_id": ("node_id",), "reading_order_index": ("reading_order_index",), "confidence": ("confidence",), "text": ("text",)} | {f"box_{b}": ("bbox", b) for b in BOX},
    parent="page",
    list_order=BOX,
    need=("node_id",),
)
CAPTURE = NodeType("capture", ("*",), {"capture": ("capture",), "status": ("status",), "image_path": ("image_path",), "overlap_px": ("overlap_px",)})
SIDE = NodeType(
    "side",
    ("*", "pages", "{side}"),
    {"box": ("bbox_full",), "area_ratio": ("area_ratio",), "winding": ("winding",), "point_count": ("point_count",)} | {f"box_{b}": ("bbox_full", b) for b in BOX},
    parent="capture",
    list_order=BOX,
)


def report_nodes(reports: DataFrame) -> DataFrame:
    """Pages and low-confidence nodes of quality reports, from whichever column holds the content."""
    return flat_tables(reports, "report_id", F.coalesce(F.to_json("pages"), "pages_json"), [PAGE, LOW_NODE])


def manifest_nodes(manifests: DataFrame) -> DataFrame:
    """Captures and page sides of capture manifests, from whichever column holds the content."""
    return flat_tables(manifests, "manifest_id", F.coalesce(F.to_json("records"), "records_json"), [CAPTURE, SIDE])


def confidence(text: Column) -> Column:
    """A confidence on the scale 0..1: values above 1 are percentages; text that is no number gives null."""
    number = text.try_cast("double")
    return F.when(number > 1, number / 100).otherwise(number)


def low_confidence_table(reports: DataFrame) -> DataFrame:
    """Flat low-confidence nodes: report, page, node, order, confidence (0..1), box and text; distinct rows."""
    f = lambda n: F.col("fields")[n]
    nodes = type_table(report_nodes(reports), "node", {
        "page_id": F.col("parent_fields")["page_id"], "node_id": f("node_id"), "reading_order_index": f("reading_order_index").try_cast("int"), "confidence": confidence(f("confidence")),
        **{f"box_{b}": f(f"box_{b}").try_cast("double") for b in BOX}, "text": f("text"),
    })
    return nodes.withColumnRenamed("root_id", "report_id").distinct()


def page_side_table(manifests: DataFrame) -> DataFrame:
    """Flat page sides that have a box: manifest, capture, side, box and ratios; distinct rows."""
    f = lambda n: F.col("fields")[n]
    sides = type_table(manifest_nodes(manifests), "side", {
        "capture": F.col("parent_fields")["capture"], "side": F.lower("key"), "box": f("box"), **{f"box_{b}": f(f"box_{b}").try_cast("int") for b in BOX}, "area_ratio": f("area_ratio").try_cast("double"),
        "winding": f("winding"),
    })
    return sides.where("box is not null").drop("box").withColumnRenamed("root_id", "manifest_id").distinct()


def page_table(reports: DataFrame) -> DataFrame:
    """Flat pages of quality reports: report, page, node counts and confidences (0..1); distinct rows."""
    f = lambda n: F.col("fields")[n]
    pages = type_table(report_nodes(reports), "page", {
        "page_id": f("page_id"), "node_count": f("node_count").try_cast("int"), "mean_confidence": confidence(f("mean_confidence")), "min_confidence": confidence(f("min_confidence")),
        "low_confidence_node_count": f("low_confidence_node_count").try_cast("int"),
    })
    return pages.where("page_id is not null").withColumnRenamed("root_id", "report_id").distinct()


def capture_table(manifests: DataFrame) -> DataFrame:
    """Flat captures of manifests: manifest, capture, status, image and overlap; distinct rows."""
    f = lambda n: F.col("fields")[n]
    captures = type_table(manifest_nodes(manifests), "capture", {"capture": f("capture"), "status": f("status"), "image_path": f("image_path"), "overlap_px": f("overlap_px").try_cast("int")})
    return captures.where("capture is not null").withColumnRenamed("root_id", "manifest_id").distinct()


def fault_table(reports: DataFrame, manifests: DataFrame) -> DataFrame:
    """(source_table, root_id, fault) of records whose content cannot be read, each once."""
    parts = [(report_nodes(reports), "ocr_quality_report_p008"), (manifest_nodes(manifests), "input_manifest")]
    a, b = (n.where("node_type = 'fault'").select(F.lit(t).alias("source_table"), "root_id", F.col("key").alias("fault")) for n, t in parts)
    return a.union(b).distinct()


def parent_child_links(reports: DataFrame, manifests: DataFrame) -> DataFrame:
    """(source_table, root_id, parent_id, child_id) of low-confidence nodes and of boxed page sides, each once."""
    nodes = report_nodes(reports).where("node_type = 'node'").select(F.lit("ocr_quality_report_p008").alias("source_table"), "root_id", F.col("parent_fields")["page_id"].alias("parent_id"), F.col("fields")["node_id"].alias("child_id"))
    sides = manifest_nodes(manifests).where(F.col("node_type") == "side").where(F.col("fields")["box"].isNotNull()).select(F.lit("input_manifest").alias("source_table"), "root_id", F.col("parent_fields")["capture"].alias("parent_id"), F.lower("key").alias("child_id"))
    return nodes.union(sides).distinct()
