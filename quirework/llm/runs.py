"""Repeated consecutive events: one row per run.

The events are range-sorted into chunks by sequence and position, so a sequence
of any length spreads over many tasks.  Each chunk encodes its runs locally; merging
two neighbouring stretches is associative, so the first and the last run of each
chunk are merged in a tree: a round joins `fan` neighbouring stretches to one, whose
own first and last run go on to the next round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quirework.session import cut_lineage

_RUN = ["seq", "label", "context", "first", "last", "n", "t_first", "t_last", "lead_n", "lead_last", "lead_t_last", "body_first", "body_t_first", "open_left", "open_right"]
_SCHEMA = "seq string, label string, context string, first long, last long, n long, t_first double, t_last double, lead_n long, lead_last long, lead_t_last double, body_first long, body_t_first double, open_left boolean, open_right boolean"


def plain_label(label: Column | str) -> Column:
    """A label without letter case, white space and separators; a null stays null."""
    return F.lower(F.regexp_replace(label, r"[^\p{L}\p{M}\p{N}]", ""))


def merge_runs(left: dict, right: dict) -> list[dict]:
    """Join two neighbouring run summaries (left comes first): one run, or two with the border put right.

    A run is a stretch of one label whose known contexts are all the same.  `lead_*`
    describe the events before its first known context (all of them if it has none):
    when the runs' contexts differ, those events belong to the left run.
    """
    if not (left["open_right"] and right["open_left"]) or left["seq"] != right["seq"] or left["label"] is None or left["label"] != right["label"]:
        return [left, right]
    a, b = left, right
    if a["context"] is None or b["context"] is None or a["context"] == b["context"]:
        joined = a | {"last": b["last"], "n": a["n"] + b["n"], "t_last": b["t_last"], "open_right": b["open_right"]}
        if a["context"] is None:
            joined |= {"context": b["context"], "lead_n": a["n"] + b["lead_n"], "body_first": b["body_first"], "body_t_first": b["body_t_first"]}
            joined |= {"lead_last": b["lead_last"], "lead_t_last": b["lead_t_last"]} if b["lead_n"] else {"lead_last": a["last"], "lead_t_last": a["t_last"]}
        return [joined]
    a = a | {"open_right": False}
    if b["lead_n"]:
        a |= {"n": a["n"] + b["lead_n"], "last": b["lead_last"], "t_last": b["lead_t_last"]}
        b = b | {"first": b["body_first"], "t_first": b["body_t_first"], "n": b["n"] - b["lead_n"], "lead_n": 0, "lead_last": None, "lead_t_last": None}
    return [a, b | {"open_left": False}]


def _encode(batch: pd.DataFrame) -> list[dict]:
    """Runs of one sorted batch."""
    n = len(batch)
    seq, label = pd.factorize(batch["seq"])[0], pd.factorize(batch["label"])[0]  # -1: null
    ctx, names = pd.factorize(batch["context"])
    at = np.arange(n)
    block = np.ones(n, bool)
    block[1:] = (seq[1:] != seq[:-1]) | (label[1:] != label[:-1]) | (label[1:] < 0)
    known = ctx >= 0
    last_known = np.maximum.accumulate(np.where(known, at, -1))
    block_at = np.maximum.accumulate(np.where(block, at, 0))
    before = np.concatenate([[-1], last_known[:-1]])
    start = block | (known & (before >= block_at) & (ctx != ctx[np.maximum(before, 0)]))
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n) - 1
    # The first known context of each run.
    next_known = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1]
    body = next_known[begin]
    frame, t = batch["pos"].to_numpy(), batch["t"].to_numpy()
    seqs, labels = batch["seq"].to_numpy(), batch["label"].to_numpy()
    out = []
    for b, e, k in zip(begin.tolist(), end.tolist(), body.tolist()):
        has = k <= e
        lead = (k if has else e + 1) - b
        out.append({
            "seq": seqs[b], "label": labels[b], "context": names[ctx[k]] if has else None, "first": int(frame[b]), "last": int(frame[e]), "n": e - b + 1, "t_first": t[b], "t_last": t[e],
            "lead_n": lead, "lead_last": int(frame[b + lead - 1]) if lead else None, "lead_t_last": t[b + lead - 1] if lead else None,
            "body_first": int(frame[k]) if has else None, "body_t_first": t[k] if has else None, "open_left": True, "open_right": True,
        })
    return out


def _closed(runs: list[dict], keep_left: bool, keep_right: bool) -> list[dict]:
    """Close the inner borders of a chunk's runs."""
    for k, r in enumerate(runs):
        r["open_left"] &= keep_left and k == 0
        r["open_right"] &= keep_right and k == len(runs) - 1
    return runs


def _frame(runs: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(runs, columns=_RUN)
    return df.astype({c: "Int64" for c in ("first", "last", "n", "lead_n", "lead_last", "body_first")} | {c: "float64" for c in ("t_first", "t_last", "lead_t_last", "body_t_first")})


def _chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one chunk; only its first and last stay open to a neighbour."""
    held: dict | None = None
    first = True
    for batch in batches:
        if not len(batch):
            continue
        runs = _encode(batch.astype({"seq": object, "label": object, "context": object}).where(batch.notna(), None) if batch.isna().any().any() else batch)
        _closed(runs, True, True)
        if held is not None:
            runs = merge_runs(held, runs[0]) + runs[1:]
        if not first:
            runs[0]["open_left"] = runs[0]["open_left"] and held is not None and held["open_left"]
        ready = runs[:-1]
        for k, r in enumerate(ready):
            r["open_right"] = False
            r["open_left"] &= first and k == 0
        held = runs[-1]
        if ready:
            held["open_left"] = False
            first = False
            yield _frame(ready)
    if held is not None:
        yield _frame([held])


def _fold(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
    """Merge the edge runs of neighbouring stretches in order; only the first and the last run of the result stay open."""
    edges = edges.sort_values(["seq", "first", "last"])
    rows = edges.astype(object).where(edges.notna(), None).to_dict("records")
    out: list[dict] = []
    for r in rows:
        out = out[:-1] + merge_runs(out[-1], r) if out else [r]
    return _frame(_closed(out, True, True)).assign(chunk=key[0])


def merged_edges(edges: DataFrame, chunks: int, fan: int) -> DataFrame:
    """Edge runs of numbered chunks merged over all chunks: a tree of ceil(log(chunks) / log(fan)) rounds, in which no task sees more than 2 * fan runs of one stretch."""
    done = []
    while True:
        edges = edges.withColumn("chunk", F.expr(f"chunk div {fan}")).groupBy("chunk").applyInPandas(_fold, f"{_SCHEMA}, chunk long")
        chunks = -(-chunks // fan)
        if chunks <= 1:
            return reduce(DataFrame.unionByName, [*done, edges.drop("chunk")])
        edges = cut_lineage(edges)
        done.append(edges.where("not (open_left or open_right)").drop("chunk"))
        edges = edges.where("open_left or open_right")


def collapse_runs(events: DataFrame, sequence: Column | str, position: Column | str, label: Column, context: Column | None = None, time: Column | None = None, fan: int = 64) -> DataFrame:
    """One row per run: sequence, label, context, first_position, last_position, events, duration_s, first_time, last_time.

    An event joins the run before it in its sequence if its label is the same and
    its context is not another than the run's; a null context joins any.  Events
    at one position count once: the one with the smallest label, context and time
    stays, whole, and a known value goes before a null.  Defined
    results: rows with a null sequence or position belong to no sequence and are
    left out; a null label is like no other and runs alone; without time, or with
    null times, the duration is null; an empty input gives no rows.
    """
    events = events.select(
        (F.col(sequence) if isinstance(sequence, str) else sequence).cast("string").alias("seq"),
        (F.col(position) if isinstance(position, str) else position).cast("long").alias("pos"),
        label.alias("label"),
        (context if context is not None else F.lit(None).cast("string")).alias("context"),
        (F.unix_micros(time.cast("timestamp")) if time is not None else F.lit(None)).cast("double").alias("t"),
    ).where("seq is not null and pos is not null")
    # Redelivered events are combined before the shuffle, so one repeated a million times costs one row a task.
    rank = F.struct(*[part for c in ("label", "context", "t") for part in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))])
    once = events.groupBy("seq", "pos").agg(F.min(rank).alias("e")).select("seq", "pos", "e.label", "e.context", "e.t")
    chunks = once.repartitionByRange("seq", "pos").sortWithinPartitions("seq", "pos")
    # Tasks of a range partitioning are numbered in its order.  Written once, so that edge runs and finished ones come from the same chunks.
    runs = chunks.mapInPandas(_chunk, _SCHEMA).withColumn("chunk", F.spark_partition_id().cast("long"))
    tagged = cut_lineage(runs.withColumn("edge", F.col("open_left") | F.col("open_right")))
    last = tagged.where("edge").agg(F.max("chunk")).first()[0]
    merged = merged_edges(tagged.where("edge").drop("edge"), (last or 0) + 1, fan)
    return tagged.where("not edge").drop("edge", "chunk").unionByName(merged).select(
        F.col("seq").alias("sequence"), "label", "context", F.col("first").alias("first_position"), F.col("last").alias("last_position"), F.col("n").alias("events"),
        ((F.col("t_last") - F.col("t_first")) / 1e6).alias("duration_s"), F.timestamp_micros(F.col("t_first").cast("long")).alias("first_time"), F.timestamp_micros(F.col("t_last").cast("long")).alias("last_time"),
    )
