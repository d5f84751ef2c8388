"""Comparing two reports or two lists: joins with a status, deltas, verdicts, set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def compared(baseline: DataFrame, candidate: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Full outer join of two reports: keys, status, and b_/c_ of each measure.

    status is COMPARED, BASELINE_ONLY or CANDIDATE_ONLY.  Keys must be unique a side.
    """
    b = baseline.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures], F.lit(True).alias("__b"))
    c = candidate.select(*keys, *[F.col(m).alias(f"c_{m}") for m in measures], F.lit(True).alias("__c"))
    status = F.when(F.col("__b").isNull(), "CANDIDATE_ONLY").when(F.col("__c").isNull(), "BASELINE_ONLY").otherwise("COMPARED")
    return b.join(c, keys, "full").withColumn("status", status).drop("__b", "__c")


def ratio_delta(base: Column, cand: Column) -> Column:
    """Relative change; from 0 it is 1 for any growth and 0 for none; null with a null side."""
    return F.when(base == 0, F.when(cand > 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(cand - base, base))


def verdict(status: Column, nodes: Column, confidence: Column, b_score: Column, c_score: Column) -> Column:
    """First rule that holds: large change of nodes, better score without loss of confidence, clear change of confidence, else a tie.

    nodes: relative change of the node count; confidence: change of the mean.
    """
    return (
        F.when(status == "CANDIDATE_ONLY", "REVIEW")
        .when(status == "BASELINE_ONLY", "BASELINE_PREFERRED")
        .when(F.abs(nodes) >= 0.45, "REVIEW")
        .when((c_score < b_score) & (confidence.isNull() | (confidence >= -0.08)), "CANDIDATE_PREFERRED")
        .when((c_score > b_score) & (confidence.isNull() | (confidence <= 0.08)), "BASELINE_PREFERRED")
        .when((confidence >= 0.08) & (c_score <= b_score + 1), "CANDIDATE_PREFERRED")
        .when((confidence <= -0.08) & (b_score <= c_score + 1), "BASELINE_PREFERRED")
        .otherwise("TIE_OR_REVIEW")
    )


def recommendation(verdicts: DataFrame) -> DataFrame:
    """One row: counts of each verdict and what follows from them."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = verdicts.agg(n("CANDIDATE_PREFERRED").alias("candidate"), n("BASELINE_PREFERRED").alias("baseline"), n("REVIEW").alias("review"), n("TIE_OR_REVIEW").alias("tie"))
    return out.withColumn(
        "recommendation",
        F.when((F.col("candidate") > F.col("baseline")) & (F.col("review") + F.col("tie") <= F.col("candidate")), "CANDIDATE_CAN_ADVANCE_TO_OVERLAY_REVIEW").when(F.col("baseline") > F.col("candidate"), "KEEP_BASELINE_PENDING_ENGINE_TUNING").otherwise("REVIEW_REQUIRED_BEFORE_DEFAULT_SWITCH"),
    )


def with_defaults(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join in which missing columns of the right side take their defaults."""
    joined = left.join(right.select(*keys, *defaults), keys, "left")
    return joined.select(*left.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def zipped(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Two ordered lists of a group side by side by position, the shorter one padded: keys, position, left, right, same."""
    numbered = lambda df, name: df.select(*keys, F.col(value).alias(name), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("position"))
    return numbered(left, "left").join(numbered(right, "right"), [*keys, "position"], "full").withColumn("same", F.col("left").eqNullSafe(F.col("right")))


def anchored(rows: DataFrame, group: list[str], anchor: Column, measures: list[str]) -> DataFrame:
    """Rows with the difference of each measure to the group's anchor row; groups without anchor are left out.  One anchor a group."""
    base = rows.where(anchor).select(*group, *[F.col(m).alias(f"__{m}") for m in measures])
    joined = rows.where(~anchor).join(base, group)
    return joined.select(*rows.columns, *[(F.col(m) - F.col(f"__{m}")).alias(f"d_{m}") for m in measures])


def type_deltas(baseline: DataFrame, candidate: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, kind, baseline, candidate, delta): how often each kind occurs on each side; only kinds that differ."""
    count = lambda df, name: df.groupBy(*keys, kind).agg(F.count("*").alias(name))
    both = count(baseline, "baseline").join(count(candidate, "candidate"), [*keys, kind], "full").fillna(0, ["baseline", "candidate"])
    return both.withColumn("delta", F.col("candidate") - F.col("baseline")).where("delta <> 0")


def policy_wins(trials: DataFrame, a: str, b: str, dead_band: float = 0.002, enough: int = 5) -> DataFrame:
    """One row: wins of a and b, ties within the dead band, and the choice if one side has enough wins and more than the other."""
    d = F.col(a) - F.col(b)
    out = trials.agg(F.count_if(d > dead_band).alias("wins_a"), F.count_if(d < -dead_band).alias("wins_b"), F.count_if(F.abs(d) <= dead_band).alias("ties"))
    return out.withColumn("choice", F.when(F.expr(f"wins_a >= {enough} and wins_a > wins_b"), a).when(F.expr(f"wins_b >= {enough} and wins_b > wins_a"), b).otherwise("none"))


def regressions(rows: DataFrame, row_id: str, gate: str, drops: dict[str, float], k: int = 3) -> DataFrame:
    """The k worst rows: severity is 1 for a failed gate plus every positive drop; only rows with a failed gate or a drop over its trigger."""
    hit, severity = F.col(gate), F.when(F.col(gate), 1.0).otherwise(0.0)
    for column, trigger in drops.items():
        hit = hit | (F.col(column) > trigger)
        severity = severity + F.greatest(F.coalesce(column, F.lit(0.0)), F.lit(0.0))
    return rows.where(F.coalesce(hit, F.lit(False))).withColumn("severity", F.round(severity, 6)).orderBy(F.desc("severity"), row_id).limit(k)


def key_sets(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many distinct keys are in both, only left, only right, either; and whether the sets are equal or disjoint."""
    tag = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(1))
    both = tag(left, "l").join(tag(right, "r"), keys, "full")
    out = both.agg(F.count_if(F.expr("l = 1 and r = 1")).alias("both"), F.count_if(F.expr("r is null")).alias("only_left"), F.count_if(F.expr("l is null")).alias("only_right"), F.count("*").alias("either"))
    return out.withColumn("equal", F.expr("only_left = 0 and only_right = 0")).withColumn("disjoint", F.expr("both = 0"))


def appended(base: DataFrame, new: DataFrame, position: str) -> DataFrame:
    """Base rows and then new rows with source_rank 0 and 1; (source_rank, position) is the order of the whole."""
    return base.withColumn("source_rank", F.lit(0)).unionByName(new.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def aligned_ratio(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str, autojunk: bool = False) -> DataFrame:
    """(keys, ratio, equal, replaced, inserted, deleted): alignment of two sequences of a group by longest matching blocks."""
    import difflib

    schema = ", ".join(f"{k} {t}" for k, t in left.select(*keys).dtypes) + ", ratio double, equal int, replaced int, inserted int, deleted int"

    def align(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (d.sort_values([order, value])[value].tolist() if len(d) else [] for d in (a, b))
        m = difflib.SequenceMatcher(None, x, y, autojunk=autojunk)
        n = dict.fromkeys(("equal", "replace", "insert", "delete"), 0)
        for tag, i1, i2, j1, j2 in m.get_opcodes():
            n[tag] += max(i2 - i1, j2 - j1)
        return pd.DataFrame([(*key, m.ratio(), n["equal"], n["replace"], n["insert"], n["delete"])], columns=[*keys, "ratio", "equal", "replaced", "inserted", "deleted"])

    # Fresh aliases: both sides may come from one table.
    side = lambda df: df.select(*[F.col(c).alias(c) for c in (*keys, order, value)]).groupBy(*keys)
    return side(left).cogroup(side(right)).applyInPandas(align, schema)


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with ratio: longest-matching-blocks similarity of two texts, in the form without blanks and case; null with a null text."""
    import difflib

    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        form = lambda t: "".join(t.split()).casefold()
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, form(p), form(q)).ratio() for p, q in zip(x, y)], dtype="float64")

    return pairs.withColumn("ratio", ratio(a, b))
