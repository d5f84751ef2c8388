"""Documents as focus items and utterances: flattening, references, reuse, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions.values import text_key


def resolved_references(owners: DataFrame, targets: DataFrame, keys: list[str], owner: str, refs: str, target: str) -> DataFrame:
    """(keys, owner, target, place): an owner's references that exist, each target once where it is first named; dangling ones drop out."""
    named = owners.select(*keys, owner, F.posexplode(refs).alias("__p", target)).groupBy(*keys, owner, target).agg(F.min("__p").alias("__p"))
    found = named.join(targets.select(*keys, target).distinct(), [*keys, target])
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys, owner).orderBy("__p"))).drop("__p")


def dangling_references(owners: DataFrame, targets: DataFrame, keys: list[str], owner: str, refs: str, target: str) -> DataFrame:
    """(keys, owner, target) of references to nothing."""
    return owners.select(*keys, owner, F.explode(refs).alias(target)).distinct().join(targets.select(*keys, target), [*keys, target], "left_anti")


def focus_items(nodes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item_id, kind, problem_id, place): a page's nodes in reading order, the members of a problem in its place by role, each node once.

    nodes: keys, node_id, ord, kind.  members: keys, problem_id, node_id, role, place; problem_id is a node.
    """
    rank = F.when(F.col("role") == "stem", 0).when(F.col("role") == "condition", 1).when(F.col("role") == "bogi", 2).otherwise(3)
    owned = members.groupBy(*keys, "node_id").agg(F.min(F.struct(rank.alias("r"), "place", "problem_id")).alias("m"))
    heads = nodes.select(*keys, F.col("node_id").alias("problem_id"), F.col("ord").alias("head_ord"))
    inner = owned.select(*keys, "node_id", F.col("m.problem_id").alias("problem_id"), F.col("m.r").alias("r"), F.col("m.place").alias("p")).join(heads, [*keys, "problem_id"])
    joined = nodes.join(inner, [*keys, "node_id"], "left")
    w = Window.partitionBy(*keys).orderBy(F.coalesce("head_ord", "ord"), F.coalesce(F.col("r") + 1, F.lit(0)), F.coalesce("p", F.lit(0)), "node_id")
    return joined.select(*keys, F.col("node_id").alias("item_id"), "kind", "problem_id", (F.row_number().over(w) - 1).alias("place"))


def utterances(items: DataFrame, spans: DataFrame, cells: DataFrame) -> DataFrame:
    """(key, text): what is spoken - whole items by id, spans by id#i, table cells by id#r{row}c{column}; blank texts are left out, each key once."""
    all_ = items.select(F.col("item_id").alias("key"), "text").unionByName(spans.select(F.concat_ws("#", "item_id", F.col("i").cast("string")).alias("key"), "text"))
    all_ = all_.unionByName(cells.select(F.concat(F.col("item_id"), F.lit("#r"), F.col("row").cast("string"), F.lit("c"), F.col("column").cast("string")).alias("key"), "text"))
    return all_.where("trim(text) <> ''").groupBy("key").agg(F.min("text").alias("text"))


def reused(wanted: DataFrame, stored: DataFrame, key: str, text: str, asset: str) -> DataFrame:
    """Wanted rows with their stored asset where key and text are the same, and action: keep or synthesize."""
    old = stored.select(F.col(key).alias("__k"), F.col(text).alias("__t"), asset)
    joined = wanted.join(old, (F.col(key) == F.col("__k")) & (F.col(text) == F.col("__t")), "left").drop("__k", "__t")
    return joined.withColumn("action", F.when(F.col(asset).isNull(), "synthesize").otherwise("keep"))


def preflight(utterance_rows: DataFrame, audio: DataFrame, key: str) -> DataFrame:
    """One row: utterances, audio entries, utterances without audio, audio without utterance, and whether both key sets are equal."""
    both = utterance_rows.select(key).distinct().withColumn("u", F.lit(1)).join(audio.select(key).distinct().withColumn("a", F.lit(1)), key, "full")
    out = both.agg(F.count("u").alias("utterances"), F.count("a").alias("audio"), F.count_if(F.col("a").isNull()).alias("without_audio"), F.count_if(F.col("u").isNull()).alias("without_utterance"))
    return out.withColumn("complete", F.expr("without_audio = 0 and without_utterance = 0"))


def reanchored(cursors: DataFrame, items: DataFrame, page: str, item: str, index: str, stored_index: str, same_revision: Column) -> DataFrame:
    """Cursors with their index in the given items; error says MISSING_ANCHOR, or INDEX_DRIFT if it moved within one revision."""
    joined = cursors.join(items.select(page, item, index), [page, item], "left")
    error = F.when(F.col(index).isNull(), "MISSING_ANCHOR").when(same_revision & (F.col(index) != F.col(stored_index)), "INDEX_DRIFT")
    return joined.withColumn("error", error)


def tree_status(issues: Column, leftover: Column, unknown: Column) -> Column:
    """INVALID with an error issue or leftover tokens, PARTIAL with an unknown part, else VALID."""
    return F.when(F.exists(F.coalesce(issues, F.array().cast("array<string>")), lambda i: i == "error") | (F.coalesce(leftover, F.lit(0)) > 0), "INVALID").when(F.coalesce(unknown, F.lit(0)) > 0, "PARTIAL").otherwise("VALID")


def cross_checked(pages: DataFrame, first: str, second: str) -> DataFrame:
    """Pages with both engines' texts: how many choice marks each has and whether the second confirms that the first lost some."""
    from quirework.functions.text import choice_count

    a, b = choice_count(first), choice_count(second)
    return pages.withColumn("first_marks", a).withColumn("second_marks", b).withColumn("outcome", F.when(a.between(2, 4) & (b > a), "OMISSION_CONFIRMED").when(a.between(2, 4), "INCONCLUSIVE").otherwise("RECORDED"))


def excluded_pages(nodes: DataFrame, keys: list[str], exclude: DataFrame) -> DataFrame:
    """Nodes of which excluded pages keep one visual node in place of their content; members are marked and leave the order.

    nodes: keys, node_id, ord, kind.  exclude: keys.
    """
    flagged = nodes.join(exclude.select(*keys).distinct().withColumn("__x", F.lit(True)), keys, "left").withColumn("embedded", F.coalesce("__x", F.lit(False)))
    kept = flagged.withColumn("ord", F.when(~F.col("embedded"), F.col("ord"))).drop("__x")
    stand_in = flagged.where("embedded").groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.concat_ws("-", *keys, F.lit("excluded")).alias("node_id"), F.lit(0).alias("ord"), F.lit("UNSUPPORTED_VISUAL").alias("kind"), F.lit(False).alias("embedded"))
    return kept.select(*keys, "node_id", "ord", "kind", "embedded").unionByName(stand_in)


def assembled_revision(base: DataFrame, new: DataFrame, keys: list[str], page: str, item: str) -> DataFrame:
    """(keys, pages, base_pages, new_pages, repeated_pages, unnumbered, steps_back, valid): base pages and new pages after them, checked as a whole.

    Valid is a revision whose pages all have a number, each once, in rising order.
    """
    both = base.select(*keys, page, item, F.lit(0).alias("__s")).union(new.select(*keys, page, item, F.lit(1)))
    before = F.lag(page).over(Window.partitionBy(*keys).orderBy("__s", page, item))
    out = both.withColumn("__b", before).groupBy(*keys).agg(
        F.count("*").alias("pages"), F.count_if(F.col("__s") == 0).alias("base_pages"), F.count_if(F.col("__s") == 1).alias("new_pages"), (F.count(page) - F.count_distinct(page)).alias("repeated_pages"),
        (F.count("*") - F.count(page)).alias("unnumbered"), F.count_if(F.col(page) < F.col("__b")).alias("steps_back"),
    )
    return out.withColumn("valid", F.expr("repeated_pages = 0 and unnumbered = 0 and steps_back = 0"))


def content_keys(rows: DataFrame, text: str) -> DataFrame:
    """Rows with the key of their content and how many rows share it."""
    keyed = rows.withColumn("content_key", text_key(text))
    counts = keyed.groupBy("content_key").agg(F.count("*").alias("copies"))
    return keyed.join(counts, "content_key")
