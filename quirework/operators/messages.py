"""Messages delivered more than once: keep one copy of each.

Copies are rows that share an identifier, directly or through other rows.  The
work is split by aggregated identifier frequency: rows whose identifiers all
occur once pass directly, only rows of repeated groups are linked and ranked, and
both parts are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quirework.session import cut_lineage

#: White space that may surround a key (fixed values: ASCII, no-break and ideographic blanks).
OUTER_SPACE = " \t\n\r\f\u000b\u00a0\u3000"


def plain_key(key: Column | str) -> Column:
    """A key without outer white space and letter case; a null stays null."""
    key = F.col(key) if isinstance(key, str) else key
    return F.lower(F.btrim(key, F.lit(OUTER_SPACE)))


def connected_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, label), label being the smallest node.

    edges has columns a and b of one orderable type; self loops, repeats and null
    ends are allowed and ignored.  Alternating large-star and small-star rounds
    need O(log n) passes whatever the diameter.  Each pass is a min-aggregate,
    which combines before the shuffle, and an equi-join, which AQE splits on hot
    nodes.  Nodes without an edge to another node do not appear.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    state = cut_lineage(tidy(edges))
    seen = mark(state)
    for _ in range(max_rounds if seen[0] else 0):
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = tidy(both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        near = large.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = cut_lineage(tidy(near.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))))
        now = mark(state)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _identified(rows: DataFrame, row_id: str, identifiers: list[list[Column | str]], carried: list[Column]) -> DataFrame:
    """(__r, carried, __i0, __i1, ...): rows with a struct for each identifier, null where a part of it is null."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    names = [
        F.when(reduce(lambda x, y: x & y, [as_col(c).isNotNull() for c in parts]), F.struct(*[as_col(c).alias(f"p{k}") for k, c in enumerate(parts)])).alias(f"__i{j}")
        for j, parts in enumerate(identifiers)
    ]
    return rows.select(F.col(row_id).alias("__r"), *carried, *names)


def repeated_identifiers(slim: DataFrame, names: list[str]) -> list[DataFrame]:
    """For each identifier column (__k, first): the values that occur more than once, with the smallest row id.

    Combined before the shuffle: a hot identifier costs one row a task.
    """
    return [
        cut_lineage(slim.where(F.col(n).isNotNull()).groupBy(F.col(n).alias("__k")).agg(F.count("*").alias("__n"), F.min("__r").alias("first")).where("__n > 1").select("__k", "first"))
        for n in names
    ]


def _groups(slim: DataFrame, often: list[DataFrame], carried: list[str]) -> DataFrame:
    """(__r, group_id, carried) for every row of a repeated group."""
    marked, firsts = slim, [f"__f{j}" for j in range(len(often))]
    for j, (keys, f) in enumerate(zip(often, firsts)):
        marked = marked.join(keys.withColumnRenamed("first", f), F.col(f"__i{j}") == F.col("__k"), "left").drop("__k")
    repeated = cut_lineage(marked.where(" or ".join(f"{f} is not null" for f in firsts)).select("__r", *firsts, *carried))
    own = F.coalesce(firsts[0], "__r")
    if len(firsts) == 1:
        return repeated.select("__r", own.alias("group_id"), *carried)
    # own is the row's node.  A row ties its node to the first row of each further identifier, and such a first row to
    # its own node.  Where copies share all identifiers both ends are the same and nothing is left to search.
    ties = [repeated.where(F.col(f).isNotNull()).select(own.alias("a"), F.col(f).alias("b")) for f in firsts[1:]]
    ties.append(repeated.where(" or ".join(f"__r = {f}" for f in firsts[1:])).select(F.col("__r").alias("a"), own.alias("b")))
    labels = connected_labels(reduce(DataFrame.union, ties))
    return repeated.withColumn("__own", own).join(labels, F.col("__own") == F.col("node"), "left").select("__r", F.coalesce("label", "__own").alias("group_id"), *carried)


def message_groups(rows: DataFrame, row_id: str, identifiers: list[list[Column | str]]) -> DataFrame:
    """(row_id, group_id) for every row of a repeated group; group_id is the group's smallest row id.

    identifiers: each a list of columns that together name a message; an identifier
    with a null part names nothing.  Rows whose identifiers are all unique do not
    appear.  Row ids must be unique, orderable and not null.
    """
    slim = _identified(rows, row_id, identifiers, [])
    names = [f"__i{j}" for j in range(len(identifiers))]
    return _groups(slim, repeated_identifiers(slim, names), []).select(F.col("__r").alias(row_id), "group_id")


def _ranked(rows: DataFrame, row_id: str, identifiers: list[list[Column | str]], rank_by: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(__r, best) for every row of a repeated group, best telling whether it is the one to keep; and the repeated identifiers."""
    slim = _identified(rows, row_id, identifiers, [F.col(c).alias(f"__k{j}") for j, c in enumerate(rank_by)])
    often = repeated_identifiers(slim, [f"__i{j}" for j in range(len(identifiers))])
    groups = cut_lineage(_groups(slim, often, [f"__k{j}" for j in range(len(rank_by))]))
    order = [part.alias(f"o{j}{p}") for j in range(len(rank_by)) for p, part in (("n", F.col(f"__k{j}").isNotNull()), ("v", F.col(f"__k{j}")))]
    # A max aggregate, so a group that holds a third of all rows never meets in one task.
    best = groups.groupBy("group_id").agg(F.max(F.struct(*order, (-F.col("__r")).alias("neg"))).alias("b")).select((-F.col("b.neg")).alias("__best"))
    return groups.join(best, F.col("__r") == F.col("__best"), "left").select("__r", F.col("__best").isNotNull().alias("best")), often


def surplus_copies(rows: DataFrame, row_id: str, identifiers: list[list[Column | str]], rank_by: list[str]) -> DataFrame:
    """(row_id) of every copy but the one kept of its message.

    Kept is the row with the highest rank_by columns, in their order (null is
    lowest); of equals the one with the smallest row id, which must be a number.
    """
    return _ranked(rows, row_id, identifiers, rank_by)[0].where("not best").select(F.col("__r").alias(row_id))


def frequency_bits(often: list[DataFrame], power: int) -> DataFrame:
    """One row with a bit for each hash of a repeated identifier: an array of 2^power / 32768 bitmaps of 4 KB, null where no bit is set."""
    hashed = reduce(DataFrame.union, [k.select(F.pmod(F.xxhash64(F.lit(j), "__k"), F.lit(2**power)).alias("h")) for j, k in enumerate(often)])
    parts = hashed.groupBy(F.expr("h div 32768").cast("int").alias("b")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("m"))
    bits = parts.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("m"))  # at most 2^power / 32768 entries
    return bits.select(F.transform(F.sequence(F.lit(0), F.lit(2**power // 32768 - 1)), lambda k: F.col("m")[k]).alias("bits"))


def _may_repeat(names: list[str], bits: Column, power: int) -> Column:
    """Whether any identifier's bit is set."""
    out = F.lit(False)
    for j, n in enumerate(names):
        h = F.pmod(F.xxhash64(F.lit(j), F.col(n)), F.lit(2**power))
        byte = F.substr(F.element_at(bits, F.floor(h / 32768).cast("int") + 1), F.floor(h % 32768 / 8).cast("int") + 1, F.lit(1))
        out = out | (F.col(n).isNotNull() & F.coalesce(F.bit_get(F.conv(F.hex(byte), 16, 10).cast("int"), (h % 8).cast("int")) == 1, F.lit(False)))
    return out


def one_copy_each(rows: DataFrame, row_id: str, identifiers: list[list[Column | str]], rank_by: list[str], power: int = 26) -> DataFrame:
    """rows without surplus copies, all columns kept.

    Rows whose identifiers all occur once pass directly, without a shuffle: a filter
    of the repeated identifiers lets them through where they are read.  Only the other
    rows are joined with their rank, and both parts are united.  The filter has 2^power
    bits (8 MB), whatever the number of identifiers; the fuller it is, the more
    singletons take the longer way, and none is lost.
    Defined results: an empty input gives an empty output; a row whose identifiers are
    all null stays; equal values in other columns never make two rows copies.  Columns
    of the input may have any names but those beginning with two underscores.
    """
    ranked, often = _ranked(rows, row_id, identifiers, rank_by)
    names = [f"__i{j}" for j in range(len(identifiers))]
    bits = cut_lineage(frequency_bits(often, power)).scalar()
    told = _identified(rows, row_id, identifiers, [F.col(c) for c in rows.columns]).withColumn("__may", _may_repeat(names, bits, power))
    singles = told.where("not __may").select(*rows.columns)
    surplus = ranked.where("not best").select(F.col("__r").alias("__surplus"))
    others = told.where("__may").select("__r", *rows.columns).join(surplus, F.col("__r") == F.col("__surplus"), "left_anti").select(*rows.columns)
    return singles.union(others)


def one_copy_of_all(stored: DataFrame, new: DataFrame, row_id: str, identifiers: list[list[Column | str]], rank_by: list[str]) -> DataFrame:
    """One copy of each message among all stored and new deliveries; a column that one side lacks is null there.

    stored are deliveries as they came, surplus copies included: a copy that is not
    kept can still tie a later one to its message.  So batches give the same result
    whether they come together or one after the other.
    """
    return one_copy_each(stored.unionByName(new, allowMissingColumns=True), row_id, identifiers, rank_by)


def outbox_identifiers() -> list[list[Column | str]]:
    """Identifiers of a delivery_outbox row: its outbox_id, and its session with the plain idempotency key."""
    return [["outbox_id"], ["scan_session_id", plain_key("idempotency_key")]]
