"""Event and state tables: replays, cut-offs, roll-ups, queues, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def idempotency_conflicts(rows: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key, deliveries, digests, outcome): REPLAY if a key came again with the same content, CONFLICT with other content, FIRST otherwise."""
    out = rows.groupBy(*key).agg(F.count("*").alias("deliveries"), F.count_distinct(digest).alias("digests"))
    return out.withColumn("outcome", F.when(F.col("digests") > 1, "CONFLICT").when(F.col("deliveries") > 1, "REPLAY").otherwise("FIRST"))


def replay_outcomes(rows: DataFrame, keys: list[str], arrival: list[str], sequence: str, digest: str) -> DataFrame:
    """Rows with outcome against the highest sequence that arrived before: accepted, stale, replay, or collision with what came first at that sequence."""
    order = Window.partitionBy(*keys).orderBy(*arrival)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct(F.col(sequence).alias("s"), (-F.col("__n")).alias("n"), F.col(digest).alias("d"))).over(before)
    marked = rows.withColumn("__n", F.row_number().over(order)).withColumn("__top", top)
    outcome = F.when(F.col("__top").isNull() | (F.col(sequence) > F.col("__top.s")), "accepted").when(F.col(sequence) < F.col("__top.s"), "stale").when(F.col(digest).eqNullSafe(F.col("__top.d")), "replay").otherwise("collision")
    return marked.withColumn("outcome", outcome).drop("__n", "__top")


def within_cutoff(rows: DataFrame, cutoffs: DataFrame, keys: list[str], sequence: str, cutoff: str) -> DataFrame:
    """Rows with accepted: keys without a cut-off take everything, others sequences up to it."""
    return rows.join(cutoffs.select(*keys, cutoff), keys, "left").withColumn("accepted", F.col(cutoff).isNull() | (F.col(sequence) <= F.col(cutoff)))


def gapless(rows: DataFrame, keys: list[str], sequence: str, cutoff: Column | None = None) -> DataFrame:
    """(keys, n, first, last, complete): whether the distinct sequences are exactly 1..cutoff (default: 1..last)."""
    out = rows.groupBy(*keys).agg(F.count_distinct(sequence).alias("n"), F.min(sequence).alias("first"), F.max(sequence).alias("last"), *([F.max(cutoff).alias("__cut")] if cutoff is not None else []))
    end = F.col("__cut") if cutoff is not None else F.col("last")
    return out.withColumn("complete", (F.col("first") == 1) & (F.col("last") == end) & (F.col("n") == end)).select(*keys, "n", "first", "last", "complete")


def status_rollup(rows: DataFrame, keys: list[str], status: str, precedence: list[str], all_of: str, otherwise: str) -> DataFrame:
    """(keys, n, status): the first status of precedence that any row has, all_of if all rows have it, else otherwise."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(F.col(status) == all_of).alias("all"), *[F.bool_or(F.col(status) == p).alias(f"any{k}") for k, p in enumerate(precedence)])
    chosen = F.when(F.lit(False), "")
    for k, p in enumerate(precedence):
        chosen = chosen.when(F.col(f"any{k}"), p)
    return out.select(*keys, "n", chosen.when(F.col("all"), all_of).otherwise(otherwise).alias("status"))


def zero_filled(rows: DataFrame, values: list[str], column: str) -> DataFrame:
    """(column, n): how often each value occurs; those of a fixed list appear with 0 if none does, values outside it, null too, with their number."""
    fixed = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string").withColumn("n", F.lit(0).cast("long"))
    return rows.groupBy(column).agg(F.count("*").alias("n")).union(fixed).groupBy(column).agg(F.sum("n").alias("n"))


def sum_of_max(rows: DataFrame, keys: list[str], item: str, size: str) -> DataFrame:
    """(keys, total): each item's largest size, summed; 0 without sizes."""
    return rows.groupBy(*keys, item).agg(F.max(size).alias("m")).groupBy(*keys).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("total"))


def presence(sessions: DataFrame, device: str, seen: str, now: Column, stale_s: float = 45, offline_s: float = 120) -> DataFrame:
    """(device, state, live, split_brain): a device is as present as its most present session."""
    from quirework.functions.values import age_class

    state = age_class(F.col(seen), now, stale_s, offline_s)
    rank = F.when(state == "online", 2).when(state == "stale", 1).otherwise(0)
    out = sessions.groupBy(device).agg(F.max(rank).alias("r"), F.count_if(rank > 0).alias("live"))
    return out.select(device, F.when(F.col("r") == 2, "online").when(F.col("r") == 1, "stale").otherwise("offline").alias("state"), "live", (F.col("live") > 1).alias("split_brain"))


def last_state(events: DataFrame, key: list[str], state: str, at: str, tie: str) -> DataFrame:
    """(key, state, at, events): the state of the last event, of equals the highest tie."""
    return events.groupBy(*key).agg(F.max(F.struct(F.col(at).alias("t"), F.col(tie).alias("i"), F.col(state).alias("s"))).alias("m"), F.count("*").alias("events")).select(*key, F.col("m.s").alias(state), F.col("m.t").alias(at), "events")


def flush_status(outbox: DataFrame, keys: list[str], sequence: str, status: str, through: DataFrame, cutoff: str) -> DataFrame:
    """(keys, state, missing): over sequences 1..cutoff - BLOCKED with any rejected, FLUSHED if all are acked, else PENDING.

    through: keys and cutoff.  Counting distinct acked sequences replaces the list of required ones.
    """
    rows = outbox.join(through, keys).where(F.col(sequence).between(1, F.col(cutoff)))
    got = rows.groupBy(*keys).agg(F.bool_or(F.col(status) == "rejected").alias("r"), F.count_distinct(F.when(F.col(status) == "acked", F.col(sequence))).alias("a"))
    out = through.join(got, keys, "left")
    return out.select(*keys, F.when(F.coalesce("r", F.lit(False)), "BLOCKED").when(F.coalesce("a", F.lit(0)) >= F.col(cutoff), "FLUSHED").otherwise("PENDING").alias("state"), (F.col(cutoff) - F.coalesce("a", F.lit(0))).alias("missing"))


def lease_outcomes(rows: DataFrame, leased_until: str, attempts: str, now: Column, most: int = 3) -> DataFrame:
    """Rows with lease: live, queued again after it ran out, or exhausted after too many attempts; free without a lease."""
    out = F.when(F.col(leased_until).isNull(), "free").when(F.col(leased_until) > now, "live").when(F.col(attempts) >= most, "exhausted").otherwise("queued")
    return rows.withColumn("lease", out)


def next_in_queue(tasks: DataFrame, owners: DataFrame, on: str, order: list[str], k: int = 1) -> DataFrame:
    """The first k queued tasks with their owner's columns; a top-k, so nothing is sorted in full."""
    return tasks.join(owners, on).orderBy(*order).limit(k)


def current_revisions(items: DataFrame, revisions: DataFrame, item: str, current: str, revision: str) -> DataFrame:
    """Items joined to the revision that is their current one."""
    return items.join(revisions, (items[item] == revisions[item]) & (items[current] == revisions[revision])).drop(revisions[item])


def orphans(found: DataFrame, known: DataFrame, key: str, modified: str, before: Column) -> DataFrame:
    """Found entries that nothing knows and that have not changed since `before`."""
    return found.join(known.select(key), key, "left_anti").where(F.col(modified) <= before)


def nested(parents: DataFrame, children: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Parents with their children as a sorted array of structs, empty where there are none."""
    packed = children.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    kinds = dict(packed.dtypes)[name]
    return parents.join(packed, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(kinds)))


def folded_report(events: DataFrame, run: str, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(run, check columns, status): each check is (passes, fails); a check is failed by any failing event, passed by a passing one, else missing; the run has passed if all have."""
    out = events.groupBy(run).agg(*[x for n, (p, f) in checks.items() for x in (F.coalesce(F.bool_or(p), F.lit(False)).alias(f"p_{n}"), F.coalesce(F.bool_or(f), F.lit(False)).alias(f"f_{n}"))])
    state = lambda n: F.when(F.col(f"f_{n}"), "failed").when(F.col(f"p_{n}"), "passed").otherwise("missing")
    cols = out.select(run, *[state(n).alias(n) for n in checks])
    every, some = None, None
    for n in checks:
        every = (F.col(n) == "passed") if every is None else every & (F.col(n) == "passed")
        some = (F.col(n) == "failed") if some is None else some | (F.col(n) == "failed")
    return cols.withColumn("status", F.when(every, "passed").when(some, "failed").otherwise("provisional"))
