"""Ordered rows within a key: islands, stability windows, samplers, holds, rankings, chunks.

All are windows over (keys, order); the key carries the shuffle.  `order` must be a
total order of a key's rows, or the result depends on ties.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F


def _w(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _so_far(keys: list[str], order: list[str]) -> Window:
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def reindexed(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Rows numbered from 0 in order."""
    return rows.withColumn(name, F.row_number().over(_w(keys, order)) - 1)


def islands(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows with island: numbers the stretches of equal value; a null value is a value of its own."""
    v = rows.withColumn("__v", value)
    first = F.row_number().over(_w(keys, order)) == 1
    change = F.when(first | ~F.col("__v").eqNullSafe(F.lag("__v").over(_w(keys, order))), 1).otherwise(0)
    return v.withColumn("__c", change).withColumn("island", F.sum("__c").over(_so_far(keys, order))).drop("__v", "__c")


def island_rows(rows: DataFrame, keys: list[str], order: list[str], value: str, time: str) -> DataFrame:
    """(keys, island, value, n, first_time, last_time) of each stretch."""
    return islands(rows, keys, order, F.col(value)).groupBy(*keys, "island").agg(F.min(value).alias(value), F.count("*").alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def token_runs(tokens: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """Tokens with run_kind and run: OTHER tokens go with the run that is open; before any run they are TEXT."""
    open_kind = F.coalesce(F.last(F.when(F.col(kind) != "OTHER", F.col(kind)), ignorenulls=True).over(_so_far(keys, order)), F.lit("TEXT"))
    marked = tokens.withColumn("run_kind", open_kind)
    return islands(marked, keys, order, F.col("run_kind")).withColumnRenamed("island", "run")


def scope_starts(rows: DataFrame, keys: list[str], order: list[str], start: Column) -> DataFrame:
    """Rows with scope: 0 before the first start, else its number."""
    return rows.withColumn("__s", F.when(start, 1).otherwise(0)).withColumn("scope", F.sum("__s").over(_so_far(keys, order))).drop("__s")


def best_of(rows: DataFrame, keys: list[str], ranking: list[Column], columns: list[str]) -> DataFrame:
    """The best row of each key by a ranking of values (higher is better); a max aggregate, so hot keys combine before the shuffle."""
    rank = F.struct(*[r.alias(f"r{k}") for k, r in enumerate(ranking)], *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])
    return rows.groupBy(*keys).agg(F.max(rank).alias("m")).select(*keys, *[F.col(f"m.c{k}").alias(c) for k, c in enumerate(columns)])


def top_k(rows: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key, with place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key: what a bounded ring holds."""
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).where(F.col("__p") <= n).drop("__p")


def window_drops(rows: DataFrame, keys: list[str], order: list[str], capacity: int) -> DataFrame:
    """Rows with held and dropped: the size of a sliding window of `capacity` rows and how many it has let go."""
    n = F.row_number().over(_w(keys, order))
    return rows.withColumn("held", F.least(n, F.lit(capacity))).withColumn("dropped", F.greatest(n - capacity, F.lit(0)))


def range_stability(rows: DataFrame, keys: list[str], order: list[str], limits: dict[str, float], n: int = 3) -> DataFrame:
    """Rows with state over the last n: STABLE if max - min of each measure is within its limit, MOVING if not, UNSTABLE with fewer rows."""
    w = _w(keys, order).rowsBetween(-(n - 1), 0)
    ok = F.lit(True)
    for column, limit in limits.items():
        ok = ok & (F.max(column).over(w) - F.min(column).over(w) <= limit)
    return rows.withColumn("state", F.when(F.count("*").over(w) < n, "UNSTABLE").when(ok, "STABLE").otherwise("MOVING"))


def pair_stability(rows: DataFrame, keys: list[str], order: list[str], time: str, limits: dict[str, float], n: int = 3) -> DataFrame:
    """Rows with state over the last n rows, compared pair by pair: STALE if time does not rise, MOVING if a step exceeds its limit, UNSTABLE with fewer rows."""
    w = _w(keys, order)
    pairs = w.rowsBetween(-(n - 2), 0)
    marked = rows.withColumn("__t", F.lag(time).over(w))
    ok = F.lit(True)
    for k, (column, limit) in enumerate(limits.items()):
        marked = marked.withColumn(f"__d{k}", F.abs(F.col(column) - F.lag(column).over(w)))
        ok = ok & (F.max(f"__d{k}").over(pairs) <= limit)
    stale = F.max(F.when(F.col(time) <= F.col("__t"), 1).otherwise(0)).over(pairs) == 1
    out = marked.withColumn("state", F.when(F.count("*").over(w.rowsBetween(-(n - 1), 0)) < n, "UNSTABLE").when(stale, "STALE").when(ok, "STABLE").otherwise("MOVING"))
    return out.drop("__t", *[f"__d{k}" for k in range(len(limits))])


def changed_after(rows: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """Rows at which a value has stood for exactly k rows and is another than the last value that had: confirmed changes."""
    run = islands(rows, keys, order, F.col(value))
    nth = run.withColumn("__n", F.row_number().over(_w([*keys, "island"], order))).where(F.col("__n") == k)
    before = F.lag(value).over(_w(keys, order))
    return nth.withColumn("previous", before).where(~F.col(value).eqNullSafe(F.col("previous"))).drop("__n", "island")


def held(rows: DataFrame, keys: list[str], order: list[str], value: str, time: str, samples: int, millis: int) -> DataFrame:
    """(keys, value, since, at, n): the first row of each stretch at which the value has been there for enough samples and time; null values never hold."""
    run = islands(rows, keys, order, F.col(value))
    w = _w([*keys, "island"], order)
    marked = run.withColumn("n", F.row_number().over(w)).withColumn("since", F.min(time).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ready = marked.where(F.col(value).isNotNull() & (F.col("n") >= samples) & (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) >= millis * 1000))
    return ready.groupBy(*keys, "island", value, "since").agg(F.min(time).alias("at"), F.min("n").alias("n")).drop("island")


def first_decision(rows: DataFrame, keys: list[str], order: list[str], hit: Column, n: int, k_same: int, k_different: int) -> DataFrame:
    """(keys, decided_at, verdict): the first sample at which the count of hits is decided whatever follows."""
    place = F.row_number().over(_w(keys, order))
    marked = rows.withColumn("i", place).where(F.col("i") <= n).withColumn("m", F.sum(F.when(hit, 1).otherwise(0)).over(_so_far(keys, order)))
    same, different = F.col("m") >= k_same, F.col("m") + (n - F.col("i")) <= k_different
    out = marked.groupBy(*keys).agg(F.min(F.when(same | different, F.col("i"))).alias("d"), F.max("i").alias("seen"), F.min(F.when(same, F.col("i"))).alias("s"))
    return out.select(*keys, F.coalesce("d", F.least("seen", F.lit(n))).cast("int").alias("decided_at"), F.when(F.col("s") == F.col("d"), "SAME").when(F.col("d").isNotNull(), "DIFFERENT").otherwise("UNKNOWN").alias("verdict"))


def grid_samples(rows: DataFrame, keys: list[str], frame: str, step: Column | int) -> DataFrame:
    """Rows whose frame lies on a grid that begins at the key's first frame; nothing is filled in."""
    return rows.withColumn("__0", F.min(frame).over(Window.partitionBy(*keys))).where((F.col(frame) - F.col("__0")) % step == 0).drop("__0")


def cadence_samples(rows: DataFrame, key: str, time_s: str, interval: float, row_id: str) -> DataFrame:
    """(key, row_id) of the rows a sampler accepts that waits `interval` seconds after each accepted row (its grid drifts)."""
    from quirework.streaming.frames import cadence

    named = rows.select(key, F.col(time_s).cast("double").alias("t"), F.col(row_id).cast("long").alias("frame"))
    return cadence(interval).batch(named, key).select(key, F.col("frame").alias(row_id))


def hold_pulses(presses: DataFrame, down: str, up: str, delay_ms: int, interval_ms: int) -> DataFrame:
    """Presses with a row for each pulse: one at the press, then, once held for delay_ms, one each interval_ms until the release."""
    held_us = F.unix_micros(F.col(up).cast("timestamp")) - F.unix_micros(F.col(down).cast("timestamp"))
    more = F.when(held_us >= delay_ms * 1000, F.transform(F.sequence(F.lit(0).cast("long"), (held_us - delay_ms * 1000).cast("long"), F.lit(interval_ms * 1000).cast("long")), lambda x: x + delay_ms * 1000)).otherwise(F.array().cast("array<bigint>"))
    offsets = F.concat(F.array(F.lit(0).cast("long")), more)
    return presses.withColumn("__o", F.explode(offsets)).withColumn("pulse_ms", F.col("__o") / 1000).drop("__o")


def neighbours(rows: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """Rows with previous_item and next_item in order; null at the ends."""
    w = _w(keys, order)
    return rows.withColumn("previous_item", F.lag(item).over(w)).withColumn("next_item", F.lead(item).over(w))


def viewport(cells: Column, offset: Column, size: int) -> Column:
    """struct<offset, cells, total, has_previous, has_next>: the window of `size` cells at an offset that is kept inside."""
    total = F.size(cells)
    last = F.greatest(F.floor((total - 1) / size) * size, F.lit(0)).cast("int")
    at = F.greatest(F.lit(0), F.least(offset, last)).cast("int")
    return F.struct(at.alias("offset"), F.slice(cells, at + 1, F.lit(size)).alias("cells"), total.alias("total"), (at > 0).alias("has_previous"), (at + size < total).alias("has_next"))


def chunks(cells: Column, size: int) -> Column:
    """All windows of an array, one after the other; none for an empty one."""
    return F.when(F.size(cells) > 0, F.transform(F.sequence(F.lit(0), F.size(cells) - 1, F.lit(size)), lambda o: F.slice(cells, o + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def transitions(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """(from_state, to_state, n): how often a state follows another within a key."""
    return rows.withColumn("from_state", F.lag(state).over(_w(keys, order))).where("from_state is not null").groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))


def latest_generation(rows: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """Rows of each key's highest generation: stale results are left out."""
    top = rows.groupBy(*keys).agg(F.max(generation).alias("__g"))
    return rows.join(top, keys).where(F.col(generation) == F.col("__g")).drop("__g")


def only_changes(rows: DataFrame, keys: list[str], order: list[str], snapshot: Column) -> DataFrame:
    """Rows whose snapshot differs from the row before."""
    return rows.withColumn("__s", F.xxhash64(snapshot)).withColumn("__p", F.lag("__s").over(_w(keys, order))).where("__p is null or __p <> __s").drop("__s", "__p")
