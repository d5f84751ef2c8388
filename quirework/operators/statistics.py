"""Match statistics: indicators, thresholds, intervals, autocorrelation, consensus."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quirework.session import cut_lineage

Z95 = 1.959963984540054


def match_indicators(queries: DataFrame, bank: DataFrame, on: list[str], match: Column | None = None, query_id: str = "query_id") -> DataFrame:
    """(query_id, hit): whether any bank row matches a query - one row a query, never one a pair.

    on: equality columns (a null or blank never matches); match: a further condition
    over q_ and r_ columns.
    """
    real = lambda df: df.where(" and ".join(f"{c} is not null and trim(cast({c} as string)) <> ''" for c in on))
    q = real(queries).select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    r = real(bank).select(*[F.col(c).alias(f"r_{c}") for c in bank.columns])
    cond = F.expr(" and ".join(f"q_{c} = r_{c}" for c in on))
    hits = q.join(r, cond & match if match is not None else cond, "left_semi").select(F.col(f"q_{query_id}").alias("__q")).distinct()
    return queries.select(query_id).join(hits, F.col(query_id) == F.col("__q"), "left").select(query_id, F.col("__q").isNotNull().alias("hit"))


def token_overlap(a: Column, b: Column) -> Column:
    """Two token arrays share a token; blanks and nulls never match."""
    clean = lambda x: F.filter(x, lambda t: t.isNotNull() & (F.trim(t) != ""))
    return F.coalesce(F.arrays_overlap(clean(a), clean(b)), F.lit(False))


def visual_match(hamming: Column, mae: Column, ncc: Column, strict: bool) -> Column:
    """A strict (8, 0.03, 0.90) or relaxed (18, 0.06, 0.78) match of two visual descriptors."""
    h, m, n = (8, 0.03, 0.90) if strict else (18, 0.06, 0.78)
    return F.coalesce((hamming <= h) & (mae <= m) & (ncc >= n), F.lit(False))


def hybrid_match(hamming: Column, mae: Column, ncc: Column, tokens: Column) -> Column:
    """Strictly alike, or alike enough and with a token in common."""
    return visual_match(hamming, mae, ncc, True) | (visual_match(hamming, mae, ncc, False) & tokens)


def contradiction(hamming: Column, mae: Column) -> Column:
    """Whole pages so different that a match of their parts is void."""
    return F.coalesce((hamming >= 20) & (mae >= 0.06), F.lit(False))


def visual_relation(hamming: Column, mae: Column, feature: Column, same_version: Column) -> Column:
    """same, different or ambiguous for one side of a spread."""
    return (
        F.when(~same_version, "ambiguous")
        .when(((hamming <= 8) & (mae <= 0.03)) | ((feature >= 0.18) & (hamming <= 28)), "same")
        .when((hamming >= 20) & (mae >= 0.06) & (feature <= 0.08), "different")
        .otherwise("ambiguous")
    )


def ledger_match(candidates: DataFrame, query_id: str, kind: str, recency: str, entry: str) -> DataFrame:
    """(query_id, entry, kind): an exact entry before a visual before an ambiguous one, the newest first."""
    rank = F.when(F.col(kind) == "EXACT_DUPLICATE", 3).when(F.col(kind) == "VISUAL_DUPLICATE", 2).when(F.col(kind) == "AMBIGUOUS", 1)
    best = F.max(F.struct(rank.alias("r"), F.col(recency).alias("t"), F.col(entry).alias("e"), F.col(kind).alias("k"))).alias("m")
    return candidates.where(rank.isNotNull()).groupBy(query_id).agg(best).select(query_id, F.col("m.e").alias(entry), F.col("m.k").alias(kind))


def classify_count(matches: Column, k_different: Column, k_same: Column) -> Column:
    """SAME from k_same matches on, DIFFERENT up to k_different, UNKNOWN between."""
    return F.when(matches >= k_same, "SAME").when(matches <= k_different, "DIFFERENT").otherwise("UNKNOWN")


def threshold_grid(spark: SparkSession, n: int) -> DataFrame:
    """(k_different, k_same): all pairs with 0 <= k_different < k_same <= n; n * (n + 1) / 2 rows."""
    ks = spark.range(1, n + 1).select(F.col("id").cast("int").alias("k_same"))
    return ks.select(F.explode(F.sequence(F.lit(0), F.col("k_same") - 1)).alias("k_different"), "k_same")


def score_thresholds(counts: DataFrame, n: int) -> DataFrame:
    """(k_different, k_same, false_same, false_different, unknown, trials) over rows (expected, matches).

    The rows are counted by (expected, matches) first, so the grid of n^2 thresholds
    meets at most 2 * (n + 1) rows.
    """
    grid = threshold_grid(counts.sparkSession, n)
    few = counts.groupBy("expected", "matches").agg(F.count("*").alias("c"))
    got = few.join(F.broadcast(grid), F.lit(True)).withColumn("v", classify_count(F.col("matches"), F.col("k_different"), F.col("k_same")))
    total = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    return got.groupBy("k_different", "k_same").agg(
        total((F.col("v") == "SAME") & (F.col("expected") == "DIFFERENT")).alias("false_same"), total((F.col("v") == "DIFFERENT") & (F.col("expected") == "SAME")).alias("false_different"),
        total(F.col("v") == "UNKNOWN").alias("unknown"), F.sum("c").alias("trials"),
    )


def wilson(hits: Column, n: Column, z: float = Z95) -> Column:
    """struct<low, high>: Wilson's interval of a share; null without trials."""
    p = F.try_divide(hits.cast("double"), n)
    mid, width, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (mid - width) / scale).alias("low"), F.least(F.lit(1.0), (mid + width) / scale).alias("high")))


def zero_error_bound(n: Column, alpha: float = 0.05) -> Column:
    """Upper bound of an error rate of which n trials showed none: 1 - alpha^(1/n)."""
    return F.when(n > 0, 1 - F.pow(F.lit(alpha), 1 / n))


def any_of(p: Column, n: Column) -> Column:
    """Probability of at least one hit in n independent trials."""
    return 1 - F.pow(1 - p, n)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(__k, n, one column a share): exact quantiles of a value by linear interpolation; __k is the struct of the keys.

    Equal values are counted first, the counts are range-sorted into chunks, and the
    place of a value follows from the sizes of the chunks before its own: a group that
    holds all rows spreads over all tasks.  Null values count for nothing.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("__k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    chunks = cut_lineage(counts.repartitionByRange("__k", "v").withColumn("chunk", F.spark_partition_id()))
    sizes = chunks.groupBy("__k", "chunk").agg(F.sum("c").alias("t"))  # a row for each chunk and the groups in it
    group = Window.partitionBy("__k")
    before = sizes.select("__k", "chunk", (F.sum("t").over(group.orderBy("chunk")) - F.col("t")).alias("b"), F.sum("t").over(group).alias("n"))
    end = F.col("b") + F.sum("c").over(Window.partitionBy("__k", "chunk").orderBy("v"))
    placed = chunks.join(before, ["__k", "chunk"]).withColumn("hi", end).withColumn("lo", F.col("hi") - F.col("c"))
    at = lambda place: F.max(F.when((F.col("lo") <= place) & (place < F.col("hi")), F.col("v")))
    columns = []
    for name, q in shares.items():
        place = q * (F.col("n") - 1)
        columns += [at(F.floor(place)).alias(f"{name}_a"), at(F.ceil(place)).alias(f"{name}_b")]
    found = placed.groupBy("__k", "n").agg(*columns)
    between = [(F.col(f"{m}_a") + (F.col(f"{m}_b") - F.col(f"{m}_a")) * (q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1)))).alias(m) for m, q in shares.items()]
    return found.select("__k", "n", *between)


def spread_summary(rows: DataFrame, keys: list[str], value: str, low: float | None = None) -> DataFrame:
    """n, mean, median, 10th percentile (linear) of a value, and the share of rows below `low`."""
    share = F.avg(F.when(F.col(value) < low, 1.0).otherwise(0.0)) if low is not None else F.lit(None).cast("double")
    plain = rows.groupBy(F.struct(*keys).alias("__k")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), share.alias("low_share"))
    out = plain.join(exact_quantiles(rows, keys, value, {"median": 0.5, "p10": 0.1}).drop("n"), "__k", "left")
    return out.select("__k.*", "n", "mean", "median", "p10", "low_share")


def autocorrelation(rows: DataFrame, keys: list[str], order: list[str], value: str, lags: int = 10) -> DataFrame:
    """(keys, lag, rho) for lags below the number of rows: clipped to -1..1, 1 for a constant series, none for fewer than two rows.

    The windows shift one copy of the rows; nothing is joined.
    """
    w = Window.partitionBy(*keys)
    x = F.col(value).cast("double")
    centred = rows.withColumn("__d", x - F.avg(x).over(w)).withColumn("__n", F.count("*").over(w)).where("__n > 1")
    shifted = centred.select(*keys, "__n", "__d", *[F.lead("__d", k).over(w.orderBy(*order)).alias(f"__{k}") for k in range(1, lags + 1)])
    sums = shifted.groupBy(*keys).agg(F.max("__n").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("v"), *[F.coalesce(F.sum(F.col("__d") * F.col(f"__{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, lags + 1)])
    long = sums.select(*keys, "n", "v", F.posexplode(F.array(*[f"s{k}" for k in range(1, lags + 1)])).alias("p", "s")).withColumn("lag", F.col("p") + 1).where("lag < n")
    rho = F.when(F.col("v") <= 1e-12, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("s", "v"))))
    return long.select(*keys, "n", "lag", rho.alias("rho"))


def effective_size(rho: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ess): n / (1 + 2 * sum of the leading positive autocorrelations), between 1 and n."""
    w = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    lead = rho.withColumn("__ok", F.min(F.when(F.col("rho") > 0, 1).otherwise(0)).over(w))
    return lead.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.least(F.max("n").cast("double"), F.max("n") / (1 + 2 * F.sum(F.when(F.col("__ok") == 1, F.col("rho")).otherwise(0.0))))).alias("ess"))


def block_bootstrap(rows: DataFrame, keys: list[str], order: list[str], value: str, block: int, iterations: int = 2000, seed: int = 3404) -> DataFrame:
    """(keys, mean, low, high): interval of a mean by resampling moving blocks; Python's generator, so an equal seed gives equal bounds."""
    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", mean double, low double, high double"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(order)[value].astype(float).tolist()
        n, rng = len(x), random.Random(seed)
        size = max(1, min(block, n))
        sums = [0.0]
        for v in x:
            sums.append(sums[-1] + v)
        means = []
        for _ in range(iterations):
            total, left = 0.0, n
            while left > 0:
                at = rng.randrange(n - size + 1)
                take = min(size, left)
                total += sums[at + take] - sums[at]
                left -= take
            means.append(total / n)
        means.sort()
        low, high = max(0, round(0.025 * iterations) - 1), min(iterations - 1, round(0.975 * iterations) - 1)
        return pd.DataFrame([(*key, sums[-1] / n, means[low], means[high])], columns=[*keys, "mean", "low", "high"])

    return rows.where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(run, schema)


def consensus(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, votes, n): the most frequent value; of equals the one seen first.  Two aggregates, no window."""
    votes = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(order).alias("f"))
    best = F.min(F.struct((-F.col("c")).alias("c"), "f", F.col(value).alias("v"))).alias("m")
    return votes.groupBy(*keys).agg(best, F.sum("c").alias("n")).select(*keys, F.col("m.v").alias(value), (-F.col("m.c")).alias("votes"), "n")


def mask_metrics(pixels: DataFrame, keys: list[str], truth: str, found: str) -> DataFrame:
    """(keys, iou, dice, recall, leakage) of two boolean masks with a row a pixel."""
    both, either = F.count_if(F.col(truth) & F.col(found)), F.count_if(F.col(truth) | F.col(found))
    t, f = F.count_if(F.col(truth)), F.count_if(F.col(found))
    return pixels.groupBy(*keys).agg(F.try_divide(both, either).alias("iou"), F.try_divide(2 * both, t + f).alias("dice"), F.try_divide(both, t).alias("recall"), F.try_divide(f - both, f).alias("leakage"))
