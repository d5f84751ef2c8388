"""Mixing sources to target weights.

Texts are grouped by the set of sources they belong to (a text ingested under
several sources belongs to each).  These membership patterns, few whatever the
corpus, are the nodes of a min-cost flow: tokens run from patterns to source
quotas, the k-th use of a text costs more than the one before, and no source uses
a text more often than its cap.  The flow says how many tokens each pattern gives
to each source; a seeded order of the pattern's texts then says which ones.
"""

from __future__ import annotations

import ast
import base64
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quirework.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut_pattern(path: str) -> str:
    """The pre-tokenisation pattern that belongs to the vocabulary files beside path: the text assigned to PATTERN there.  The file is read, never run."""
    with open(os.path.join(os.path.dirname(path), "__init__.py")) as source:
        for step in ast.parse(source.read()).body:
            if isinstance(step, ast.Assign) and [getattr(t, "id", None) for t in step.targets] == ["PATTERN"]:
                return ast.literal_eval(step.value)
    raise ValueError(f"no PATTERN beside {path}; give pattern")


class Network:
    """Integer min-cost flow by successive shortest paths with potentials."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = {}
        self.to: list[object] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a, b, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.out.setdefault(y, [])
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source, sink) -> int:
        """Send as much as possible at the least cost; the amount sent.  Costs must not be negative."""
        height, sent = dict.fromkeys(self.out, 0), 0
        while True:
            far, via, heap, order = {source: 0}, {}, [(0, 0, source)], 0
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for k in self.out[x]:
                    y = self.to[k]
                    step = d + self.cost[k] + height[x] - height[y]
                    if self.room[k] > 0 and step < far.get(y, step + 1):
                        far[y], via[y] = step, k
                        order += 1
                        heapq.heappush(heap, (step, order, y))
            if sink not in far:
                return sent
            for x in height:
                height[x] += min(far.get(x, far[sink]), far[sink])
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            amount = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= amount
                self.room[k ^ 1] += amount
            sent += amount

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def reached(self, source) -> set:
        seen, todo = {source}, [source]
        while todo:
            for k in self.out[todo.pop()]:
                if self.room[k] > 0 and self.to[k] not in seen:
                    seen.add(self.to[k])
                    todo.append(self.to[k])
        return seen


@dataclass(frozen=True)
class Plan:
    """tokens: (pattern, source) -> tokens to draw; total: tokens of the mix; quota: source -> tokens wanted."""

    tokens: dict[tuple[tuple[str, ...], str], int]
    total: int
    quota: dict[str, int]


def _flow(patterns: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> tuple[Network, dict, int]:
    net, arcs = Network(), {}
    for p, n in sorted(patterns.items()):
        for k in range(max(repeats[s] for s in p)):
            net.arc("in", ("p", p), n, k)  # the k-th repetition of every text of the pattern
        for s in p:
            arcs[p, s] = net.arc(("p", p), ("s", s), n * repeats[s])
    for s, q in sorted(quota.items()):
        net.arc(("s", s), "out", q)
    net.out.setdefault("in", []), net.out.setdefault("out", [])
    return net, arcs, net.run("in", "out")


def plan_mix(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> Plan:
    """Tokens that each pattern gives to each source.

    patterns: sources of a pattern -> tokens of its texts.  Without total, the mix is
    the largest in which every source reaches its share: as long as quotas stay open,
    the sources cut off from further tokens say how far the total must come down.
    With a total that is too large, each source gets what its texts allow.
    """
    patterns = {tuple(sorted(s for s in p if repeats.get(s, 0) > 0 and shares.get(s, 0) > 0)): n for p, n in patterns.items()}
    merged: dict[tuple[str, ...], int] = {}
    for p, n in patterns.items():
        if p and n > 0:
            merged[p] = merged.get(p, 0) + n
    wanted = {s: w for s, w in shares.items() if w > 0}
    size = total if total is not None else sum(n * max(repeats[s] for s in p) for p, n in merged.items())
    while True:
        quota = {s: int(size * w) for s, w in wanted.items()}
        net, arcs, sent = _flow(merged, quota, repeats)
        if total is not None or sent == sum(quota.values()):
            return Plan({k: net.sent(a) for k, a in arcs.items() if net.sent(a)}, size, quota)
        open_side = net.reached("in")
        starved = [s for s in wanted if ("s", s) not in open_side]
        got = sum(net.sent(a) for (p, s), a in arcs.items() if s in starved)
        size = min(size - 1, int(got / sum(wanted[s] for s in starved)))


def plain_source(source: Column | str) -> Column:
    """A source name without outer blanks and letter case."""
    return F.lower(F.trim(source))


class Mixture:
    """A drawn mix: documents() and shares().

    documents need doc_id, text and source; targets source, target_share and
    max_repeats (one row a source).  Equal texts count as one document, which
    belongs to the sources of all its copies.  Defined results: documents whose
    source is null or no target (or one with no share or no use allowed), and null or empty texts, are not drawn; a source
    without texts makes the largest mix empty (give total_tokens to mix the rest);
    an equal seed draws equal documents.  A source's tokens differ from its quota by
    less than one document for each pattern.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, total_tokens: int | None = None,
        tokenizer: str = TOKENIZER, pattern: str | None = None, buckets: int = 4096, max_patterns: int = 100_000, max_targets: int = 10_000,
    ) -> None:
        self.spark = documents.sparkSession
        wanted = targets.select(plain_source("source").alias("s"), "target_share", "max_repeats").where("s is not null").limit(max_targets + 1).collect()
        if len(wanted) > max_targets:
            raise ValueError(f"more than {max_targets} target sources; give fewer or a larger max_targets")
        self.shares = {r[0]: float(r[1] or 0) for r in wanted}
        self.repeats = repeats = {r[0]: int(r[2] or 0) for r in wanted}
        cut = pattern or cut_pattern(tokenizer)
        id_type = dict(documents.dtypes)[doc_id]

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = _encoding(tokenizer, cut).encode_ordinary
            for batch in batches:
                codes, kinds = pd.factorize(batch["h"])  # a text that a batch holds often is cut once
                first = pd.Series(range(len(batch))).groupby(codes).first()
                tokens = np.array([len(encode(batch["text"].iloc[k])) for k in first], np.int64)
                yield pd.DataFrame({"id": batch["id"], "source": batch["source"], "h": batch["h"], "tokens": tokens[codes]})

        slim = documents.select(F.col(doc_id).alias("id"), plain_source(source).alias("source"), F.sha2(text, 256).alias("h"), F.col(text).alias("text"))
        sized = slim.where((F.col("text") != "") & F.col("source").isin([s for s, w in self.shares.items() if w > 0 and repeats[s] > 0] or [""])).mapInPandas(measured, f"id {id_type}, source string, h string, tokens long")
        # One row a text and source, then one a text: both combine before the shuffle, so a text copied a million times costs one row a task.
        owners = sized.groupBy("h", "source").agg(F.min("id").alias("id"), F.min("tokens").alias("tokens"))
        texts = owners.groupBy("h").agg(F.min("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "id"))).alias("members"))
        texts = texts.select("h", "tokens", "members", F.concat_ws("\t", F.col("members.source")).alias("pattern"), F.xxhash64("h", F.lit(seed)).alias("o"))
        self.texts = cut_lineage(texts.withColumn("bucket", F.pmod(F.shiftrightunsigned("o", 20), F.lit(buckets))).where("tokens > 0"))
        sizes = self.texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).limit(max_patterns + 1).collect()
        if len(sizes) > max_patterns:
            raise ValueError(f"more than {max_patterns} membership patterns; give fewer target sources or a larger max_patterns")
        self.plan = plan_mix({tuple(r[0].split("\t")): r[1] for r in sizes}, self.shares, repeats, total_tokens)
        self.sizes = {r[0]: r[1] for r in sizes}

    def documents(self, doc_id: str = "doc_id") -> DataFrame:
        """(doc_id, source, uses, tokens): drawn documents with the source they stand for, how often they are used, and the tokens of one use."""
        rows, at = [], {p: 0 for p in self.sizes}
        for p in sorted(self.sizes):
            members = tuple(sorted(z for z in p.split("\t") if z in self.plan.quota))
            for s in members:
                n = self.plan.tokens.get((members, s), 0)
                if n:
                    rows.append((p, s, at[p], at[p] + n, self.sizes[p]))
                    at[p] += n
        lots = self.spark.createDataFrame(rows, "pattern string, source string, a long, b long, n long")
        # Place of a text on its pattern's line of tokens: the buckets before its own, then the texts before it in the bucket.
        totals = self.texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("t"))
        before = totals.selectExpr("pattern", "bucket", "sum(t) over (partition by pattern order by bucket) - t as before")
        placed = self.texts.join(before, ["pattern", "bucket"]).selectExpr("pattern", "tokens", "members", "before + sum(tokens) over (partition by pattern, bucket order by o, h) - tokens as c")
        uses = F.expr("(b - c + n - 1) div n - (a - c + n - 1) div n")
        drawn = placed.join(F.broadcast(lots), "pattern").withColumn("uses", uses).where("uses > 0")
        mine = F.element_at(F.filter("members", lambda m: m["source"] == F.col("source")), 1)["id"]
        return drawn.select(mine.alias(doc_id), "source", F.col("uses").cast("int").alias("uses"), "tokens")

    def kept_promises(self) -> DataFrame:
        """(source, share_met, cap_kept) for every target source: its tokens are within one document for each pattern of its quota, and no document is used more often than its cap."""
        got = self.documents().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most"), F.max("tokens").alias("longest"))
        rows = [(s, q, self.repeats.get(s, 0), sum(1 for _, x in self.plan.tokens if x == s)) for s, q in sorted(self.plan.quota.items())]
        targets = self.spark.createDataFrame(rows, "source string, quota long, cap int, patterns int")
        both = targets.join(got, "source", "left").fillna(0)
        near = F.abs(F.col("tokens") - F.col("quota")) <= F.col("longest") * F.greatest("patterns", F.lit(1))
        return both.select("source", near.alias("share_met"), (F.col("most") <= F.col("cap")).alias("cap_kept"))

    def shares_reached(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, documents, uses, most_uses) for every target source."""
        got = self.documents().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
        targets = self.spark.createDataFrame(sorted(self.shares.items()), "source string, target_share double")
        whole = got.agg(F.sum("tokens").alias("whole"))
        out = targets.join(got, "source", "left").fillna(0).crossJoin(F.broadcast(whole))  # one row
        return out.select("source", "target_share", F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "uses", "most_uses")
