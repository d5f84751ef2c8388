"""Evaluation texts leaking into training text: MinHash containment search by size.

A document leaks an item if it holds at least `min_words` consecutive words of it,
that is `least` consecutive word shingles.  Short items stand inside long documents,
so both sides are cut into overlapping pieces of at most 2 * least shingles; any
`least` consecutive shingles of a text lie whole in one of its pieces.

The items' pieces are partitioned by size.  A piece of at most u shingles that has
`least` of them (its containment is least / u) in a document piece of at most 2 * least
shingles has the Jaccard similarity least / (u + least) with it or more.  From that
threshold follows how many bands of one minimum a size class needs, so that all of
them differ with probability `miss` at most; small items need fewer.  Sets in which
words repeat can have fewer than `least` distinct shingles and have no such threshold:
all their shingles are looked up.

Pieces that share a band's minimum are candidates; they are verified by exact
containment of `least` consecutive shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from quirework.llm.words import plain_words, slices
from quirework.session import cut_lineage

SHINGLE_WORDS = 5
#: Odd 64-bit multipliers (fixed values, any odd constants would do).
_MUL, _MIX, _END = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The band number under which single shingles of repetitive sets are filed.
_SINGLE = 1 << 20


def size_classes(least: int, miss: float) -> list[tuple[int, float, int]]:
    """(largest number of shingles, Jaccard threshold, bands) of each class of pieces, smallest first."""
    uppers = sorted({least + -(-least * k // 4) for k in range(5)})
    return [(u, least / (u + least), math.ceil(math.log(miss) / math.log(1 - least / (u + least)))) for u in uppers]


def _scrambled(h: np.ndarray, band: int) -> np.ndarray:
    h = (h ^ np.uint64(band * 0xC2B2AE3D27D4EB4F & (2**64 - 1))) * _MIX
    h = (h ^ (h >> np.uint64(31))) * _END
    return h ^ (h >> np.uint64(32))


class Pieces:
    """The pieces of some texts: owner, first word, number of words and of shingles of each, and the minima of any band."""

    def __init__(self, texts: list[list[str]], min_words: int) -> None:
        self.width = min(SHINGLE_WORDS, min_words)
        self.least = min_words - self.width + 1
        counts = np.array([len(t) for t in texts], np.int64)
        shingles = np.where(counts >= min_words, counts - self.width + 1, 0)
        total = int(counts.sum())
        flat = np.empty(total, object)
        flat[:] = [w for t in texts for w in t]
        codes, kinds = pd.factorize(flat)
        h = pd.util.hash_array(kinds.astype(object), categorize=False)[codes] if total else np.zeros(0, np.uint64)
        rolled = np.zeros(max(0, total - self.width + 1), np.uint64)
        for k in range(self.width):
            rolled = rolled * _MUL + h[k : k + len(rolled)]
        starts = np.cumsum(counts) - counts
        # The shingles of all texts in one row, each text's after those of the text before.
        at = np.repeat(starts - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
        self.shingle = rolled[at]
        blocks = -(-shingles // self.least)
        owner = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.block_at = (np.cumsum(shingles) - shingles)[owner] + number * self.least
        # A piece is two neighbouring blocks, or the only one.
        self.first = np.flatnonzero((number < blocks[owner] - 1) | (blocks[owner] == 1))
        self.second = np.where(blocks[owner[self.first]] == 1, self.first, self.first + 1)
        self.owner, self.word = owner[self.first], number[self.first] * self.least
        self.size = np.minimum(2 * self.least, shingles[self.owner] - self.word)
        self.words = self.size + self.width - 1

    def minima(self, band: int) -> np.ndarray:
        """The smallest value that the band's hash function gives to a shingle of each piece, filed under the band."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        low = np.minimum.reduceat(_scrambled(self.shingle, band), self.block_at)
        return _scrambled(np.minimum(low[self.first], low[self.second]), band)

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """(piece, signature) of every shingle by itself."""
        piece = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(piece)) - np.repeat(np.cumsum(self.size) - self.size, self.size) + np.repeat(self.block_at[self.first], self.size)
        return piece, _scrambled(self.shingle[at], _SINGLE)


_PIECE = "item {0}, piece string, firsts array<int>, sigs array<long>, single boolean"


def _item_pieces(min_words: int, miss: float):
    """A mapInPandas function: the pieces of items with their signatures; firsts: for each window of min_words words, where an equal one first stands in the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, chars=200_000):
            texts = [plain_words(t) for t in batch["text"]]
            p = Pieces(texts, min_words)
            classes = size_classes(p.least, miss)
            bands = np.array([b for _, _, b in classes])[np.searchsorted([u for u, _, _ in classes], p.size)] if len(p.size) else np.zeros(0, int)
            minima = np.array([p.minima(b) for b in range(classes[-1][2])])
            owner, sigs = p.singles()
            first_of = [{} for _ in texts]
            for places, words in zip(first_of, texts):
                for k in range(len(words) - min_words + 1):
                    places.setdefault(tuple(words[k : k + min_words]), k)
            out = []
            for k, (o, w, n) in enumerate(zip(p.owner.tolist(), p.word.tolist(), p.words.tolist())):
                words, own = texts[o][w : w + n], sigs[owner == k]
                few = any(len(set(own[j : j + p.least].tolist())) < p.least for j in range(len(own) - p.least + 1))
                mine = np.unique(np.concatenate([minima[: bands[k], k], own] if few else [minima[: bands[k], k]]))
                firsts = [first_of[o][tuple(words[j : j + min_words])] for j in range(n - min_words + 1)]
                out.append((batch["id"].iloc[o], " ".join(words), firsts, mine.view(np.int64), few))
            yield pd.DataFrame(out, columns=["item", "piece", "firsts", "sigs", "single"])

    return run


class Filter:
    """A Bloom filter of signatures with two probes; its bits come from a distributed aggregate and are bounded, whatever the number of items."""

    def __init__(self, sigs: DataFrame, n: int, smallest: int = 20, largest: int = 29) -> None:
        self.power = min(largest, max(smallest, math.ceil(math.log2(max(1, 256 * n)))))
        place = lambda s: F.shiftrightunsigned(s, 64 - self.power)
        bits = sigs.select(F.explode(F.array(place(F.col("sig")), place(F.shiftleft("sig", 32)))).alias("p"))
        rows = bits.groupBy(F.expr("p div 32768").alias("b")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("m")).collect()
        self.bits = np.zeros(2**self.power // 8, np.uint8)
        for b, m in rows:
            self.bits[b * 4096 : b * 4096 + 4096] = np.frombuffer(bytes(m), np.uint8)

    def hit(self, sig: np.ndarray) -> np.ndarray:
        """Which signatures may be among the items'."""
        down = np.uint64(64 - self.power)
        ok = np.ones(len(sig), bool)
        for s in (sig >> down, (sig << np.uint64(32)) >> down):
            left = np.flatnonzero(ok)
            p = s[left]
            ok[left] = (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0
        return ok


def _document_pieces(min_words: int, bands: int, wanted, singles: bool):
    """A mapInPandas function: (id, piece, sigs) of the pieces of documents that share a signature with the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = wanted.value
        for batch in slices(batches):
            texts = [plain_words(t) for t in batch["text"]]
            p = Pieces(texts, min_words)
            parts = [(np.arange(len(p.size)), p.minima(b)) for b in range(bands)] + ([p.singles()] if singles else [])
            at, sig = [], []
            for owner, s in parts:
                hit = np.flatnonzero(keep.hit(s))
                at.append(owner[hit])
                sig.append(s[hit])
            at, sig = np.concatenate(at), np.concatenate(sig)
            order = np.argsort(at, kind="stable")
            pieces, begin = np.unique(at[order], return_index=True)
            groups = np.split(sig[order].view(np.int64), begin[1:]) if len(pieces) else []
            words = [" ".join(texts[o][w : w + n]) for o, w, n in zip(p.owner[pieces].tolist(), p.word[pieces].tolist(), p.words[pieces].tolist())]
            yield pd.DataFrame({"id": batch["id"].to_numpy()[p.owner[pieces]], "piece": pd.Series(words, dtype=object), "sigs": pd.Series([np.unique(g) for g in groups], dtype=object)})

    return run


def _contained(min_words: int):
    """A pandas UDF: the numbers (firsts) of the windows of min_words words that an item piece shares with a document piece."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def shared(piece: pd.Series, item_piece: pd.Series, firsts: pd.Series) -> pd.Series:
        out = []
        for a, b, f in zip(piece, item_piece, firsts):
            a, b = a.split(" "), b.split(" ")
            have = {tuple(a[k : k + min_words]) for k in range(len(a) - min_words + 1)}
            out.append(sorted({int(f[k]) for k in range(len(b) - min_words + 1) if tuple(b[k : k + min_words]) in have}))
        return pd.Series(out, dtype=object)

    return shared


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 12, miss: float = 1e-5,
) -> DataFrame:
    """(doc_id, item_id, passages): documents that hold min_words consecutive words of an item, with the number of such windows.

    Documents are read once, whatever the number of items: each executor holds a
    filter of the items' signatures (64 MB at most), and only pieces that pass it are
    written and joined with the items by signature.  Equal pieces are verified once.
    miss bounds the probability that the shortest possible leak has no minimum in
    common; longer leaks fill several pieces.  Defined results: null and short texts
    hold nothing and items of fewer than min_words words cannot leak; equal documents
    and equal items each get their own rows; an empty side gives no rows.
    """
    doc_type, item_type = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    slim_items = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    pieces = cut_lineage(slim_items.mapInPandas(_item_pieces(min_words, miss), _PIECE.format(item_type)))
    size = pieces.agg(F.coalesce(F.sum(F.size("sigs")), F.lit(0)).alias("n"), F.coalesce(F.bool_or("single"), F.lit(False)).alias("single")).first()
    signed = pieces.select("item", F.col("piece").alias("item_piece"), "firsts", F.explode("sigs").alias("sig"))
    wanted = documents.sparkSession.sparkContext.broadcast(Filter(signed, size["n"]))
    bands = size_classes(min_words - min(SHINGLE_WORDS, min_words) + 1, miss)[-1][2]
    slim_docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    hits = cut_lineage(slim_docs.mapInPandas(_document_pieces(min_words, bands, wanted, size["single"]), f"id {doc_type}, piece string, sigs array<long>"))
    # A passage that a third of all documents hold is verified once.
    kinds = hits.groupBy("piece").agg(F.first("sigs").alias("sigs"))
    candidates = kinds.select("piece", F.explode("sigs").alias("sig")).join(signed, "sig").select("piece", "item", "item_piece", "firsts").distinct()
    shared = candidates.select("piece", "item", _contained(min_words).asNondeterministic()("piece", "item_piece", "firsts").alias("at"))
    windows = hits.select("id", "piece").join(shared.where(F.size("at") > 0), "piece").select("id", "item", F.explode("at").alias("at")).distinct()
    return windows.groupBy(F.col("id").alias(doc_id), F.col("item").alias(item_id)).agg(F.count("*").alias("passages"))


def leak_report(leaks: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Every item with the number of documents that leak it and the most windows one of them holds; 0 for clean items."""
    counts = leaks.groupBy(item_id).agg(F.count("*").alias("n"), F.max("passages").alias("m"))
    return items.join(counts, item_id, "left").select(item_id, F.coalesce("n", F.lit(0)).alias("documents"), F.coalesce("m", F.lit(0)).alias("most_passages"))
