"""Language of documents and of their sentences, whatever their label says.

One interpolated Kneser-Ney character model per language is trained on verified
sentences, and once more with the clear sentences of the corpus, whose n-grams are
counted where the documents are.  The models live in sorted hash arrays, one per n-gram length, with a
column per language: a text's n-grams are found by binary search and all languages
are scored at once.  A word's characters are predicted from the characters before
them in the word, so a word scores the same wherever it stands and each distinct
word of a batch is scored once.  A sentence gets the language of the lowest
length-normalised cross-entropy.  It is rejected if that exceeds what the language's
own held-out sentences reach, or if the next language is about as good.  Bounds and
confidence are calibrated by cross-validation on the verified sentences.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import unicodedata
from pyspark.sql import DataFrame, Window, functions as F

from quirework.llm.words import char_class, last_plane, slices

# Notations of the languages, lower case, besides their two-letter codes.
NOTATIONS = {
    "ko": "kor korean koreanisch coréen coreano 한국어 조선말 韩语 韓国語",
    "en": "eng english englisch anglais inglés inglês 영어 英语 英語",
    "ja": "jpn japanese japanisch japonais japonés japonês 日本語 일본어 日语",
    "zh": "zho chi cmn yue chinese mandarin chinesisch chinois chino chinês 中文 汉语 漢語 普通话 중국어",
    "de": "deu ger german deutsch allemand alemán alemão 독일어 德语 ドイツ語",
    "fr": "fra fre french französisch français francais francés francês 프랑스어 法语 フランス語",
    "es": "spa spanish castilian spanisch espagnol español espanol castellano espanhol 스페인어 西班牙语 スペイン語",
    "pt": "por portuguese portugiesisch portugais portugués português portugues 포르투갈어 葡萄牙语 ポルトガル語",
}
SENTENCE_END = ".!?。！？…"


@lru_cache(1)
def _notation_of() -> dict[str, str]:
    return {n: code for code, names in NOTATIONS.items() for n in [code, *names.split()]}


def named_languages(label: str | None) -> list[str]:
    """The two-letter codes a label names in any usual notation; none for null, blank and placeholder labels."""
    if not label:
        return []
    found = []
    for part in re.split(r"[\s,;/|+&()\[\]]+", unicodedata.normalize("NFKC", label).casefold()):
        code = _notation_of().get(part) or _notation_of().get(re.split(r"[-_.]", part)[0])
        if code and code not in found:
            found.append(code)
    return found


@lru_cache(2)
def _letters(last: int = 0x10FFFF) -> re.Pattern:
    """Runs of letters with their marks; an apostrophe inside a run belongs to it."""
    # \w is tested faster than a class of its own; after plain_text it holds letters, digits and the underline only.
    run = f"(?:[^\\W\\d_]++[{char_class(('M',), last)}]*+)+"
    return re.compile(f"{run}(?:['’]{run})*")


@lru_cache(2)
def _invisible(last: int = 0x10FFFF) -> re.Pattern:
    return re.compile(f"[{char_class(('Cf',), last)}]")


def words_of(plain: str) -> list[str]:
    """The words of a plain text."""
    return _letters(last_plane(plain)).findall(plain)


def plain_text(text: str) -> str:
    """Text in composed form, without invisible characters and width variants, in small letters; a blank follows full-width stops, which end a sentence wherever they stand."""
    if not text.isascii():
        text = text.replace("？", "? ").replace("！", "! ")
        text = _invisible(last_plane(text)).sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return text.lower()


# A sentence ends at a full-width stop, at a stop before a blank (closing quotes or brackets may stand between), and at an empty line.
# Where a text is written without blanks, a stop also ends a sentence before another script and before a formula.
# The pattern begins with one class, so that the search jumps from sign to sign.
_STOP = re.compile(
    r"[。！？.!?…\n](?:(?<=[。！？])[。！？]*[」』”’）)]*"
    r"|(?<=[.!?…])[.!?…]*[\"'»”’)\]]*(?=\s|$|[(「『（]?[ぁ-ヿ㐀-鿿가-힣]|[A-Za-z]{1,3}[_^(]|\([0-9])"
    r"|(?<=\n)(?=[ \t]*\n))"
)


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of a text between sentence ends and empty lines; blank stretches are left out.

    A line end alone does not end a sentence, since texts are wrapped at any width.
    """
    out, begin = [], 0
    for stop in _STOP.finditer(text):
        if not text[begin : stop.end()].isspace() and stop.end() > begin:
            out.append((begin, stop.end()))
        begin = stop.end()
    if begin < len(text) and not text[begin:].isspace():
        out.append((begin, len(text)))
    return out


@dataclass
class CharModels:
    """Kneser-Ney models of several languages over shared n-gram arrays.

    keys[n]: sorted hashes of the (n+1)-grams seen in any language.  gain[n][k, l] is
    the discounted probability of n-gram k in language l; back[n][k, l] the weight that
    language l gives to the shorter context when n-gram k is the context (1 where unseen).
    bound[l]: the highest cross-entropy, in bits a sign, at which language l is accepted;
    temperature: by which bits are divided to give probabilities.
    """

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    gain: list[np.ndarray]
    back: list[np.ndarray]
    start: np.ndarray
    uniform: float
    bound: np.ndarray
    temperature: float = 1.0


_PAD, _END = 2, 3


def _word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each framed by a begin and an end sign, and the words' lengths with frame."""
    flat = np.frombuffer("".join(f"{chr(_PAD)}{w}{chr(_END)}" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return flat, np.array([len(w) + 2 for w in words], np.int64)


def _gram_hashes(codes: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each place; 0 where it would begin before its word."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    depth = np.arange(len(codes)) - starts
    out, h = [], codes * np.uint64(0x9E3779B97F4A7C15)
    out.append(_scrambled(h, 1))
    for n in range(2, order + 1):
        shifted = np.concatenate([np.zeros(n - 1, np.uint64), codes[: 1 - n]])[: len(codes)]
        h = (h * np.uint64(0x100000001B3)) ^ (shifted * np.uint64(0x9E3779B97F4A7C15))
        out.append(np.where(depth >= n - 1, _scrambled(h, n), np.uint64(0)))
    return out


def _scrambled(h: np.ndarray, n: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)


def train(samples: list[tuple[str, str]], order: int = 5, discount: float = 0.75, folds: int = 5, deviations: float = 5.0, unseen_share: float = 0.85) -> CharModels:
    """Models from (language, sentence) pairs, calibrated by cross-validation.

    Each sentence is scored by models trained without its fold.  The bound of a
    language is the mean cross-entropy of its own sentences plus so many standard
    deviations (10 bits where it has fewer than two), but at most unseen_share of what
    a sign costs that the language never showed.  The temperature is the one under
    which the held-out sentences' languages are most probable.
    """
    by: dict[str, list[str]] = defaultdict(list)
    for lang, text in samples:
        if lang and text:
            by[lang].append(text)
    languages = sorted(by)
    models = _fit(languages, by, order, discount)
    own: list[list[float]] = [[] for _ in languages]
    held, truth = [], []
    for f in range(folds):
        partial = _fit(languages, {l: [t for k, t in enumerate(by[l]) if k % folds != f] or by[l] for l in languages}, order, discount)
        for j, l in enumerate(languages):
            scores, signs = score_texts(partial, [t for k, t in enumerate(by[l]) if k % folds == f])
            own[j] += [s[j] / n for s, n in zip(scores, signs) if n]
            held += [s for s, n in zip(scores, signs) if n]
            truth += [j] * int((signs > 0).sum())
    models.bound = np.array([np.mean(x) + deviations * np.std(x) if len(x) > 1 else 10.0 for x in own])
    models.bound = np.minimum(models.bound, -unseen_share * np.log2(models.uniform * models.start))
    if held:
        bits, right = np.array(held), np.array(truth)
        models.temperature = min(2.0 ** np.arange(0, 7, 0.5), key=lambda t: -np.log(np.maximum(posterior(bits, t)[np.arange(len(right)), right], 1e-12)).mean())
    return models


def posterior(bits: np.ndarray, temperature: float) -> np.ndarray:
    """Probabilities of the languages from the bits that each of them needs."""
    p = np.exp2(-np.minimum((bits - bits.min(1, keepdims=True)) / temperature, 60))
    return p / p.sum(1, keepdims=True)


def _count_grams(words: Counter, order: int) -> Counter:
    """How often each n-gram of up to order signs ends inside the framed words; an n-gram's length says which n."""
    out: Counter = Counter()
    for w, c in words.items():
        s = chr(_PAD) + w + chr(_END)
        for i in range(1, len(s)):
            for n in range(1, min(order, i + 1) + 1):
                out[s[i - n + 1 : i + 1]] += c
    return out


def _fit(languages: list[str], by: dict[str, list[str]], order: int, discount: float, more: dict[str, Counter] | None = None) -> CharModels:
    """Models from the sentences of each language and, if given, from n-gram counts besides."""
    L = len(languages)
    counts: list[list[Counter]] = [[Counter() for _ in languages] for _ in range(order)]
    for j, l in enumerate(languages):
        for part in (_count_grams(Counter(w for t in by[l] for w in words_of(plain_text(t))), order), (more or {}).get(l, {})):
            for g, c in part.items():
                counts[len(g) - 1][j][g] += c
    # Below the highest order a gram counts the different characters before it (continuation count); grams at a word's begin have none before and keep their counts.
    kn = [[Counter() for _ in languages] for _ in range(order)]
    for j in range(L):
        for n in range(order):
            if n == order - 1:
                kn[n][j] = counts[n][j]
                continue
            for g in counts[n + 1][j]:
                kn[n][j][g[1:]] += 1
            for g, c in counts[n][j].items():
                if g[0] == chr(_PAD):
                    kn[n][j][g] = c
    alphabet = {g for c in kn[0] for g in c}
    keys, gain, back = [], [], []
    for n in range(order):
        total, kinds = [Counter() for _ in languages], [Counter() for _ in languages]
        for j in range(L):
            for g, c in kn[n][j].items():
                total[j][g[:-1]] += c
                kinds[j][g[:-1]] += 1
        grams = sorted({g for c in kn[n] for g in c})
        table = np.zeros((len(grams), L), np.float32)
        for k, g in enumerate(grams):
            for j in range(L):
                c = kn[n][j].get(g)
                if c:
                    table[k, j] = max(c - discount, 0) / total[j][g[:-1]]
        keys.append(_keys(grams))
        gain.append(table)
        back.append((total, kinds))
    weights = []
    start = np.array([discount * back[0][1][j][""] / max(1, back[0][0][j][""]) for j in range(L)], np.float32)
    for n in range(order):  # weight when an (n+1)-gram is the context of a longer gram
        grams = sorted({g for c in kn[n] for g in c} | ({chr(_PAD)} if n == 0 else set()))
        w = np.ones((len(grams), L), np.float32)
        if n + 1 < order:
            total, kinds = back[n + 1]
            for k, g in enumerate(grams):
                for j in range(L):
                    if total[j].get(g):
                        w[k, j] = discount * kinds[j][g] / total[j][g]
        if n == 0:  # the begin sign is a context only: it needs a place among the single characters
            table = np.zeros((len(grams), L), np.float32)
            old = {g: k for k, g in enumerate(sorted({g for c in kn[0] for g in c}))}
            for k, g in enumerate(grams):
                if g in old:
                    table[k] = gain[0][old[g]]
            gain[0], keys[0] = table, _keys(grams)
        weights.append(w)
    for n in range(order):
        at = np.argsort(keys[n], kind="stable")
        keys[n], gain[n], weights[n] = keys[n][at], gain[n][at], weights[n][at]
    return CharModels(languages, order, keys, gain, weights, start, 1.0 / (len(alphabet) + 1), np.full(L, 10.0))


def _keys(grams: list[str]) -> np.ndarray:
    """Hashes of n-grams of one length."""
    if not grams:
        return np.zeros(0, np.uint64)
    n = len(grams[0])
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return _gram_hashes(codes, np.full(len(grams), n, np.int64), n)[-1][n - 1 :: n]


def score_words(models: CharModels, words: list[str]) -> np.ndarray:
    """Bits of each word in each language: (words, languages)."""
    L = len(models.languages)
    if not words:
        return np.zeros((0, L))
    codes, lengths = _word_codes(words)
    hashes = _gram_hashes(codes, lengths, models.order)
    p = np.full((len(codes), L), models.uniform, np.float32) * models.start
    context = None
    for n in range(models.order):
        keys = models.keys[n]
        at = np.minimum(np.searchsorted(keys, hashes[n]), len(keys) - 1)
        hit = keys[at] == hashes[n]
        if n:
            # The context of an (n+1)-gram is the n-gram that ends one place before.
            c_at, c_hit = context
            c_at, c_hit = np.concatenate([[0], c_at[:-1]]), np.concatenate([[False], c_hit[:-1]]) & (hashes[n] != 0)
            rows = np.flatnonzero(c_hit)
            p[rows] *= models.back[n - 1][c_at[rows]]
        rows = np.flatnonzero(hit)
        p[rows] += models.gain[n][at[rows]]
        context = (at, hit)
    bits = -np.log2(np.maximum(p, 1e-12))
    ends = np.cumsum(lengths)
    bits[ends - lengths] = 0  # the begin sign is given, not predicted
    return np.add.reduceat(bits, ends - lengths, axis=0).astype(np.float64)


def _score_lists(models: CharModels, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Bits in each language and number of predicted signs of each list of words."""
    sizes = np.array([len(x) for x in lists], np.int64)
    total = int(sizes.sum())
    scores, signs = np.zeros((len(lists), len(models.languages))), np.zeros(len(lists))
    if total:
        flat = np.empty(total, object)
        flat[:] = [w for x in lists for w in x]
        codes, kinds = pd.factorize(flat)
        bits = score_words(models, list(kinds))
        lens = np.array([len(w) + 1 for w in kinds])
        owner = np.repeat(np.arange(len(lists)), sizes)
        for j in range(scores.shape[1]):
            scores[:, j] = np.bincount(owner, bits[codes, j], len(lists))
        signs = np.bincount(owner, lens[codes], len(lists))
    return scores, signs


def score_texts(models: CharModels, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits in each language and number of predicted signs of whole texts."""
    return _score_lists(models, [words_of(plain_text(t)) for t in texts])


def verified_sentences(samples: DataFrame, lang: str = "lang", text: str = "text", max_rows: int = 100_000) -> list[tuple[str, str]]:
    """(language, sentence) pairs for a fit, max_rows at most; each language has an equal part, drawn by the hash of the sentence."""
    rows = samples.where(F.col(lang).isNotNull() & (F.col(text) != "")).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    kinds = rows.select("l").distinct().count()
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("t"), "t"))
    drawn = rows.withColumn("p", place).where(F.col("p") <= max(1, max_rows // max(1, kinds))).select("l", "t").collect()
    return sorted((r[0], r[1]) for r in drawn)


def clear_words(documents: DataFrame, models: CharModels, text: str = "text", sure_bits: float = 20.0, main_share: float = 0.7, min_letters: int = 20) -> DataFrame:
    """(lang, word, n): how often each word stands in clear sentences of a language, over all documents.

    A sentence is clear if its language leads by sure_bits and makes up main_share of
    its document's letters.  Counts are combined in each slice and before the shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        L = len(m.languages)
        for batch in slices(batches):
            lists, owner = [], []
            for d, raw in enumerate(batch["text"]):
                plain = plain_text(raw)
                letters_in = _letters(last_plane(plain)).findall
                for b, e in sentences(plain):
                    lists.append(letters_in(plain[b:e]))
                    owner.append(d)
            if not lists or L < 2:
                continue
            scores, signs = _score_lists(m, lists)
            letters, at, best = signs - np.array([len(x) for x in lists]), np.array(owner), scores.argmin(1)
            mass = np.bincount(at * L + best, letters, len(batch) * L).reshape(-1, L)
            order = np.sort(scores, 1)
            ok = (order[:, 1] - order[:, 0] >= sure_bits) & (letters >= min_letters) & (best == mass.argmax(1)[at]) & (mass.max(1) >= main_share * mass.sum(1))[at]
            counts: list[Counter] = [Counter() for _ in m.languages]
            for k in np.flatnonzero(ok):
                counts[best[k]].update(lists[k])
            for l, c in zip(m.languages, counts):
                if c:
                    yield pd.DataFrame({"lang": l, "word": list(c), "n": list(c.values())})

    source = documents.where(F.col(text) != "").select(F.col(text).alias("text"))
    return source.mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): counts of the n-grams of counted words, combined in each batch and before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for l, part in batch.groupby("lang"):
                c = _count_grams(Counter(dict(zip(part["word"], part["n"].tolist()))), order)
                yield pd.DataFrame({"lang": l, "gram": list(c), "n": list(c.values())})

    return words.mapInPandas(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def corpus_models(samples: DataFrame, documents: DataFrame, text: str = "text", lang: str = "lang", sample_text: str = "text", max_rows: int = 100_000, **options) -> CharModels:
    """Models of verified sentences and of the clear sentences of all documents.

    The n-grams of the clear sentences are counted where the documents are; only their
    sums, bounded by the languages' n-grams, come to the driver.  Labels are not read.
    Bounds and temperature stay those of the cross-validation, whose held-out sentences
    have words that the models do not know; with the corpus counted in, the verified
    sentences know no such words any more and would give bounds of a third, which
    refuse every sentence with words of its own.
    """
    verified = verified_sentences(samples, lang, sample_text, max_rows)
    first = train(verified, **options)
    more: dict[str, Counter] = defaultdict(Counter)
    grams = gram_counts(clear_words(documents, first, text), first.order).toArrow()
    for l, g, n in zip(*(grams[c].to_pylist() for c in ("lang", "gram", "n"))):
        more[l][g] = n
    by: dict[str, list[str]] = defaultdict(list)
    for l, t in verified:
        by[l].append(t)
    again = _fit(first.languages, by, first.order, options.get("discount", 0.75), more)
    again.bound, again.temperature = first.bound, first.temperature
    return again


def segment_languages(documents: DataFrame, models: CharModels, doc_id: str = "doc_id", text: str = "text", label: str | None = None, clear_bits: float = 8.0) -> DataFrame:
    """A row for each sentence of each document: (doc_id, segment, begin, end, lang, confidence, letters, whole, named).

    lang is the language of the lowest cross-entropy; it is null where that is above
    the language's bound or where the next language needs less than clear_bits more
    (formulas, numbers, answer keys and single short words, whatever their length).
    confidence is the language's calibrated probability, 0 where lang is null.  whole
    tells that the stretch ends like a sentence (not by dots of omission); named lists
    the languages that the document's label names.  Defined results: null and empty
    texts have no rows; a null or placeholder label names nothing; texts may have any
    length; begin and end count characters of the text in composed, plain form.  No
    shuffle: each document is cut and scored in place.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)
    schema = f"{doc_id} {dict(documents.dtypes)[doc_id]}, segment int, begin int, end int, lang string, confidence double, letters int, whole boolean, named array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.languages, None], object)
        for batch in slices(batches):
            ids, labels = batch["id"].to_numpy(), [named_languages(x) for x in batch["label"]]
            owner, number, begin, end, lists, stops = [], [], [], [], [], []
            for d, raw in enumerate(batch["text"]):
                plain = plain_text(raw)
                letters_in = _letters(last_plane(plain)).findall
                for k, (b, e) in enumerate(sentences(plain)):
                    piece = plain[b:e]
                    last = piece.rstrip("\"'»”’)]」』） ")
                    owner.append(d), number.append(k), begin.append(b), end.append(e)
                    lists.append(letters_in(piece))
                    stops.append(last[-1:] in SENTENCE_END[:-1] and not last.endswith("...") and last != "")
            if not owner:
                continue
            at = np.array(owner)
            scores, signs = _score_lists(m, lists)
            letters = signs - np.array([len(x) for x in lists])
            best = scores.argmin(1)
            row = np.arange(len(best))
            low = scores[row, best]
            clear = np.partition(scores, 1, 1)[:, 1] - low >= clear_bits if scores.shape[1] > 1 else letters > 0
            ok = clear & (low <= m.bound[best] * np.maximum(signs, 1))
            yield pd.DataFrame({
                doc_id: ids[at], "segment": np.array(number, np.int32), "begin": np.array(begin, np.int32), "end": np.array(end, np.int32), "lang": names[np.where(ok, best, len(m.languages))],
                "confidence": np.where(ok, posterior(scores, m.temperature)[row, best], 0.0), "letters": letters.astype(np.int32), "whole": np.array(stops, bool), "named": [labels[d] for d in owner],
            })

    source = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"))
    return source.where("text <> ''").mapInPandas(run, schema)


def unnamed_languages(segments: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang): languages of which a document has a whole sentence and which its label does not name."""
    return segments.where("whole and lang is not null and not array_contains(named, lang)").select(doc_id, "lang").distinct()


def document_languages(segments: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang, share, confidence, languages): each document's main language by letters, its share of them, the letter-weighted confidence, and all its languages."""
    per = segments.where("lang is not null").groupBy(doc_id, "lang").agg(F.sum("letters").alias("n"), F.sum(F.col("letters") * F.col("confidence")).alias("w"))
    best = per.groupBy(doc_id).agg(F.max(F.struct("n", "lang", "w")).alias("b"), F.sum("n").alias("all"), F.sort_array(F.collect_set("lang")).alias("languages"))
    return best.select(doc_id, F.col("b.lang").alias("lang"), (F.col("b.n") / F.col("all")).alias("share"), (F.col("b.w") / F.col("b.n")).alias("confidence"), "languages")
