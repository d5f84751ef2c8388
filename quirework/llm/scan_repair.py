"""Noise in text from scanned pages: find it and put the text right.

Running heads and page numbers are recognised line by line, words broken over a
line end are joined if the corpus knows the joined word, and misread words are
found against the corpus lexicon: a symmetric-delete index proposes words, an edit
distance weighted by confusion pairs ranks them, and word frequency and the
neighbouring words decide.  A listed pair of look-alike shapes is cheap; any other
edit costs more, less so if it explains several words of the corpus, and what it
costs the frequency of the word and its neighbours must outweigh.  All statistics are
aggregates over the whole corpus; texts are only cut in Python, never compared there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quirework.llm.visual_text import consistent_text
from quirework.session import cut_lineage

# Words that number the parts of a book and do not belong to a topic.
UNIT_WORDS = "단원 장 절 unit chapter section step level no einheit kapitel abschnitt unidad capítulo sección unité chapitre unidade seção"
# Pairs of shapes that scanning takes for one another.
LATIN_PAIRS = "e c, o 0, t f, n u, i !, i 1, l 1, l !, s 5, h b, g 9, b 6, u ii, d cl, m rn, w vv, h li, n ri"
VOWEL_PAIRS = "ㅏ ㅑ, ㅓ ㅕ, ㅓ ㅣ, ㅡ ㅜ, ㅡ ㅣ, ㅡ ㅢ, ㅗ ㅛ, ㅐ ㅔ, ㅜ ㅠ"
FINAL_PAIRS = "ㄴ ㅁ, ㄱ ㄴ, ㄹ ㄴ, ㅇ ㄴ, ㅁ ㅇ, ㅂ ㅁ, ㄹ ㅁ, ㄹ -"
_VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
_FINALS = "-ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
#: Joins the halves of a word broken over a line end in the token table.
BREAK = "­"
_OUTER = "\"'“”‘’«»〈〉()[]{}<>.,:;?¿¡…·*—–/|"
_SENTENCE_END = r"[.?!。？！…][\"'»”’)\]]*\s*$"
_PAGE_LINE = r"(?i)^[\s\-–—·\[\]〈〉<>|*•_~]*(?:p\.?|s\.?|page|seite|página)?\s*([0-9]{1,6})\s*쪽?[\s\-–—·\[\]〈〉<>|*•_~]*$"


@lru_cache(1)
def shape_pairs() -> dict[str, set[str]]:
    """Each shape with the shapes it is taken for; '' stands for none."""
    pairs = [tuple(p.split()) for p in LATIN_PAIRS.split(", ")]
    pairs += [tuple(chr(0x1161 + _VOWELS.index(v)) for v in p.split()) for p in VOWEL_PAIRS.split(", ")]
    pairs += [tuple(chr(0x11A7 + _FINALS.index(v)) if v != "-" else "" for v in p.split()) for p in FINAL_PAIRS.split(", ")]
    out: dict[str, set[str]] = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def word_forms(word: str) -> set[str]:
    """The forms under which a word is indexed: Hangul in letters, digits inside words as the letter they look like; with and without pairs of signs drawn together."""
    form = unicodedata.normalize("NFD", word) if any("가" <= c <= "힣" for c in word) else word
    form = form.translate(str.maketrans("0159!6", "olsgib"))
    drawn = form
    for a, b in (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h")):
        drawn = drawn.replace(a, b)
    return {form, drawn}


def delete_keys(word: str, deletes: int = 1) -> list[str]:
    """The word's forms and every form with up to `deletes` signs left out."""
    found = last = word_forms(word)
    for _ in range(deletes):
        last = {form[:k] + form[k + 1 :] for form in last for k in range(len(form))}
        found = found | last
    return sorted(found)


def shape_distance(a: str, b: str, pair_cost: float = 0.4) -> float:
    """Edit distance over letters (Hangul letters for syllables) in which a listed pair of shapes costs pair_cost and any other edit 1."""
    a, b = (unicodedata.normalize("NFD", w) if any("가" <= c <= "힣" for c in w) else w for w in (a, b))
    pairs, inf = shape_pairs(), float("inf")
    d = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            here = d[i][j]
            if here == inf:
                continue
            for m, n in ((1, 1), (1, 0), (0, 1), (1, 2), (2, 1)):
                if i + m > len(a) or j + n > len(b):
                    continue
                p, q = a[i : i + m], b[j : j + n]
                cost = 0.0 if p == q else pair_cost if q in pairs.get(p, ()) else 1.0 if max(m, n) == 1 else inf
                if here + cost < d[i + m][j + n]:
                    d[i + m][j + n] = here + cost
    return d[len(a)][len(b)]


_BROKEN = re.compile(r"[^\W\d_]\S*(?<=[\w!])[-¬]$|^[^\W\d_][-¬]$")


def core_word(raw: str) -> tuple[str, str, str]:
    """(before, core, after) of a token: outer punctuation off, and a number that a Hangul word is joined to.  A "!" stays: it may stand for a letter."""
    core = raw.strip(_OUTER)
    head = re.match(r"[\d.,:~/()\-]+(?=[가-힣])", core)
    if head:
        core = core[head.end() :]
    at = raw.find(core) if core else len(raw)
    return raw[:at], core, raw[at + len(core) :]


def reading_tokens(text: str, dropped: set[int]) -> list[tuple[str, str | None]]:
    """Tokens of a text in reading order, without the dropped lines: (raw, None), or the two halves of a word broken over a line end."""
    out: list[tuple[str, str | None]] = []
    open_half = -1
    for n, line in enumerate(text.split("\n")):
        if n in dropped:
            continue
        words = line.split()
        if not words:
            continue
        if open_half >= 0 and any(c.isalpha() for c in line):
            if words[0][0].isalpha():
                out[open_half] = (out[open_half][0], words.pop(0))
            open_half = -1
        out += [(w, None) for w in words]
        if words and _BROKEN.search(words[-1]):
            open_half = len(out) - 1
    return out


def token_key(raw: str, second: str | None) -> str:
    """What a token counts as: its core in small letters, '#' without letters, both halves of a broken word with BREAK between."""
    if second is not None:
        a, b = core_word(raw[:-1])[1], core_word(second)[1]
        return f"{a.casefold()}{BREAK}{b.casefold()}"
    core = core_word(raw)[1].casefold()
    return core if any(c.isalpha() and c not in "²³" for c in core) else "#"


def _topic_key(line: Column) -> Column:
    """A line's letters in small form without the words that number parts."""
    words = "|".join(UNIT_WORDS.split())
    plain = F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", " ")
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), f"(?<= )(?:{words})(?= )", ""), " ", "")


def _letters(line: Column) -> Column:
    return F.char_length(F.regexp_replace(line, r"[^\p{L}\p{M}]", ""))


def page_lines(texts: DataFrame, min_support: int = 1) -> DataFrame:
    """(id, line_no, kind) of the lines that are a running head or a page number; texts: id, page, canonical_text.

    Topics are learned from the corpus: the letters of one-line texts that are neither
    sentences nor answer keys.  A line of a longer text is a running head if its
    letters, without words that number parts, are a topic.
    """
    single = texts.where(~F.col("canonical_text").contains("\n") & ~F.col("canonical_text").rlike(_SENTENCE_END))
    topics = single.where(_letters(F.col("canonical_text")) >= 0.25 * F.char_length("canonical_text")).select(_topic_key(F.col("canonical_text")).alias("topic"))
    topics = topics.where("char_length(topic) >= 2").groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("topic")
    lines = texts.where(F.col("canonical_text").contains("\n")).select("id", "page", F.posexplode(F.split("canonical_text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    number = F.regexp_extract("line", _PAGE_LINE, 1)
    page = F.regexp_extract(F.coalesce("page", F.lit("")), "([0-9]+)", 1)
    numbers = lines.where((number != "") & (number.try_cast("long") == page.try_cast("long"))).select("id", "line_no", F.lit("page_number").alias("kind"))
    heads = lines.where(~F.col("line").rlike(_SENTENCE_END)).select("id", "line_no", _topic_key(F.col("line")).alias("topic")).where("char_length(topic) >= 2")
    heads = heads.join(topics, "topic", "left_semi").select("id", "line_no", F.lit("header").alias("kind"))
    return numbers.unionByName(heads)


def _tokenised(batches: Iterator[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Token rows, handed on whenever there are enough, so that long texts do not pile up."""
    names, out = ["id", "rep", "pos", "w", "prev", "next"], []
    for batch in batches:
        for i, rep, text, dropped in zip(batch["id"], batch["rep"], batch["canonical_text"], batch["dropped"]):
            keys = [token_key(*t) for t in reading_tokens(text, set(dropped) if dropped is not None else set())]
            for n, k in enumerate(keys):
                if k != "#":
                    out.append((i, rep, n, k, keys[n - 1] if n else "^", keys[n + 1] if n + 1 < len(keys) else "$"))
                if len(out) >= rows:
                    yield pd.DataFrame(out, columns=names)
                    out = []
    if out:
        yield pd.DataFrame(out, columns=names)


def _keys_of(deletes: int):
    """A pandas UDF: the keys of words."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(words: pd.Series) -> pd.Series:
        return words.map(lambda w: delete_keys(w, deletes))

    return keys


def edit_of(w: str, c: str) -> str:
    """What differs between two words: their middles without the common beginning and end, in whole syllables or letters."""
    n = 0
    while n < min(len(w), len(c)) and w[n] == c[n]:
        n += 1
    m = 0
    while m < min(len(w), len(c)) - n and w[-1 - m] == c[-1 - m]:
        m += 1
    return f"{w[n : len(w) - m]}>{c[n : len(c) - m]}"


@F.pandas_udf(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("edit", T.StringType())]))
def _judged(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Distance and edit of two words together: one Python worker a task does for both."""
    return pd.DataFrame({"distance": pd.Series([shape_distance(x, y) for x, y in zip(a, b)], dtype="float64"), "edit": pd.Series([edit_of(x, y) for x, y in zip(a, b)], dtype=object)})


def lookalike_words(suspects: DataFrame, lexicon: DataFrame, min_count: int, max_distance: float, deletes: int = 1, least_ratio: float = 0.2) -> DataFrame:
    """(w, nw, c, nc, distance, edit): for suspect words the lexicon words, least_ratio times as frequent, that the symmetric-delete index proposes and the distance accepts."""
    keys = _keys_of(deletes)
    left = suspects.select("w", "n", F.explode(keys("w")).alias("key"))
    right = lexicon.where(F.col("n") >= min_count).select(F.col("w").alias("c"), F.col("n").alias("nc"), F.explode(keys("w")).alias("key"))
    pairs = left.join(right, "key").where(f"w <> c and nc >= {least_ratio} * n").select("w", F.col("n").alias("nw"), "c", "nc").distinct()
    # Marked as not to be repeated: the filter would otherwise be pushed below the distinct and judge every pair twice.
    return pairs.withColumn("j", _judged.asNondeterministic()("w", "c")).select("w", "nw", "c", "nc", "j.distance", "j.edit").where(F.col("distance") <= max_distance)


def best_repair() -> Column:
    """Aggregate: the word c of the smallest distance, then the most frequent (nc), then the alphabetically first."""
    return F.min(F.struct("distance", (-F.col("nc")).alias("m"), F.col("c"))).getField("c")


def unlisted_pairs(rare: DataFrame, lexicon: DataFrame, lawful: DataFrame, min_count: int, listed: float) -> DataFrame:
    """(w, c, gain): rare words with lexicon words that differ from them in other edits than the listed pairs alone.

    gain: by how much frequency, and the number of rare words that the same edit
    explains, outweigh the distance; a word is repaired if its neighbours make up for
    the rest, one of which must be a word.  One edit, or two in words of seven signs or
    more; words with digits or of fewer than four Latin letters have none, nor are an
    edit by which the language forms words or signs put before or after a whole word.
    """
    pairs = lookalike_words(rare, lexicon, min_count, 2.0, 2, 4.0).where(F.col("distance") > listed)
    hangul = F.col("w").rlike("[가-힣]")
    pairs = pairs.where(F.expr(r"not w rlike '[0-9]'") & (hangul | (F.char_length("w") >= 4)))
    pairs = pairs.where((F.col("distance") <= 1.0) | (~hangul & (F.char_length("w") >= 7)))
    affix = F.expr("startswith(w, c) or startswith(c, w) or endswith(w, c) or endswith(c, w)")
    pairs = pairs.where(~affix).join(lawful, "edit", "left_anti")
    support = pairs.groupBy("edit").agg(F.count_distinct("w").alias("support"))
    gain = F.col("nc") / F.greatest("nw", F.lit(1)) * F.col("support") / F.pow(F.lit(10.0), 1.2 * (F.col("distance") - 0.4))
    return pairs.join(support, "edit").select("w", "c", gain.alias("gain"))


class ScanNoise:
    """The noise of a corpus of scanned texts; each part is a DataFrame over all rows.

    rows: one text a row; row_id unique and not null, page like 'p085' or null.
    hints: optional (row_id, confidence) of rows whose recognition was uncertain; up to
    a confidence of 0.5 (or null) they need hinted_odds from the neighbouring words,
    at 1 context_odds, and in between in proportion.  A word is misread if a
    lexicon word at shape distance max_distance or less is far more frequent
    (rare_share) and the edit between them is not one by which the language forms
    words (language_share) or its word is certain_ratio times as frequent, or if its
    neighbours prefer that word by the factor context_odds.  A word of at most `rare`
    occurrences that no listed pair explains may differ in other edits, if frequency
    and neighbours outweigh them (unlisted_pairs).
    Texts that look the same count once in the statistics.  Defined results: null
    and empty texts have no noise; ties between repairs go to the smaller distance,
    the more frequent and the alphabetically first word.
    """

    def __init__(
        self, rows: DataFrame, row_id: str, text: str, page: str, hints: DataFrame | None = None, min_count: int = 3, max_distance: float = 0.9, rare_share: float = 0.05,
        language_share: float = 0.25, certain_ratio: float = 100.0, context_odds: float = 100.0, hinted_odds: float = 40.0, rare: int = 2,
    ) -> None:
        self.row_id = row_id
        plain = consistent_text(rows.where(F.col(text).isNotNull()), row_id, text).withColumnRenamed(row_id, "__cid")
        base = rows.select(F.col(row_id).alias("id"), F.col(page).alias("page")).join(plain, F.col("id") == F.col("__cid")).drop("__cid")
        self.texts = cut_lineage(base)
        self.lines = cut_lineage(page_lines(self.texts))
        reps = self.texts.groupBy(F.sha2("canonical_text", 256).alias("h")).agg(F.min("id").alias("rid"))
        dropped = self.lines.groupBy("id").agg(F.collect_set("line_no").alias("dropped")).withColumnRenamed("id", "__did")
        self.cut = (
            self.texts.join(dropped, F.col("id") == F.col("__did"), "left")
            .join(reps.select("rid"), F.col("id") == F.col("rid"), "left")
            .select("id", F.col("rid").isNotNull().alias("rep"), "canonical_text", "dropped")
        )
        id_type = dict(self.texts.dtypes)["id"]
        self.tokens = cut_lineage(self.cut.mapInPandas(_tokenised, f"id {id_type}, rep boolean, pos int, w string, prev string, next string"))
        self._judge(hints, min_count, max_distance, rare_share, language_share, certain_ratio, context_odds, hinted_odds, rare)

    def _judge(self, hints, min_count, max_distance, rare_share, language_share, certain_ratio, context_odds, hinted_odds, most_rare) -> None:
        tokens = self.tokens
        counted = tokens.where("rep")
        lexicon = cut_lineage(counted.where(~F.col("w").contains(BREAK)).groupBy("w").agg(F.count("*").alias("n")))
        halves = F.split("w", BREAK)
        broken = tokens.where(F.col("w").contains(BREAK)).select("w").distinct().select(F.col("w").alias("key"), F.concat(halves[0], halves[1]).alias("joined"), F.concat(halves[0], F.lit("-"), halves[1]).alias("hyphened"), halves[0].alias("a"), halves[1].alias("b"))
        known = lambda c, n: lexicon.select(F.col("w").alias(c), F.col("n").alias(n))
        broken = broken.join(known("joined", "nj"), "joined", "left").join(known("hyphened", "nh"), "hyphened", "left").join(known("a", "na"), "a", "left").join(known("b", "nb"), "b", "left").fillna(0, ["nj", "nh", "na", "nb"])
        unseen = broken.select(F.col("joined").alias("w")).union(broken.select("hyphened")).distinct().join(lexicon.select("w"), "w", "left_anti").withColumn("n", F.lit(0).cast("long"))
        pairs = cut_lineage(lookalike_words(lexicon.unionByName(unseen), lexicon, min_count, max_distance))
        # An edit that links many pairs of words of like frequency is part of the language (an ending, say), not a misreading.
        rare_pair = (F.col("nc") >= 4 * F.col("nw")) & (F.col("nw") <= F.greatest(F.lit(2), rare_share * F.col("nc")))
        edits = pairs.withColumn("rare", rare_pair)
        both_live = edits.where("nw >= 2 and nc < 4 * nw").groupBy("edit").agg(F.count("*").alias("live"))
        lone = edits.where("rare").groupBy("edit").agg(F.count("*").alias("lone"))
        language = both_live.join(lone, "edit", "left").where(f"live >= 2 and live >= {language_share} * coalesce(lone, 0)").select("edit")
        # Rare words: a frequent look-alike settles it.
        lawful = language.withColumn("__l", F.lit(True))
        rare = edits.where("rare").join(lawful, "edit", "left").where(F.col("__l").isNull() | (F.col("nc") >= certain_ratio * F.col("nw")))
        self.repairs = cut_lineage(rare.groupBy("w").agg(best_repair().alias("c")))
        fixed = self.repairs.select(F.col("w").alias("__w"), F.col("c").alias("__c"))
        for form, out in (("joined", "cj"), ("hyphened", "ch")):
            broken = broken.join(fixed.select(F.col("__w").alias(form), F.col("__c").alias(out)), form, "left")
        unknown = F.expr("nj = 0 and nh = 0")
        join = F.when(~unknown, F.col("nj") >= F.col("nh")).when(F.col("cj").isNotNull(), True).when(F.col("ch").isNotNull(), False).otherwise((F.col("na") < min_count) | (F.col("nb") < min_count))
        self.broken = cut_lineage(broken.select("key", join.alias("join"), F.when(join, F.col("joined")).otherwise(F.col("hyphened")).alias("word"), F.when(join, F.col("cj")).otherwise(F.col("ch")).alias("repair")))
        # Words that are rightly in the lexicon: only their neighbours can tell.
        doubtful = pairs.join(self.repairs.select("w"), "w", "left_anti").where("nw > 0").select("w", "c", F.lit(1.0).alias("gain"), F.lit(False).alias("unlisted"))
        unexplained = lexicon.where(F.col("n") <= most_rare).join(self.repairs.select("w"), "w", "left_anti")
        doubtful = cut_lineage(doubtful.union(unlisted_pairs(unexplained, lexicon, language, min_count, max_distance).withColumn("unlisted", F.lit(True))))
        # What is said of a word is joined to the tokens once: a repair, how a broken word is joined, or that its neighbours are asked.
        nothing, no = F.lit(None).cast("string"), F.lit(False)
        marks = self.repairs.select("w", F.col("c").alias("fix"), F.lit(None).cast("boolean").alias("joined"), no.alias("ask")).union(self.broken.select("key", "repair", "join", no)).union(doubtful.select("w").distinct().select("w", nothing, F.lit(None).cast("boolean"), F.lit(True)))
        flagged = cut_lineage(tokens.drop("rep").join(marks, "w"))
        # Only neighbours of words in question are counted.
        asked = doubtful.select("w").union(doubtful.select("c")).distinct()
        around = cut_lineage(counted.join(asked, "w", "left_semi").groupBy("prev", "w", "next").agg(F.count("*").alias("b")))
        before, after = around.groupBy("prev", "w").agg(F.sum("b").alias("b")), around.groupBy("w", "next").agg(F.sum("b").alias("b"))
        context = flagged.where("ask").select("prev", "w", "next").distinct().join(doubtful, "w")
        for side, word, name, known_pairs in (("prev", "w", "pw", before), ("next", "w", "wn", after), ("prev", "c", "pc", before), ("next", "c", "cn", after)):
            context = context.join(known_pairs.select(side, F.col("w").alias(word), F.col("b").alias(name)), [side, word], "left")
        odds = (F.coalesce("pc", F.lit(0)) + 0.5) / (F.greatest(F.coalesce("pw", F.lit(0)) - 1, F.lit(0)) + 0.5) * (F.coalesce("cn", F.lit(0)) + 0.5) / (F.greatest(F.coalesce("wn", F.lit(0)) - 1, F.lit(0)) + 0.5)
        judged = context.withColumn("odds", odds * F.col("gain")).where((F.col("odds") >= min(context_odds, hinted_odds)) & F.expr("not unlisted or (pc is not null and prev not in ('^', '#')) or (cn is not null and next not in ('$', '#'))"))
        chosen = judged.groupBy("prev", "w", "next").agg(F.min(F.struct((-F.col("odds")).alias("o"), "c")).alias("m")).select("prev", "w", "next", (-F.col("m.o")).alias("odds"), F.col("m.c").alias("c"))
        by_context = flagged.where("ask").select("id", "pos", "prev", "w", "next").join(chosen, ["prev", "w", "next"])
        if hints is not None:
            sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.5)), F.lit(1.0))
            h = hints.select(F.col(self.row_id).alias("__hid"), (hinted_odds + (context_odds - hinted_odds) * (2 * sure - 1)).alias("__need")).groupBy("__hid").agg(F.min("__need").alias("__need"))
            by_context = by_context.join(h, F.col("id") == F.col("__hid"), "left").where(F.col("odds") >= F.coalesce("__need", F.lit(context_odds)))
        else:
            by_context = by_context.where(F.col("odds") >= context_odds)
        self.misread = flagged.where("fix is not null").select("id", "pos", F.col("fix").alias("c")).unionByName(by_context.select("id", "pos", "c"))
        self.breaks = flagged.where("joined is not null").select("id", "pos", "joined")
        self.hyphens = self.breaks.where("joined").select("id", "pos")

    def kinds(self) -> DataFrame:
        """(row_id, noise): each kind of noise in a row once: hyphen, misread, header, page_number."""
        parts = self.lines.select("id", F.col("kind").alias("noise")).unionByName(self.hyphens.select("id", F.lit("hyphen").alias("noise"))).unionByName(self.misread.select("id", F.lit("misread").alias("noise")))
        return parts.distinct().select(F.col("id").alias(self.row_id), "noise")

    def repaired(self) -> DataFrame:
        """(row_id, repaired_text): continuous text without running heads and page numbers, words whole and put right."""
        words = self.breaks.select("id", "pos", F.when(F.col("joined"), "J").otherwise("H").alias("how"), F.lit(None).cast("string").alias("c"))
        fixes = words.unionByName(self.misread.select("id", "pos", F.lit(None).cast("string").alias("how"), "c")).groupBy("id").agg(F.collect_list(F.struct("pos", "how", "c")).alias("fixes")).withColumnRenamed("id", "__fid")
        work = self.cut.join(fixes, F.col("id") == F.col("__fid"), "left").select("id", "canonical_text", "dropped", "fixes")
        id_type = dict(self.texts.dtypes)["id"]
        return work.mapInPandas(_rebuilt, f"id {id_type}, repaired_text string").withColumnRenamed("id", self.row_id)


def _cased(like: str, word: str) -> str:
    if len(like) > 1 and like.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, dropped, fixes in zip(batch["canonical_text"], batch["dropped"], batch["fixes"]):
            how = {f["pos"]: f["how"] for f in (fixes if fixes is not None else []) if f["how"]}
            right = {f["pos"]: f["c"] for f in (fixes if fixes is not None else []) if f["c"]}
            words = []
            for n, (raw, second) in enumerate(reading_tokens(text, set(dropped) if dropped is not None else set())):
                if second is not None:
                    raw = (raw[:-1] if how.get(n) == "J" else raw[:-1] + "-") + second
                before, core, after = core_word(raw)
                words.append(before + _cased(core, right[n]) + after if n in right else raw)
            out.append(" ".join(words))
        yield pd.DataFrame({"id": batch["id"], "repaired_text": out})
