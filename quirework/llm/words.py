"""Plain words of a text, as the passage search compares them."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd


def char_class(categories: tuple[str, ...], last: int = sys.maxunicode) -> str:
    """The inside of a regular-expression class with every character, up to last, of the given general categories."""
    spans: list[list[int]] = []
    for c in range(last + 1):
        if unicodedata.category(chr(c)).startswith(categories):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


#: Characters of two or more 16-bit units.  A class that has none of them is tested by one table look-up, another range by range.
_HIGH = re.compile("[\U00010000-\U0010ffff]")


def last_plane(text: str) -> int:
    """The last character that a class needs to cover for this text."""
    return sys.maxunicode if _HIGH.search(text) else 0xFFFF


@lru_cache(2)
def word_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """Runs of letters (with their marks) and decimal digits."""
    return re.compile(f"[{char_class(('L', 'M', 'Nd'), last)}]+")


@lru_cache(2)
def _odd_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """Characters that have to be replaced before words are cut: invisible ones and width variants."""
    return re.compile(f"[{char_class(('Cf',), last)}︀-️͏！-￯]")


def _plain_char(found: re.Match) -> str:
    ch = found[0]
    return unicodedata.normalize("NFKC", ch) if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")) else "" if ch < "＀" or ch == "﻿" else ch


def plain_words(text: str | None) -> list[str]:
    """The words of a text without regard to case, punctuation, blanks, invisible characters, width and composition."""
    if not text:
        return []
    last = 0xFFFF
    if not text.isascii():
        last = last_plane(text)
        text = _odd_pattern(last).sub(_plain_char, text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return word_pattern(last).findall(text.casefold())


def slices(batches: Iterator[pd.DataFrame], column: str = "text", chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Batches cut so that each holds about `chars` characters of text (or one longer text): what is made of a slice stays small whatever the texts' length."""
    for batch in batches:
        size = batch[column].str.len().fillna(0).cumsum()
        part = (size // chars).astype("int64")
        if len(batch) and part.iloc[-1] == 0:
            yield batch
            continue
        for _, piece in batch.groupby(part.to_numpy(), sort=True):
            yield piece.reset_index(drop=True)
