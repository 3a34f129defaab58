"""Similarity of names as an Arrow function."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _in_word(character: str) -> bool:
    return character.isalnum() or character == "_"


def canonical_words(name: str) -> list[str]:
    """The words that two spellings of a name are compared by.

    Compatibility form, case-folded. A word that a line break has cut at its hyphen is one word;
    hyphens inside words stay; all other characters but letters, digits and underscores part words.
    """
    whole: list[str] = []
    for piece in unicodedata.normalize("NFKC", name).casefold().split():
        broken = whole and whole[-1].endswith("-") and len(whole[-1]) > 1 and _in_word(whole[-1][-2]) and _in_word(piece[0])
        if broken:
            whole[-1] += piece
        else:
            whole.append(piece)
    words = ["".join(run) for piece in whole for kept, run in groupby(piece, lambda c: c == "-" or _in_word(c)) if kept]
    while words and not words[0].strip("-"):
        words.pop(0)
    while words and not words[-1].strip("-"):
        words.pop()
    if words:
        words[0] = words[0].lstrip("-")
        words[-1] = words[-1].rstrip("-")
    return words


def digit_runs(words: list[str]) -> set[str]:
    """The distinct runs of digits in words."""
    return {"".join(run) for word in words for digits, run in groupby(word, str.isdecimal) if digits}


@lru_cache(maxsize=50_000)
def _words_and_digits(name: str) -> tuple[tuple[str, ...], frozenset[str]]:
    words = canonical_words(name)
    return tuple(words), frozenset(digit_runs(words))


@lru_cache(maxsize=250_000)
def _ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio()


@lru_cache(maxsize=250_000)
def name_similarity(left: str | None, right: str | None) -> float:
    """1 if the words are equal, 0 if their numbers differ; else the better matching ratio of the names as they are and with sorted words."""
    (a, one), (b, other) = _words_and_digits(left or ""), _words_and_digits(right or "")
    if a == b or one != other:
        return float(a == b)
    return max(_ratio(x, y) for x, y in {(" ".join(a), " ".join(b)), (" ".join(sorted(a)), " ".join(sorted(b)))})


def similarity(left: Column, right: Column) -> Column:
    """name_similarity of two columns, in Arrow batches; each distinct pair of a batch is compared once."""

    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")])
        codes, distinct = pairs.factorize()
        return pd.Series([name_similarity(x, y) for x, y in distinct], dtype="float64").take(codes).reset_index(drop=True)

    return compared(left, right)


#: Letters from common to rare. Any order of characters gives right results; this one parts names well.
COMMON = " etaoinsrhldcumfpgwybvkxjqz"


def character_tokens(text: str) -> list[str]:
    """Each character of a text with how often it came before, rare ones first: two texts share as many as they have characters in common."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        common = len(COMMON) - COMMON.index(c) if c in COMMON else 0
        out.append((common - 8 * seen[c], f"{c}{seen[c]}"))
    return [token for _, token in sorted(out)]


def canonical(name: Column) -> Column:
    """A struct of a name's words joined by spaces, its distinct numbers, and its characters as tokens, in Arrow batches."""

    @F.pandas_udf("text string, digits string, tokens array<string>")
    def made(names: pd.Series) -> pd.DataFrame:
        words = [canonical_words(n or "") for n in names]
        texts = [" ".join(w) for w in words]
        return pd.DataFrame({"text": texts, "digits": [",".join(sorted(digit_runs(w))) for w in words], "tokens": [character_tokens(t) for t in texts]})

    return made(name)


def canonical_text(name: Column) -> Column:
    """A name's words joined by spaces, in Arrow batches."""

    @F.pandas_udf("string")
    def made(names: pd.Series) -> pd.Series:
        return pd.Series([" ".join(canonical_words(n or "")) for n in names], dtype="object")

    return made(name)


def matching_ratio(left: Column, right: Column) -> Column:
    """The matching ratio of two texts as they are, in Arrow batches."""

    @F.pandas_udf("double")
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return compared(left, right)
