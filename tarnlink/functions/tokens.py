"""Tokenizers as Column expressions (K01-K11); only the phonetic ones run in Python."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .phonetic import double_metaphone

WORD = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Commas are blanks, blanks separate; standardized text is in lower case already."""
    return F.filter(F.split(F.regexp_replace(_col(text), ",", " "), r"\s+"), lambda w: w != "")


def word_chars(text: Column | str) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


#: Up to U+024F Python and the JVM agree on letters, digits and lower case; other texts are cut by the JVM only.
BEYOND = r"[^\x00-\u024F]"
_beyond, _runs = re.compile(BEYOND), re.compile(r"[^\W_]+")


def beyond(text: Column | str) -> Column:
    """word_chars(text) of a text with letters beyond U+024F, null for others: what python_word_chars() needs."""
    return F.when(_col(text).rlike(BEYOND), word_chars(text))


def python_word_chars(text: str | None, known: Callable[[], list[str] | None]) -> list[str]:
    """word_chars() in Python; known gives beyond() of the text, and is asked only where that holds something."""
    if text is None:
        return []
    return known() or [] if _beyond.search(text) else _runs.findall(text.lower())


def char_ngrams(text: Column | str, n: int) -> Column:
    """Character n-grams inside words."""
    long = F.filter(word_chars(text), lambda w: F.length(w) >= n)
    return F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substr(w, i, F.lit(n)))))


def skip_bigrams(text: Column | str) -> Column:
    """Letters i and i + 2 of a word."""
    long = F.filter(word_chars(text), lambda w: F.length(w) >= 3)
    pair = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.concat(F.substr(w, i, F.lit(1)), F.substr(w, i + 2, F.lit(1))))
    return F.flatten(F.transform(long, pair))


def word_shingles(text: Column | str) -> Column:
    """Pairs of neighbouring words, in lower case."""
    w = words(F.lower(_col(text)))
    return F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat_ws(" ", a, b)), lambda x: x.contains(" "))


def _codes(cut: int | None):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}

        def of(word: str) -> list[str]:
            if word not in known:
                known[word] = list(dict.fromkeys(c[:cut] for c in double_metaphone(word) if c))
            return known[word]

        return texts.map(lambda ws: [] if ws is None else [c for w in ws for c in of(w)])

    return run


def phonetic(text: Column | str, cut: int | None = 4) -> Column:
    """K04 (cut to 4 characters), K05 (cut=None): distinct Double Metaphone codes of each word; numbers have none."""
    return _codes(cut)(words(text))


#: Replacements of the phonetic key, in order.
KEY_RULES = (
    ("ph", "f"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("sh", "s"), ("ch", "C"), ("ck", "k"), ("q", "k"), ("x", "ks"),
    ("z", "j"), ("w", "v"), ("y", "i"), ("ee", "i"), ("oo", "u"), ("c", "k"), ("C", "c"),
)


def phonetic_key(word: Column) -> Column:
    """K07 of one lower-case word: replacements, doubles collapsed, later vowels and h dropped; others stay."""
    key = word
    for a, b in KEY_RULES:
        key = F.replace(key, F.lit(a), F.lit(b))
    key = F.regexp_replace(F.regexp_replace(key, r"(.)\1+", "$1"), "(?<=.)[aeiouh]", "")
    return F.when(word.rlike(r"^\p{L}+$"), key).otherwise(word)


def phonetic_keys(text: Column | str) -> Column:
    return F.transform(words(text), phonetic_key)


def numbers(text: Column | str) -> Column:
    """The distinct runs of digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(r"\d+"), F.lit(0))))


def plain_words(text: Column | str) -> Column:
    """Words without a digit."""
    return F.filter(words(text), lambda w: ~w.rlike(r"\d"))


def fuzzy_words(text: Column | str, limit: int, least: int = 1, alpha: bool = False) -> Column:
    """The first words that are long enough and, on demand, letters only."""
    fit = F.filter(words(text), lambda w: (F.length(w) >= least) & (w.rlike(r"^\p{L}+$") if alpha else F.lit(True)))
    return F.slice(fit, 1, limit)


TOKENIZERS = {
    "words": words,
    "bi": lambda c: char_ngrams(c, 2),
    "tri": lambda c: char_ngrams(c, 3),
    "skip": skip_bigrams,
    "phonetic": phonetic,
    "phonfull": lambda c: phonetic(c, None),
    "phonkey": phonetic_keys,
    "shingle": word_shingles,
}

#: Tokenizers whose terms lie inside the words of word_chars(): the characters of a window, and which of them are the term.
INSIDE = {"bi": (2, (0, 1)), "tri": (3, (0, 1, 2)), "skip": (3, (0, 2))}
