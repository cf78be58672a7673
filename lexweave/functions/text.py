"""Tokenizers, keys and other text expressions (all JVM-side unless noted)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token classes. Spark's \w is ASCII only, so classes are spelled out.
WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
GREEK_BLOCKS = "Ͱ-Ͽἀ-῿"
LATIN_BLOCKS = "A-Za-zÀ-ɏ"
APOSTROPHES = "ʼ'’"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


#: Java 17 takes any letter as part of a word in \b, though its \w is ASCII only
_ASCII_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_edges(pattern: str) -> str:
    r"""The pattern with each \b at the edges of ASCII words, as RE2 has it."""
    return pattern.replace(r"\b", _ASCII_EDGE)


def words(col: Column | str, pattern: str = WORD2) -> Column:
    """Lower-cased tokens of a text as an array."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(pattern), F.lit(0))


def count_words(col: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_c(col), F.lit(WORD), F.lit(0)))


def script_tokens(col: Column | str, blocks: str = GREEK_BLOCKS) -> Column:
    """Runs of one script; an elision apostrophe stays on its word."""
    pattern = f"[{blocks}]+(?:[{APOSTROPHES}][{blocks}]*)?"
    return F.regexp_extract_all(_c(col), F.lit(pattern), F.lit(0))


def parser_tokens(col: Column | str) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(_c(col), F.lit(WORD_OR_MARK), F.lit(0))


def review_tokens(col: Column | str, blocks: str = GREEK_BLOCKS) -> Column:
    """Script words, numbers with decimals, and any other single mark."""
    word = f"[{blocks}]+(?:[{APOSTROPHES}][{blocks}]*)?"
    return F.regexp_extract_all(_c(col), F.lit(rf"{word}|\d+(?:[.,]\d+)?|[^\s]"), F.lit(0))


@F.pandas_udf(T.StringType())
def casefold_nfc(s: pd.Series) -> pd.Series:
    """Full case folding then NFC; Spark has neither, so one Arrow batch at a time."""
    return s.map(lambda v: unicodedata.normalize("NFC", v.casefold()), na_action="ignore")


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Drop combining marks (NFD minus category Mn), recomposed to NFC."""

    def one(v: str) -> str:
        kept = "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn")
        return unicodedata.normalize("NFC", kept)

    return s.map(one, na_action="ignore")


def alnum_key(col: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), "[^a-z0-9]+", "")


def snake_key(col: Column | str) -> Column:
    snake = F.regexp_replace(F.lower(F.coalesce(_c(col), F.lit(""))), "[^a-z0-9]+", "_")
    return F.regexp_replace(snake, "^_+|_+$", "")


def let(col: Column, body) -> Column:
    """Bind a column to a lambda variable so that lambdas nested in ``body`` do
    not evaluate it again for every element."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All token n-grams lo..hi of an array, space-joined; short arrays give none."""
    empty = F.array().cast("array<string>")

    def grams(t: Column, n: int) -> Column:
        if n == 1:
            return t
        run = lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")
        return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), run)).otherwise(empty)

    return let(tokens, lambda t: F.concat(empty, *[grams(t, n) for n in range(lo, hi + 1)]))


def char_ngrams(text: Column, n: int) -> Column:
    """Overlapping character n-grams in one pass (a lookahead captures n
    characters while the match itself advances by one)."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def whole_word(term: str) -> str:
    """Java pattern for a term not touching ASCII letters."""
    return r"(?<![A-Za-z])\Q" + term.replace("\\E", "") + r"\E(?![A-Za-z])"


def snippet(text: Column, start: Column, end: Column, width: int = 80) -> Column:
    """Text around the 0-based span [start, end) with ellipses where it was cut."""
    left = F.greatest(F.lit(0), start - width)
    right = F.least(F.length(text), end + width)
    body = F.replace(F.substr(text, left + 1, right - left), F.lit("\n"), F.lit(" "))
    return F.concat(
        F.when(left > 0, "...").otherwise(""), body, F.when(right < F.length(text), "...").otherwise("")
    )


def feats_map(col: Column | str) -> Column:
    """``Key=Value|Key=Value`` to a map; ``_`` and empty give an empty map."""
    c = _c(col)
    empty = F.create_map().cast("map<string,string>")
    return F.when(c.isNull() | c.isin("", "_"), empty).otherwise(
        F.str_to_map(c, F.lit(r"\|"), F.lit("="))
    )


def feats_canonical(col: Column | str) -> Column:
    """Key-sorted ``k=v|k=v`` text, or ``_`` when empty."""
    entries = F.array_sort(F.map_entries(feats_map(col)))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return F.when(text == "", "_").otherwise(text)


def deps_list(col: Column | str) -> Column:
    """``head:rel|head:rel`` to array<struct<head,deprel>>; relations may hold colons."""
    c = _c(col)
    items = F.when(c.isNull() | c.isin("", "_"), F.array().cast("array<string>")).otherwise(
        F.split(c, r"\|")
    )
    return F.transform(
        items,
        lambda i: F.struct(
            F.substring_index(i, ":", 1).alias("head"),
            F.substr(i, F.instr(i, ":") + 1).alias("deprel"),
        ),
    )


def note_value(col: Column | str, key: str) -> Column:
    """Value of ``key=`` in ``;``-separated notes, '' when absent."""
    return F.trim(F.regexp_extract(F.coalesce(_c(col), F.lit("")), rf"(?:^|;\s*)\Q{key}\E=([^;]+)", 1))
