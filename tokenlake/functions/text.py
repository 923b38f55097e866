"""Text functions: two normalisations, reject reasons, edit counts, parsing of token lists."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.functions.arrays import let

#: Words in Spark and DuckDB regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
#: What Python's str.strip and \s take as white space.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"

# Characters that the two normalisations treat by name.
DIACRITICS = "\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED\u0640"
UNIFIED = {"\u0623": "\u0627", "\u0625": "\u0627", "\u0622": "\u0627", "\u0649": "\u064A", "\u0629": "\u0647"}
PUNCTUATION = {"\u061F": "?", "\u060C": ",", "\u061B": ";", "\u06D4": ".", "\u2026": ".", "\u2013": "-", "\u2014": "-"}
QUOTES = {"\u2018": "'", "\u2019": "'", "\u201C": '"', "\u201D": '"'}
TATWEEL = "\u0640"
INVISIBLE = "\u200B\u200C\u200D\u200E\u200F\u202A\u202B\u202C\u202D\u202E\u2066\u2067\u2068\u2069\u00A0\uFEFF"
ARABIC_LETTER = "[\u0620-\u064A\u0671-\u06D3\u06FA-\u06FF\u0750-\u077F]"

_speech_map = str.maketrans(PUNCTUATION | QUOTES | {TATWEEL: None} | dict.fromkeys(INVISIBLE, " "))
_unify = str.maketrans(UNIFIED)
_marks = re.compile(f"[{DIACRITICS}]")
_symbols = re.compile("[^\\w\\s\u0600-\u06FF]")


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    return unicodedata.category(c)


def normalized_transcript(text: str) -> str:
    """One transcript as it is compared: letters unified, marks and punctuation gone (which joins words), one space."""
    text = _marks.sub("", unicodedata.normalize("NFKC", text)).translate(_unify)
    gone = {ord(c): None for c in set(text) if _kind(c)[0] == "P"}
    return " ".join(_symbols.sub(" ", text.translate(gone)).split())


def speakable(text: str, strip_marks: bool = True) -> str:
    """One text as a phonemizer reads it: punctuation mapped to Latin, invisible characters to spaces, marks dropped."""
    text = unicodedata.normalize("NFKC", text).translate(_speech_map)
    if strip_marks:
        text = text.translate({ord(c): None for c in set(text) if _kind(c) == "Mn"})
    return re.sub(r"\s+", " ", text).strip()


@F.pandas_udf(T.StringType())
def normalize_transcript(text: pd.Series) -> pd.Series:
    return text.map(normalized_transcript, na_action="ignore")


@F.pandas_udf(T.StringType())
def speech_text(text: pd.Series) -> pd.Series:
    return text.map(speakable, na_action="ignore")


@F.pandas_udf(T.StringType())
def mapped_text(text: pd.Series) -> pd.Series:
    return text.map(lambda t: speakable(t, strip_marks=False), na_action="ignore")


def is_blank(text: Column) -> Column:
    """Null or white space only."""
    return text.isNull() | text.rlike(rf"\A{BLANK}*\z")


def reject_reason(text: Column, mapped: Column, n: Column, most: int, least: int = 50, *, letters: str = ARABIC_LETTER, reject_latin: bool = False) -> Column:
    """The first reason to reject a sample, null to keep it. mapped: mapped_text(text), made in a stage before."""
    reason = F.when(text.isNull(), "null_text").when(mapped == "", "empty_text").when(~mapped.rlike(letters), "no_arabic_letters").when(mapped.rlike(r"\p{Nd}"), "contains_digits")
    if reject_latin:
        reason = reason.when(mapped.rlike("[A-Za-z]{2,}"), "latin_run")
    return reason.when(n < least, "too_short").when(n > most, "too_long")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


#: Code points for distinct words: those above the basic plane.
LETTERS = 1 << 20


def word_errors(ref: Column, hyp: Column) -> Column:
    """Edit distance over words: each distinct word of the pair becomes one character, then levenshtein.

    A pair with more than LETTERS distinct words, which no transcript has, is an error rather than a wrong count. The
    words' names and the strings are computed once a pair, whatever names them.
    """

    def distance(r: Column, h: Column, names: Column) -> Column:
        letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(names, w) + 65535), 8, "0")), "UTF-32")
        join = lambda a: F.array_join(F.transform(a, letter), "")
        many = F.raise_error(F.lit(f"more than {LETTERS} distinct words in a pair")).cast("int")
        return F.when(F.size(names) <= LETTERS, edits(join(r), join(h))).otherwise(many)

    return let(word_array(ref), lambda r: let(word_array(hyp), lambda h: let(F.array_distinct(F.concat(r, h)), lambda names: distance(r, h, names)))).cast("long")


def edits(a: Column, b: Column) -> Column:
    """levenshtein, tried within bands that grow from the difference of the lengths: its cost is the band times the length."""

    def banded(x: Column, y: Column) -> Column:
        near = F.abs(F.char_length(x) - F.char_length(y)) * 4 + 16
        within = lambda n: F.nullif(F.call_function("levenshtein", x, y, n), F.lit(-1))
        return F.coalesce(within(near), within(near * 8), F.levenshtein(x, y))

    return let(a, lambda x: let(b, lambda y: banded(x, y)))


def char_errors(ref: Column, hyp: Column) -> Column:
    return edits(ref, hyp).cast("long")


def parsed_tokens(raw: Column, strict: bool = False) -> Column:
    """A JSON list of integers, or integers between commas and white space; of anything else null, or an error if strict."""
    text = F.trim(raw)
    listed = F.from_json(text, "array<int>")
    parts = F.filter(F.split(text, r"[,\s]+"), lambda p: p != "")
    cast = F.transform(parts, lambda p: p.try_cast("int"))
    plain = F.when((F.size(parts) > 0) & ~F.exists(cast, lambda c: c.isNull()), cast)
    got = F.when(text.startswith("["), F.when(~F.exists(listed, lambda c: c.isNull()), listed)).otherwise(plain)
    if not strict:
        return got
    said = F.when(F.coalesce(text, F.lit("")) == "", "no tokens to read").otherwise(F.concat(F.lit("not a list of tokens: "), F.substring(text, 1, 80)))
    return F.when(got.isNotNull(), got).otherwise(F.raise_error(said).cast("array<int>"))
