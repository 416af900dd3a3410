"""Text cleaning expressions.

Patterns carry the flags ``(?U)`` (Unicode word and space classes) and ``(?d)``
(only ``\\n`` ends a line), so that they read text as the source data expects.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railweave.functions import wordlists as W

# Python's str.split() also treats the four ASCII separators as blanks.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
# type objects, so that the module can be imported before a session exists
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                   T.StructField("end", T.IntegerType())]))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda evaluates what it refers to again for every element, so costly values are
    bound (or kept in a column) before a lambda uses them.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Single accented letters and their base letter, derived from Unicode data."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _unsettled_characters() -> str:
    """Pattern of the characters that canonical composition may move, join or replace; none is below U+0300."""
    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    found = []
    for code in range(0x300, sys.maxunicode + 1):
        char = chr(code)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(int(parts[1], 16))
        if unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char):
            found.append(code)
    ranges = []
    for code in sorted(seconds.union(found)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return rf"[\x{{300}}-\x{{10FFFF}}&&[{''.join(rf'\x{{{a:X}}}-\x{{{b:X}}}' for a, b in ranges)}]]"


@lru_cache(maxsize=1)
def _blank_characters() -> str:
    return "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def squeeze_blanks(text: Column) -> Column:
    """B7 as split-and-join: every run of blanks becomes one space, ends trimmed.

    Single spaces, the bulk of all blanks, are left where they are.
    """
    return F.trim(F.regexp_replace(
        text, r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]", " "))


def strip_blanks(text: Column) -> Column:
    """Blanks of any kind off both ends."""
    return F.btrim(text, F.lit(_blank_characters()))


def normalize_whitespace(text: Column) -> Column:
    """The six ASCII blanks squeezed to one space, then stripped."""
    return strip_blanks(F.regexp_replace(
        text, r"[\t\n\r\f\x0B ]{2,}|[\t\n\r\f\x0B]", " "))


def remove_accents(text: Column) -> Column:
    """Base letters for precomposed letters, then drop loose combining marks."""
    source, target = _fold_table()
    return F.regexp_replace(F.translate(text, source, target), r"\p{Mn}+", "")


def ascii_fold(text: Column) -> Column:
    """Accent folding with the usual Latin ligatures spelled out (used by B1)."""
    folded = remove_accents(text)
    for char, letters in (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe")):
        folded = F.replace(folded, F.lit(char), F.lit(letters))
    return F.translate(folded, "ØøŁłĐđıſ’‘–—", "OoLlDdis''--")


def normalize_name(name: Column) -> Column:
    """B1: the key under which station, city and query names are compared."""
    lowered = F.lower(ascii_fold(F.coalesce(name, F.lit(""))))
    spaced = F.translate(lowered, "-'`", "   ")
    return squeeze_blanks(F.regexp_replace(spaced, r"(?U)[^\w\s]", ""))


def extract_city_name(name: Column) -> Column:
    """B2: strip each known station suffix once, in order."""
    city = name
    for suffix in W.CITY_SUFFIXES:
        city = F.regexp_replace(city, "(?iUd)" + suffix, "")
    return strip_blanks(city)


def split_keys(keys: Column) -> Column:
    """B4: ';'-separated keys to a clean array."""
    return F.filter(F.transform(F.split(keys, ";"), strip_blanks), lambda k: k != "")


@F.pandas_udf(T.StringType())
def normalize_unicode_exact(text: pd.Series) -> pd.Series:
    """B5 for any script, in Arrow batches."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_unicode(text: Column) -> Column:
    """Canonical composition.

    Only rows that hold a mark, a jamo or another character that composition may change go through
    ``normalize_unicode_exact``; the others stay in the JVM, and their place in its batches is null.
    """
    return F.coalesce(normalize_unicode_exact(F.when(text.rlike(_unsettled_characters()), text)), text)


def normalize_apostrophes(text: Column) -> Column:
    """B6."""
    return F.translate(text, W.APOSTROPHES, "'" * len(W.APOSTROPHES))


def normalize_hyphens(text: Column) -> Column:
    """B6."""
    return F.translate(text, W.DASHES, "-" * len(W.DASHES))


def remove_punctuation(text: Column, keep: str = "'-") -> Column:
    """Drop everything but word characters, blanks and ``keep``."""
    kept = "".join(c if c.isalnum() else "\\" + c for c in keep)
    return F.regexp_replace(text, rf"(?U)[^\w\s{kept}]", "")


@dataclass(frozen=True)
class CleanConfig:
    """B10 switches."""

    lowercase: bool = False
    remove_accents: bool = False
    normalize_whitespace: bool = True
    remove_punctuation: bool = False
    normalize_apostrophes: bool = True
    normalize_hyphens: bool = True
    strip_extra_spaces: bool = True
    exact_unicode: bool = False


def clean_text(text: Column, config: CleanConfig = CleanConfig()) -> Column:
    """One expression composed from the enabled steps, in fixed order."""
    steps = [
        (True, normalize_unicode_exact if config.exact_unicode else normalize_unicode),
        (config.normalize_apostrophes, normalize_apostrophes),
        (config.normalize_hyphens, normalize_hyphens),
        (config.remove_accents, remove_accents),
        (config.lowercase, F.lower),
        (config.remove_punctuation, remove_punctuation),
        (config.normalize_whitespace, normalize_whitespace),
        (config.strip_extra_spaces, strip_blanks),
    ]
    result = F.coalesce(text, F.lit(""))
    for enabled, step in steps:
        if enabled:
            result = step(result)
    return result


def words(text: Column) -> Column:
    """Whitespace tokens of a text; a blank text has none."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def tokenize(text: Column, config: CleanConfig = CleanConfig()) -> Column:
    """Tokens of the cleaned text."""
    return words(clean_text(text, config))


@F.arrow_udf(_SPANS)
def token_spans(text: pa.Array, tokens: pa.Array) -> pa.Array:
    """Character span of each token, searched left to right.

    A fold over a Spark array copies the array at each step, which is quadratic on
    long documents, so this linear scan runs in Arrow batches.  Only one row at a time
    is held as Python objects; its spans go to flat columns of integers.
    """
    starts, ends, offsets, missing = array("i"), array("i"), array("i", [0]), []
    for value, parts in zip(text, tokens):
        value, parts = value.as_py(), parts.as_py()
        missing.append(value is None or parts is None)
        at = 0
        for part in [] if missing[-1] else parts:
            start = value.find(part, at)
            if start < 0:
                starts.append(at)
                ends.append(at + len(part))
            else:
                at = start + len(part)
                starts.append(start)
                ends.append(at)
        offsets.append(len(starts))
    spans = pa.StructArray.from_arrays(
        [pa.array(np.frombuffer(c, np.int32) if c else [], pa.int32()) for c in (starts, ends)], ["start", "end"])
    return pa.ListArray.from_arrays(
        pa.array(np.frombuffer(offsets, np.int32)), spans, mask=pa.array(missing, pa.bool_()))


def clean_artifacts(text: Column) -> Column:
    """Known markers first, then the generic patterns, then squeeze."""
    markers = "|".join(re.escape(m) for m in W.ARTIFACT_MARKERS)
    patterns = rf"(?d)(?=[\[*._…-])(?:{'|'.join(W.ARTIFACT_PATTERNS)})"
    # the lookahead spares most positions the list of markers
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?=[\[*])(?:{markers})", " ")
    return squeeze_blanks(F.regexp_replace(bare, patterns, " "))


def is_pure_artifact(text: Column) -> Column:
    """Nothing but artifacts."""
    return F.length(clean_artifacts(text)) == 0
