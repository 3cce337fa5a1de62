"""Scalar text functions. Column in, Column out.

Classes are written out because Java's ``\\w \\s \\b`` are ASCII-only by default.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U:[\s\x1c-\x1f])"
WORD = r"[\p{L}\p{N}_]"
LETTERS = r"[\p{L}\p{Nl}\p{No}]"


def strip(c: Column | str) -> Column:
    """Removes any Unicode white space at both ends (``trim`` knows only U+0020)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, numbers and underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), F.lit(0))


def letter_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters (and letter-like numerals, but no digits)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(f"{LETTERS}+"), F.lit(0))


def clean_id(c: Column | str) -> Column:
    """An identifier trimmed of any Unicode space and lower-cased; blank is null."""
    c = strip(F.lower(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def normalize(s: str | None) -> str | None:
    """NFKC, case folding and white-space collapse of one string."""
    return None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split())


@F.pandas_udf(T.StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    return s.map(normalize, na_action="ignore")


def _fold(s: str) -> str:
    s = unicodedata.normalize("NFD", s.replace("-", "").replace("'", ""))
    return "".join(ch for ch in s if not unicodedata.combining(ch)).lower()


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Drops hyphens, apostrophes and accents; lower case."""
    return s.map(_fold, na_action="ignore")


def _align_key(s: str) -> str:
    s = unicodedata.normalize("NFD", s.lower())
    return "".join(ch for ch in s if "a" <= ch <= "z")


@F.pandas_udf(T.StringType())
def align_key(s: pd.Series) -> pd.Series:
    """Only the letters a to z that remain after accents are taken off."""
    return s.map(_align_key, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def py_round4(s: pd.Series) -> pd.Series:
    """Rounds the exact binary value, half to even, to four places."""
    return s.map(lambda x: round(x, 4), na_action="ignore")


def marker_pattern(words: list[str]) -> str:
    """A case-insensitive pattern for any of ``words`` (regular expressions) between word boundaries."""
    return rf"(?iu)(?<!{WORD})(?:{'|'.join(words)})(?!{WORD})"


def tidy(c: Column | str) -> Column:
    """Collapses white space, strips gutter marks at the start and the space before punctuation."""
    c = F.col(c) if isinstance(c, str) else c
    c = strip(F.regexp_replace(c, f"{SPACE}+", " "))
    c = F.regexp_replace(c, r"^[|`'’\"~*_.,:;\- ]+", "")
    return strip(F.regexp_replace(c, r" +([.,;:!?])", "$1"))


def split_lines(c: Column | str) -> Column:
    """Lines of a text at every Unicode line break; one trailing empty line is dropped."""
    c = F.col(c) if isinstance(c, str) else c
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    return F.split(F.regexp_replace(c, rf"(?:{breaks})\z", ""), breaks)
