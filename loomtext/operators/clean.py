"""Cleaning and keep-first deduplication of sentence pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, strip


def first_of(df: DataFrame, keys: list[str | Column], ordinal: str = "ordinal") -> DataFrame:
    """The row with the least ordinal of each key; a window that Spark cuts to one row before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def within_limits(df: DataFrame, min_chars: int = 5, max_chars: int = 500, max_ratio: float = 3.0) -> DataFrame:
    """Trims both sides, drops nulls, and keeps pairs whose lengths and length ratio lie within the limits (both ends belong to them)."""
    df = df.na.drop(subset=["src", "trg"]).withColumn("src", strip("src")).withColumn("trg", strip("trg"))
    a, b = F.length("src"), F.length("trg")
    ratio = a / F.greatest(b, F.lit(1))
    return df.where(a.between(min_chars, max_chars) & b.between(min_chars, max_chars) & ratio.between(1.0 / max_ratio, max_ratio))


def clean_pairs(df: DataFrame, min_chars: int = 5, max_chars: int = 500, max_ratio: float = 3.0) -> DataFrame:
    """:func:`within_limits`, then one row for each source text, the first.

    The first row of a source survives pair deduplication whatever its target,
    so deduplicating by source alone gives both.
    """
    return first_of(within_limits(df, min_chars, max_chars, max_ratio), ["src"])


def dedup_normalized(df: DataFrame, column: str = "src", ordinal: str = "ordinal") -> DataFrame:
    """The first row of each text after NFKC, case folding and white-space collapse."""
    return first_of(df.withColumn("norm", normalize_text(F.col(column))), ["norm"], ordinal)
