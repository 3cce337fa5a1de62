"""Corpus-level translation scores, and the table of runs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = re.compile(r"([^\w\s]|_)")
_MARK_BLEU = re.compile(r"([^\w\s.,'])")
_POINT = re.compile(r"(?<![0-9])([.,])|([.,])(?![0-9])")


def letters(text: str) -> list[str]:
    return [c for c in text if not c.isspace()]


def marked_words(text: str) -> list[str]:
    """Words, with punctuation marks as words of their own."""
    return _MARK.sub(r" \1 ", text).split()


def bleu_words(text: str) -> list[str]:
    """As :func:`marked_words`, but numbers keep their points and words their apostrophes."""
    return _POINT.sub(lambda m: f" {m.group()} ", _MARK_BLEU.sub(r" \1 ", text)).split()


def ngram_matches(pairs: DataFrame, units: list[tuple[Callable[[str], list[str]], int]], key: list[str], hyp: str, ref: str) -> DataFrame:
    """``*key, o, hyp, ref, hit``: for each order o, n-grams of hypothesis and reference and those in both (each at most as often as in the other), summed over sentences.

    Matches are counted within a sentence, so one Arrow pass gives a few numbers a sentence and only sums are shuffled.
    """

    def count(h: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(h, r):
            row: list[int] = []
            for cut, n in units:
                a, b = cut(x), cut(y)
                u, v = (Counter(zip(*[z[i:] for i in range(n)])) for z in (a, b))
                row += [max(0, len(a) - n + 1), max(0, len(b) - n + 1), sum(min(c, v[g]) for g, c in u.items())]
            out.append(row)
        return pd.Series(out)

    count.__annotations__ = {"h": pd.Series, "r": pd.Series, "return": pd.Series}
    counted = pairs.na.drop(subset=[hyp, ref]).select(*key, F.pandas_udf(count, T.ArrayType(T.LongType()))(F.col(hyp), F.col(ref)).alias("_c"))
    names = ("hyp", "ref", "hit")
    sums = counted.groupBy(*key).agg(*[F.sum(F.col("_c")[3 * o + j]).alias(f"{name}{o}") for o in range(len(units)) for j, name in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(o).alias("o"), *[F.col(f"{name}{o}").alias(name) for name in names]) for o in range(len(units))])
    return sums.select(*key, F.explode(rows).alias("x")).select(*key, "x.*")


def corpus_chrf(pairs: DataFrame, key: list[str], hyp: str = "hyp", ref: str = "ref", chars: int = 6, word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """``*key, chrf``: character n-gram F-score with words (chrF++ at ``word_order`` 2), after Popovic (2015, 2017).

    Precision and recall are taken over the sums of the whole corpus for each
    order and averaged over the orders that occur on both sides. Pairs with a null side are left out.
    """
    units = [(letters, n) for n in range(1, chars + 1)] + [(marked_words, n) for n in range(1, word_order + 1)]
    m = ngram_matches(pairs, units, key, hyp, ref).where("hyp > 0 and ref > 0")
    avg = m.groupBy(*key).agg(F.avg(F.col("hit") / F.col("hyp")).alias("p"), F.avg(F.col("hit") / F.col("ref")).alias("r"))
    b2 = beta * beta
    return avg.select(*key, F.when(b2 * F.col("p") + F.col("r") > 0, 100 * (1 + b2) * F.col("p") * F.col("r") / (b2 * F.col("p") + F.col("r"))).otherwise(0.0).alias("chrf"))


def corpus_bleu(pairs: DataFrame, key: list[str], hyp: str = "hyp", ref: str = "ref", most: int = 4, words: Callable[[str], list[str]] = bleu_words) -> DataFrame:
    """``*key, bleu``: BLEU of Papineni et al. (2002), one reference, exponential smoothing of orders without a match; ``words`` is the tokenizer (a subword one gives spBLEU)."""
    m = ngram_matches(pairs, [(words, n) for n in range(1, most + 1)], key, hyp, ref)
    zeros = F.sum((F.col("hit") == 0).cast("int")).over(Window.partitionBy(*key).orderBy("o"))
    prec = F.when(F.col("hyp") == 0, F.lit(None)).when(F.col("hit") == 0, 1.0 / (F.pow(F.lit(2.0), zeros) * F.col("hyp"))).otherwise(F.col("hit") / F.col("hyp"))
    got = m.withColumn("lp", F.log(prec)).groupBy(*key).agg(F.sum(F.coalesce("lp", F.lit(-1e9))).alias("s"), F.max(F.when(F.col("o") == 0, F.col("hyp"))).alias("h"), F.max(F.when(F.col("o") == 0, F.col("ref"))).alias("r"))
    brief = F.when(F.col("h") >= F.col("r"), 0.0).otherwise(1 - F.col("r") / F.greatest("h", F.lit(1)))
    return got.select(*key, (100 * F.exp(F.col("s") / most + brief)).alias("bleu"))


def collate_runs(metrics: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """One row for each run of ``metrics(run, eval, metric, value)``: columns ``{eval}_{metric}`` rounded to two places, and the run's settings."""
    long = metrics.select("run", F.concat_ws("_", "eval", "metric").alias("name"), F.bround("value", 2).alias("value"))
    wide = long.groupBy("run").pivot("name").agg(F.first("value"))
    return wide if configs is None else wide.join(configs, "run", "left")
