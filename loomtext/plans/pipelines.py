"""Whole runs: preparing corpora, auditing them, scoring predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit, clean, sample, score, split
from ..session import materialize
from ..sources import sinks


def build_pivot(pairs: DataFrame, sizes: list[int], out: str, key: str, how: str = "stratified", mode: str = "errorifexists") -> dict[int, int]:
    """Cleans a pivot corpus once, writes a sample of each size and returns their row counts."""
    cleaned = materialize(clean.clean_pairs(pairs))
    counts = {}
    for n, df in sample.build_ladders(cleaned, sizes, how).items():
        sinks.write_jsonl(df.select("src", "trg"), f"{out}/pivot/{key}_{n}", mode=mode)
        counts[n] = min(n, cleaned.count())
    return counts


def build_target(rows: DataFrame, out: str, seed: int = 13, mode: str = "errorifexists") -> DataFrame:
    """Splits the target rows without leaks, writes train, dev and test, and returns the assignment."""
    parts = materialize(split.split_pairs(rows, seed))
    for name in ("train", "dev", "test"):
        sinks.write_jsonl(parts.where(F.col("split") == name).drop("split", "component"), f"{out}/target/{name}", mode=mode)
    return parts


def require_size(df: DataFrame, n: int, what: str) -> DataFrame:
    """Raises unless the table has exactly ``n`` rows."""
    if (have := df.count()) != n:
        raise ValueError(f"{what} should have {n} rows, has {have}")
    return df


def audit_corpora(texts: DataFrame, lexicons: DataFrame, sample_size: int | None = None) -> dict[str, DataFrame]:
    """Marker rates, overlaps and lexicon evidence of ``texts(corpus, ordinal, text)``, on the first ``sample_size`` rows of each corpus if given."""
    if sample_size is not None:
        ranked = sample.number_rows(texts.select("corpus", "text", F.struct("corpus", "ordinal").alias("o")), "o")
        first = ranked.groupBy("corpus").agg(F.min("position").alias("p0"))
        texts = ranked.join(F.broadcast(first), "corpus").where(F.col("position") - F.col("p0") < sample_size)
    texts = materialize(texts.select("corpus", "text"))
    vocab, forms = materialize(audit.corpus_vocab(texts, "corpus", "text")), materialize(audit.lexicon_forms(lexicons))
    return {
        "markers": audit.marker_rates(texts.where("text is not null"), ["corpus"], "text"), "overlap": audit.overlaps(texts, "corpus", "text"),
        "coverage": audit.raw_coverage(vocab, forms), "discriminative": audit.discriminative_coverage(vocab, forms), "stability": audit.bootstrap_identity(vocab, forms),
    }


def predict(df: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], text: str = "src", out: str = "hyp", prompt: str = "translate English to Kikongo: ", batch: int = 32) -> DataFrame:
    """Adds a model's output; ``make`` loads the model once a task and returns a function from texts to texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            asked = [prompt + (x or "") for x in s]
            yield pd.Series([y for k in range(0, len(asked), batch) for y in model(asked[k : k + batch])], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, T.StringType())(F.col(text)))


def evaluate(predictions: DataFrame, run: str, key: str = "eval", pieces: Callable[[str], list[str]] | None = None) -> DataFrame:
    """``run, eval, metric, value`` of predictions ``(eval, hyp, ref)``: chrF++, BLEU, and spBLEU where ``pieces``, a subword tokenizer, is given.

    Without one spBLEU is left out, and that is said.
    """
    named = lambda df, c: df.select(key, F.lit(c).alias("metric"), F.col(df.columns[-1]).alias("value"))
    out = named(score.corpus_chrf(predictions, [key]), "chrf++").union(named(score.corpus_bleu(predictions, [key]), "bleu"))
    if pieces is None:
        print("spBLEU left out: no subword tokenizer is given")
    else:
        out = out.union(named(score.corpus_bleu(predictions, [key], words=pieces), "spbleu"))
    return out.select(F.lit(run).alias("run"), F.col(key).alias("eval"), "metric", "value")


def stage(spark: SparkSession, path: str, key: str, make: Callable[[str], None]) -> bool:
    """Runs ``make(path)`` and leaves the completion mark, unless the mark is already there; tells whether it ran."""
    if sinks.finished(spark, path):
        return False
    make(path)
    sinks.mark_complete(spark, path, key)
    return True
