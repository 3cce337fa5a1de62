"""Keeping held-out material out of a training pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .clean import clean_pairs, dedup_normalized
from .sample import sample_ladder


def blocked_documents(rows: DataFrame, held: DataFrame, doc: str = "document_id", text: str = "src") -> DataFrame:
    """Distinct ids of documents with any sentence in ``held(norm)``."""
    return rows.where(f"{doc} is not null").select(doc, normalize_text(F.col(text)).alias("norm")).join(held.select("norm").distinct(), "norm", "left_semi").select(doc).distinct()


def exclude_blocked(rows: DataFrame, held: DataFrame, blocked_ids: DataFrame | None = None, doc: str = "document_id", text: str = "src") -> DataFrame:
    """Rows that are clear of held-out material.

    A document goes whole if one of its sentences is held out, or if its id is in
    ``blocked_ids`` (the same document in another language's block); a single sentence goes if it is held out.
    """
    normed = rows.withColumn("_norm", normalize_text(F.col(text)))
    heldset = held.select(F.col("norm").alias("_norm")).distinct()
    hit = normed.where(f"{doc} is not null").join(heldset, "_norm", "left_semi").select(doc)
    if blocked_ids is not None:
        hit = hit.union(blocked_ids.select(doc))
    docs = normed.where(f"{doc} is not null").join(hit.distinct(), doc, "left_anti").select(normed.columns)
    single = normed.where(f"{doc} is null").join(heldset, "_norm", "left_anti").select(normed.columns)
    return docs.union(single).drop("_norm")


def split_by_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among ``keys`` (reviewed), and the others (pending)."""
    k = keys.select(*on).distinct()
    return rows.join(k, on, "left_semi"), rows.join(k, on, "left_anti")


def leak_report(parts: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """``column, a, b, shared``: distinct normalised values that every two splits share, for each column."""
    values = None
    for c in columns:
        v = parts.select(F.lit(c).alias("column"), F.col(split).alias("s"), normalize_text(F.col(c)).alias("v")).where("v is not null and v <> ''")
        values = v if values is None else values.union(v)
    held = values.groupBy("column", "v").agg(F.collect_set("s").alias("ss"))
    names = parts.select(F.col(split).alias("s")).distinct()
    grid = names.select(F.col("s").alias("a")).join(names.select(F.col("s").alias("b")), F.col("a") < F.col("b")).crossJoin(values.select("column").distinct())
    pairs = held.where(F.size("ss") > 1).select("column", F.explode("ss").alias("a"), "ss").select("column", "a", F.explode("ss").alias("b")).where("a < b").groupBy("column", "a", "b").agg(F.count("*").alias("shared"))
    return grid.join(pairs, ["column", "a", "b"], "left").select("column", "a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def build_eligible_pool(rows: DataFrame, held: DataFrame, n: int, seed: int = 13) -> DataFrame:
    """Cleaned, normalised-distinct rows without held-out sources, drawn evenly over the ordinal."""
    pool = dedup_normalized(clean_pairs(rows))
    pool = pool.join(held.select("norm").distinct(), "norm", "left_anti").drop("norm")
    return sample_ladder(pool, n, "stratified", seed)


def provenance(rows: DataFrame, by: str = "origin", doc: str = "document_id") -> DataFrame:
    """``by, n_rows, n_documents, n_sources, chars``: totals of each origin; a null origin is ``unknown``."""
    return rows.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.count("*").alias("n_rows"), F.countDistinct(doc).alias("n_documents"), F.countDistinct("src").alias("n_sources"), F.coalesce(F.sum(F.length("src")), F.lit(0)).alias("chars"))
