"""Size ladders of a corpus sorted by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def number_rows(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Adds ``position``, counted from 0 in the order of ``ordinal``, without one task for all rows.

    Rows are sorted in ranges, as many as the session shuffles into; a row's range
    and its place in it are written down once, because the bounds of the ranges come
    from a sample that another run of the same plan would draw anew. The sizes of
    the ranges (a row each) give every range its offset. Rows of one ordinal are
    numbered in any order; an empty table stays empty.
    """
    ranged = df.repartitionByRange(F.col(ordinal)).sortWithinPartitions(ordinal).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")


def seeded_order(c: Column | str, seed: int) -> Column:
    """The md5 of ``seed:value``: a seeded order that any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col(c) if isinstance(c, str) else c).cast("string")))


def sample_ladder(df: DataFrame, n: int, how: str = "stratified", seed: int = 13, ordinal: str = "ordinal") -> DataFrame:
    """``n`` rows: ``top`` the first, ``random`` in seeded hash order, ``stratified`` every (N / n)-th.

    A table of at most ``n`` rows comes back whole. The stratified rows are those at
    the positions floor(i * N / n), found by arithmetic on each row's position
    rather than by a list of positions.
    """
    if how not in ("top", "random", "stratified"):
        raise ValueError(f"unknown kind of sample: {how}")
    total = df.count()
    if n >= total:
        return df
    if how == "top":
        return df.orderBy(ordinal).limit(n)
    if how == "random":
        return df.orderBy(seeded_order(ordinal, seed), ordinal).limit(n)
    i = F.ceil(F.col("position") * F.lit(float(n)) / F.lit(float(total)))
    hits = [(i + k).cast("double") * F.lit(total / n) for k in (-1, 0, 1)]
    on = F.lit(False)
    for k, h in zip((-1, 0, 1), hits):
        on = on | ((h.cast("long") == F.col("position")) & (i + k >= 0) & (i + k < n))
    return number_rows(df, ordinal).where(on).drop("position")


def build_ladders(df: DataFrame, sizes: list[int], how: str = "stratified", seed: int = 13) -> dict[int, DataFrame]:
    """A sample for each size of one cleaned corpus."""
    return {n: sample_ladder(df, n, how, seed) for n in sizes}
