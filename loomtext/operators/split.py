"""Train, dev and test splits over documents linked by equal sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..session import materialize
from .clean import clean_pairs, first_of
from .components import connected_components
from .sample import seeded_order

BATCH = 10_000


def linked_components(rows: DataFrame, group: str = "group_id", sides: tuple[str, ...] = ("src", "trg")) -> DataFrame:
    """``group, component``: groups that share a normalised text on the same side, directly or through others, before any cleaning.

    Each text links its groups to the least one of them, so a text in very many
    groups costs a link for each, not one for each pair.
    """
    keyed = None
    for s in sides:
        k = rows.select(F.col(group).alias("g"), F.lit(s).alias("side"), normalize_text(F.col(s)).alias("n"))
        keyed = k if keyed is None else keyed.union(k)
    keyed = materialize(keyed.where("g is not null and n is not null and n <> ''").distinct())
    least = keyed.groupBy("side", "n").agg(F.min("g").alias("a"), F.count("*").alias("k")).where("k > 1")
    links = keyed.join(least, ["side", "n"]).select("a", F.col("g").alias("b"))
    own = rows.where(f"{group} is not null").select(F.col(group).alias("a"), F.col(group).alias("b")).distinct()
    return connected_components(links.union(own).distinct()).select(F.col("node").alias(group), "component")


def group_sizes(rows: DataFrame, group: str = "component") -> DataFrame:
    """``group, size, kind``: a group is ``smoldoc`` if any of its rows is."""
    return rows.groupBy(group).agg(F.count("*").alias("size"), F.when(F.max((F.col("origin") == "smoldoc").cast("int")) == 1, "smoldoc").otherwise("smolsent").alias("kind"))


def pack_groups(sizes: DataFrame, group: str = "component", seed: int = 13, most_test: int = 300) -> DataFrame:
    """``group, split``: greedy packing in seeded hash order.

    Test gets min(``most_test``, a quarter) of the rows and dev half of that, in the mixture of
    kinds; a group goes to test, else dev, if that brings its count strictly closer to the
    target, else to train. The decision is sequential, but a group fits
    only while it is smaller than twice what a target still lacks. So the driver asks for the next
    ``BATCH`` groups that fit, places them, and asks again with what is lacking
    then: the first of each batch is always placed, there are few batches, and no group is ever left out.
    """
    totals = {r["kind"]: r["n"] for r in sizes.groupBy("kind").agg(F.sum("size").alias("n")).collect()}
    every = sum(totals.values())
    n_test = min(most_test, every // 4)
    spark = sizes.sparkSession
    chosen: list[tuple] = []
    for kind, total in sorted(totals.items()):
        lacking = {"test": round(total * n_test / every), "dev": round(total * (n_test // 2) / every)}
        keyed = sizes.where(F.col("kind") == kind).select(seeded_order(group, seed).alias("h"), F.col(group).alias("g"), "size")
        last = None
        while max(lacking.values()) > 0:
            fits = keyed.where(F.col("size") < 2 * max(lacking.values()))
            if last is not None:
                fits = fits.where((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("g") > last[1])))
            batch = fits.orderBy("h", "g").limit(BATCH).collect()
            for r in batch:
                for name in ("test", "dev"):
                    if abs(lacking[name] - r["size"]) < abs(lacking[name]):
                        lacking[name] -= r["size"]
                        chosen.append((r["g"], name))
                        break
            if len(batch) < BATCH:
                break
            last = batch[-1]["h"], batch[-1]["g"]
    placed = spark.createDataFrame(chosen or [(None, None)], f"{group} {sizes.schema[group].dataType.simpleString()}, split string")
    return sizes.join(F.broadcast(placed), group, "left").select(group, F.coalesce("split", F.lit("train")).alias("split"))


def split_pairs(rows: DataFrame, seed: int = 13) -> DataFrame:
    """Rows with ``component`` and ``split``: linked before cleaning, then cleaned, deduplicated by normalised source and packed.

    A row without a group is a group of its own, and linked by its texts like any other.
    """
    own = F.coalesce("group_id", F.concat(F.lit("row:"), F.col("ordinal").cast("string")))
    rows = rows.withColumn("_group", own)
    comp = linked_components(rows, "_group")
    kept = clean_pairs(rows).join(comp, "_group").drop("_group")
    kept = materialize(first_of(kept.withColumn("_n", normalize_text(F.col("src"))), ["_n"]).drop("_n"))
    return kept.join(pack_groups(group_sizes(kept), seed=seed), "component")
