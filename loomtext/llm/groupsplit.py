"""Splits that keep related records together: component swap search by parallel annealing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_id
from ..operators.components import connected_components
from ..session import marks_of, materialize

BLOCK = 20_000
HEAVY_SHARE = 0.005


def row_sets(rows: DataFrame, id_col: str = "row_id", keys: tuple[str, ...] = ("document_id", "group_id")) -> DataFrame:
    """``id_col, set_key, set_id, set_rows`` of every row; ``set_id`` is the least row id of the set.

    Rows that share a value of any key column are tied, also through chains.
    Ids are compared trimmed and in lower case; null or blank ties nothing, so a
    row without keys is a set of its own. The graph has a node for each key
    value and a link for each distinct pair of values in one row, so copies and
    hot values cost nothing; rows take the set of their first key.
    """
    named = [F.concat(F.lit(f"{i}:"), clean_id(k)) for i, k in enumerate(keys)]
    keyed = rows.select(F.col(id_col), *[k.alias(f"k{i}") for i, k in enumerate(named)])
    first = F.coalesce(*[F.col(f"k{i}") for i in range(len(keys))])
    links = None
    for i in range(len(keys)):
        part = keyed.select(first.alias("a"), F.col(f"k{i}").alias("b")).where(f"k{i} is not null")
        links = part if links is None else links.union(part)
    comp = connected_components(links.distinct())
    keyed = materialize(keyed.select(id_col, first.alias("node")).join(comp, "node", "left").select(id_col, F.coalesce("component", F.concat(F.lit("row:"), F.col(id_col).cast("string"))).alias("set_key")))
    sets = keyed.groupBy("set_key").agg(F.min(id_col).alias("set_id"), F.count("*").alias("set_rows"))
    return keyed.join(sets, "set_key")


def tied_rows(rows: DataFrame, id_col: str = "row_id", keys: tuple[str, ...] = ("document_id", "group_id")) -> DataFrame:
    """``id_col, set_id`` of the rows that are tied to another row."""
    return row_sets(rows, id_col, keys).where("set_rows > 1").select(id_col, "set_id")


Parts = list[list[tuple[int, float]]]


def anneal(sizes: Parts, start: list[int], target: np.ndarray, seed: int, sweeps: int = 40) -> tuple[list[int], float]:
    """Moves and exchanges whole components until size and label deviation stop falling.

    ``sizes``: for each component its rows in all (column 0) and by label, as columns and numbers; only labels that it has.
    ``target``: rows by split and column. Returns the best assignment seen and its energy, the sum
    of relative deviations. The moves taken are written down, and those up to the lowest energy are done over at the end, so the best is exact at any size.
    """
    rng = np.random.default_rng(seed)
    n, k = len(sizes), len(target)
    weight = (1 / np.maximum(target.sum(axis=0), 1.0)).tolist()
    dev = (-target).tolist()
    for part, q in zip(sizes, start):
        for c, x in part:
            dev[q][c] += x
    low = e = sum(abs(x) * w for row in dev for x, w in zip(row, weight))
    if n == 0 or k < 2:
        return list(start), low
    steps = max(2_000, sweeps * n)
    temps = np.geomspace(0.02, 1e-6, steps)
    # a step that adds d is taken with exp(-d / temperature), that is if d < temperature x -log(coin)
    allow = (temps * -np.log(np.maximum(rng.random(steps), 1e-300))).tolist()
    at, log, best = list(start), [], 0
    for i, j, to, swap, most in zip(rng.integers(n, size=steps).tolist(), rng.integers(n, size=steps).tolist(), rng.integers(k, size=steps).tolist(), (rng.random(steps) >= 0.5).tolist(), allow):
        p, q = at[i], at[j] if swap else to
        if p == q:
            continue
        out, into = dev[p], dev[q]
        if swap:
            change = dict(sizes[i])
            for c, x in sizes[j]:
                change[c] = change.get(c, 0.0) - x
            moved = list(change.items())
        else:
            moved = sizes[i]
        d = 0.0
        for c, x in moved:
            a, b = out[c], into[c]
            d += (abs(a - x) - abs(a) + abs(b + x) - abs(b)) * weight[c]
        if d <= 0 or d < most:
            for c, x in moved:
                out[c] -= x
                into[c] += x
            at[i] = q
            log.append((i, q))
            if swap:
                at[j] = p
                log.append((j, p))
            e += d
            if e < low - 1e-12:
                low, best = e, len(log)
    at = list(start)
    for i, q in log[:best]:
        at[i] = q
    return at, low


def _hashed_start(h: np.ndarray, share: np.ndarray, seed: int) -> list[int]:
    x = (h.astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B9 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    u = (x >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.minimum(np.searchsorted(np.cumsum(share), u, side="right"), len(share) - 1).tolist()


def split_components(rows: DataFrame, targets: DataFrame, id_col: str = "row_id", keys: tuple[str, ...] = ("document_id", "group_id"), label: str = "origin", chains: int = 4, seed: int = 13) -> DataFrame:
    """``id_col, set_id, split`` of every row, in the shares of ``targets(split, share)``.

    Components (a row each, with their size by label) are dealt to blocks of
    about ``BLOCK`` by hash; ``chains`` annealing chains run for each block in
    parallel from differently hashed assignments, and the best chain of a block
    is kept. Components over ``HEAVY_SHARE`` of all rows (so at most
    1 / HEAVY_SHARE of them) are placed first by an annealing of their own and the
    blocks share what is left of the targets, so a component with a third of
    all rows takes its place before anything else. Null labels are a label of
    their own; there may be any number of labels, and ids of any type. An empty table gives an empty
    result; shares are scaled to sum 1.
    """
    spark = rows.sparkSession
    share_rows = sorted((r["split"], float(r["share"] or 0)) for r in targets.where("split is not null").collect())
    names = [n for n, _ in share_rows]
    share = np.array([s for _, s in share_rows])
    if not len(share) or share.sum() <= 0:
        raise ValueError("targets hold no positive share")
    share = share / share.sum()
    sets = materialize(row_sets(rows, id_col, keys))
    # an id that comes twice has as many labels as rows
    labelled = sets.join(rows.groupBy(id_col, F.coalesce(clean_id(label), F.lit("")).alias("label")).agg(F.count("*").alias("k")), id_col).dropDuplicates([id_col, "label"])
    counted = labelled.groupBy("set_id", "label").agg(F.sum("k").cast("double").alias("k"))
    comps = counted.groupBy("set_id").agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(F.struct("label", "k"))).alias("by")).withColumn("h", F.xxhash64("set_id"))
    comps = materialize(comps, marks={"count": F.count(F.lit(1)), "rows": F.sum("n")})
    number, total = marks_of(comps)["count"], marks_of(comps)["rows"] or 0.0
    limit = max(1.0, HEAVY_SHARE * total)

    heavy = sorted(comps.where(F.col("n") > limit).collect(), key=lambda r: str(r["set_id"]))
    of_heavy = sorted({x["label"] for r in heavy for x in r["by"]})
    sums = {r["label"]: r["k"] for r in comps.select(F.explode("by").alias("x")).select("x.*").where(F.col("label").isin(of_heavy)).groupBy("label").agg(F.sum("k").alias("k")).collect()} if heavy else {}
    heavy_at: list[int] = []
    left: dict[str | None, np.ndarray] = {None: share}  # the splits' shares of what is left, in all and of the labels that heavy components have
    if heavy:
        column = {x: c + 1 for c, x in enumerate(of_heavy)}
        parts = [[(0, r["n"]), *((column[x["label"]], x["k"]) for x in r["by"])] for r in heavy]
        goal = share[:, None] * np.array([total, *(sums[x] for x in of_heavy)])[None, :]
        h = np.array([r["h"] for r in heavy], np.int64)
        heavy_at = min((anneal(parts, _hashed_start(h, share, seed + c), goal, seed + c, 400) for c in range(chains)), key=lambda r: r[1])[0]
        for part, q in zip(parts, heavy_at):
            for c, x in part:
                goal[q, c] -= x
        goal = np.maximum(goal, 0)
        for c, x in enumerate([None, *of_heavy]):
            left[x] = goal[:, c] / goal[:, c].sum() if goal[:, c].sum() > 0 else share
    blocks = max(1, -(-number // BLOCK))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", ignore_index=True)
        column: dict[str, int] = {}
        parts = [[(0, n), *((column.setdefault(x["label"], len(column) + 1), x["k"]) for x in by)] for n, by in zip(pdf.n, pdf.by)]
        sums = np.zeros(len(column) + 1)
        for part in parts:
            for c, x in part:
                sums[c] += x
        goal = np.stack([left[None], *(left.get(x, share) for x in column)], axis=1) * sums[None, :]
        chain = int(key[1])
        at, e = anneal(parts, _hashed_start(pdf.h.to_numpy(), left[None], seed + 101 * chain), goal, seed + 7 * chain + int(key[0]))
        return pd.DataFrame({"set_id": pdf.set_id, "at": at, "block": int(key[0]), "chain": chain, "energy": e})

    light = comps.where(F.col("n") <= limit).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    light = light.withColumn("chain", F.explode(F.array(*[F.lit(c) for c in range(chains)])))
    kind = T.StructType([comps.schema["set_id"], *T._parse_datatype_string("at int, block int, chain int, energy double").fields])
    tried = materialize(light.groupBy("block", "chain").applyInPandas(run, kind))
    best = tried.groupBy("block").agg(F.min_by("chain", F.struct("energy", "chain")).alias("chain"))
    chosen = tried.join(best, ["block", "chain"]).select("set_id", "at")
    if heavy:
        chosen = chosen.union(spark.createDataFrame([(r["set_id"], q) for r, q in zip(heavy, heavy_at)], T.StructType([comps.schema["set_id"], T.StructField("at", T.IntegerType())])))
    name = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at") + 1)
    return sets.join(chosen, "set_id").select(id_col, "set_id", name.alias("split"))


def split_report(assigned: DataFrame, rows: DataFrame, targets: DataFrame, id_col: str = "row_id", label: str = "origin") -> DataFrame:
    """``split, label, n_rows, target_rows``: reached and wanted rows by split and label."""
    lab = rows.select(id_col, F.coalesce(clean_id(label), F.lit("")).alias("label"))
    got = assigned.join(lab, id_col).groupBy("split", "label").agg(F.count("*").alias("n_rows"))
    all_labels = got.groupBy("label").agg(F.sum("n_rows").alias("label_rows"))
    grid = all_labels.crossJoin(F.broadcast(targets.select("split", "share")))
    return grid.join(got, ["split", "label"], "left").select("split", "label", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.col("share") * F.col("label_rows")).alias("target_rows"))
