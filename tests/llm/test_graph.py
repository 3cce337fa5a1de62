import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.llm import clusters, groupsplit

PAIR = "pair_id long, left_group_id string, left_document_id string, right_group_id string, right_document_id string, score double, verdict string, component_id string"


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_consolidation_reads_ids_verdicts_and_documents(spark):
    rows = [
        (1, " A ", None, "b", "x", None, "MATCH ", "clash"), (2, "b", None, None, " D9 ", 0.9, "match", ""), (3, "z", None, "y", None, 0.1, "no_match", ""),
        (4, "q", None, "Q", None, 0.1, "match", ""), (5, None, None, "a", None, 1.0, "match", ""), (6, "w", None, "v", None, 1.0, None, ""), (7, "b", None, "a", None, 1.0, "Match", ""),
    ]
    got = {r.group_id: r.component_id for r in clusters.consolidate(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == {"a": "a", "b": "a", "doc:d9": "a"}


def test_hash_to_min_on_chains_hubs_and_random_graphs(spark):
    rng = random.Random(3)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)] + [(f"r{rng.randrange(90):02}", f"r{rng.randrange(90):02}") for _ in range(60)]
    df = spark.createDataFrame([*edges, ("s", "s"), (None, "a")] * 2, "a string, b string")
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert {r.member: r.component for r in clusters.hash_to_min(df).collect()} == want


def test_empty_pairs(spark):
    assert clusters.consolidate(spark.createDataFrame([], PAIR)).count() == 0


ROW = "row_id long, src string, document_id string, group_id string, origin string, set_id string"


def target(spark, n=400):
    rng = random.Random(7)
    rows = [(i, "same text", "hot" if i % 3 == 0 else (f"d{rng.randrange(90)}" if rng.random() < 0.7 else None), f"G{rng.randrange(150)}" if rng.random() < 0.5 else " ", rng.choice(["a", "b", None]), "x") for i in range(n)]
    return spark.createDataFrame(rows, ROW), rows


def test_tied_rows_against_union_find(spark):
    df, rows = target(spark)
    edges = [(("r", r[0]), k) for r in rows for k in [("d", r[2])] * bool(r[2]) + [("g", r[3].lower())] * bool(r[3].strip())]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
    sets = {}
    for r in rows:
        sets.setdefault(root(("r", r[0])), []).append(r[0])
    want = {(i, min(v)) for v in sets.values() if len(v) > 1 for i in v}
    assert {tuple(r) for r in groupsplit.tied_rows(df).collect()} == want


def test_splits_keep_sets_whole_and_meet_shares(spark):
    rng = random.Random(1)
    rows = [(i, "t", f"d{rng.randrange(250)}", None, rng.choice("ab"), "x") for i in range(1000)]
    df = spark.createDataFrame(rows, ROW)
    goal = spark.createDataFrame([("train", 0.8), ("validation", 0.08), ("test", 0.12)], "split string, share double")
    out = groupsplit.split_components(df, goal).collect()
    assert len(out) == 1000
    by_set = {}
    for r in out:
        assert by_set.setdefault(r.set_id, r.split) == r.split
    share = Counter(r.split for r in out)
    assert abs(share["train"] - 800) <= 3 and abs(share["test"] - 120) <= 3
    assert sorted(map(tuple, out)) == sorted(map(tuple, groupsplit.split_components(df, goal).collect()))


def test_split_with_a_component_of_a_third(spark):
    df, rows = target(spark, 300)
    goal = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, share double")
    out = groupsplit.split_components(df, goal)
    assert out.count() == 300
    report = {(r.split, r.label): r.n_rows for r in groupsplit.split_report(out, df, goal).collect()}
    assert sum(report.values()) == 300 and set(x for _, x in report) == {"", "a", "b"}


def test_split_of_nothing_and_without_shares(spark):
    goal = spark.createDataFrame([("train", 1.0)], "split string, share double")
    none = spark.createDataFrame([], ROW)
    assert groupsplit.split_components(none, goal).count() == 0 and groupsplit.tied_rows(none).count() == 0
    with pytest.raises(ValueError):
        groupsplit.split_components(none, goal.where(F.lit(False)))


def test_the_best_assignment_is_exact_at_any_size():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (50, 3000):
        parts = [[(0, float(x)), (1 + int(rng.integers(3)), float(x))] for x in rng.integers(1, 9, n)]
        sums = np.zeros(4)
        for part in parts:
            for c, x in part:
                sums[c] += x
        goal = np.array([0.8, 0.1, 0.1])[:, None] * sums
        at, low = groupsplit.anneal(parts, [0] * n, goal, 5)
        dev = -goal
        for part, q in zip(parts, at):
            for c, x in part:
                dev[q, c] += x
        assert (np.abs(dev) / np.maximum(goal.sum(axis=0), 1)).sum() == pytest.approx(low, abs=1e-6) and low < 0.05


def test_any_number_of_labels_and_ids_that_are_no_numbers(spark):
    rng = random.Random(2)
    rows = [(f"r{i:04}", "t", f"d{rng.randrange(200)}", None, f"label {rng.randrange(90)}", "x") for i in range(1000)]
    df = spark.createDataFrame(rows, ROW.replace("row_id long", "row_id string"))
    goal = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, share double")
    out = groupsplit.split_components(df, goal).collect()
    assert len(out) == 1000 and abs(sum(r.split == "train" for r in out) - 800) <= 16
    by_set = {}
    assert all(by_set.setdefault(r.set_id, r.split) == r.split for r in out)
