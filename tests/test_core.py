import math
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import audit, clean, decontam, sample, score, split
from loomtext.operators.components import connected_components


def pairs(spark, rows):
    return spark.createDataFrame(rows, "ordinal int, src string, trg string")


def test_clean_pairs_keeps_the_one_good_row(spark):
    df = pairs(spark, [(0, " good source ", "good target"), (1, "good source", "other target"), (2, "tiny", "good target"), (3, "a" * 40, "short"), (4, None, "x" * 9), (5, "x" * 501, "x" * 400)])
    assert [tuple(r) for r in clean.clean_pairs(df).collect()] == [(0, "good source", "good target")]


def test_ratio_and_length_ends_belong(spark):
    df = pairs(spark, [(0, "a" * 5, "b" * 15), (1, "c" * 15, "d" * 5), (2, "e" * 5, "f" * 16), (3, "g" * 500, "h" * 500)])
    assert sorted(r.ordinal for r in clean.clean_pairs(df).collect()) == [0, 1, 3]


def test_cleaning_twice_changes_nothing(spark):
    df = pairs(spark, [(i, f" sentence {i % 7} ", f"target {i}") for i in range(30)])
    once = clean.clean_pairs(df)
    assert sorted(map(tuple, clean.clean_pairs(once).collect())) == sorted(map(tuple, once.collect()))


def test_dedup_normalized_keeps_first(spark):
    df = pairs(spark, [(2, "Hello  World", "b"), (1, "hello world", "a"), (3, "other", "c")])
    assert sorted(r.ordinal for r in clean.dedup_normalized(df).collect()) == [1, 3]


@pytest.mark.parametrize("n,total", [(10, 1000), (7, 100), (99, 100), (3, 10), (64, 129)])
def test_stratified_rows(spark, n, total):
    df = spark.range(total).select(F.col("id").alias("ordinal"))
    got = sorted(r.ordinal for r in sample.sample_ladder(df, n).collect())
    assert got == [int(i * total / n) for i in range(n)]


def test_ladder_kinds(spark):
    df = spark.range(50).select(F.col("id").alias("ordinal"))
    assert sample.sample_ladder(df, 500).count() == 50
    assert sorted(r.ordinal for r in sample.sample_ladder(df, 5, "top").collect()) == [0, 1, 2, 3, 4]
    a, b = (sorted(r.ordinal for r in sample.sample_ladder(df, 5, "random", seed=s).collect()) for s in (1, 1))
    assert a == b and len(set(a)) == 5
    with pytest.raises(ValueError):
        sample.sample_ladder(df, 5, "odd")


def test_coverage_and_leaning(spark):
    lex = spark.createDataFrame([("a", f"alpha{i}") for i in range(25)] + [("b", f"beta{i}") for i in range(25)] + [("a", "yo"), ("c", "gamma")], "lexicon string, form string")
    corpus = spark.createDataFrame([("x", " ".join(f"alpha{i}" for i in range(25)))], "corpus string, text string")
    forms, vocab = audit.lexicon_forms(lex), audit.corpus_vocab(corpus, "corpus", "text")
    raw = {r.lexicon: (r.n_forms, r.hits, r.coverage) for r in audit.raw_coverage(vocab, forms).collect()}
    assert raw == {"a": (25, 25, 1.0), "b": (25, 0, 0.0), "c": (1, 0, 0.0)}
    d = audit.discriminative_coverage(vocab, forms).collect()
    assert [(r.a, r.b, r.leans, r.margin) for r in d] == [("a", "b", "a", 1.0)]
    boot = audit.bootstrap_identity(vocab, forms).collect()
    assert boot[0].winner == "a" and boot[0].win_rate == 1.0
    assert audit.bootstrap_identity(vocab, forms.where("lexicon = 'a'")).count() == 0


def test_overlaps_and_markers(spark):
    df = spark.createDataFrame([("a", "one"), ("a", " one "), ("a", "two"), ("b", "one"), ("c", "ke tala")], "c string, t string")
    got = {(r.a, r.b): (r.shared, round(r.jaccard, 4)) for r in audit.overlaps(df, "c", "t").collect()}
    assert got == {("a", "b"): (1, 0.5), ("a", "c"): (0, 0.0), ("b", "c"): (0, 0.0)}
    rates = {(r.c, r.marker): r.rate for r in audit.marker_rates(df, ["c"], "t").collect()}
    assert rates["c", "kituba_tam"] == 1.0 and rates["a", "religious"] == 0.0


def test_unigram_model_and_lines(spark):
    words = spark.createDataFrame([("en", "the")] * 3 + [("en", "cat"), ("fr", "le")], "lang string, token string")
    model = audit.unigram_model(words)
    logp = {(r.lang, r.token): r.logp for r in model.collect()}
    assert math.isclose(logp["en", "the"], math.log(4 / 6))
    lines = spark.createDataFrame([(1, "The cat dog"), (2, "--"), (3, None)], "line_id int, line string")
    got = {(r.line_id, r.lang): (r.n_tokens, r.n_known, r.score) for r in audit.score_lines(lines, model).collect()}
    assert got[1, "en"][:2] == (3, 2) and math.isclose(got[1, "en"][2], math.log(4 / 6) + math.log(2 / 6) - 12)
    assert got[2, "fr"] == (0, 0, 0.0) == got[3, "fr"]


def test_decontamination(spark):
    rows = spark.createDataFrame([(1, "Held  out", "t", "d1"), (2, "free", "t", "d1"), (3, "held out", "t", None), (4, "clear", "t", None), (5, "fine", "t", "d2"), (6, "good", "t", "d3")], "ordinal int, src string, trg string, document_id string")
    held = spark.createDataFrame([("held out",)], "norm string")
    assert sorted(r.ordinal for r in decontam.exclude_blocked(rows, held).collect()) == [4, 5, 6]
    ids = spark.createDataFrame([("d3",)], "document_id string")
    assert sorted(r.ordinal for r in decontam.exclude_blocked(rows, held, ids).collect()) == [4, 5]
    assert [r.document_id for r in decontam.blocked_documents(rows, held).collect()] == ["d1"]


def test_leak_report_counts_distinct_values(spark):
    parts = spark.createDataFrame([("train", "a"), ("test", "A "), ("test", "a"), ("dev", "b")], "split string, src string")
    got = {(r.a, r.b): r.shared for r in decontam.leak_report(parts, ["src"]).collect()}
    assert got == {("dev", "test"): 0, ("dev", "train"): 0, ("test", "train"): 1}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a int, b int")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert {k: v for k, v in got.items() if k in parent} == {x: root(x) for x in parent}
    assert connected_components(df.limit(0)).count() == 0


def target(spark):
    rows = [(d * 8 + i, f"source sentence {d if d > 1 else 0} {i}" if i == 0 else f"source {d} sentence {i}", f"target {d} sentence {i}", "smoldoc" if d % 2 else "smolsent", f"doc{d}", f"g{d:02}") for d in range(40) for i in range(8)]
    return spark.createDataFrame(rows, "ordinal int, src string, trg string, origin string, document_id string, group_id string")


def test_splits_are_leak_free_and_repeat(spark):
    t = target(spark)
    a = split.split_pairs(t)
    got = {r.ordinal: (r.component, r.split, r.group_id) for r in a.collect()}
    assert got == {r.ordinal: (r.component, r.split, r.group_id) for r in split.split_pairs(t).collect()}
    assert {s for _, s, _ in got.values()} == {"train", "dev", "test"}
    assert len({s for _, s, g in got.values() if g in ("g00", "g01")}) == 1
    assert all(r.shared == 0 for r in decontam.leak_report(a, ["document_id", "group_id", "src", "trg"]).collect())


def test_identical_texts_score_100(spark):
    p = spark.createDataFrame([("a", "the cat sat on the mat.", "the cat sat on the mat."), ("b", "entirely other words here", "nothing shared x y z q")], "k string, hyp string, ref string")
    chrf = {r.k: r.chrf for r in score.corpus_chrf(p, ["k"]).collect()}
    bleu = {r.k: r.bleu for r in score.corpus_bleu(p, ["k"]).collect()}
    assert math.isclose(chrf["a"], 100) and math.isclose(bleu["a"], 100)
    assert chrf["b"] < 30 and bleu["b"] < 10


def test_chrf_against_plain_counting(spark):
    from collections import Counter

    hyp, ref = ["the cat sat", "a dog ran far"], ["the cat sits", "the dog ran"]
    p = r = k = 0.0
    for kind, n in [("c", i) for i in range(1, 7)] + [("w", 1), ("w", 2)]:
        hit = nh = nr = 0
        for h, f in zip(hyp, ref):
            u, v = (list(h.replace(" ", "")), list(f.replace(" ", ""))) if kind == "c" else (h.split(), f.split())
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (u, v))
            hit, nh, nr = hit + sum((a & b).values()), nh + sum(a.values()), nr + sum(b.values())
        if nh and nr:
            p, r, k = p + hit / nh, r + hit / nr, k + 1
    p, r = p / k, r / k
    want = 100 * 5 * p * r / (4 * p + r)
    df = spark.createDataFrame(list(zip(["x"] * 2, hyp, ref)), "k string, hyp string, ref string")
    assert math.isclose(score.corpus_chrf(df, ["k"]).first().chrf, want, rel_tol=1e-9)


def test_run_table(spark):
    m = spark.createDataFrame([("r1", "dev", "chrf", 12.345), ("r1", "test", "bleu", 1.0), ("r2", "dev", "chrf", 9.0)], "run string, eval string, metric string, value double")
    c = spark.createDataFrame([("r1", 13)], "run string, seed int")
    got = {r.run: r.asDict() for r in score.collate_runs(m, c).collect()}
    assert got["r1"]["dev_chrf"] in (12.34, 12.35) and got["r2"]["test_bleu"] is None and got["r2"]["seed"] is None


def test_positions_of_many_rows_are_exact(spark):
    df = spark.range(1_200_000).select((F.col("id") * 7 + 3).alias("ordinal")).orderBy(F.xxhash64("ordinal"))
    got = sample.number_rows(df).agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.count_if(F.col("position") * 7 + 3 != F.col("ordinal")).alias("bad")).first()
    assert tuple(got) == (1_200_000, 1_200_000, 0, 1_199_999, 0)


def test_lexicon_entries_give_each_word(spark):
    df = spark.createDataFrame([("fr", "L’aube"), ("fr", "mots-clés"), ("fr", "un"), ("kg", None)], "lexicon string, form string")
    assert sorted(r.form for r in audit.lexicon_forms(df).collect()) == ["aube", "clés", "mots"]


def test_rows_without_group_are_split_as_well(spark):
    rows = [(i, f"sentence number {i}", f"target number {i}", "smolsent", None, None if i % 3 == 0 else f"g{i}") for i in range(60)] + [(100, "sentence number 3", "another target here", "smolsent", None, "g4")]
    df = spark.createDataFrame(rows, "ordinal int, src string, trg string, origin string, document_id string, group_id string")
    got = {r.ordinal: (r.component, r.split) for r in split.split_pairs(df).collect()}
    assert len(got) == 60 and {s for _, s in got.values()} == {"train", "dev", "test"} and got[3] == got[4]


def test_packing_takes_as_many_batches_as_needed(spark, monkeypatch):
    sizes = spark.createDataFrame([(f"g{i}", 3 + i % 5, "smolsent") for i in range(300)], "component string, size int, kind string")
    want = {tuple(r) for r in split.pack_groups(sizes).collect()}
    monkeypatch.setattr(split, "BATCH", 7)
    assert {tuple(r) for r in split.pack_groups(sizes).collect()} == want
