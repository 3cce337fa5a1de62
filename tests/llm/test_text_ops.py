import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import align, langid, mixture, ocr, subjects

PAIR = {"cat": "nkewa", "dog": "mbwa", "house": "nzo", "water": "masa", "tree": "nti", "child": "mwana", "sings": "yimbila", "drinks": "nwa", "sees": "mona", "red": "mbwaki", "small": "fioti", "old": "nunu", "road": "nzila", "eats": "dia", "woman": "nkento", "man": "bakala"}


def bilingual(rng, n):
    out = []
    for _ in range(n):
        ws = [rng.choice(list(PAIR)) for _ in range(7)]
        num = str(rng.randrange(1000))
        out.append((" ".join([*ws, num]) + ".", " ".join([*(PAIR[w] for w in ws), num]) + "."))
    return out


def dictionary(spark):
    return spark.createDataFrame([(k.upper(), [v, None, " "]) for k, v in PAIR.items()] * 2 + [(None, ["x"]), ("none", []), ("nil", None)], "src string, trgs array<string>")


DOC = "id string, srcs array<string>, trgs array<string>, src_index string"


def test_alignment_of_known_documents(spark):
    rng = random.Random(5)
    docs, want = [], set()
    for d in range(25):
        p = bilingual(rng, 8)
        src, trg = [a for a, _ in p], [b for _, b in p]
        links = [(i, i) for i in range(8)]
        order = list(range(8))
        if d % 3 == 0:
            order[2], order[5] = 5, 2
        trg = [trg[i] for i in order]
        links = [(i, order.index(i)) for i in range(8)]
        if d % 2:
            del trg[3]
            links = [(i, j - (j > 3)) for i, j in links if j != 3]
        if d % 5 == 0:
            trg[0] = trg[0] + " " + trg[1]
            del trg[1]
            links = [(i, max(0, j - 1)) if j else (i, j) for i, j in links]
        trg.append("…")
        docs.append((f" D{d}", src, trg, "clash"))
        want |= {(f"d{d}", i, j) for i, j in links}
    docs += [docs[0], ("x", None, ["a"], ""), ("y", [], [], ""), (None, ["cat"], ["nkewa"], ""), ("z", [None, " "], ["", None], "")]
    got = {(r.id, r.src_index, r.trg_index) for r in align.align_documents(spark.createDataFrame(docs, DOC), dictionary(spark)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want), (got - want, want - got)


def test_long_documents_with_omissions_and_far_moves(spark):
    p = bilingual(random.Random(7), 2000)
    moved = p[1000:] + p[:1000]
    df = spark.createDataFrame([("first", [a for a, _ in p], [b for _, b in p[:500]], ""), ("moved", [a for a, _ in p], [b for _, b in moved], "")], DOC)
    got = {(r.id, r.src_index, r.trg_index) for r in align.align_documents(df, dictionary(spark)).collect()}
    assert len(got & {("first", i, i) for i in range(500)}) > 475
    assert len(got & {("moved", i, (i + 1000) % 2000) for i in range(2000)}) > 1900


def test_sparse_transport_links_as_the_dense_one():
    p = bilingual(random.Random(9), 300)
    rarity = {w: 1.0 for k, v in PAIR.items() for w in (k, v)}
    vec = align.Vectors({k: [(v, 1.0)] for k, v in PAIR.items()}, rarity, rarity, 5.0)
    src, trg = [a for a, _ in p], [b for _, b in p[40:]] + [p[3][1] + " " + p[4][1], None]
    dense, sparse = align.links(src, trg, vec), align.links(src, trg, vec, dense=0)
    assert [x[:2] for x in dense] == [x[:2] for x in sparse] and np.allclose([x[2] for x in dense], [x[2] for x in sparse], atol=1e-3)


def test_entries_of_several_words_are_used(spark):
    words = spark.createDataFrame([("in front of", ["ntwala"]), ("in", ["muna"]), ("front", ["nima"])], "src string, trgs array<string>")
    table = align.dictionary_table(words)
    vec = align.Vectors(table, {}, {}, 5.0)
    assert vec.units("He stood In Front of us in front", True) == ["He", "stood", "In Front of", "us", "in", "front"]
    assert vec.units("in front of", False) == ["in", "front", "of"]
    df = spark.createDataFrame([("d", ["in front of", "in", "front"], ["nima", "ntwala", "muna"], "")], DOC)
    assert {(r.src_index, r.trg_index) for r in align.align_documents(df, words).collect()} == {(0, 1), (1, 2), (2, 0)}


def test_transport_runs_until_the_masses_are_met():
    rng = np.random.default_rng(1)
    a, b = rng.random(30), rng.random(25)
    a, b = a / (a.sum() + b.sum()), b / (a.sum() + b.sum())
    cost = rng.random((30, 25))
    near, far = align.transport(cost, a, b, 0.3, close=1e-9, rounds=100_000), align.transport(cost, a, b, 0.3)
    assert np.abs(near - far).max() < 1e-4
    x, y = np.divmod(np.arange(750), 25)
    assert np.allclose(align.sparse_transport(x, y, cost.ravel(), a, b, 0.3, close=1e-9, rounds=100_000), near.ravel(), atol=1e-7)


def test_many_documents_are_transported_as_each_by_itself():
    rng = np.random.default_rng(2)
    parts = []
    for n, m in [(1, 1), (3, 9), (8, 8), (20, 5), (7, 7), (2, 1), (31, 33)]:
        a, b = rng.random(n), rng.random(m)
        parts.append((rng.random((n, m)), a / (a.sum() + b.sum()), b / (a.sum() + b.sum())))
    for got, (cost, a, b) in zip(align.transport_many(parts, 0.3), parts):
        assert np.allclose(got, align.transport(cost, a, b, 0.3), atol=1e-6)


def test_alignment_of_long_and_no_documents(spark):
    p = bilingual(random.Random(6), 1500)
    df = spark.createDataFrame([("long", [a for a, _ in p], [b for _, b in p], "")], DOC)
    got = {(r.src_index, r.trg_index) for r in align.align_documents(df, dictionary(spark)).collect()}
    assert len(got & {(i, i) for i in range(1500)}) > 1450
    assert align.align_documents(df.limit(0), dictionary(spark)).count() == 0
    assert align.align_documents(df.limit(1), dictionary(spark).limit(0)).count() > 0  # numbers alone


def test_transport_keeps_masses():
    rng = np.random.default_rng(0)
    a, b = rng.random(5), rng.random(7)
    plan = align.transport(rng.random((5, 7)), a / 20, b / 20, 0.4)
    assert (plan >= 0).all() and (plan.sum(axis=1) <= a / 20 + 1e-6).all() and (plan.sum(axis=0) <= b / 20 + 1e-3).all()


SCAN = "rec_id long, id string, kikongo string, kikongo_variant string, body array<string>, page int, kind string, line_no string"


def scans(spark):
    rng = random.Random(9)
    words = "maison chemin montagne femme grand travail lumière semaine année enfant donner jardin famille chaque".split()
    rows = []
    for i in range(120):
        text = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(4)]
        text[-1] += "."
        rows.append([i, "e", "MWANA KE LOMBA MASA KUNA NZILA", None, text])
    bad = {}
    for i, (line, new, kind) in enumerate([(0, lambda s: s.replace("m", "rn", 1), "char"), (1, lambda s: "| " + s, "margin"), (2, lambda s: s[:-2] + "-", "hyphen"), (0, lambda s: s.replace("a", "4", 0).replace("e", "c", 1), "char"), (1, lambda s: s.replace("l", "1", 1), "char")]):
        rows[i][4][line] = new(rows[i][4][line] if kind != "hyphen" else rows[i][4][line] + "xx"[:0])
        bad[i, line] = kind
    for i in range(20, 40):
        rows[i][4].insert(2, f"{i}   Paroles du vieux chemin")
        bad[i, 2] = "header"
        rows[i + 30][4].insert(1, f"— {i} —")
        bad[i + 30, 1] = "page_number"
    rows[60][2] = "MWANA KE LOM- BA MASA KUNA NZILA"
    bad[60, -1] = "hyphen"
    rows[61][2] = "MWANA KE L0MBA MASA KUNA NZILA"
    bad[61, -1] = "char"
    rows += [[500, None, None, None, None], [501, None, "", None, []], [502, None, "X", None, [None, "", " ", "~ |"]]]
    bad[502, 3] = "margin"
    return spark.createDataFrame([(*r, None, "clash", "clash") for r in map(tuple, rows)], SCAN), bad


def test_damage_of_scanned_entries(spark):
    df, bad = scans(spark)
    got = {(r.rec_id, r.line_no): r.kind for r in ocr.damage(ocr.examine(df)).collect()}
    missing, extra = {k: v for k, v in bad.items() if got.get(k) != v}, {k: v for k, v in got.items() if k not in bad}
    assert not extra and len(missing) <= 1, (missing, extra)


def test_repaired_text_and_empty_scans(spark):
    df, _ = scans(spark)
    text = {r.rec_id: r for r in ocr.repaired(ocr.examine(df)).collect()}
    assert "Paroles" not in text[25].text and not re.search(r"\d", text[55].text) and text[61].headword == "MWANA KE LOMBA MASA KUNA NZILA"
    assert text[500].headword is None and text[500].text == "" and "|" not in text[1].text
    assert ocr.damage(ocr.examine(df.limit(0))).count() == 0


LEARNT = ocr.Confusions({("rn", "m"): -2.0, ("c", "e"): -2.0, ("ii", "u"): -3.0, ("cl", "d"): -3.0, ("ri", "n"): -3.0})


def test_hash_differences_name_the_exchange():
    assert ocr.anagram_hash("listen") == ocr.anagram_hash("silent")
    for word, true in [("tbe", "the"), ("hand", "band"), ("hous", "house"), ("rnodern", "modern"), ("eleves", "élèves"), ("cliirable", "durable"), ("ivie", "me"), ("0", "o")]:
        met = set(ocr.reduced_hashes(word).tolist()) & set(ocr.reduced_hashes(true).tolist())
        assert met or ocr.skeleton(word, ocr.undone(LEARNT)) == ocr.skeleton(true, ocr.undone(LEARNT)), word
    assert ocr.exchange("tbe", "the") == ("b", "h", True) and ocr.exchange("hous", "house") == ("", "e", False)
    assert [at for at, _ in ocr.misreadings("rnodern", "modem", LEARNT)[0]] == [0, 5]
    assert ocr.misreadings("tbe", "the", LEARNT)[2] is False and ocr.misreadings("house", "mouse", LEARNT, False) is None
    assert ocr.misreadings("tree", "house", LEARNT) is None


def test_words_misread_in_many_places_share_a_skeleton():
    undone = ocr.undone(LEARNT)
    for word, true in [("rnodeles", "modèlès"), ("d" * 30 + "rn" * 10 + "c", "d" * 30 + "m" * 10 + "é"), ("clurablc", "durable")]:
        assert ocr.skeleton(word, undone) == ocr.skeleton(true, undone), word
    assert ocr.misreadings("rnodcrnc", "moderne", LEARNT)[2]
    assert ("a", "b") not in ocr.undone(ocr.Confusions({("a", "b"): -2.0, ("b", "a"): -1.0}))


def test_confusions_are_learnt_from_the_table(spark):
    rng = random.Random(4)
    words = [f"{a}h{b}" for a in ("mut", "kas", "lom", "ves") for b in ("ama", "elo", "iso", "una", "ide")]
    lines = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(400)]
    for i in range(0, 400, 20):
        w = words[(i // 20) % len(words)]
        lines[i] = lines[i].replace(w, w.replace("h", "b"), 1) if w in lines[i] else lines[i] + " " + w.replace("h", "b")
    df = spark.createDataFrame([(i, None, lines[10 * i : 10 * i + 10]) for i in range(40)], "rec_id long, kikongo string, body array<string>")
    got = {(r.rec_id, r.line_no) for r in ocr.damage(ocr.examine(df)).where("kind = 'char'").collect()}
    want = {(i // 10, i % 10) for i, x in enumerate(lines) if re.search(r"b(ama|elo|iso|una|ide)", x)}
    assert len(want) == 20 and got == want


def test_a_plain_misreading_that_nothing_else_shows(spark):
    body = ["the old man sees the river and the rain"] * 30
    df = spark.createDataFrame([(i, None, body) for i in range(6)] + [(9, None, ["xyzzy sees tbe river and thc rain"])], "rec_id long, kikongo string, body array<string>")
    found = ocr.examine(df)
    assert {r.rec_id: r.text for r in ocr.repaired(found).collect()}[9].startswith("xyzzy sees")
    df = spark.createDataFrame([(i, None, body) for i in range(60)] + [(9000, None, ["xyzzy sees tbe rivfr and the rain"])], "rec_id long, kikongo string, body array<string>")
    assert {r.rec_id: r.text for r in ocr.repaired(ocr.examine(df)).collect()}[9000] == "xyzzy sees the river and the rain"


def test_hyphens_stay_where_the_table_speaks_for_them(spark):
    rows = [(i, "NGANGA-NKISI KE MONA", ["un bien-aimé et un arc-en-ciel", "la rivière chante"]) for i in range(4)]
    rows += [(10, "NGANGA-NKISI KE MONA", ["le bien-", "aimé voit un arc-en-", "ciel et la rivi-", "ère"]), (11, "NGA- NGA KE MONA", ["la rivière"]), (12, "NGANGA KE MO-NA", ["x"]), (13, "NGANGA KE MONA", ["x"])]
    found = ocr.examine(spark.createDataFrame(rows, "rec_id long, kikongo string, body array<string>"))
    text = {r.rec_id: r for r in ocr.repaired(found).collect()}
    assert text[10].text == "le bien-aimé voit un arc-en-ciel et la rivière" and text[10].headword == "NGANGA-NKISI KE MONA"
    assert text[11].headword == text[12].headword == "NGANGA KE MONA"
    hyphens = {(r.rec_id, r.line_no) for r in ocr.damage(found).where("kind = 'hyphen'").collect()}
    assert hyphens == {(10, 0), (10, 1), (10, 2), (11, -1), (12, -1)}


def test_running_headers_and_their_misread_forms(spark):
    wide = "a line of the text that is as wide as all the other lines of it"
    heads = ["Words of the old road"] * 5 + ["Vv0rds of thc old road", "Something else entirely"]
    df = spark.createDataFrame([(i, None, [wide, h, wide]) for i, h in enumerate(heads)], "rec_id long, kikongo string, body array<string>")
    got = {r.rec_id for r in ocr.damage(ocr.examine(df)).where("kind = 'header'").collect()}
    assert got == {0, 1, 2, 3, 4, 5}


def test_two_lost_accents_are_mended(spark):
    body = ["les élèves chantent la pluie et les élèves portent la terre"] * 6 + ["les eleves chantent la pluie"]
    scans = spark.createDataFrame([(i, None, body[:6]) for i in range(3)] + [(9, None, body)], "rec_id long, kikongo string, body array<string>")
    found = ocr.examine(scans)
    assert (9, 6, "char") in {tuple(r) for r in ocr.damage(found).collect()}
    assert "eleves" not in {r.rec_id: r.text for r in ocr.repaired(found).collect()}[9]


TEXT = {
    "en": "the old man walks along the river while children of the village sing about the rain and their mothers carry water home".split(),
    "fr": "le vieil homme marche près de la rivière pendant que les enfants du village chantent la pluie et leurs mères portent de l'eau".split(),
    "kg": "nkuluntu ke tambula na nzila ya masa ntangu bana ya bwala ke yimbila mvula mpe bamama ke nata masa na nzo".split(),
}


def corpus(rng, lang, n):
    return [" ".join(rng.choice(TEXT[lang]) for _ in range(12)).capitalize() + "." for _ in range(n)]


def test_languages_of_rows_segments_and_lines(spark):
    rng = random.Random(8)
    lex = spark.createDataFrame([(k, w) for k, v in TEXT.items() for w in v] + [(None, "x"), ("en", None)], "lexicon string, form string")
    passages = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in enumerate((k, t) for k in TEXT for t in corpus(rng, k, 30))], "item_id int, lang string, text string, split string")
    rows = [(i, t, "kon_Latn") for i, t in enumerate(corpus(rng, "kg", 30))]
    rows += [(100, corpus(rng, "fr", 1)[0], "KG"), (101, corpus(rng, "kg", 1)[0] + " " + corpus(rng, "en", 1)[0], "kg"), (102, corpus(rng, "kg", 1)[0], " und"), (103, None, None), (104, "  ", None), (105, corpus(rng, "en", 1)[0] * 400, "eng"), (100, rows[0][1], "kg")]
    r = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "row_id long, trg string, trg_lang string, lang string, text string")
    body = [corpus(rng, "fr", 1)[0], "| " + corpus(rng, "fr", 1)[0], "~", None, corpus(rng, "en", 1)[0], "water."]
    s = spark.createDataFrame([(1, body), (2, None), (3, [])], "rec_id long, body array<string>")
    segs, lines = langid.segments_of_both(r, s, lex, passages)
    got = {(x.rec_id, x.seg_no): x.lang for x in langid.doubtful(segs).collect()}
    assert got == {(100, 0): "fr", (101, 0): "kg", (101, 1): "en", (102, 0): "kg"}
    assert {x.seg_no: x.lang for x in lines.collect()} == {0: "fr", 1: "fr", 4: "en", 5: "en"}
    assert all(0 < x.confidence <= 1 for x in segs.collect())
    doc = {x.rec_id: x for x in langid.document_languages(segs).collect()}
    assert doc[101].mixed and doc[105].lang == "en"
    assert langid.doubtful(langid.segments_of_both(r.limit(0), s.limit(0), lex, passages)[0]).count() == 0


def test_language_models_see_every_seed(spark):
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(5_600)]
    lex = spark.createDataFrame([("en", "house"), ("kg", " "), (None, "zzz")], "lexicon string, form string")
    passages = spark.createDataFrame([(i, lang, f"q{x}q", "x") for i, x in enumerate(names) for lang in ("eng", "fr" if i % 2 else None)], "item_id int, lang string, text string, split string")
    none = spark.createDataFrame([], "p string, fold int")
    for m in langid.fit(none, lex, passages):
        assert m.langs == ["en", "fr"]
        keys = langid._packed([f"q{x}q" for x in names] + ["house"], 5)[0][4::5]  # the last five letters of each
        assert (m.grams.find(langid._hashed(keys, 5)) >= 0).all()
    want = langid.count_grams({"en": [f" q{x}q " for x in names] + [" house "], "fr": [f" q{x}q " for x in names[1::2]]})
    got = langid.seed_counts(lex, passages)
    for lang, (keys, n) in want.items():
        assert dict(zip(*map(list, got[lang]))) == dict(zip(keys, n))


def test_language_models_see_every_segment(spark):
    rng = random.Random(12)
    lex = spark.createDataFrame([(k, w) for k, v in TEXT.items() for w in v], "lexicon string, form string")
    passages = spark.createDataFrame([], "item_id int, lang string, text string, split string")
    texts = [" ".join([f"nza{c}x{c}mba"] + corpus(rng, "kg", 1)) for c in "bcdfghjklm"]
    h = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    hot = min(texts, key=lambda t: h[t])
    r = spark.createDataFrame([(hot, "kg")] * 12_500 + [(t, "kg") for t in texts], "trg string, trg_lang string")
    segments = langid.row_texts(r).select("p", "fold").distinct()
    one, two = langid.fit(segments, lex, passages)
    for c in "bcdfghjklm":
        key = langid._hashed(langid._packed([f"za{c}x{c}"], 5)[0][-1:], 5)
        assert (one.grams.find(key)[0] >= 0) != (two.grams.find(key)[0] >= 0), c  # in the half that it belongs to, and only there


def test_kneser_ney_sums_to_one():
    m = langid.Models(langid.count_grams({"a": ["abab", "abba"], "b": ["bbbb"]}, 3), order=3)
    for context in ("", "a", "b", "ab", "ba", "zz"):
        # the letters seen, and one that stands for all others
        total = sum(np.exp(-(m.score([context + c])[0] * (len(context) + 1) - (m.score([context])[0] * len(context) if context else 0))) for c in "abz")
        assert total == pytest.approx([1.0, 1.0], abs=1e-5), context


def test_kneser_ney_against_the_definition():
    from collections import Counter

    texts, order, d = ["banana band", "bandana an"], 3, 0.75
    counts = {order: Counter(("\x02" * (order - 1) + t)[i : i + order] for t in texts for i in range(len(t)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        own = {x: c for x, c in counts[len(g)].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        t = sum(own.values())
        return max(own.get(g, 0) - d, 0) / t + d * len(own) / t * p(g[1:])

    m = langid.Models(langid.count_grams({"x": texts}, order), order)
    for t in ("banana", "nab", "xyz", "d an"):
        s = "\x02" * (order - 1) + t
        assert m.score([t])[0, 0] == pytest.approx(-sum(np.log(p(s[i : i + order])) for i in range(len(t))) / len(t), rel=1e-4)


def test_hash_lookup_equals_a_search():
    rng = np.random.default_rng(3)
    table = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    asked = np.concatenate([table[::7], rng.integers(0, 1 << 63, 1000, dtype=np.uint64), table[:1], table[-1:]])
    where = {int(x): i for i, x in enumerate(table)}
    assert langid.Hashes(table).find(asked).tolist() == [where.get(int(x), -1) for x in asked] and langid.Hashes(table[:0]).find(asked).max() == -1


def test_rejection_of_what_is_no_known_language(spark):
    rng = random.Random(1)
    lex = spark.createDataFrame([(k, w) for k, v in TEXT.items() for w in v], "lexicon string, form string")
    passages = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in enumerate((k, t) for k in TEXT for t in corpus(rng, k, 60))], "item_id int, lang string, text string, split string")
    odd = ["мама мыла раму и пела песню", "12 34", "qx zvq xxk", "жук"]
    rows = [(i, t, None) for i, t in enumerate(t for k in TEXT for t in corpus(rng, k, 60))] + [(1000 + i, t, None) for i, t in enumerate(odd)] + [(2000, "la rivière", None), (2001, "the", None)]
    segs, _ = langid.segments_of_both(spark.createDataFrame(rows, "row_id long, trg string, trg_lang string"), spark.createDataFrame([], "rec_id long, body array<string>"), lex, passages)
    got = {x.rec_id: x for x in segs.collect()}
    assert [got[1000 + i].lang for i in range(4)] == ["und"] * 4 and got[1001].confidence == 0.0
    assert got[2000].lang == "fr" and got[2001].lang == "en" and sum(x.lang == "und" for x in got.values()) <= 6


DOCS = "doc_id long, text string, lang string, source string, n_chars long, uses string, tokens string"


def test_mixture_hits_shares_and_caps(spark):
    rng = random.Random(3)
    names = ["A b", "a_B ", "big", "small", None, "other"]
    rows = [(i, " ".join("word" for _ in range(rng.randrange(1, 60))) if i % 50 else rng.choice([None, ""]), rng.choice(["en", "EN", None, "fra"]), names[0 if i % 2 else 1] if i % 3 else rng.choice(names[2:]), 1, "c", "c") for i in range(1500)]
    goal = spark.createDataFrame([("a_b", 0.5, 1), ("big", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    out = mixture.mixed_documents(spark.createDataFrame(rows, DOCS), goal)
    got = out.collect()
    assert len(got) == 1500 and all(r.uses == 0 for r in got if r.source in (None, "other") or r.tokens == 0)
    assert max(r.uses for r in got if r.source == "a_b") <= 1 and max(r.uses for r in got if r.source == "small") <= 4
    share = {r.source: r for r in mixture.mix_shares(out, goal).collect()}
    assert abs(share["a_b"].reached_share - 0.5 / 0.95) < 0.01 and abs(share["small"].reached_share - 0.15 / 0.95) < 0.01 and share["absent"].used_tokens == 0
    assert sorted(map(tuple, (r[:2] for r in got)), key=str) == sorted(map(tuple, (r[:2] for r in mixture.mixed_documents(spark.createDataFrame(rows, DOCS), goal).collect())), key=str)
    assert mixture.mixed_documents(spark.createDataFrame([], DOCS), goal).count() == 0


def test_budgets_go_to_siblings_before_ancestors():
    leaves = [("a", "en", 100), ("a", "fr", 10), ("b", "en", 1000)]
    b = mixture.plan_budgets(leaves, {"a": (0.5, 1), "b": (0.5, 1)}, 200)
    assert b["a", "en"] + b["a", "fr"] == pytest.approx(100) and b["b", "en"] == pytest.approx(100)
    b = mixture.plan_budgets(leaves, {"a": (0.5, 1), "b": (0.5, 1)}, 400)
    assert b["a", "en"] == 100 and b["a", "fr"] == 10 and b["b", "en"] == pytest.approx(290)
    b = mixture.plan_budgets(leaves, {"a": (0.5, 1), "b": (0.5, 1)})
    assert sum(b.values()) == pytest.approx(220)


def test_a_plan_of_three_levels_by_hand():
    leaves = [("a", "en", 40), ("a", "fr", 60), ("b", "en", 1000), ("c", "fr", 100), ("d", "en", 1000)]
    targets, domains = {"a": (0.4, 1), "b": (0.1, 1), "c": (0.1, 1), "d": (0.4, 1)}, {"a": "x", "b": "x", "c": "x"}
    # 500 tokens: domain x 300 and d 200; in x, en weighs 0.26 (a 0.16, b 0.1) and fr 0.34 (a 0.24, c 0.1): 130 and 170
    # en: a has 40 of its 80, b takes 50 + 40; fr: a has 60 of its 120, c takes 50 + 50, and 10 are left for en of x, where b takes them
    b = mixture.plan_budgets(leaves, targets, 500, domains)
    assert {k: round(v, 6) for k, v in b.items()} == {("a", "en"): 40, ("b", "en"): 100, ("a", "fr"): 60, ("c", "fr"): 100, ("d", "en"): 200}
    # 2,400 tokens: x can give 1,200 of its 1,440, so d would have 960 + 240 but holds 1,000 only
    b = mixture.plan_budgets(leaves, targets, 2400, domains)
    assert sum(b.values()) == pytest.approx(2200) and b["d", "en"] == pytest.approx(1000)


def test_a_total_that_leaves_short(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(1, 60))), rng.choice(["en", "fr"]), s, 1, "c", "c") for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 30)]
    docs = spark.createDataFrame(rows + rows[:5], DOCS)  # repeated ids keep their rows
    goal = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.4, 3)], "source string, target_share double, max_repeats int")
    out = mixture.mixed_documents(docs, goal, domains={"mid": "x", "small": "x"}, once=True)
    assert out.count() == len(rows) + 5
    got = {r.source: r for r in mixture.mix_shares(out, goal).collect()}
    total = sum(r.available_tokens for r in got.values())
    assert got["small"].most_uses == 3 and got["small"].used_tokens == 3 * got["small"].available_tokens
    # the domain's other source takes what the small one lacks, as far as it can, before the other domain does
    assert got["mid"].used_tokens == pytest.approx(min(2 * got["mid"].available_tokens, 0.7 * total - got["small"].used_tokens), rel=0.02)
    assert sum(r.used_tokens for r in got.values()) == pytest.approx(total, rel=0.02)


def test_token_counts_are_exact():
    import base64

    import regex
    import tiktoken

    with open(mixture.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=mixture.PIECES_FULL, mergeable_ranks=ranks, special_tokens={})
    n = mixture.count_tokens()
    for t in ["Hello, world! it's  2 spaces\n\n", "À l’école ² ½ x_y नमस्ते", "a" * 5000, " ", "\t\tx"]:
        assert n(t) == len(enc.encode_ordinary(t))
    assert regex


def test_subjects_from_topics(spark):
    rng = random.Random(2)
    subj = {"law": "judge court verdict prison lawyer appeal statute witness".split(), "music": "drum song choir rhythm melody trumpet verse singer".split(), "sport": "goal match team coach medal runner league trophy".split()}
    common = "house road friend river mother stone bird village tree cloud hand fire".split()
    docs, truth, labels = [], set(), []
    for i in range(600):
        mine = rng.sample(sorted(subj), rng.choice([0, 1, 1, 2]))
        ws = [rng.choice(common) for _ in range(60)] + [rng.choice(subj[s]) for s in mine for _ in range(20)]
        if rng.random() < 0.3:
            ws += [rng.choice(subj[rng.choice(sorted(subj))])]
        rng.shuffle(ws)
        docs.append((i, " ".join(ws), "x"))
        truth |= {(i, s) for s in mine}
        if i % 3 == 0:
            labels += [(i, rng.choice([s.upper(), f" {s}"]), "ann") for s in mine]
    docs += [(900, None, "x"), (901, "", "x"), (902, "...", "x"), (903, docs[1][1], "x")]
    truth |= {(903, s) for i, s in truth if i == 1}
    labels += [(5, None, "a"), (None, "law", "a"), (99999, "law", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    got = {tuple(r) for r in subjects.document_subjects(d, lab).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    make = {r.subject: r.n_docs for r in subjects.composition(spark.createDataFrame(sorted(got), "doc_id long, subject string"), d).collect()}
    assert make["none"] == 604 - len({i for i, _ in got})
    assert subjects.document_subjects(d, lab.limit(0)).count() == 0 and subjects.document_subjects(d.limit(0), lab).count() == 0
    top = subjects.topic_terms(d, lab)
    assert {r.subject for r in top.where(F.col("subject").isNotNull()).select("subject").distinct().collect()} == set(subj)


def test_a_rare_subject_keeps_its_terms(spark, monkeypatch):
    monkeypatch.setattr(subjects, "RARE", 20)
    rng = random.Random(3)
    subj = {"law": "judge court verdict prison lawyer appeal statute witness".split(), "music": "drum song choir rhythm melody trumpet verse singer".split(), "sport": "goal match team coach medal runner league trophy".split(), "chess": "pawn bishop knight rook castling gambit endgame checkmate".split()}
    common = "house road friend river mother stone bird village tree cloud hand fire".split()
    docs, truth, labels = [], set(), []
    for i in range(1000):
        mine = ["chess"] if i % 33 == 0 else [["law"], ["music"], ["sport"], []][i % 4]
        docs.append((i, " ".join([rng.choice(common) for _ in range(60)] + [rng.choice(subj[s]) for s in mine for _ in range(20)])))
        truth |= {(i, s) for s in mine}
        if i % 3 == 0:
            labels += [(i, s, "ann") for s in mine]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    got = {tuple(r) for r in subjects.document_subjects(d, lab).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    assert sum(s == "chess" for _, s in got & truth) >= 29


def test_empty_tables_give_defined_results(spark):
    rows = spark.createDataFrame([(1, "mwana ke lomba. Masa?", "kg"), (2, None, None)], "row_id long, trg string, trg_lang string")
    scans_ = spark.createDataFrame([(7, ["un deux", None, "12"])], "rec_id long, body array<string>")
    lex, passages = spark.createDataFrame([], "lexicon string, form string"), spark.createDataFrame([], "item_id int, lang string, text string")
    segs, lines = langid.segments_of_both(rows, scans_, lex, passages)
    assert {(r.rec_id, r.seg_no, r.lang) for r in segs.collect()} == {(1, 0, "und"), (1, 1, "und")} and {(r.rec_id, r.seg_no, r.lang) for r in lines.collect()} == {(7, 0, "und")}
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "", "")], DOCS)
    no_goal = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert [r.uses for r in mixture.mixed_documents(docs, no_goal, once=True).collect()] == [0] and mixture.mix_shares(mixture.mixed_documents(docs, no_goal), no_goal).count() == 0
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.document_subjects(docs, labels).count() == 0 and subjects.document_subjects(docs.limit(0), labels).count() == 0
    assert subjects.topic_terms(docs.limit(0), labels).count() == 0 and subjects.composition(subjects.document_subjects(docs, labels), docs).count() == 1


def test_subject_ids_of_any_type(spark):
    words = {"law": "judge court verdict prison lawyer appeal", "music": "drum song choir rhythm melody trumpet"}
    docs = spark.createDataFrame([(f"d{i}", " ".join([words[s]] * 3 + ["w" * 60])) for i in range(80) for s in [("law", "music")[i % 2]]], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", ("law", "music")[i % 2]) for i in range(40)], "doc_id string, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(docs, labels).collect()}
    assert len(got & {(f"d{i}", ("law", "music")[i % 2]) for i in range(80)}) >= 76
