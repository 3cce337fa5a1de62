from pyspark.sql import functions as F

from loomtext.functions.text import align_key
from loomtext.operators import audit, extract


def pages(spark, *texts, book="b"):
    return spark.createDataFrame([(book, i + 1, t) for i, t in enumerate(texts)], "book string, page int, text string")


def entries(spark, *texts):
    lines = extract.dehyphenate(extract.clean_lines(pages(spark, *texts)))
    return [r.asDict() for r in extract.merge_bodyless(extract.split_entries(lines)).orderBy("entry").collect()]


def test_lines_lose_bars_marks_and_page_numbers(spark):
    got = extract.clean_lines(pages(spark, "| first\n~ ~\n\n 31 \n] second")).orderBy("no").collect()
    assert [r.line for r in got] == ["first", "second"]


def test_dehyphenation_joins_small_letters_only(spark):
    got = extract.dehyphenate(extract.clean_lines(pages(spark, "confli-\ntos na al-\ndeia\nBem-\nVindo"))).orderBy("no").collect()
    assert [r.line for r in got] == ["conflitos na aldeia", "Bem-", "Vindo"]


def test_headword_lines(spark):
    df = spark.createDataFrame([("NGANGA KE MONA VE.",), ("ABC",), ("Ordinary text line here",)], "line string")
    assert [r[0] for r in df.select(extract.is_headword("line")).collect()] == [True, False, False]


def test_cut_headword(spark):
    df = spark.createDataFrame([("MWANA KE LOMBA | o filho pede sempre",), ("MWANA KE LOMBA",)], "line string")
    got = [tuple(r.c) for r in df.select(extract.cut_headword("line").alias("c")).collect()]
    assert got == [("MWANA KE LOMBA", "o filho pede sempre"), ("MWANA KE LOMBA", "")]


def test_wrapped_headword_and_page_break(spark):
    got = entries(spark, "NGANGA KE MONA KIMA\nKYA NENE VE.\nO curandeiro não vê.", "segue aqui.\nMWANA KE LOMBA MASA.\nA child asks.")
    assert [(e["kikongo"], e["page"], e["body"]) for e in got] == [("NGANGA KE MONA KIMA KYA NENE VE.", 1, ["O curandeiro não vê.", "segue aqui."]), ("MWANA KE LOMBA MASA.", 2, ["A child asks."])]


def test_variant_line_belongs_to_the_entry_before(spark):
    got = entries(spark, "NGANGA KE MONA VE.\nYOVO: NGANGA KA MONA KO.\nBody line one.")
    assert len(got) == 1 and got[0]["variant"] == "NGANGA KA MONA KO." and got[0]["body"] == ["Body line one."]


def test_bodyless_entries_flow_into_the_next(spark):
    got = entries(spark, "NGANGA KE MONA VE.\nMWANA KE LOMBA MASA.", "BAKENTO KE KWENDA.\nThe women go.\nDYAMBU DYA NSUKA YAYI.")
    assert [(e["kikongo"], e["page"]) for e in got] == [("NGANGA KE MONA VE. MWANA KE LOMBA MASA. BAKENTO KE KWENDA.", 1), ("DYAMBU DYA NSUKA YAYI.", 2)]


def test_segments_translation_and_record(spark):
    words = [("pt", w) for w in "o filho da casa não pede nada ao pai".split()] + [("fr", w) for w in "le fils de la maison ne demande rien au père".split()] + [("en", w) for w in "the son of the house asks nothing of his father".split()]
    model = audit.unigram_model(spark.createDataFrame(words, "lang string, token string"))
    e = spark.createDataFrame([("b", 0, "MWANA KE LOMBA ", "", 33, ["o filho da casa", "não pede nada.", "ao pai", "le fils ne demande rien.", "the son asks nothing."]), ("b", 1, "X", "", 34, [])], "book string, entry int, kikongo string, variant string, page int, body array<string>")
    got = {r.entry: r for r in extract.records(e, model).collect()}
    assert (got[0].pt, got[0].pt_explanation, got[0].fr, got[0].en, got[0].page) == ("o filho da casa não pede nada.", "ao pai", "le fils ne demande rien.", "the son asks nothing.", 31)
    assert got[0].kikongo == "MWANA KE LOMBA." and got[1].pt == "" and got[1].kikongo_variant == ""


def rec(spark, rows):
    return spark.createDataFrame(rows, "ordinal int, kikongo string, pt string")


def test_alignment_first_with_first_then_close(spark):
    a = rec(spark, [(1, "MWANA KE LOMBA MENGI.", "a1"), (2, "MWANA KE LOMBA MENGI.", "a2"), (3, "BAKENTO KE KWENDA NA NZO YANDI.", "a3"), (4, "OTHER THING", "a4")])
    b = rec(spark, [(1, "Mwana ke lomba mengi", "b1"), (2, "MWANA KE LOMBA MENGI", "b2"), (3, "BAKENTO KE KWENDA NA NZO YANDL.", "b3")])
    exact = {r.ordinal: (r.pt, r.matched) for r in extract.align_exact(a, b, ["pt"]).collect()}
    assert exact == {1: ("b1", True), 2: ("b2", True), 3: ("a3", False), 4: ("a4", False)}
    fuzzy = {r.ordinal: (r.pt, r.matched) for r in extract.align_fuzzy(a, b, ["pt"]).collect()}
    assert fuzzy == {1: ("b1", True), 2: ("b2", True), 3: ("b3", True), 4: ("a4", False)}


def test_fixed_width_columns_and_carried_heading(spark):
    head = "Francais    English     Lingala     Kikongo"
    body = "maison      house       ndako       nzo ya\nmaison      house       ndako       nzo ya"
    got = {(r.lang, r.form): r.n for r in extract.fixed_width_words(pages(spark, "early lines lines", f"{head}\n{body}", "chien       dog         mbwa        mbwa mbwa"), least=1).collect()}
    assert got["Kikongo", "nzo"] == 2 and got["English", "house"] == 2 and got["Kikongo", "mbwa"] == 2 and ("English", "lines") not in got


def test_headword_harvest(spark):
    lines = spark.createDataFrame([(x,) for x in ["ka-lumba, n. fille", "kalúmba, jeune fille", "fille, x", "la fille, une fille, fille", "cajole, y", "no comma"]], "line string")
    counts = {r["form"]: (r["head"], r["def"]) for r in extract.headword_counts(lines).collect()}
    assert counts["kalumba"] == (2, 0) and counts["fille"] == (1, 4)
    french = spark.createDataFrame([("jeune",)], "form string")
    assert [r["form"] for r in extract.harvest_headwords(lines, french).collect()] == ["kalumba"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "book string, page int, text string")
    assert extract.merge_bodyless(extract.split_entries(extract.dehyphenate(extract.clean_lines(none)))).count() == 0
    assert extract.fixed_width_words(none).count() == 0
    assert spark.createDataFrame([], "line string").select(F.count("*")).first()[0] == 0


def test_blocks_equal_brute_force():
    import random

    r = random.Random(3)
    logp = {lang: {w: -r.uniform(2, 9) for w in "abcdefgh" if r.random() < 0.7} for lang in extract.LANGS}
    for _ in range(200):
        body = [" ".join(r.choice("abcdefghxyz") for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 8))]
        score = lambda lang, part: sum(logp[lang].get(w, extract.UNKNOWN_LOGP) for x in part for w in x.split())
        n = len(body)
        tries = [(round(score("pt", body[:i]) + score("fr", body[i:j]) + score("en", body[j:]) - score("en", body) - extract.EMPTY_BLOCK * ((i == 0) + (i == j) + (j == n)), 5), -i, -j) for i in range(n + 1) for j in range(i, n + 1)]
        _, i, j = max(tries)
        assert extract._blocks(body, logp) == (-i, -j)


def test_a_headword_s_small_words_go_to_the_translation(spark):
    lines = ["MWANA E o filho pede", "MWANA KE | E «o filho pede", "o filho pede", "A b c D e f g", ""]
    got = [tuple(r.c) for r in spark.createDataFrame([(x,) for x in lines], "line string").select(extract.cut_headword("line").alias("c")).collect()]
    assert got == [("MWANA", "E o filho pede"), ("MWANA KE", "E «o filho pede"), ("", "o filho pede"), ("", "A b c D e f g"), ("", "")]


def test_long_books_are_cut_alike_in_ranges(spark):
    text = "NGANGA KE MONA KIMA\nKYA NENE VE.\nO curandeiro não vê.\nYOVO: NGANGA KA MONA KO.\nsegue aqui."
    many = spark.createDataFrame([("b", i, text) for i in range(300)], "book string, page int, text string")
    got = extract.merge_bodyless(extract.split_entries(extract.dehyphenate(extract.clean_lines(many)))).orderBy("entry").collect()
    assert len(got) == 300 and {(r.kikongo, r.variant, tuple(r.body)) for r in got} == {("NGANGA KE MONA KIMA KYA NENE VE.", "NGANGA KA MONA KO.", ("O curandeiro não vê.", "segue aqui."))}
    assert [r.page for r in got] == list(range(300))


def test_close_matching_equals_going_through_the_rows(spark):
    import difflib
    import random
    from collections import defaultdict, deque

    r = random.Random(5)
    base = ["".join(r.choice("abdegklmn") for _ in range(r.randint(3, 30))) for _ in range(30)]

    def spoiled(x):
        x = list(x)
        for _ in range(r.randint(0, max(1, len(x) // 8))):
            x[r.randrange(len(x))] = r.choice("abdegklmn")
        return "".join(x)

    a = [(i, spoiled(r.choice(base)), f"a{i}") for i in range(120)]
    b = [(1000 + i, spoiled(r.choice(base)), f"b{i}") for i in range(90)]
    got = {x.ordinal: x.pt for x in extract.align_fuzzy(spark.createDataFrame(a, "ordinal int, kikongo string, pt string"), spark.createDataFrame(b, "ordinal int, kikongo string, pt string"), ["pt"]).collect()}
    waiting = defaultdict(deque)
    for _, k, v in b:
        waiting[k].append(v)
    want, rest = {}, []
    for o, k, v in a:
        if waiting[k]:
            want[o] = waiting[k].popleft()
        else:
            rest.append((o, k, v))
    for o, k, v in rest:
        best = difflib.get_close_matches(k, sorted(x for x in waiting if waiting[x]), n=1, cutoff=0.9)
        want[o] = waiting[best[0]].popleft() if best else v
    assert got == want and sum(v.startswith("b") for v in got.values()) > 40


def test_close_keys_equal_trying_every_pair(monkeypatch):
    import difflib
    import random

    import pyarrow as pa

    r = random.Random(7)
    base = ["".join(r.choice("abdegklmn") for _ in range(r.choice([1, 2, 5, 10, 30, 80, 250]))) for _ in range(30)]

    def spoiled(x):
        for _ in range(r.randint(0, max(1, len(x) // 8))):
            p, how = r.randrange(len(x) + 1), r.randrange(3)
            x = x[:p] + r.choice("abdegklmn") * (how < 2) + x[p + (how > 0) :]
        return x or "a"

    a, b = (sorted({spoiled(r.choice(base)) for _ in range(150)}) for _ in range(2))
    want = {(x, y, q) for x in a for y in b for q in [difflib.SequenceMatcher(None, y, x).ratio()] if q >= 0.9}
    assert len(want) > 50
    for tile, cells in ((extract.TILE, extract.CELLS), (7, extract.CELLS), (64, 500)):
        monkeypatch.setattr(extract, "TILE", tile)
        monkeypatch.setattr(extract, "CELLS", cells)
        got = extract._close(0.9)(pa.table({"key": a}), pa.table({"other": b})).to_pylist()
        assert len(got) == len(want) and {(x["key"], x["other"], x["ratio"]) for x in got} == want
        assert extract._close(0.9)(pa.table({"key": a}), pa.table({"other": pa.array([], pa.string())})).num_rows == 0


def test_close_matching_broadcasts_nothing(spark, monkeypatch):
    # files so small that the planner would broadcast them, and all that is exploded from them
    a = rec(spark, [(i, f"MWANA KE LOMBA MENGI {x}{x}", f"a{i}") for i, x in enumerate("ABCD")])
    b = rec(spark, [(i, f"MWANA KE LOMBA MENGI {x}", f"b{i}") for i, x in enumerate("HIJK")])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keys = [extract.materialize(x.select(align_key(F.col("kikongo")).alias("key"))) for x in (a, b)]
    assert "Broadcast" not in plan(extract.close_keys(*keys, 0.9))
    want = {(f"mwanakelombamengi{x}{x}", f"mwanakelombamengi{y}") for x in "abcd" for y in "hijk"}
    assert {(r.key, r.other) for r in extract.close_keys(*keys, 0.9).collect()} == want
    monkeypatch.setattr(extract, "BLOCK", 1)
    monkeypatch.setattr(extract, "BLOCKS", 3)
    assert {(r.key, r.other) for r in extract.close_keys(*keys, 0.9).collect()} == want
    monkeypatch.setattr(extract, "ROUNDS", 2)
    got = extract.align_fuzzy(a, b, ["pt"])
    # equal ratios: the larger headword first, and each row waits for those before it
    assert "Broadcast" not in plan(got) and {r.ordinal: r.pt for r in got.collect()} == {i: f"b{3 - i}" for i in range(4)}
