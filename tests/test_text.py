import re
import unicodedata

from pyspark.sql import functions as F

from loomtext.functions import text


def test_strip_equals_python_strip_on_every_white_space(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    rows = [(i, s + "x" + s) for i, s in enumerate(spaces)]
    got = spark.createDataFrame(rows, "i int, s string").select(text.strip("s").alias("s")).distinct().collect()
    assert [r.s for r in got] == ["x"]


def test_tokens_are_lower_cased_words_digits_and_underscores(spark):
    s = "Élé_phant 12, l’amí -- NZAMBI²"
    got = spark.createDataFrame([(s,)], "s string").select(text.tokens("s").alias("t")).first().t
    assert got == [x for x in re.findall(r"[^\W]+", s.lower()) for x in re.findall(r"\w+", x)]


def test_normalize_fold_and_keys(spark):
    df = spark.createDataFrame([("  Straße ﬁ ２  ", "ka-Lúmba'x"), (None, None)], "a string, b string")
    got = df.select(text.normalize_text("a").alias("n"), text.fold("b").alias("f"), text.align_key("b").alias("k")).collect()
    assert (got[0].n, got[0].f, got[0].k) == ("strasse fi 2", "kalumbax", "kalumbax")
    assert got[1].n is None and got[1].f is None


def test_marker_boundaries(spark):
    rows = ["ke", "éke", "ke_", "a ke b", "KE.", "²ke"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select(F.col("s").rlike(text.marker_pattern(["ke"])).alias("m")).collect()
    assert [r.m for r in got] == [bool(re.search(r"\bke\b", r, re.I)) for r in rows]


def test_clean_id_and_lines(spark):
    df = spark.createDataFrame([(" A ", "a\r\nb\x0bc\n"), ("", "x"), (None, None)], "i string, t string")
    got = df.select(text.clean_id("i").alias("i"), text.split_lines("t").alias("l")).collect()
    assert [r.i for r in got] == ["a", None, None]
    assert got[0].l == "a\r\nb\x0bc\n".splitlines()


def test_tidy(spark):
    df = spark.createDataFrame([("| .  a   b ,c",), ("« x",)], "s string")
    assert [r[0] for r in df.select(text.tidy("s")).collect()] == ["a b,c", "« x"]


def test_normalize_matches_unicodedata():
    assert text.normalize("ǅ") == unicodedata.normalize("NFKC", "ǅ").casefold()
