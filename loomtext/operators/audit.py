"""Which language is a corpus in? Marker rates, overlaps, lexicon coverage and its stability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import marker_pattern, strip, tokens

MIN_FORM = 3
MAX_LANGS = 1_000
# fixed values: marker words by group
MARKERS = {
    "kituba_tam": ["ke", "ta", "me", "vandaka", "salaka"],
    "kituba_lex": ["munu", "nge", "beto", "sambu", "mutindu"],
    "kikongo_lex": ["mono", "ngeye", "yeto", "kadi", "mpila"],
    "religious": ["Yezu", "Yehowa", "Nzambi", "Biblia", "Kristu", "mpeve"],
}

# fixed values: function words for a language model where no text is at hand
FALLBACK_MARKERS = {
    "pt": ["não", "são", "está", "é", "este", "esta", "provérbio", "dos", "das", "um", "uma", "ao", "pelo", "para", "com", "porque", "também", "muito", "quem", "mas", "seu", "sua", "ou", "mais", "todos", "quando", "sobre"],
    "fr": ["les", "des", "une", "dans", "est", "ce", "cette", "proverbe", "qui", "pour", "sur", "ne", "pas", "plus", "avec", "ses", "elle", "nous", "vous", "tout", "quand", "comme", "mais", "aussi", "leur", "sont"],
    "en": ["the", "of", "and", "to", "is", "that", "who", "this", "saying", "when", "in", "for", "with", "his", "her", "they", "not", "are", "be", "will", "as", "by", "from", "one", "said", "which", "there"],
}


def ratio(hits: Column, total: Column) -> Column:
    """hits / total, 0 for an empty total."""
    return F.when(total > 0, hits / total).otherwise(0.0)


def marker_rates(df: DataFrame, by: list[str], text: str, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """``*by, marker, hits, n, rate``: texts with at least one marker of each group, in one pass over the texts."""
    markers = markers or MARKERS
    hits = [F.count_if(F.col(text).rlike(marker_pattern(words))).alias(name) for name, words in markers.items()]
    wide = df.groupBy(*by).agg(F.count("*").alias("n"), *hits)
    long = wide.select(*by, "n", F.explode(F.create_map(*[x for m in markers for x in (F.lit(m), F.col(m))])).alias("marker", "hits"))
    return long.select(*by, "marker", "hits", "n", ratio(F.col("hits"), F.col("n")).alias("rate"))


def pairs_within(items: str, a: str = "a", b: str = "b") -> Column:
    """Every two elements of a sorted array of different values, as structs, the smaller first."""
    return F.expr(f"flatten(transform({items}, (x, i) -> transform(slice({items}, i + 2, size({items})), y -> struct(x as {a}, y as {b}))))")


def overlaps(df: DataFrame, corpus: str, text: str) -> DataFrame:
    """``a, b, shared, jaccard`` of every two corpora's distinct trimmed texts.

    A row for each text with the set of corpora that hold it is enough: pairs of
    corpora come from that set, which is as small as the number of corpora.
    """
    flat = df.select(F.col(corpus).alias("c"), strip(text).alias("t")).where("c is not null and t is not null").distinct()
    sizes = flat.groupBy("c").agg(F.count("*").alias("n"))
    sets = flat.groupBy("t").agg(F.sort_array(F.collect_set("c")).alias("cs")).where(F.size("cs") > 1)
    pairs = sets.select(F.explode(pairs_within("cs")).alias("p"))
    shared = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    ranked = sizes.agg(F.sort_array(F.collect_list(F.struct("c", "n"))).alias("cs"))
    grid = ranked.select(F.explode(pairs_within("cs")).alias("p")).select(F.col("p.a.c").alias("a"), F.col("p.b.c").alias("b"), F.col("p.a.n").alias("na"), F.col("p.b.n").alias("nb"))
    both = F.coalesce("shared", F.lit(0))
    return grid.join(shared, ["a", "b"], "left").select("a", "b", both.alias("shared"), ratio(both, F.col("na") + F.col("nb") - both).alias("jaccard"))


def lexicon_forms(lexicons: DataFrame) -> DataFrame:
    """``lexicon, form``: distinct lower-cased word forms of at least three characters; an entry of several words gives each of them."""
    return lexicons.select("lexicon", F.explode(tokens("form")).alias("form")).where(F.length("form") >= MIN_FORM).distinct()


def corpus_vocab(df: DataFrame, corpus: str, text: str) -> DataFrame:
    """``corpus, form``: distinct word forms of at least three characters of each corpus."""
    return df.select(F.col(corpus).alias("corpus"), F.explode(F.array_distinct(tokens(text))).alias("form")).where(F.length("form") >= MIN_FORM).distinct()


def raw_coverage(vocab: DataFrame, forms: DataFrame) -> DataFrame:
    """``corpus, lexicon, n_forms, hits, coverage`` for the whole grid, so that a lexicon without hits shows."""
    grid = vocab.select("corpus").distinct().crossJoin(F.broadcast(forms.groupBy("lexicon").agg(F.count("*").alias("n_forms"))))
    hits = vocab.join(forms, "form").groupBy("corpus", "lexicon").agg(F.count("*").alias("hits"))
    h = F.coalesce("hits", F.lit(0))
    return grid.join(hits, ["corpus", "lexicon"], "left").select("corpus", "lexicon", "n_forms", h.alias("hits"), ratio(h, F.col("n_forms")).alias("coverage"))


def discriminative_coverage(vocab: DataFrame, forms: DataFrame, min_forms: int = 20) -> DataFrame:
    """``corpus, a, b, only_a, only_b, cov_a, cov_b, leans, margin`` of every two lexicons, over the forms that only one of them has.

    A pair with fewer than ``min_forms`` forms on either side is left out; a tie leans to ``b``.
    """
    pairs = forms.agg(F.sort_array(F.collect_set("lexicon")).alias("ls")).select(F.explode(pairs_within("ls")).alias("p")).select("p.*")
    sides = pairs.withColumn("lexicon", F.explode(F.array("a", "b")))
    sided = F.broadcast(sides).join(forms, "lexicon").groupBy("a", "b", "form").agg(F.min("lexicon").alias("x"), F.count("*").alias("k"))
    own = sided.where("k = 1").withColumn("side_a", F.col("x") == F.col("a"))
    sizes = own.groupBy("a", "b").agg(F.count_if("side_a").alias("only_a"), F.count_if(~F.col("side_a")).alias("only_b")).where((F.col("only_a") >= min_forms) & (F.col("only_b") >= min_forms))
    hits = own.join(vocab, "form").groupBy("corpus", "a", "b").agg(F.count_if("side_a").alias("ha"), F.count_if(~F.col("side_a")).alias("hb"))
    grid = vocab.select("corpus").distinct().crossJoin(F.broadcast(sizes)).join(hits, ["corpus", "a", "b"], "left")
    ca, cb = ratio(F.coalesce("ha", F.lit(0)), F.col("only_a")), ratio(F.coalesce("hb", F.lit(0)), F.col("only_b"))
    out = grid.select("corpus", "a", "b", "only_a", "only_b", ca.alias("cov_a"), cb.alias("cov_b"))
    return out.withColumn("leans", F.when(F.col("cov_a") > F.col("cov_b"), F.col("a")).otherwise(F.col("b"))).withColumn("margin", F.abs(F.col("cov_a") - F.col("cov_b")))


def bootstrap_identity(vocab: DataFrame, forms: DataFrame, n_boot: int = 1000, seed: int = 13) -> DataFrame:
    """``corpus, winner, win_rate, margin_mean, margin_low, margin_high, n_boot``: how stable the best lexicon is under resampling of the lexicons' forms.

    Draws from a lexicon are independent, so the hits of a replicate are
    binomial in the lexicon's size and coverage: the same distribution as
    drawing forms one by one, without a row for each draw. Fewer than two
    lexicons give no row.
    """
    cells = raw_coverage(vocab, forms).where("n_forms > 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame(columns=["corpus", "winner", "win_rate", "margin_mean", "margin_low", "margin_high", "n_boot"])
        pdf = pdf.sort_values("lexicon")
        rng = np.random.default_rng([seed, *pdf.corpus.iloc[0].encode()])
        cov = np.stack([rng.binomial(n, h / n, n_boot) / n for n, h in zip(pdf.n_forms, pdf.hits)])
        top = np.sort(cov, axis=0)[::-1]
        margins = np.sort(top[0] - top[1])
        wins = np.bincount(cov.argmax(axis=0), minlength=len(pdf))
        best = int(wins.argmax())
        return pd.DataFrame([(pdf.corpus.iloc[0], pdf.lexicon.iloc[best], wins[best] / n_boot, margins.mean(), margins[int(0.025 * n_boot)], margins[int(0.975 * n_boot)], n_boot)], columns=["corpus", "winner", "win_rate", "margin_mean", "margin_low", "margin_high", "n_boot"])

    return cells.groupBy("corpus").applyInPandas(run, "corpus string, winner string, win_rate double, margin_mean double, margin_low double, margin_high double, n_boot long")


def unigram_model(words: DataFrame) -> DataFrame:
    """``lang, token, count, logp``: add-one smoothed log-probabilities of ``words(lang, token)``."""
    n = words.groupBy("lang", "token").agg(F.count("*").alias("count"))
    w = Window.partitionBy("lang")
    return n.withColumn("logp", F.log((F.col("count") + 1.0) / (F.sum("count").over(w) + F.count("*").over(w))))


def marker_model(words: dict[str, list[str]], spark) -> DataFrame:
    """The model of :func:`unigram_model` where no text is at hand: every marker counts once in its own language."""
    return unigram_model(spark.createDataFrame([(lang, w) for lang, ws in words.items() for w in ws], "lang string, token string"))


def score_lines(lines: DataFrame, model: DataFrame, unknown: float = -12.0) -> DataFrame:
    """``line_id, lang, n_tokens, n_known, score``: the log-probability of each line under each language; a line without tokens scores 0.

    A token meets its languages once, as one row with an array of them, so lines and
    tokens are never multiplied by the languages before the last step; the languages are counted first.
    """
    langs = [r[0] for r in model.select("lang").distinct().orderBy("lang").limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages in the model")
    of = model.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("lang", "logp"))).alias("m"))
    words = lines.select("line_id", F.explode_outer(tokens("line")).alias("token")).groupBy("line_id", "token").agg(F.count("*").alias("k"))
    k = F.when(F.col("token").isNotNull(), F.col("k")).otherwise(0)
    hit = words.join(of, "token", "left").withColumn("k", k)
    logp = [F.try_element_at("m", F.lit(x)) for x in langs]
    sums = hit.groupBy("line_id").agg(F.sum("k").alias("n_tokens"), *[c for i, p in enumerate(logp) for c in (F.sum(F.when(p.isNotNull(), F.col("k")).otherwise(0)).alias(f"n{i}"), F.sum(F.col("k") * F.coalesce(p, F.lit(unknown))).alias(f"s{i}"))])
    rows = F.array(*[F.struct(F.lit(x).alias("lang"), F.col(f"n{i}").alias("n_known"), F.col(f"s{i}").alias("score")) for i, x in enumerate(langs)])
    return sums.select("line_id", "n_tokens", F.explode(rows).alias("x")).select("line_id", "x.lang", "n_tokens", "x.n_known", "x.score")
