"""The registered queries of the core operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_id, normalize_text, strip, tokens
from ..operators import audit, clean, decontam, extract, sample, score, split
from ..session import table
from ..sources import readers, sinks


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lin_smol").select(F.col("row_id").alias("ordinal"), "src", "trg", "origin", clean_id("document_id").alias("document_id"))


def _target(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "smol_target").select(F.col("row_id").alias("ordinal"), "src", "trg", "origin", clean_id("document_id").alias("document_id"), clean_id("group_id").alias("group_id"))


def _corpora(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c: table(spark, d, t).select(F.lit(f"{t}.{c}").alias("corpus"), F.col(c).alias("text"))
    return one("smol_target", "trg").union(one("smol_test", "trg")).union(one("lin_smol", "trg")).union(one("lin_smol", "src")).union(one("smol_test", "src"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "smol_test").select(normalize_text("src").alias("norm")).where("norm is not null and norm <> ''").distinct()


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The scanned entries as the pages of two readings of a book: headword lines, then body lines."""
    p = table(spark, d, "proverbs_ocr")
    return p.select(F.col("ocr_pass").alias("book"), F.col("rec_id").cast("int").alias("page"), F.concat_ws("\n", "kikongo", F.when(F.col("kikongo_variant").isNotNull(), F.concat(F.lit("Yovo: "), "kikongo_variant")), F.array_join("body", "\n")).alias("text"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return extract.clean_lines(_pages(spark, d))


def _model(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "flores_devtest").where(F.col("lang").isin("pt", "fr", "en")).select("lang", F.explode(tokens("text")).alias("token"))
    return audit.unigram_model(words)


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return audit.corpus_vocab(_corpora(spark, d), "corpus", "text")


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return audit.lexicon_forms(table(spark, d, "lexicons"))


def clean_pairs(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_pairs(_pairs(spark, d)).select("ordinal", "src", "trg")


def dedup_normalized(spark: SparkSession, d: str) -> DataFrame:
    return clean.dedup_normalized(_pairs(spark, d).where("src is not null")).select("ordinal", "src")


def ladder_top(spark: SparkSession, d: str) -> DataFrame:
    return sample.sample_ladder(_pairs(spark, d), 500, "top").select("ordinal", "src")


def ladder_stratified(spark: SparkSession, d: str) -> DataFrame:
    return sample.sample_ladder(_pairs(spark, d), 700, "stratified").select("ordinal", "src")


def ladder_random(spark: SparkSession, d: str) -> DataFrame:
    return sample.sample_ladder(_pairs(spark, d), 500, "random").select("ordinal", "src")


def marker_rates(spark: SparkSession, d: str) -> DataFrame:
    return audit.marker_rates(_corpora(spark, d).where("text is not null"), ["corpus"], "text")


def overlap(spark: SparkSession, d: str) -> DataFrame:
    return audit.overlaps(_corpora(spark, d), "corpus", "text")


def lexicon_raw(spark: SparkSession, d: str) -> DataFrame:
    return audit.raw_coverage(_vocab(spark, d), _forms(spark, d))


def lexicon_discriminative(spark: SparkSession, d: str) -> DataFrame:
    return audit.discriminative_coverage(_vocab(spark, d), _forms(spark, d))


def bootstrap_identity(spark: SparkSession, d: str) -> DataFrame:
    return audit.bootstrap_identity(_vocab(spark, d), _forms(spark, d))


def lang_lm_train(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).select("lang", "token", "count", F.round("logp", 6).alias("logp"))


def lang_lm_score(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "smol_test").select(F.col("row_id").alias("line_id"), F.col("src").alias("line"))
    return audit.score_lines(lines, _model(spark, d)).select("line_id", "lang", "n_tokens", "n_known", F.round("score", 4).alias("score"))


def lang_lm_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The model of the marker words alone, for use where no text is at hand."""
    return audit.marker_model(audit.FALLBACK_MARKERS, spark).select("lang", "token", "count", F.round("logp", 6).alias("logp"))


def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontam.exclude_blocked(_pairs(spark, d), _held(spark, d)).select("ordinal", "origin", "document_id")


def decontaminate_blocked(spark: SparkSession, d: str) -> DataFrame:
    """As ``decontaminate``, where documents of the target rows are blocked by their ids as well."""
    ids = _target(spark, d).where("document_id is not null").select("document_id").distinct()
    return decontam.exclude_blocked(_pairs(spark, d), _held(spark, d), ids).select("ordinal", "origin", "document_id")


def review_reviewed(spark: SparkSession, d: str) -> DataFrame:
    return decontam.split_by_keys(_pairs(spark, d), table(spark, d, "smol_test"), ["src"])[0].select("ordinal", "src")


def review_pending(spark: SparkSession, d: str) -> DataFrame:
    return decontam.split_by_keys(_pairs(spark, d), table(spark, d, "smol_test"), ["src"])[1].select("ordinal", "src")


def leak_report(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lin_smol").select(F.lit("train").alias("split"), "src", "trg").union(table(spark, d, "smol_test").select("split", "src", "trg")).union(table(spark, d, "smol_target").select(F.lit("target").alias("split"), "src", "trg"))
    return decontam.leak_report(parts, ["src", "trg"])


def eligible_pool(spark: SparkSession, d: str) -> DataFrame:
    return decontam.build_eligible_pool(_pairs(spark, d), _held(spark, d), 500).select("ordinal", "src", "trg")


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return decontam.provenance(_pairs(spark, d))


def components(spark: SparkSession, d: str) -> DataFrame:
    return split.linked_components(_target(spark, d))


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return split.group_sizes(_target(spark, d).where("group_id is not null"), "group_id")


def greedy_split(spark: SparkSession, d: str) -> DataFrame:
    return split.split_pairs(_target(spark, d)).select("ordinal", "component", "split")


def split_audit(spark: SparkSession, d: str) -> DataFrame:
    return decontam.leak_report(split.split_pairs(_target(spark, d)), ["document_id", "group_id", "src", "trg"])


def zip_explode(spark: SparkSession, d: str) -> DataFrame:
    return readers.explode_documents(table(spark, d, "smoldoc_en_kg"))[0]


def zip_rejected(spark: SparkSession, d: str) -> DataFrame:
    return readers.explode_documents(table(spark, d, "smoldoc_en_kg"))[1]


def explode_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return readers.explode_lexicon(table(spark, d, "gatitos_en_kg"))


def target_rows(spark: SparkSession, d: str) -> DataFrame:
    single = table(spark, d, "smol_target").where("origin = 'smolsent' and sentence_id is not null").select(F.col("sentence_id").alias("id"), "src", "trg")
    return readers.target_rows(single, table(spark, d, "smoldoc_en_kg"))


def _columns(spark: SparkSession, d: str) -> DataFrame:
    """The scanned entries as pages of a word list of four columns: heading, then the words of each line spread over the columns."""
    p = table(spark, d, "proverbs_ocr")
    word = "rpad(left(coalesce(try_element_at(split(regexp_replace(x, '[^a-zA-Z ]', ''), ' +'), {0}), ''), 11), 12, ' ')"
    lines = F.expr("transform(filter(body, x -> x is not null), x -> concat(" + ", ".join(word.format(i) for i in (1, 2, 3, 4)) + "))")
    head = F.lit("".join(c.ljust(12) for c in ("English", "Francais", "Lingala", "Kikongo")))
    # every third page goes on under the heading of the page before
    text = F.when(F.col("rec_id") % 3 == 0, F.array_join(lines, "\n")).otherwise(F.concat_ws("\n", head, F.array_join(lines, "\n")))
    return p.select(F.col("ocr_pass").alias("book"), F.col("rec_id").cast("int").alias("page"), text.alias("text"))


def lexicon_words(spark: SparkSession, d: str) -> DataFrame:
    return extract.fixed_width_words(_columns(spark, d))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return readers.page_lines(_pages(spark, d))


def form_feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each work as one layout text, cut at its form feeds."""
    books = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("book"), F.replace("text", F.lit("\n\n"), F.lit("\f")).alias("text"))
    return readers.form_feed_pages(books).select("book", "page", F.length("text").alias("n_chars"))


def pivot_registry(spark: SparkSession, d: str) -> DataFrame:
    return readers.pivot_registry(spark).select("key", "name", "iso", "family", "rows")


def clean_page(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return extract.dehyphenate(_lines(spark, d))


def headword_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(extract.is_headword("line"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    e = extract.merge_bodyless(extract.split_entries(extract.dehyphenate(_lines(spark, d))))
    return e.select("book", "entry", "page", "kikongo", "variant", F.size("body").alias("n_lines"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    e = extract.merge_bodyless(extract.split_entries(extract.dehyphenate(_lines(spark, d))))
    return extract.records(e, _model(spark, d))


def proverb_records(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)


def translation_counts(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    full = (F.col("pt") != "") & (F.col("fr") != "") & (F.col("en") != "")
    return r.groupBy("book").agg(F.count("*").alias("n"), *[F.count_if(F.col(c) != "").alias(c) for lang in ("pt", "fr", "en") for c in (lang, f"{lang}_explanation")], F.count_if(full).alias("complete"))


def _two_passes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "proverbs_ocr").select(F.col("rec_id").alias("ordinal"), "kikongo", "ocr_pass", F.array_join("body", " ").alias("pt"))
    return p.where("ocr_pass = 'fra_eng'").drop("ocr_pass"), p.where("ocr_pass = 'por'").drop("ocr_pass")


def align_exact(spark: SparkSession, d: str) -> DataFrame:
    return extract.align_exact(*_two_passes(spark, d), ["pt"]).select("ordinal", "kikongo", "pt", "matched")


def align_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return extract.align_fuzzy(*_two_passes(spark, d), ["pt"])


def _text_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


def headword_counts(spark: SparkSession, d: str) -> DataFrame:
    return extract.headword_counts(_text_lines(spark, d))


def headword_harvest(spark: SparkSession, d: str) -> DataFrame:
    fr = extract.foreign_vocabulary(table(spark, d, "lexicons").where("lexicon = 'fr'").select("form"))
    return extract.harvest_headwords(_text_lines(spark, d), fr, least=1)


def _hyps(spark: SparkSession, d: str) -> DataFrame:
    """How far the corpora's targets are their sources: hypothesis src, reference trg."""
    return table(spark, d, "smol_test").select("split", F.col("src").alias("hyp"), F.col("trg").alias("ref"))


def score_chrf(spark: SparkSession, d: str) -> DataFrame:
    return score.corpus_chrf(_hyps(spark, d), ["split"]).select("split", F.round("chrf", 6).alias("chrf"))


def score_bleu(spark: SparkSession, d: str) -> DataFrame:
    return score.corpus_bleu(_hyps(spark, d), ["split"]).select("split", F.round("bleu", 6).alias("bleu"))


def run_table(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the test material as the metrics of two runs, with the settings of one of them."""
    t = table(spark, d, "smol_test")
    m = t.groupBy(F.col("split").alias("run")).agg(F.count("*").cast("double").alias("rows"), F.countDistinct("document_id").cast("double").alias("docs"))
    long = m.select("run", F.lit("size").alias("eval"), F.explode(F.create_map(F.lit("rows"), F.col("rows"), F.lit("docs"), F.col("docs"))).alias("metric", "value"))
    return score.collate_runs(long, spark.createDataFrame([("test", "lin", 50_000)], "run string, pivot string, pivot_size int"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    name = readers.language_name("trg_lang", readers.LANG_NAMES | {"kg": "Kikongo", "ln": "Lingala", "sw": "Swahili"})
    return table(spark, d, "lin_smol").select("row_id", F.concat(F.lit("translate English to "), name, F.lit(": "), strip("src")).alias("prompt"))


def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The data hashes of a run: one for each of its (small) input files."""
    files = [f"{d}/{t}.parquet" for t in ("lexicons", "gatitos_en_kg", "flores_devtest")]
    return sinks.file_hashes(spark, files).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "sha256")


def review_sheet(spark: SparkSession, d: str) -> DataFrame:
    return sinks.review_sheet(_pairs(spark, d), 100).select("ordinal", "src", "trg", "meaning_preserved", "fluent", "correct_language", "notes")


QUERIES = {f.__name__: f for f in (
    clean_pairs, dedup_normalized, ladder_top, ladder_stratified, ladder_random, marker_rates, overlap, lexicon_raw, lexicon_discriminative, bootstrap_identity,
    lang_lm_train, lang_lm_fallback, lang_lm_score, decontaminate, decontaminate_blocked, review_reviewed, review_pending, leak_report, eligible_pool, provenance, components, group_sizes, greedy_split, split_audit,
    zip_explode, zip_rejected, explode_lexicon, target_rows, lexicon_words, page_lines, form_feed_pages, pivot_registry, clean_page, dehyphenate, headword_lines, entries, proverb_records, translation_counts,
    align_exact, align_fuzzy, headword_counts, headword_harvest, score_chrf, score_bleu, run_table, prompts, row_hashes, file_hashes, review_sheet,
)}
