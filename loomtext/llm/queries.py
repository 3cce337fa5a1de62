"""The pN_ queries and, where SQL can say the same, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import align, clusters, groupsplit, langid, leak, mixture, ocr, overlap, subjects


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return align.align_documents(table(spark, d, "smoldoc_en_kg"), table(spark, d, "gatitos_en_kg"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).select("id", "src_index", "trg_index")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.damage(ocr.examine(table(spark, d, "proverbs_ocr")))


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repaired(ocr.examine(table(spark, d, "proverbs_ocr")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.tied_rows(table(spark, d, "smol_target"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.split_components(table(spark, d, "smol_target"), table(spark, d, "split_targets"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.split_report(p3_splits(spark, d), table(spark, d, "smol_target"), table(spark, d, "split_targets"))


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return langid.segments_of_both(*(table(spark, d, t) for t in ("lin_smol", "proverbs_ocr", "lexicons", "flores_devtest")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows, lines = _segments(spark, d)
    cols = ["rec_id", "seg_no", "lang"]
    found = langid.doubtful(rows).select(F.lit("lin_smol").alias("tbl"), *cols)
    return found.union(lines.select(F.lit("proverbs_ocr").alias("tbl"), *cols))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    rows, lines = _segments(spark, d)
    return langid.document_languages(rows).select(F.lit("lin_smol").alias("tbl"), "*").union(langid.document_languages(lines).select(F.lit("proverbs_ocr").alias("tbl"), "*"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_overlaps(table(spark, d, "smol_test"), table(spark, d, "lin_smol"))
    return pairs.select(F.col("eval_row_id").alias("test_row_id"), F.col("train_row_id").alias("lin_row_id"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    test, lin = table(spark, d, "smol_test"), table(spark, d, "lin_smol")
    return overlap.overlap_report(overlap.cross_split_overlaps(test, lin, coverage=True), test, lin)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.consolidate(table(spark, d, "group_matches"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(table(spark, d, "documents"), table(spark, d, "flores_devtest"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(table(spark, d, "documents"), table(spark, d, "flores_devtest"), offsets=True)


#: the domains of the sources, for the upper level of the tree
DOMAINS = {
    "parish_letters": "community", "village_radio": "community", "reading_circle": "community", "song_archive": "community", "school_primers": "teaching", "code_club": "teaching", "star_watchers": "teaching",
    "market_bulletin": "work", "field_almanac": "work", "clinic_leaflets": "public", "court_notes": "public", "old_scans": "print",
}


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=DOMAINS)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_mix_total(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of as many tokens as all targeted sources have: the small ones are short, and others take their place."""
    return mixture.mixed_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"), domains=DOMAINS, once=True)


def p8_shares_total(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_shares(p8_mix_total(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "doc_subjects"))


def p9_topics(spark: SparkSession, d: str) -> DataFrame:
    return subjects.topic_terms(table(spark, d, "documents"), table(spark, d, "doc_subjects"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p9_found(spark, d), table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_text, p3_found, p3_splits, p3_report, p4_found, p4_records, p5_found, p5_report, p6_found, p7_found, p7_passages, p8_mix, p8_shares, p8_mix_total, p8_shares_total, p9_found, p9_topics, p9_composition)}

_ID = r"nullif(regexp_replace(regexp_replace(lower({0}), '^[\s\p{{Z}}\x1c-\x1f\x85]+', ''), '[\s\p{{Z}}\x1c-\x1f\x85]+$', ''), '')"
ORACLES = {
    "p6_found": f"""
        WITH RECURSIVE p AS (
          SELECT coalesce({_ID.format('left_group_id')}, 'doc:' || {_ID.format('left_document_id')}) AS a,
                 coalesce({_ID.format('right_group_id')}, 'doc:' || {_ID.format('right_document_id')}) AS b
          FROM group_matches WHERE {_ID.format('verdict')} = 'match'),
        e AS (SELECT a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
        r(v, u) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
        SELECT v AS group_id, least(min(u), v) AS component_id FROM r GROUP BY v""",
    "p3_found": f"""
        WITH RECURSIVE k AS (SELECT row_id, 'd:' || {_ID.format('document_id')} AS d, 'g:' || {_ID.format('group_id')} AS g FROM smol_target),
        l AS (SELECT DISTINCT coalesce(d, g) AS a, g AS b FROM k WHERE g IS NOT NULL UNION SELECT DISTINCT d, d FROM k WHERE d IS NOT NULL),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(v, u) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
        c AS (SELECT v, min(u) AS comp FROM r GROUP BY v),
        s AS (SELECT row_id, comp FROM k JOIN c ON coalesce(k.d, k.g) = c.v),
        t AS (SELECT comp, min(row_id) AS set_id, count(*) AS n FROM s GROUP BY comp)
        SELECT row_id, set_id FROM s JOIN t USING (comp) WHERE n > 1""",
}
