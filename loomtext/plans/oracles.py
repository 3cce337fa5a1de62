"""The same results in SQL, over tables of the same names."""

from __future__ import annotations

from ..operators.audit import FALLBACK_MARKERS
from ..sources.readers import LANG_NAMES, PIVOTS

_WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


def _id(c: str) -> str:
    return f"nullif({_strip(f'lower({c})')}, '')"


def _norm(c: str) -> str:
    """NFKC and case folding as far as these tables need them: composition, full-width forms, ligatures, ß."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94))
    t = f"translate(nfc_normalize({c}), '{wide.replace(chr(39), chr(39) * 2)}', '{plain.replace(chr(39), chr(39) * 2)}')"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("…", "..."), ("ß", "ss")):
        t = f"replace({t}, '{a}', '{b}')"
    return _strip(f"regexp_replace(lower({t}), '{_WS}+', ' ', 'g')")


def _seeded(c: str, seed: int = 13) -> str:
    return f"md5('{seed}:' || {c}::VARCHAR)"


_TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


def _tok(c: str) -> str:
    return _TOK.format(c=c)


_PAIRS = f"SELECT row_id AS ordinal, src, trg, origin, {_id('document_id')} AS document_id FROM lin_smol"
_CORPORA = " UNION ALL ".join(f"SELECT '{t}.{c}' AS corpus, {c} AS text FROM {t}" for t, c in (("smol_target", "trg"), ("smol_test", "trg"), ("lin_smol", "trg"), ("lin_smol", "src"), ("smol_test", "src")))
_HELD = f"SELECT DISTINCT {_norm('src')} AS norm FROM smol_test WHERE src IS NOT NULL AND {_norm('src')} <> ''"
_VOCAB = f"SELECT DISTINCT corpus, form FROM (SELECT corpus, unnest({_tok('text')}) AS form FROM ({_CORPORA})) WHERE length(form) >= 3"
_FORMS = f"SELECT DISTINCT lexicon, form FROM (SELECT lexicon, unnest({_tok('form')}) AS form FROM lexicons) WHERE length(form) >= 3"
_MODEL = f"""SELECT lang, token, count(*) AS "count", ln((count(*) + 1.0) / (sum(count(*)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))) AS logp
  FROM (SELECT lang, unnest({_tok('text')}) AS token FROM flores_devtest WHERE lang IN ('pt', 'fr', 'en')) GROUP BY lang, token"""
_LIMITS = f"""SELECT ordinal, src, trg FROM (SELECT ordinal, {_strip('src')} AS src, {_strip('trg')} AS trg FROM ({_PAIRS}) WHERE src IS NOT NULL AND trg IS NOT NULL)
  WHERE length(src) BETWEEN 5 AND 500 AND length(trg) BETWEEN 5 AND 500 AND length(src)::DOUBLE / greatest(length(trg), 1) BETWEEN 1.0 / 3.0 AND 3.0"""
_LIMITS_OF = f"""SELECT * FROM (SELECT * REPLACE ({_strip('src')} AS src, {_strip('trg')} AS trg) FROM {{rows}} WHERE src IS NOT NULL AND trg IS NOT NULL)
  WHERE length(src) BETWEEN 5 AND 500 AND length(trg) BETWEEN 5 AND 500 AND length(src)::DOUBLE / greatest(length(trg), 1) BETWEEN 1.0 / 3.0 AND 3.0"""
_CLEAN = f"SELECT * FROM ({_LIMITS}) QUALIFY row_number() OVER (PARTITION BY src ORDER BY ordinal) = 1"
_MARKERS = {"kituba_tam": "ke|ta|me|vandaka|salaka", "kituba_lex": "munu|nge|beto|sambu|mutindu", "kikongo_lex": "mono|ngeye|yeto|kadi|mpila", "religious": "yezu|yehowa|nzambi|biblia|kristu|mpeve"}
_TARGET = f"SELECT row_id AS ordinal, src, trg, origin, {_id('document_id')} AS document_id, {_id('group_id')} AS group_id FROM smol_target"
_STRIDE = "SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS position, count(*) OVER () AS total FROM ({rows})"
_SIDES = f"SELECT group_id AS g, 'src' AS side, {_norm('src')} AS n FROM t WHERE group_id IS NOT NULL AND src IS NOT NULL UNION SELECT group_id, 'trg', {_norm('trg')} FROM t WHERE group_id IS NOT NULL AND trg IS NOT NULL"


def _stride(rows: str, n: int, cols: str) -> str:
    return f"""WITH p AS ({_STRIDE.format(rows=rows)}), k AS (SELECT CAST(floor(i * (total::DOUBLE / {n})) AS BIGINT) AS position FROM (SELECT max(total) AS total FROM p), range({n}) r(i) WHERE total > {n})
      SELECT {cols} FROM p WHERE total <= {n} OR position IN (SELECT position FROM k)"""


def _pairwise(values: str, names: str) -> str:
    return f"""WITH v AS ({values}), n AS ({names}), c AS (SELECT DISTINCT "column" FROM v)
      SELECT c."column", x.s AS a, y.s AS b, (SELECT count(*) FROM (SELECT v FROM v WHERE v.s = x.s AND v."column" = c."column" INTERSECT SELECT v FROM v WHERE v.s = y.s AND v."column" = c."column")) AS shared
      FROM n x JOIN n y ON x.s < y.s CROSS JOIN c"""


ORACLES = {
    "clean_pairs": _CLEAN,
    "dedup_normalized": f"SELECT ordinal, src FROM ({_PAIRS}) WHERE src IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_norm('src')} ORDER BY ordinal) = 1",
    "ladder_top": f"SELECT ordinal, src FROM ({_PAIRS}) ORDER BY ordinal LIMIT 500",
    "ladder_stratified": _stride(_PAIRS, 700, "ordinal, src"),
    "marker_rates": f"""WITH c AS (SELECT corpus, lower(text) AS t FROM ({_CORPORA}) WHERE text IS NOT NULL), m(marker, words) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _MARKERS.items())})
      SELECT corpus, marker, count(*) FILTER (regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(' || words || ')($|[^\\p{{L}}\\p{{N}}_])')) AS hits, count(*) AS n,
        count(*) FILTER (regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(' || words || ')($|[^\\p{{L}}\\p{{N}}_])'))::DOUBLE / count(*) AS rate FROM c CROSS JOIN m GROUP BY corpus, marker""",
    "overlap": f"""WITH v AS (SELECT DISTINCT corpus AS c, {_strip('text')} AS t FROM ({_CORPORA}) WHERE text IS NOT NULL), n AS (SELECT c, count(*) AS n FROM v GROUP BY c),
      s AS (SELECT a.c AS a, b.c AS b, count(*) AS shared FROM v a JOIN v b ON a.t = b.t AND a.c < b.c GROUP BY 1, 2)
      SELECT x.c AS a, y.c AS b, coalesce(shared, 0) AS shared, coalesce(shared, 0)::DOUBLE / (x.n + y.n - coalesce(shared, 0)) AS jaccard FROM n x JOIN n y ON x.c < y.c LEFT JOIN s ON s.a = x.c AND s.b = y.c""",
    "lexicon_raw": f"""WITH v AS ({_VOCAB}), f AS ({_FORMS}), g AS (SELECT corpus, lexicon, n_forms FROM (SELECT DISTINCT corpus FROM v) CROSS JOIN (SELECT lexicon, count(*) AS n_forms FROM f GROUP BY lexicon)),
      h AS (SELECT corpus, lexicon, count(*) AS hits FROM v JOIN f USING (form) GROUP BY 1, 2)
      SELECT corpus, lexicon, n_forms, coalesce(hits, 0) AS hits, coalesce(hits, 0)::DOUBLE / n_forms AS coverage FROM g LEFT JOIN h USING (corpus, lexicon)""",
    "lexicon_discriminative": f"""WITH v AS ({_VOCAB}), f AS ({_FORMS}), l AS (SELECT DISTINCT lexicon FROM f), p AS (SELECT x.lexicon AS a, y.lexicon AS b FROM l x JOIN l y ON x.lexicon < y.lexicon),
      o AS (SELECT a, b, f.form, f.lexicon = a AS side_a FROM p JOIN f ON f.lexicon = a OR f.lexicon = b WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.form = f.form AND g.lexicon <> f.lexicon AND g.lexicon IN (a, b))),
      s AS (SELECT a, b, count(*) FILTER (side_a) AS only_a, count(*) FILTER (NOT side_a) AS only_b FROM o GROUP BY a, b HAVING count(*) FILTER (side_a) >= 20 AND count(*) FILTER (NOT side_a) >= 20),
      h AS (SELECT corpus, a, b, count(*) FILTER (side_a) AS ha, count(*) FILTER (NOT side_a) AS hb FROM o JOIN v USING (form) GROUP BY 1, 2, 3),
      r AS (SELECT corpus, a, b, only_a, only_b, coalesce(ha, 0)::DOUBLE / only_a AS cov_a, coalesce(hb, 0)::DOUBLE / only_b AS cov_b FROM (SELECT DISTINCT corpus FROM v) CROSS JOIN s LEFT JOIN h USING (corpus, a, b))
      SELECT *, CASE WHEN cov_a > cov_b THEN a ELSE b END AS leans, abs(cov_a - cov_b) AS margin FROM r""",
    "lang_lm_train": f'SELECT lang, token, "count", round(logp, 6) AS logp FROM ({_MODEL})',
    "decontaminate": f"""WITH p AS (SELECT *, {_norm('src')} AS norm FROM ({_PAIRS})), h AS ({_HELD}), b AS (SELECT DISTINCT document_id FROM p WHERE document_id IS NOT NULL AND norm IN (SELECT norm FROM h))
      SELECT ordinal, origin, document_id FROM p WHERE (document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM b)) OR (document_id IS NULL AND (norm IS NULL OR norm NOT IN (SELECT norm FROM h)))""",
    "review_reviewed": f"SELECT ordinal, src FROM ({_PAIRS}) WHERE src IN (SELECT src FROM smol_test WHERE src IS NOT NULL)",
    "review_pending": f"SELECT ordinal, src FROM ({_PAIRS}) p WHERE NOT EXISTS (SELECT 1 FROM smol_test t WHERE t.src = p.src)",
    "leak_report": _pairwise(
        "SELECT DISTINCT \"column\", s, v FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {s} AS s, {_norm(c)} AS v FROM {t} WHERE {c} IS NOT NULL" for c in ("src", "trg") for t, s in (("lin_smol", "'train'"), ("smol_test", "split"), ("smol_target", "'target'"))) + ") WHERE v <> ''",
        "SELECT 'train' AS s UNION SELECT 'target' UNION SELECT DISTINCT split FROM smol_test"),
    "eligible_pool": _stride(f"SELECT ordinal, src, trg FROM (SELECT * FROM ({_CLEAN}) QUALIFY row_number() OVER (PARTITION BY {_norm('src')} ORDER BY ordinal) = 1) WHERE {_norm('src')} NOT IN (SELECT norm FROM ({_HELD}))", 500, "ordinal, src, trg"),
    "provenance": f"SELECT coalesce(origin, 'unknown') AS origin, count(*) AS n_rows, count(DISTINCT document_id) AS n_documents, count(DISTINCT src) AS n_sources, coalesce(sum(length(src)), 0)::BIGINT AS chars FROM ({_PAIRS}) GROUP BY 1",
    "components": f"""WITH RECURSIVE t AS ({_TARGET}), k AS (SELECT * FROM ({_SIDES}) WHERE n <> ''), l AS (SELECT DISTINCT x.a, k.g AS b FROM k JOIN (SELECT side, n, min(g) AS a FROM k GROUP BY side, n) x USING (side, n)),
      e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT group_id, group_id FROM t WHERE group_id IS NOT NULL), r(v, u) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
      SELECT v AS group_id, min(u) AS component FROM r GROUP BY v""",
    "group_sizes": f"SELECT group_id, count(*) AS size, CASE WHEN max(CASE WHEN origin = 'smoldoc' THEN 1 ELSE 0 END) = 1 THEN 'smoldoc' ELSE 'smolsent' END AS kind FROM ({_TARGET}) WHERE group_id IS NOT NULL GROUP BY group_id",
    "zip_explode": "SELECT id, (i - 1)::INT AS sentence_index, srcs[i] AS src, trgs[i] AS trg FROM (SELECT *, unnest(range(1, len(srcs) + 1)) AS i FROM smoldoc_en_kg WHERE len(srcs) = len(trgs))",
    "zip_rejected": "SELECT id, len(srcs)::INT AS n_srcs, len(trgs)::INT AS n_trgs FROM smoldoc_en_kg WHERE NOT coalesce(len(srcs) = len(trgs), false)",
    "explode_lexicon": "SELECT DISTINCT src, unnest(trgs) AS trg FROM gatitos_en_kg",
    "target_rows": """SELECT src, trg, 'smolsent' AS origin, sentence_id, 'sent:' || sentence_id AS group_id, NULL::VARCHAR AS document_id, NULL::INT AS sentence_index FROM smol_target WHERE origin = 'smolsent' AND sentence_id IS NOT NULL
      UNION ALL SELECT srcs[i], trgs[i], 'smoldoc', NULL, 'doc:' || id, id, (i - 1)::INT FROM (SELECT *, unnest(range(1, len(srcs) + 1)) AS i FROM smoldoc_en_kg WHERE len(srcs) = len(trgs))""",
    "lang_lm_score": f"""WITH m AS ({_MODEL}), l AS (SELECT row_id AS line_id, src FROM smol_test), w AS (SELECT line_id, unnest({_tok('src')}) AS token FROM l), g AS (SELECT line_id, lang FROM l CROSS JOIN (SELECT DISTINCT lang FROM m)),
      s AS (SELECT line_id, g.lang, count(*) AS n_tokens, count(logp) AS n_known, sum(coalesce(logp, -12.0)) AS score FROM g JOIN w USING (line_id) LEFT JOIN m ON m.lang = g.lang AND m.token = w.token GROUP BY 1, 2)
      SELECT line_id, lang, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_known, 0)::BIGINT AS n_known, round(coalesce(score, 0.0), 4) AS score FROM g LEFT JOIN s USING (line_id, lang)""",
    "run_table": "SELECT split AS run, count(DISTINCT document_id)::DOUBLE AS size_docs, count(*)::DOUBLE AS size_rows, CASE WHEN split = 'test' THEN 'lin' END AS pivot, CASE WHEN split = 'test' THEN 50000 END AS pivot_size FROM smol_test GROUP BY split",
    "prompts": f"""SELECT row_id, 'translate English to ' || coalesce(CASE {_id('trg_lang')} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in (LANG_NAMES | {'kg': 'Kikongo', 'ln': 'Lingala', 'sw': 'Swahili'}).items())} ELSE {_id('trg_lang')} END, 'und') || ': ' || {_strip('src')} AS prompt FROM lin_smol""",
    "lang_lm_fallback": f"""SELECT lang, token, 1::BIGINT AS "count", round(ln(2.0 / (2 * count(*) OVER (PARTITION BY lang))), 6) AS logp FROM (VALUES {', '.join(f"('{lang}', '{w}')" for lang, ws in FALLBACK_MARKERS.items() for w in ws)}) t(lang, token)""",
    "pivot_registry": f"""SELECT * FROM (VALUES {', '.join(f"('{k}', '{n}', '{iso}', '{fam}', {rows}::BIGINT)" for k, n, rows, iso, fam in PIVOTS)}) t("key", name, iso, family, "rows")""",
    "ladder_random": f"SELECT ordinal, src FROM ({_PAIRS}) ORDER BY {_seeded('ordinal')}, ordinal LIMIT 500",
    "review_sheet": f"SELECT ordinal, src, trg, NULL::BOOLEAN AS meaning_preserved, NULL::BOOLEAN AS fluent, NULL::BOOLEAN AS correct_language, '' AS notes FROM ({_PAIRS}) ORDER BY {_seeded('ordinal')}, ordinal LIMIT 100",
    "decontaminate_blocked": f"""WITH p AS (SELECT *, {_norm('src')} AS norm FROM ({_PAIRS})), h AS ({_HELD}), b AS (SELECT document_id FROM p WHERE document_id IS NOT NULL AND norm IN (SELECT norm FROM h) UNION SELECT document_id FROM ({_TARGET}) WHERE document_id IS NOT NULL)
      SELECT ordinal, origin, document_id FROM p WHERE (document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM b)) OR (document_id IS NULL AND (norm IS NULL OR norm NOT IN (SELECT norm FROM h)))""",
    "form_feed_pages": "SELECT doc_id::VARCHAR AS book, (i - 1)::INT AS page, length(parts[i])::INT AS n_chars FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10) || chr(10), chr(12)), chr(12)) AS parts FROM documents WHERE text IS NOT NULL))",
    "row_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
}

# groups linked before cleaning, rows cleaned and deduplicated, groups packed one after the other
_GROUPED = f"SELECT ordinal, src, trg, origin, document_id, group_id AS own_group, coalesce(group_id, 'row:' || ordinal) AS group_id FROM ({_TARGET})"
_SPLIT = f"""WITH RECURSIVE t AS ({_GROUPED}), k AS (SELECT * FROM ({_SIDES}) WHERE n <> ''), l AS (SELECT DISTINCT x.a, k.g AS b FROM k JOIN (SELECT side, n, min(g) AS a FROM k GROUP BY side, n) x USING (side, n)),
      e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT group_id, group_id FROM t), r(v, u) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
      comp AS (SELECT v AS group_id, min(u) AS component FROM r GROUP BY v),
      c AS ({_LIMITS_OF.replace('{rows}', 't')}), d AS (SELECT * FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY src ORDER BY ordinal) = 1) QUALIFY row_number() OVER (PARTITION BY {_norm('src')} ORDER BY ordinal) = 1),
      kept AS (SELECT d.*, component FROM d JOIN comp USING (group_id)),
      sizes AS (SELECT component, count(*) AS size, CASE WHEN max(CASE WHEN origin = 'smoldoc' THEN 1 ELSE 0 END) = 1 THEN 'smoldoc' ELSE 'smolsent' END AS kind FROM kept GROUP BY component),
      totals AS (SELECT kind, sum(size) AS total, (SELECT least(300, sum(size)::BIGINT // 4) FROM sizes) AS n_test, (SELECT sum(size) FROM sizes) AS n FROM sizes GROUP BY kind),
      o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_seeded('component')}, component) AS i FROM sizes),
      w(kind, i, component, name, lt, ld) AS (SELECT kind, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, round_even(total * n_test / n::DOUBLE, 0), round_even(total * (n_test // 2) / n::DOUBLE, 0) FROM totals
        UNION ALL SELECT o.kind, o.i, o.component, CASE WHEN abs(lt - size) < abs(lt) THEN 'test' WHEN abs(ld - size) < abs(ld) THEN 'dev' ELSE 'train' END,
          CASE WHEN abs(lt - size) < abs(lt) THEN lt - size ELSE lt END, CASE WHEN abs(lt - size) < abs(lt) THEN ld WHEN abs(ld - size) < abs(ld) THEN ld - size ELSE ld END
          FROM w JOIN o ON o.kind = w.kind AND o.i = w.i + 1),
      parts AS (SELECT kept.*, w.name AS split FROM kept JOIN w USING (component))"""
ORACLES |= {
    "greedy_split": f"{_SPLIT} SELECT ordinal, component, split FROM parts",
    "split_audit": f"""{_SPLIT}, v AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", split AS s, {_norm(x)} AS v FROM parts WHERE {x} IS NOT NULL" for c, x in (("document_id", "document_id"), ("group_id", "own_group"), ("src", "src"), ("trg", "trg")))}) WHERE v <> ''),
      m AS (SELECT DISTINCT split AS s FROM parts), q AS (SELECT DISTINCT "column" FROM v)
      SELECT q."column", x.s AS a, y.s AS b, (SELECT count(*) FROM (SELECT v FROM v WHERE v.s = x.s AND v."column" = q."column" INTERSECT SELECT v FROM v WHERE v.s = y.s AND v."column" = q."column")) AS shared
      FROM m x JOIN m y ON x.s < y.s CROSS JOIN q""",
}

# n-gram scores
_CHARS = f"regexp_replace({{c}}, '{_WS}', '', 'g')"
_MARKED = r"list_filter(string_split_regex(regexp_replace({c}, '([^\p{L}\p{N}_\s]|_)', ' \1 ', 'g'), '\s+'), lambda x: x <> '')"


def _bleu_words(c: str) -> str:
    marked = rf"regexp_replace({c}, '([^\p{{L}}\p{{N}}_\s.,''])', ' \1 ', 'g')"
    # a point or comma stays where it stands between two digits; RE2 looks neither back nor ahead, so the kept ones are put aside first
    kept = marked
    for mark, aside in ((".", "chr(1)"), (",", "chr(2)")):
        for _ in range(2):
            kept = rf"regexp_replace({kept}, '([0-9])[{mark}]([0-9])', '\1' || {aside} || '\2', 'g')"
    spaced = rf"regexp_replace({kept}, '([.,])', ' \1 ', 'g')"
    return rf"list_filter(string_split_regex(replace(replace({spaced}, chr(1), '.'), chr(2), ','), '\s+'), lambda x: x <> '')"


def _grams(units: list[tuple[str, int]]) -> str:
    """``split, o, hyp, ref, hit`` summed over sentences, for units (list of pieces, n)."""
    parts = []
    for o, (pieces, n) in enumerate(units):
        side = lambda c: f"SELECT row_id, split, gram, count(*) AS k FROM (SELECT row_id, split, unnest(list_transform(range(1, len(p) - {n} + 2), lambda i: list_aggregate(p[i:i + {n} - 1], 'string_agg', chr(31)))) AS gram FROM (SELECT row_id, split, {pieces.replace('{c}', c)} AS p FROM smol_test WHERE src IS NOT NULL AND trg IS NOT NULL) WHERE len(p) >= {n}) GROUP BY 1, 2, 3"
        parts.append(f"SELECT split, {o} AS o, coalesce(sum(a.k), 0) AS hyp, coalesce(sum(b.k), 0) AS ref, coalesce(sum(least(a.k, b.k)) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL), 0) AS hit FROM ({side('src')}) a FULL JOIN ({side('trg')}) b USING (row_id, split, gram) GROUP BY split")
    return " UNION ALL ".join(parts)


_CHRF = _grams([(f"string_split({_CHARS}, '')", n) for n in range(1, 7)] + [(_MARKED, n) for n in (1, 2)])
_BLEU = _grams([(_bleu_words("{c}"), n) for n in range(1, 5)])
ORACLES |= {
    "score_chrf": f"""SELECT split, round(CASE WHEN 4 * p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM (SELECT split, avg(hit / hyp) AS p, avg(hit / ref) AS r FROM ({_CHRF}) WHERE hyp > 0 AND ref > 0 GROUP BY split)""",
    "score_bleu": f"""WITH m AS ({_BLEU}), z AS (SELECT *, sum(CASE WHEN hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY split ORDER BY o) AS zeros FROM m),
      p AS (SELECT split, sum(CASE WHEN hyp = 0 THEN -1e9 WHEN hit = 0 THEN ln(1.0 / (power(2.0, zeros) * hyp)) ELSE ln(hit / hyp) END) AS s, max(hyp) FILTER (o = 0) AS h, max(ref) FILTER (o = 0) AS r FROM z GROUP BY split)
      SELECT split, round(100 * exp(s / 4 + CASE WHEN h >= r THEN 0 ELSE 1 - r / greatest(h, 1) END), 6) AS bleu FROM p""",
}

# lines of a scanned book
_PAGE = "SELECT ocr_pass AS book, rec_id::INT AS page, concat_ws(chr(10), kikongo, 'Yovo: ' || kikongo_variant, array_to_string(body, chr(10))) AS text FROM proverbs_ocr"
_LINES = f"""SELECT book, page, no, line FROM (SELECT book, page, (i - 1)::INT AS no, {_strip("regexp_replace(lines[i], '^[ \t-\r]*[|{}\\[\\]<>][ \t-\r]*', '')")} AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT book, page, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM ({_PAGE}))))
  WHERE line <> '' AND NOT regexp_matches(line, '^[\\s|{{}}\\[\\]<>\\\\/_~^`''".,:;!*+=-]*$') AND NOT regexp_matches(line, '^\\s*[0-9]{{1,3}}\\s*$')"""
_UP = "length(regexp_replace(line, '[^\\p{Lu}]', '', 'g'))"
_LET = "length(regexp_replace(line, '[^\\p{L}]', '', 'g'))"
ORACLES |= {
    "clean_page": _LINES,
    "headword_lines": f"SELECT * FROM ({_LINES}) WHERE {_LET} >= 8 AND {_UP} >= 0.75 * {_LET}",
    "dehyphenate": f"""WITH l AS ({_LINES}), m AS (SELECT *, coalesce(suffix(lag(line) OVER w, '-') AND regexp_matches(line, '^\\p{{Ll}}'), false) AS joins FROM l WINDOW w AS (PARTITION BY book, page ORDER BY no)),
      g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY book, page ORDER BY no) AS island, coalesce(lead(joins) OVER (PARTITION BY book, page ORDER BY no), false) AS cut FROM m)
      SELECT book, page, min(no)::INT AS no, string_agg(CASE WHEN cut THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY no) AS line FROM g GROUP BY book, page, island""",
    "align_exact": """WITH p AS (SELECT rec_id AS ordinal, kikongo, ocr_pass, array_to_string(body, ' ') AS pt, regexp_replace(lower(strip_accents(kikongo)), '[^a-z]', '', 'g') AS k FROM proverbs_ocr),
      n AS (SELECT *, row_number() OVER (PARTITION BY ocr_pass, k ORDER BY ordinal) AS nth FROM p)
      SELECT a.ordinal, a.kikongo, CASE WHEN b.ordinal IS NOT NULL THEN b.pt ELSE a.pt END AS pt, b.ordinal IS NOT NULL AS matched FROM n a LEFT JOIN n b ON b.ocr_pass = 'por' AND a.k = b.k AND a.nth = b.nth WHERE a.ocr_pass = 'fra_eng'""",
    "headword_counts": r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
      h AS (SELECT lower(strip_accents(replace(replace(w, '-', ''), '''', ''))) AS form FROM (SELECT regexp_extract(line, '^\s{0,3}([\p{L}\p{Nl}\p{No}][\p{L}\p{N}_''-]{1,30}),', 1) AS w FROM l) WHERE w <> ''),
      c AS (SELECT form, count(*) AS head FROM h WHERE length(form) >= 3 AND NOT regexp_matches(form, '[^\p{L}]') GROUP BY form),
      d AS (SELECT lower(strip_accents(w)) AS form FROM (SELECT unnest(regexp_extract_all(lower(substring(line, instr(line, ',') + 1)), '[\p{L}\p{Nl}\p{No}]+')) AS w FROM l WHERE instr(line, ',') > 0)),
      e AS (SELECT form, count(*) AS def FROM d WHERE length(form) >= 3 GROUP BY form)
      SELECT form, head, coalesce(def, 0) AS def FROM c LEFT JOIN e USING (form)""".replace("\\\\", "\\").replace("\\'", "'"),
}

# entries of a scanned book
_END = r"""[.!?]\s*[»"”’'')\]]*\s*$"""
_BAR = r"^\s*[|{}\[\]<>]\s*"
_YOVO = r"^\s*yovo(?:$|[^\p{L}\p{N}_])\s*[:;.,-]?\s*"
_HARVEST_FR = "SELECT DISTINCT lower(strip_accents(replace(replace(form, '-', ''), '''', ''))) AS form FROM lexicons WHERE lexicon = 'fr' AND form IS NOT NULL"


def _tidy(c: str) -> str:
    t = _strip(f"regexp_replace({c}, '{_WS}+', ' ', 'g')")
    t = rf"""regexp_replace({t}, '^[|`''’"~*_.,:;\- ]+', '')"""
    return _strip(rf"regexp_replace({t}, ' +([.,;:!?])', '\1', 'g')")


def _joined(lang: str, part: str) -> str:
    return _tidy(f"array_to_string({lang}[{part}], ' ')")


_ENTRIES = f"""l AS ({ORACLES['dehyphenate']}),
  w AS (SELECT *, list_filter(string_split_regex(line, '{_WS}+'), lambda x: x <> '') AS words, {_LET} >= 8 AND {_UP} >= 0.75 * {_LET} AS hw, regexp_matches(line, '{_END}') AS ends FROM l),
  f AS (SELECT *, coalesce(list_position([regexp_matches(words[i], '[\\p{{Ll}}ªº]') AND regexp_matches(words[i + 1], '[\\p{{Ll}}ªº]') AND regexp_matches(words[i + 2], '[\\p{{Ll}}ªº]') FOR i IN range(1, len(words) - 1)], true), 0) AS run FROM w),
  k AS (SELECT *, CASE WHEN run > 0 THEN coalesce(list_max([i FOR i IN range(1, run) IF length(trim(words[i], '.,;:!?»«()|''’-')) > 1]), 0) END AS n FROM f),
  c AS (SELECT *, CASE WHEN n IS NULL THEN line ELSE array_to_string(words[1:n], ' ') END AS head, CASE WHEN n IS NULL THEN '' ELSE regexp_replace(array_to_string(words[n + 1:], ' '), '{_BAR}', '') END AS tail FROM k),
  s AS (SELECT *, CASE WHEN ends OR NOT hw THEN 0 WHEN NOT regexp_matches(head, '{_END}') AND tail = '' THEN 1 END AS change FROM c),
  i AS (SELECT *, coalesce(last_value(change IGNORE NULLS) OVER (PARTITION BY book ORDER BY page, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM s),
  h AS (SELECT *, sum(CASE WHEN hw AND NOT inside THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page, no) AS hno, hw OR inside AS in_head,
    CASE WHEN NOT (hw OR inside) THEN line WHEN inside AND (ends OR NOT hw) THEN tail WHEN hw AND NOT inside AND coalesce(change, 0) = 0 THEN tail END AS body_line FROM i),
  p AS (SELECT book, hno, max(struct_pack(page := page, no := no)) FILTER (in_head) AS last_head, coalesce(string_agg(head, ' ' ORDER BY page, no) FILTER (in_head AND head <> ''), '') AS head, coalesce(list(body_line ORDER BY page, no) FILTER (coalesce(body_line, '') <> ''), []) AS body FROM h WHERE hno > 0 GROUP BY book, hno),
  v AS (SELECT *, regexp_matches(head, '(?i){_YOVO}') AND hno > 1 AS is_var FROM p),
  n AS (SELECT *, sum(CASE WHEN is_var THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY hno) AS entry FROM v),
  e AS (SELECT book, entry, arg_min(head, hno) AS kikongo, arg_min(last_head.page, hno) AS page, coalesce(arg_max(regexp_replace(head, '(?i){_YOVO}', ''), hno) FILTER (is_var), '') AS variant, flatten(list(body ORDER BY hno)) AS body FROM n GROUP BY book, entry),
  g AS (SELECT *, coalesce(sum(CASE WHEN len(body) > 0 OR variant <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e),
  entries AS (SELECT book, g::BIGINT AS entry, string_agg(kikongo, ' ' ORDER BY entry) AS kikongo, arg_min(page, entry)::INT AS page, arg_max(variant, entry) AS variant, arg_max(body, entry) AS body FROM g GROUP BY book, g)"""
_THREE = ("pt", "fr", "en")
_RECORDS = f"""{_ENTRIES}, lm AS ({_MODEL}), lines AS (SELECT book, entry, unnest(range(1, len(body) + 1)) AS nth, unnest(body) AS line FROM entries),
  tok AS (SELECT book, entry, nth, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS token FROM lines),
  sc AS (SELECT book, entry, nth, x.lang, sum(coalesce(logp, -12.0)) AS s FROM tok CROSS JOIN (VALUES ('pt'), ('fr'), ('en')) x(lang) LEFT JOIN lm ON lm.lang = x.lang AND lm.token = tok.token GROUP BY 1, 2, 3, 4),
  per AS (SELECT l.book, l.entry, l.nth, {', '.join(f"coalesce(max(s) FILTER (lang = '{x}'), 0) AS {x}" for x in _THREE)} FROM lines l LEFT JOIN sc USING (book, entry, nth) GROUP BY 1, 2, 3),
  cum AS (SELECT book, entry, 0 AS nth, 0.0::DOUBLE AS pt, 0.0::DOUBLE AS fr, 0.0::DOUBLE AS en FROM entries UNION ALL SELECT book, entry, nth, {', '.join(f"sum({x}) OVER (PARTITION BY book, entry ORDER BY nth)" for x in _THREE)} FROM per),
  ab AS (SELECT a.book, a.entry, a.nth AS i, b.nth AS j, round(round(a.pt - a.fr, 6) + round(b.fr - b.en, 6), 6) - 20.0 * ((a.nth = 0)::INT + (a.nth = b.nth)::INT + (b.nth = len(e.body))::INT) AS total FROM cum a JOIN cum b ON a.book = b.book AND a.entry = b.entry AND a.nth <= b.nth JOIN entries e ON e.book = a.book AND e.entry = a.entry),
  best AS (SELECT book, entry, i, j FROM ab QUALIFY row_number() OVER (PARTITION BY book, entry ORDER BY total DESC, i, j) = 1),
  cut AS (SELECT book, entry, kikongo, variant, page, body[1:i] AS pt, body[i + 1:j] AS fr, body[j + 1:] AS en FROM entries JOIN best USING (book, entry)),
  till AS (SELECT *, {', '.join(f"coalesce(list_min([k FOR k IN range(1, len({x}) + 1) IF regexp_matches({x}[k], '{_END}')]), len({x})) AS n_{x}" for x in _THREE)} FROM cut),
  heads AS (SELECT *, {_tidy('kikongo')} AS hk, {_tidy('variant')} AS hv FROM till),
  records AS (SELECT book, entry, CASE WHEN hk = '' THEN '' ELSE regexp_replace(hk, '[ .]+$', '') || '.' END AS kikongo, CASE WHEN hv = '' THEN '' ELSE regexp_replace(hv, '[ .]+$', '') || '.' END AS kikongo_variant,
    {', '.join(f"{_joined(x, f'1:n_{x}')} AS {x}, {_joined(x, f'n_{x} + 1:')} AS {x}_explanation" for x in _THREE)}, page - 2 AS page FROM heads)"""
_FILLED = ", ".join(f"count(*) FILTER ({c} <> '') AS {c}" for x in _THREE for c in (x, f"{x}_explanation"))
ORACLES |= {
    "entries": f"WITH {_ENTRIES} SELECT book, entry, page, kikongo, variant, len(body)::INT AS n_lines FROM entries",
    "proverb_records": f"WITH {_RECORDS} SELECT * FROM records",
    "translation_counts": f"WITH {_RECORDS} SELECT book, count(*) AS n, {_FILLED}, count(*) FILTER (pt <> '' AND fr <> '' AND en <> '') AS complete FROM records GROUP BY book",
    "page_lines": f"SELECT book, page, (i - 1)::INT AS no, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT book, page, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM ({_PAGE})))",
    "headword_harvest": f"SELECT * FROM ({ORACLES['headword_counts']}) WHERE head >= 1 AND def <= 2.0 * head AND NOT regexp_matches(form, '[cjqrx]') AND form NOT IN ({_HARVEST_FR})",
}
# a word list of four columns made of the scanned lines, and its words by column
_CELL = r"rpad(left(coalesce(string_split_regex(regexp_replace(x, '[^a-zA-Z ]', '', 'g'), ' +')[{0}], ''), 11), 12, ' ')"
_LIST_LINES = "[" + " || ".join(_CELL.format(i) for i in (1, 2, 3, 4)) + " FOR x IN body IF x IS NOT NULL]"
ORACLES |= {
    "lexicon_words": f"""WITH p AS (SELECT ocr_pass AS book, rec_id AS page, {_LIST_LINES} AS lines FROM proverbs_ocr WHERE body IS NOT NULL),
      h AS (SELECT *, sum(CASE WHEN page % 3 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY page) AS headed FROM p), s AS (SELECT headed, unnest(lines) AS line FROM h),
      c AS (SELECT lang, unnest(regexp_extract_all(lower(substring(line, at_char, 12)), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS form FROM s CROSS JOIN (VALUES ('English', 1), ('Français', 13), ('Lingala', 25), ('Kikongo', 37)) t(lang, at_char) WHERE headed > 0)
      SELECT lang, form, count(*) AS n FROM c WHERE length(form) >= 3 GROUP BY lang, form HAVING count(*) >= 2""",
}
