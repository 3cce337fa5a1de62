"""Records out of printed dictionaries: fixed-width columns, headword harvest, and entries of a scanned book."""

from __future__ import annotations

import difflib
import functools
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, align_key, fold, letter_tokens, split_lines, strip, tidy
from ..session import discard, materialize
from .scan import last_before, running_sum

# fixed values: column headings and the spellings a scanner makes of them
COLUMNS = {
    "Français": ["Français", "Francais", "Frangais"],
    "English": ["English"],
    "Lingala": ["Lingala"],
    "Kikongo": ["Kikongo"],
    "Kiswahili": ["Kiswahili"],
    "Tshiluba": ["Tshiluba"],
}
# fixed values: what closes a sentence, a bar at the left edge, a line of marks, the word for another wording, the marks around a word, and the weights of the segmentation
END = r"""[.!?]\s*[»"”’')\]]*\s*$"""
BAR = r"^\s*[|{}\[\]<>]\s*"
NOISE = r"""^[\s|{}\[\]<>\\/_~^`'".,:;!*+=-]*$"""
VARIANT = r"(?iu)^\s*yovo(?![\p{L}\p{N}_])\s*[:;.,-]?\s*"
EDGE = ".,;:!?»«()|'’-"
SMALL_RUN = 3
UNKNOWN_LOGP = -12.0
EMPTY_BLOCK = 20.0
LANGS = ("pt", "fr", "en")
PAGES = 64  # pages of a book that are scanned as one range
RANGE = 4_096  # entries that are numbered as one range
BLOCK = 2_048  # headwords of a block, each of which meets every block of the other reading
BLOCKS = 16  # blocks of a reading; the blocks of larger ones are larger
TILE = 1_024  # headwords whose letters are compared in one product of matrices
CELLS = 1 << 22  # numbers in each factor of that product
ROUNDS = 16  # rounds of close matching whose matches stay in files of their own
STRETCH = 16  # letters of a headword between two looks at what they share


# ---- fixed-width columns


def fixed_width_words(pages: DataFrame, book: str = "book", page: str = "page", text: str = "text", least: int = 2) -> DataFrame:
    """``lang, form, n``: word counts of the columns of a multilingual word list.

    A page is cut at the offsets of its first heading line (which must name
    Lingala and Kikongo and at least four languages); only lines below it count. A page without
    heading takes the offsets of the page before; pages before the first heading are left out.
    """
    lines = pages.select(book, page, F.posexplode(split_lines(text)).alias("no", "line"))
    at = {c: F.coalesce(*[F.when(F.instr("line", a) > 0, F.instr("line", a) - 1) for a in names], F.lit(None).cast("int")) for c, names in COLUMNS.items()}
    found = F.filter(F.array(*[F.struct(p.alias("start"), F.lit(c).alias("lang")) for c, p in at.items()]), lambda x: x.start.isNotNull())
    heads = lines.withColumn("cols", F.array_sort(found)).where((F.size("cols") >= 4) & F.exists("cols", lambda x: x.lang == "Lingala") & F.exists("cols", lambda x: x.lang == "Kikongo"))
    first = heads.groupBy(book, page).agg(F.min_by(F.struct("no", "cols"), "no").alias("h"))
    filled = pages.select(book, page).distinct().join(first, [book, page], "left")
    w = Window.partitionBy(book).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.select(book, page, F.coalesce("h.no", F.lit(-1)).alias("below"), F.last("h.cols", True).over(w).alias("cols")).where("cols is not null")
    body = lines.join(filled, [book, page]).where("no > below").where(strip("line") != "")
    cells = body.select("line", F.explode(F.expr("transform(cols, (c, i) -> struct(c.lang as lang, c.start as a, if(i + 1 < size(cols), try_element_at(cols, i + 2).start, 1000000) as b))")).alias("c"))
    words = cells.select("c.lang", F.explode(letter_tokens(strip(F.expr("substring(line, c.a + 1, c.b - c.a)")))).alias("form"))
    return words.where(F.length("form") >= 3).groupBy("lang", "form").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# ---- headword harvest


def headword_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """``form, head, def``: how often a folded word stands before the first comma of a line as headword, and how often after it."""
    l = lines.select(F.col(line).alias("line"))
    head = l.select(F.regexp_extract("line", r"^(?U:\s){0,3}([\p{L}\p{Nl}\p{No}][\p{L}\p{N}_'-]{1,30}),", 1).alias("w")).where("w <> ''").select(fold("w").alias("form")).where(F.length("form") >= 3)
    head = head.where(~F.col("form").rlike(r"[^\p{L}]")).groupBy("form").agg(F.count("*").alias("head"))
    rest = l.where(F.locate(",", F.col("line")) > 0).select(F.explode(letter_tokens(F.expr("substring(line, locate(',', line) + 1)"))).alias("w"))
    rest = rest.groupBy("w").agg(F.count("*").alias("k")).select(fold("w").alias("form"), "k").where(F.length("form") >= 3).groupBy("form").agg(F.sum("k").alias("def"))
    return head.join(rest, "form", "left").select("form", "head", F.coalesce("def", F.lit(0)).alias("def"))


def harvest_headwords(lines: DataFrame, foreign: DataFrame | None = None, least: int = 1, def_ratio: float = 2.0, keep_implausible: bool = False) -> DataFrame:
    """Headwords seen ``least`` times, not mostly in definitions, not in ``foreign(form)`` and written in the language's own letters."""
    out = headword_counts(lines).where((F.col("head") >= least) & (F.col("def") <= def_ratio * F.col("head")))
    if foreign is not None:
        out = out.join(foreign.select("form").distinct(), "form", "left_anti")
    return out if keep_implausible else out.where(~F.col("form").rlike("[cjqrx]"))


def foreign_vocabulary(*tables: DataFrame) -> DataFrame:
    """``form``: the union of word lists, folded."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.select(fold(F.col(out.columns[0])).alias("form")).where("form <> ''").distinct()


# ---- entries of a scanned book


def clean_lines(pages: DataFrame, book: str = "book", page: str = "page", text: str = "text") -> DataFrame:
    """``book, page, no, line``: lines without a bar at the left, blank lines, marks and page numbers."""
    l = pages.select(F.col(book).alias("book"), F.col(page).alias("page"), F.posexplode(split_lines(text)).alias("no", "line"))
    l = l.withColumn("line", strip(F.regexp_replace("line", BAR, "")))
    return l.where("line <> ''").where(~F.col("line").rlike(NOISE)).where(~F.col("line").rlike(r"^\s*[0-9]{1,3}\s*$"))


def dehyphenate(lines: DataFrame) -> DataFrame:
    """Joins a line to the one before, on the same page, that ends with a hyphen, if it begins with a small letter.

    Whether two lines join depends on their own characters only, so islands of joined lines come from a running sum.
    """
    w = Window.partitionBy("book", "page").orderBy("no")
    joins = F.lag("line").over(w).endswith("-") & F.col("line").rlike(r"^\p{IsLowercase}")
    marked = lines.withColumn("island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    parts = marked.groupBy("book", "page", "island").agg(F.min("no").alias("no"), F.sort_array(F.collect_list(F.struct("no", "line"))).alias("p"))
    text = F.expr("array_join(transform(p, (x, i) -> if(i + 1 < size(p), left(x.line, length(x.line) - 1), x.line)), '')")
    return parts.select("book", "page", "no", text.alias("line"))


def is_headword(c):
    """At least 8 letters, three quarters of them capitals."""
    c = F.col(c) if isinstance(c, str) else c
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    large = F.length(F.regexp_replace(c, r"[^\p{IsUppercase}]", ""))
    return (letters >= 8) & (large >= 0.75 * letters)


def cut_headword(c: str) -> Column:
    """``head, tail`` of a line: the capitals, and the translation that was merged onto it.

    Capitals never make ``SMALL_RUN`` words with small letters in a row, so the first such run is
    translation, together with the words of at most one letter or digit right before it. The flags of all
    words are built once as an array; both cuts are the position of the first value sought in it.
    """
    marks = "".join("\\" + ch for ch in EDGE)
    line = F.col(c)
    words = F.filter(F.split(line, f"{SPACE}+"), lambda w: w != "")
    return F.transform(
        F.array(words),
        lambda ws: F.transform(
            F.array(_first_small_run(ws)),
            lambda at: F.when(at == 0, F.struct(line.alias("head"), F.lit("").alias("tail"))).otherwise(_cut_at(ws, _kept_words(ws, at, marks))),
        )[0],
    )[0]


def _first_small_run(words: Column) -> Column:
    """Where the first ``SMALL_RUN`` words with small letters in a row begin, counted from 1, or 0."""
    small = F.transform(words, lambda w: w.rlike(r"\p{IsLowercase}"))
    runs = F.transform(small, lambda _, i: F.forall(F.slice(small, i + 1, SMALL_RUN), lambda y: y) & (i + SMALL_RUN <= F.size(small)))
    return F.array_position(runs, True)


def _kept_words(words: Column, at: Column, marks: str) -> Column:
    """How many words before word ``at`` are the headword's: all up to the last one of two characters or more."""
    before = F.slice(words, 1, (at - 1).cast("int"))
    long_ = F.reverse(F.transform(before, lambda w: F.length(F.regexp_replace(w, f"^[{marks}]+|[{marks}]+$", "")) > 1))
    back = F.array_position(long_, True)
    return F.when(back == 0, 0).otherwise(at - back).cast("int")


def _cut_at(words: Column, n: Column) -> Column:
    tail = F.array_join(F.slice(words, n + 1, F.size(words)), " ")
    return F.struct(F.array_join(F.slice(words, F.lit(1), n), " ").alias("head"), F.regexp_replace(tail, BAR, "").alias("tail"))


def split_entries(lines: DataFrame) -> DataFrame:
    """``book, entry, page, no, kikongo, variant, body``: the stream of a book's lines cut at every headword.

    A headword may wrap over lines: after an open one everything up to the next
    closing line belongs to it. Each line either closes, opens or keeps that
    state, so the state before a line is the last change before it; entries are
    islands of a running count, and both run over ranges of ``PAGES`` pages (see
    :mod:`scan`), so a book of any length has as many tasks as ranges.
    """
    order = ["page", "no"]
    l = lines.withColumn("c", cut_headword("line")).withColumn("part", F.floor(F.col("page") / PAGES))
    head_line, ends = is_headword("line"), F.col("line").rlike(END)
    opens = head_line & ~ends & ~F.col("c.head").rlike(END) & (F.col("c.tail") == "")
    change = F.when(ends | ~head_line, F.lit(0)).when(opens, F.lit(1))
    l = l.withColumn("hw", head_line).withColumn("change", change)
    l = last_before(l, "book", "part", order, F.col("change"), "state")
    l = l.withColumn("inside", F.coalesce("state", F.lit(0)) == 1)
    closing = ends | ~F.col("hw")
    starts = F.col("hw") & ~F.col("inside")
    # a headword's lines share a number; it stands complete on its closing line, or on a lone line of its own
    l = running_sum(l, "book", "part", order, starts.cast("int"), "hno")
    l = l.withColumn("in_head", F.col("hw") & ~F.col("inside") | F.col("inside"))
    l = l.withColumn("body_line", F.when(~F.col("in_head"), F.col("line")).when(F.col("inside") & closing, F.col("c.tail")).when(starts & (F.col("change").isNull() | (F.col("change") == 0)), F.col("c.tail")))
    l = l.where("hno > 0")
    parts = l.groupBy("book", "hno").agg(
        F.max(F.when(F.col("in_head"), F.struct("page", "no"))).alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("in_head") & (F.col("c.head") != ""), F.struct("page", "no", F.col("c.head").alias("t"))))).alias("h"),
        F.sort_array(F.collect_list(F.when(F.coalesce("body_line", F.lit("")) != "", F.struct("page", "no", F.col("body_line").alias("t"))))).alias("b"),
    )
    e = materialize(parts.select("book", "hno", F.col("last.page").alias("page"), F.col("last.no").alias("no"), F.array_join("h.t", " ").alias("head"), F.col("b.t").alias("body")))
    # a line "Yovo: ..." is another wording of the entry before it, whose body goes on
    e = e.withColumn("is_var", F.col("head").rlike(VARIANT) & (F.col("hno") > 1)).withColumn("part", F.floor(F.col("hno") / RANGE))
    e = running_sum(e, "book", "part", ["hno"], (~F.col("is_var")).cast("int"), "entry")
    e = e.groupBy("book", "entry").agg(
        F.min_by("head", "hno").alias("kikongo"), F.min_by("page", "hno").alias("page"), F.min_by("no", "hno").alias("no"),
        F.max_by(F.when(F.col("is_var"), F.regexp_replace("head", VARIANT, "")), F.when(F.col("is_var"), F.col("hno"))).alias("variant"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("hno", "body"))), lambda x: x.body)).alias("body"),
    )
    return e.withColumn("variant", F.coalesce("variant", F.lit("")))


def merge_bodyless(entries: DataFrame) -> DataFrame:
    """An entry without body and variant is put before the next one's headword, with its page; a last one stays."""
    full = (F.size("body") > 0) | (F.col("variant") != "")
    e = running_sum(entries.withColumn("part", F.floor(F.col("entry") / RANGE)), "book", "part", ["entry"], full.cast("int"), "g", inclusive=False)
    return e.groupBy("book", "g").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry", "kikongo"))), lambda x: x.kikongo), " ").alias("kikongo"),
        F.min_by("page", "entry").alias("page"), F.min_by("no", "entry").alias("no"), F.max_by("variant", "entry").alias("variant"), F.max_by("body", "entry").alias("body"),
    ).withColumnRenamed("g", "entry")


def _blocks(body: list[str], logp: dict[str, dict[str, float]]) -> tuple[int, int]:
    """The cut points of the blocks pt, fr, en with the best total score; the first best in order.

    ``gain[i]`` is what lines 0 to i - 1 gain as pt over fr, ``loss[j]`` what lines 0 to j - 1 gain as fr over
    en. Of all first cuts up to j only the best counts, which is a running maximum, so one pass over the lines does it.
    """
    words = [re.findall(r"[^\W\d_]+", x.lower()) for x in body]
    score = np.array([[sum(logp.get(lang, {}).get(w, UNKNOWN_LOGP) for w in ws) for lang in LANGS] for ws in words]).reshape(len(words), len(LANGS))
    run = np.vstack([np.zeros(len(LANGS)), score.cumsum(axis=0)])
    # rounded, so that equal lines tie whatever the order in which their sums were taken
    gain, loss = np.round(run[:, 0] - run[:, 1], 6), np.round(run[:, 1] - run[:, 2], 6)
    gain[0] -= EMPTY_BLOCK
    loss[-1] -= EMPTY_BLOCK
    first, best = 0, (-np.inf, 0, 0)
    for j in range(len(gain)):
        # an empty block between the cuts costs; otherwise the first cut is the best one before j
        tries = [(round(gain[j] + loss[j] - EMPTY_BLOCK, 6), -j, -j)] + [(round(gain[first] + loss[j], 6), -first, -j)] * (first < j)
        best = max(best, *tries)
        if gain[j] > gain[first]:
            first = j
    return -best[1], -best[2]


def segment_languages(entries: DataFrame, model: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``pt, fr, en``: the body cut into its three blocks. ``model(lang, token, logp)`` is a bounded vocabulary, checked and sent to all tasks."""
    rows = model.where(F.col("lang").isin(*LANGS)).select("lang", "token", "logp").limit(2_000_001).collect()
    if len(rows) > 2_000_000:
        raise ValueError("the language model's vocabulary is too large to be sent to every task")
    logp: dict[str, dict[str, float]] = defaultdict(dict)
    for r in rows:
        logp[r["lang"]][r["token"]] = r["logp"]
    state = entries.sparkSession.sparkContext.broadcast(dict(logp))

    @F.pandas_udf(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))
    def cuts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_blocks(list(x), state.value) if x is not None and len(x) else (0, 0) for x in s], columns=["i", "j"])

    e = entries.withColumn("_c", cuts(body))
    return e.withColumn("pt", F.slice(body, 1, F.col("_c.i"))).withColumn("fr", F.slice(body, F.col("_c.i") + 1, F.col("_c.j") - F.col("_c.i"))).withColumn("en", F.slice(body, F.col("_c.j") + 1, F.size(body) - F.col("_c.j"))).drop("_c")


def split_translation(c: str):
    """The lines through the first that ends a sentence, and the rest; with no such line all is translation. Two columns."""
    cut = F.coalesce(F.array_min(F.filter(F.transform(F.col(c), lambda x, i: F.when(x.rlike(END), i + 1)), lambda x: x.isNotNull())), F.size(c))
    return F.array_join(F.slice(c, 1, cut), " "), F.array_join(F.slice(c, cut + 1, F.greatest(F.size(c) - cut, F.lit(0))), " ")


def tidy_headword(c: str):
    """Tidied, and closed with exactly one full stop; empty stays empty."""
    t = tidy(c)
    return F.when(t == "", "").otherwise(F.concat(F.regexp_replace(t, r"[ .]+$", ""), F.lit(".")))


def records(entries: DataFrame, model: DataFrame, page_offset: int = 2) -> DataFrame:
    """One row for each entry: tidied headword and variant, and translation and explanation in three languages."""
    e = segment_languages(entries, model)
    cols = [x for lang in LANGS for a, b in [split_translation(lang)] for x in (tidy(a).alias(lang), tidy(b).alias(f"{lang}_explanation"))]
    return e.select("book", "entry", tidy_headword("kikongo").alias("kikongo"), tidy_headword("variant").alias("kikongo_variant"), *cols, (F.col("page") - page_offset).alias("page"))


def align_exact(primary: DataFrame, secondary: DataFrame, values: list[str], head: str = "kikongo", order: str = "ordinal") -> DataFrame:
    """``primary`` with ``values`` from the secondary row of the same folded headword, first with first, second with second; ``matched`` tells which."""
    w = Window.partitionBy("key").orderBy(order)
    a = primary.withColumn("key", align_key(F.col(head))).withColumn("nth", F.row_number().over(w))
    b = secondary.withColumn("key", align_key(F.col(head))).withColumn("nth", F.row_number().over(w)).select("key", "nth", F.struct(*values).alias("other"))
    j = a.join(b, ["key", "nth"], "left")
    return j.select(*[F.when(F.col("other").isNotNull(), F.col(f"other.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in primary.columns], F.col("other").isNotNull().alias("matched"), "key", "nth")


def _letter_counts(keys: list[str]) -> np.ndarray:
    """How often each letter is in each key; a sign that is not a to z counts with one of those, which never lowers what two keys share."""
    signs = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32) % 26
    whose = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return np.bincount(whose * 26 + signs, minlength=len(keys) * 26).reshape(len(keys), 26)


def _steps(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A row of ones and zeros for each row of counts, so that the product of two rows is the sum of the lesser counts, each up to ``most``."""
    return np.concatenate([counts[:, c, None] > np.arange(most[c]) for c in range(26)], axis=1).astype(np.float32)


def _tiles(lengths: np.ndarray, at: int, end: int):
    """Ranges of ``TILE`` sorted keys between ``at`` and ``end``, of fewer where the keys are long."""
    while at < end:
        to = min(end, at + TILE)
        while to - at > 1 and (to - at) * lengths[to - 1] > CELLS:
            to = at + (to - at) // 2
        yield at, to
        at = to


def _may_reach(x: list[str], y: list[str], cutoff: float):
    """``i, j`` of the keys of ``x`` and ``y``, both sorted by length, that have letters enough in common for a ratio of ``cutoff``, in the order of ``i`` within a tile."""
    n, m = np.array([len(k) for k in x]), np.array([len(k) for k in y])
    for at, to in _tiles(n, 0, len(x)):
        counts = _letter_counts(x[at:to])
        most = counts.max(axis=0)
        # 2 x common >= cutoff x (n + m), with the lengths as two more columns; the slack is above what single precision can lose
        left = np.column_stack([_steps(counts, most), n[at:to] * (cutoff / 2), np.ones(to - at)]).astype(np.float32)
        first, last = np.searchsorted(m * (2 - cutoff), n[at] * cutoff - 1e-6), np.searchsorted(m * cutoff, n[to - 1] * (2 - cutoff) + 1e-6, "right")
        for start, stop in _tiles(m, first, last):
            right = np.column_stack([_steps(_letter_counts(y[start:stop]), most), -np.ones(stop - start), m[start:stop] * (-cutoff / 2)]).astype(np.float32)
            found = np.nonzero(left @ right.T >= -1e-3 - 1e-6 * (n[to - 1] + m[stop - 1]))
            yield from zip((found[0] + at).tolist(), (found[1] + start).tolist())


def _shares(places: dict[str, int], n: int, y: str, least: int) -> bool:
    """Whether ``y`` and a key of ``n`` letters, whose ``places`` are bits, have a common subsequence of ``least`` letters.

    After some letters of ``y`` all but ``len(y) - least`` of them must have found a partner, at most ``n - least`` places
    further on; most pairs end there.
    """
    full = open_ = (1 << n) - 1
    for at in range(0, len(y), STRETCH):
        for ch in y[at : at + STRETCH]:
            met = open_ & places.get(ch, 0)
            open_ = ((open_ + met) | (open_ - met)) & full
        done = min(at + STRETCH, len(y))
        reach = max(0, min(n, done + n - least))
        if reach - (open_ & ((1 << reach) - 1)).bit_count() < done - len(y) + least:
            return False
    return True


def _close(cutoff: float):
    """A function of a block of left and one of right keys: the pairs whose ``difflib`` ratio reaches ``cutoff``.

    Of every pair the letters in common are counted, then the longest common subsequence, neither of which the
    matched letters of ``difflib`` can exceed; the ratio itself is taken of what is left.
    """

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (sorted(t.column(c).to_pylist(), key=len) for t, c in ((left, "key"), (right, "other")))
        out, matcher, last = [], difflib.SequenceMatcher(), None
        for i, j in _may_reach(x, y, cutoff):
            a, b = x[i], y[j]
            if i != last:
                last, places = i, defaultdict(int)
                for k, ch in enumerate(a):
                    places[ch] |= 1 << k
                matcher.set_seq2(a)
            if not _shares(places, len(a), b, math.ceil(cutoff / 2 * (len(a) + len(b)) - 1e-9)):
                continue
            matcher.set_seq1(b)
            if (ratio := matcher.ratio()) >= cutoff:
                out.append((a, b, ratio))
        return pa.table({"key": pa.array([o[0] for o in out], pa.string()), "other": pa.array([o[1] for o in out], pa.string()), "ratio": pa.array([o[2] for o in out], pa.float64())})

    return pairs


def close_keys(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """``key, other, ratio`` of every two keys of the two tables whose ``difflib`` ratio reaches ``cutoff``.

    Two keys of a language share most short pieces with some other, so what meets by pieces grows as fast as the
    pairs do, and costs more for each. The keys are dealt to blocks instead, and every block of the left table meets
    every block of the right one in a task. Nothing is broadcast, as the planner can't tell the size of what is exploded.
    """
    a, b = left.select("key").distinct(), right.select(F.col("key").alias("other")).distinct()
    rows, cols = (min(BLOCKS, max(1, -(-t.count() // BLOCK))) for t in (a, b))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.select(block("key", rows).alias("i"), every(cols).alias("j"), "key").repartition(rows * cols, "i", "j")
    b = b.select(every(rows).alias("i"), block("other", cols).alias("j"), "other").repartition(rows * cols, "i", "j")
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_close(cutoff), "key string, other string, ratio double")


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that is never a broadcast: files of headwords that recur are small on disk, but not in the driver's memory."""
    return left.join(right.hint("merge"), on, how)


def align_fuzzy(primary: DataFrame, secondary: DataFrame, values: list[str], head: str = "kikongo", order: str = "ordinal", cutoff: float = 0.9) -> DataFrame:
    """Exact alignment, then close matches of at least ``cutoff`` among what is left, each secondary row used once, in the order of the primary.

    A match takes its row from later ones, yet the result is that of going
    through the rows one by one: in a round every open row names its best key
    that has rows left, and the choice stands if fewer open rows before it could want that
    key than it has rows. The first open row always stands, so the rounds end;
    all of them are joins over the close pairs only.
    """
    exact = materialize(align_exact(primary, secondary, values, head, order))
    w = Window.partitionBy("key").orderBy(order)
    used = exact.where("matched").select("key", "nth")
    spare = _joined(secondary.withColumn("key", align_key(F.col(head))).withColumn("nth", F.row_number().over(w)), used, ["key", "nth"], "left_anti").where("key <> ''")
    spare = materialize(spare.select("key", order, *values).withColumn("nth", F.row_number().over(w)))
    rest = exact.where("not matched and key <> ''").select("key", order)
    near = materialize(close_keys(rest, spare, cutoff))
    open_ = materialize(_joined(rest, near, "key").select(F.col(order).alias("o"), "other", "ratio"))
    room = materialize(_joined(spare.groupBy(F.col("key").alias("other")).agg(F.count("*").alias("room")), near.select("other").distinct(), "other"))
    taken = []
    while True:
        wants = _joined(open_, room, "other").withColumn("place", F.row_number().over(Window.partitionBy("other").orderBy("o")))
        best = wants.withColumn("r", F.row_number().over(Window.partitionBy("o").orderBy(F.desc("ratio"), F.desc("other")))).where("r = 1 and place <= room")
        got = materialize(best.select("o", "other"))
        if got.isEmpty():
            break
        taken.append(got)
        left = materialize(_joined(open_, got.select("o"), "o", "left_anti"))
        more = materialize(_joined(room, got.groupBy("other").agg(F.count("*").alias("gone")), "other", "left").select("other", (F.col("room") - F.coalesce("gone", F.lit(0))).alias("room")).where("room > 0"))
        discard(open_)
        discard(room)
        open_, room = left, more
        if len(taken) >= ROUNDS:  # the plan of what is returned stays small, whatever the number of rounds
            one = materialize(functools.reduce(DataFrame.union, taken))
            for x in taken:
                discard(x)
            taken = [one]
    if not taken:
        return exact.select(*primary.columns, "matched")
    hits = functools.reduce(DataFrame.union, taken).withColumn("nth", F.row_number().over(Window.partitionBy("other").orderBy("o")))
    got = _joined(hits, spare.select(F.col("key").alias("other"), "nth", *[F.col(v).alias(f"_{v}") for v in values]), ["other", "nth"]).select(F.col("o").alias("_o"), *[f"_{v}" for v in values])
    j = _joined(exact, got, exact[order] == got["_o"], "left")
    return j.select(*[F.when(F.col("_o").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in primary.columns], (F.col("matched") | F.col("_o").isNotNull()).alias("matched"))
