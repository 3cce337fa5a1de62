"""Same or near-same records across splits: parts of texts that a change leaves as they are meet by their hashes, then an exact check."""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_id
from ..session import discard, materialize

PARTS = 4  # of a text, of which two slips leave two as they are
GRID = np.unique(np.concatenate([[0], np.round(1.33 ** np.arange(75)).astype(np.int64)]))  # letters before and after a changed word that are compared
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29  # size of the filter over the evaluation side's keys: 8 bits a key, 64 MB at most
HOT = 20_000  # training texts of one key that one task takes; more are dealt to several
LEAST = 5  # letters from which a text may be the same as another that isn't equal
SPAN = 64  # letters that a shared span needs at most
CHUNK = 500_000  # letters that are hashed at once

_JOIN = re.compile(r"['’ʼ`´‐‑\-­]")
_JUNK = re.compile(r"[\W_]+")


_ASCII = {i: None if chr(i) in "'`-" else " " if not chr(i).isalnum() else chr(i).lower() for i in range(128)}


def plain_words(text: str) -> str:
    """NFKC, case folding, no punctuation, single spaces."""
    if text.isascii():
        return " ".join(text.translate(_ASCII).split())
    return _JUNK.sub(" ", _JOIN.sub("", unicodedata.normalize("NFKC", text).casefold())).strip()


@F.pandas_udf(T.StringType())
def plain(s: pd.Series) -> pd.Series:
    return pd.Series([plain_words(x) if x is not None else None for x in s], dtype=object)


def _within(starts: list[int], size: int, lo: int, hi: int) -> bool:
    """Whether letters ``lo`` to ``hi`` lie in one word; ``starts``: where the words begin."""
    k = bisect_right(starts, lo) - 1
    return hi <= (starts[k + 1] if k + 1 < len(starts) else size)


def word_starts(text: str) -> tuple[str, list[int]]:
    """A text without spaces, and where its words begin in it."""
    out, at = [], 0
    for w in text.split():
        out.append(at)
        at += len(w)
    return text.replace(" ", ""), out


def one_word_apart(a: str, b: str) -> bool:
    """At most one word added, dropped or replaced, wherever else white space was set or left out."""
    if len(a) > len(b):
        a, b = b, a
    (x, at), (y, bt) = word_starts(a), word_starts(b)
    if x == y:
        return True
    n, more = min(len(x), len(y)), len(y) - len(x)
    p = next((i for i in range(n) if x[i] != y[i]), n)
    s = next((i for i in range(n) if x[-1 - i] != y[-1 - i]), n)
    # the change may slide where its letters are those beside it
    for u in range(p, -1, -1):
        v = max(u, len(x) - s)
        if _within(at, len(x), u, v) and _within(bt, len(y), u, v + more):
            return True
        if v > u:  # the stretch only grows from here
            break
    return False


@F.pandas_udf(T.BooleanType())
def word_slip(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_word_apart(x, y) for x, y in zip(a, b)], dtype=bool)


def same_text(a: str, b: str):
    """A column: ``a`` and ``b`` are the same but for one word or two characters (white space not counted)."""
    tight = [F.regexp_replace(c, " ", "") for c in (a, b)]
    return (F.levenshtein(*tight, 2) >= 0) | word_slip(a, b)


def guaranteed(starts: list[int], size: int) -> int:
    """Letters of the longest span that begins with a word and survives any two slips, a word's change, or a lost space beside either."""

    def later(at: int) -> int:
        k = bisect_right(starts, at) + 1
        return starts[k] if k < len(starts) else size

    lo, hi = 0, size
    while lo < hi:
        x = (lo + hi) // 2
        second = later(x)
        third = later(second + x)
        if size - third <= x:
            hi = x
        else:
            lo = x + 1
    ends = [*starts[1:], size]
    return max(0, min(lo, min(max(u, size - later(v - 1)) for u, v in zip(starts, ends))))


def span_need(starts: list[int], size: int) -> int:
    """The letters that a shared span of a text needs: every text that is the same has one."""
    need = guaranteed(starts, size)
    if need >= 8:
        return min(need, SPAN)
    longest = max(b - a for a, b in zip(starts, [*starts[1:], size]))
    return max(1, min(-(-(size - 2) // 3), -(-(size - longest) // 2)))


def covered(a: str, b: str) -> float:
    """The part of ``a`` that lies in spans shared with ``b``, each at a place that one changed word or two slips can have moved it to."""
    (x, starts), y = word_starts(a), b.replace(" ", "")
    if x == y:
        return 1.0
    need, n = span_need(starts, len(x)), len(x)
    p, q = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (x, y))
    inside = np.zeros(n + 1, np.int64)
    for move in {-2, -1, 0, 1, 2, len(y) - n}:
        lo, hi = max(0, -move), min(n, len(y) - move)
        if hi - lo < need:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], p[lo:hi] == q[lo + move : hi + move], [0]])))
        begin, end = edge[::2] + lo, edge[1::2] + lo
        long = end - begin >= need
        np.add.at(inside, begin[long], 1)
        np.add.at(inside, end[long], -1)
    return float((np.cumsum(inside[:-1]) > 0).mean())


@F.pandas_udf(T.DoubleType())
def coverage_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([covered(x, y) for x, y in zip(a, b)], dtype=float)


_M = (1 << 64) - 1


def _key(kind: int, field: np.ndarray, place: np.ndarray | int, *hashes: np.ndarray) -> np.ndarray:
    """64-bit keys of what stands at a place: ``kind`` 0 a part, 1 two parts, 2 a prefix, 3 a suffix, 4 both."""
    h = field * np.uint64(0xC2B2AE3D27D4EB4F) + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0x165667B19E3779F9 & _M)
    for x in (*hashes, np.uint64(1)):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + x
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Letters:
    """Texts without spaces, and the hash of any of their spans."""

    def __init__(self, norm: list[str], field: np.ndarray) -> None:
        self.tight, self.starts = zip(*map(word_starts, norm))
        self.size = np.fromiter(map(len, self.tight), np.int64, len(norm))
        self.longest = np.array([max(b - a for a, b in zip(s, [*s[1:], n])) for s, n in zip(self.starts, self.size.tolist())], np.int64)
        self.field = field.astype(np.uint64)
        codes = np.frombuffer("".join(self.tight).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.first = np.cumsum(self.size) - self.size
        # which of 64 groups of letters occur an odd number of times: a letter added or dropped changes one bit, a replaced one two
        self.odd = np.bitwise_xor.reduceat(np.uint64(1) << ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)), self.first).view(np.int64)
        # sums of code * base^place: a span's hash is its sum times base^-start, taken by the odd inverse
        base = 0x9E3779B97F4A7C15
        power, self.back = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(codes), np.uint64(x), np.uint64))]) for x in (base, pow(base, -1, 1 << 64)))
        self.run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * power[:-1], dtype=np.uint64)])

    def span(self, r: np.ndarray, lo: np.ndarray | int, hi: np.ndarray | int) -> np.ndarray:
        at = self.first[r] + lo
        return (self.run[self.first[r] + hi] - self.run[at]) * self.back[at]


def _chunks(pdf: pd.DataFrame) -> Iterator[tuple[_Letters, np.ndarray]]:
    """The texts of a batch and their ids, so many at once as ``CHUNK`` letters hold."""
    if len(pdf):
        of = pdf.norm.str.len().cumsum().to_numpy() // CHUNK
        for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(of)) + 1):
            rows = pdf.iloc[part]
            yield _Letters(rows.norm.tolist(), rows.field.to_numpy()), rows.id.to_numpy()


_ROWS = "key long, id long, n int, longest int, odd long, far int"


def _rows(x: _Letters, ids: np.ndarray, r: np.ndarray, key: np.ndarray, far: int = 64) -> pd.DataFrame:
    """``far``: bits of ``odd`` in which a partner by this key may differ."""
    return pd.DataFrame({"key": key.view(np.int64), "id": ids[r], "n": x.size[r].astype(np.int32), "longest": x.longest[r].astype(np.int32), "odd": x.odd[r], "far": np.int32(far)})


def _evaluation_keys(x: _Letters, ids: np.ndarray) -> pd.DataFrame:
    """The keys of texts of the evaluation side; those that only go into the filter have ``far`` -1.

    Any two parts of a text, whole; and for each word, what stands before it and after it, as far as the grid goes.
    """
    r = np.flatnonzero(x.size >= LEAST)
    n, field = x.size[r], x.field[r]
    cuts = [t * n // PARTS for t in range(PARTS + 1)]
    parts = [x.span(r, a, b) for a, b in zip(cuts, cuts[1:])]
    single = [_key(0, field, n * PARTS + t, h) for t, h in enumerate(parts)]
    out = [_rows(x, ids, r, _key(1, field, (n * PARTS + i) * PARTS + j, parts[i], parts[j]), 4) for i in range(PARTS) for j in range(i + 1, PARTS)]
    count = np.fromiter((len(x.starts[k]) for k in r), np.int64, len(r))
    w = np.repeat(r, count)
    lo = np.fromiter((p for k in r for p in x.starts[k]), np.int64, int(count.sum()))
    hi = np.append(lo[1:], 0)
    hi[np.cumsum(count) - 1] = n
    a, b = (GRID[np.searchsorted(GRID, v, "right") - 1] for v in (lo, x.size[w] - hi))
    w, a, b = np.unique(np.stack([w, a, b]), axis=1)
    before, after = x.span(w, 0, a), x.span(w, x.size[w] - b, x.size[w])
    single += [_key(2, x.field[w], a, before), _key(3, x.field[w], b, after)]
    out.append(_rows(x, ids, w, _key(4, x.field[w], (a << 31) + b, before, after)))
    only = np.unique(np.concatenate(single))
    out.append(pd.DataFrame({"key": only.view(np.int64), "id": 0, "n": np.int32(0), "longest": np.int32(0), "odd": 0, "far": np.int32(-1)}))
    return pd.concat(out, ignore_index=True)


def _moves() -> dict[int, list[tuple[int, int, int, int]]]:
    """By how much longer a text is: two parts of the other and their moves in it, where at most two letters are added, dropped or replaced in the other parts."""
    out: dict[int, set] = {}
    for i in range(PARTS):
        for j in range(i + 1, PARTS):
            before, between, after = (range(-2, 3) if some else (0,) for some in (i > 0, j > i + 1, j < PARTS - 1))
            for p in before:
                for q in between:
                    for s in after:
                        if abs(p) + abs(q) + abs(s) <= 2:
                            out.setdefault(p + q + s, set()).add((i, p, j, p + q))
    return {k: sorted(v) for k, v in out.items()}


MOVES = _moves()


def _training_keys(x: _Letters, ids: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
    """The keys of texts of the training side that are in the filter ``bits``; ``sizes`` tells which lengths the evaluation side has."""
    mask = np.uint64(len(bits) * 8 - 1)

    def known(key: np.ndarray) -> np.ndarray:
        low = key & mask
        return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1

    out: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(r: np.ndarray, key: np.ndarray) -> None:
        hit = known(key)
        if hit.any():
            out.append((r[hit], key[hit]))

    for more, moves in MOVES.items():
        n = x.size - more
        r = np.flatnonzero((n >= 0) & (n < len(sizes)) & sizes[np.clip(n, 0, len(sizes) - 1)])
        n = n[r]
        at: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for t, move in {m[k : k + 2] for m in moves for k in (0, 2)}:
            lo, hi = t * n // PARTS + move, (t + 1) * n // PARTS + move
            ok = np.flatnonzero((lo >= 0) & (hi <= x.size[r]))
            h, there = np.zeros(len(r), np.uint64), np.zeros(len(r), bool)
            h[ok] = x.span(r[ok], lo[ok], hi[ok])
            there[ok] = known(_key(0, x.field[r[ok]], n[ok] * PARTS + t, h[ok]))
            at[t, move] = h, there
        for i, p, j, q in moves:
            k = np.flatnonzero(at[i, p][1] & at[j, q][1])
            if len(k):
                keep(r[k], _key(1, x.field[r[k]], (n[k] * PARTS + i) * PARTS + j, at[i, p][0][k], at[j, q][0][k]))
    ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[], []]
    for a in GRID[GRID <= x.size.max()].tolist():
        r = np.flatnonzero(x.size >= a)
        for side, kind in ((0, 2), (1, 3)):
            h = x.span(r, *((0, a) if side == 0 else (x.size[r] - a, x.size[r])))
            there = known(_key(kind, x.field[r], a, h))
            if there.any():
                full, at_all = np.zeros(len(x.size), np.uint64), np.zeros(len(x.size), bool)
                full[r], at_all[r] = h, there
                ends[side].append((a, full, at_all))
    for a, before, has in ends[0]:
        for b, after, too in ends[1]:
            k = np.flatnonzero(has & too & (x.size >= a + b))
            if len(k):
                keep(k, _key(4, x.field[k], (a << 31) + b, before[k], after[k]))
    if not out:
        return _rows(x, ids, np.zeros(0, np.int64), np.zeros(0, np.uint64))
    # a text may have one key by two moves
    return _rows(x, ids, *map(np.concatenate, zip(*out))).drop_duplicates(["key", "id"])


def near_pairs(texts: DataFrame) -> DataFrame:
    """``id_eval, id_train``: pairs of texts that may differ by one word or two letters, all such pairs among them.

    ``texts(id, field, norm, side)`` holds each text once, ``side`` 1 for the
    evaluation side and 0 for training. Texts are taken without their spaces, so white space set or left out changes nothing but
    where words are. Two slips leave two of ``PARTS`` equal parts of the evaluation text as they are, moved by two letters at most: pairs
    of parts meet by their hash, if the letters of the texts are the same but for two. A changed word leaves what stands before and after some word of the evaluation text as the beginning and the end of the
    other: both together meet by their hash, each shortened to a length of ``GRID``, so that the other side need not know the
    words. A filter over the evaluation side's keys drops other keys of the training side before their rows are made, a pair of
    parts only after each part is in it. A key with over ``HOT`` training texts is dealt to several tasks, each with all of its evaluation texts;
    Spark's join holds no key in Python.
    """
    spark = texts.sparkSession

    def evaluation(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, ids in _chunks(pdf):
                yield _evaluation_keys(x, ids)

    ev = materialize(texts.where("side = 1").select("id", "field", "norm").mapInPandas(evaluation, _ROWS))
    lengths = [r["n"] for r in ev.where("far >= 0").select("n").distinct().collect()]
    if not lengths:
        return spark.createDataFrame([], "id_eval long, id_train long")
    sizes = np.zeros(max(lengths) + 1, bool)
    sizes[lengths] = True
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * ev.count()).bit_length()))
    bits = np.zeros(n_bits // 8, np.uint8)
    low = F.col("key").bitwiseAND(n_bits - 1)
    low = low + 1  # the bitmap functions count from 1
    maps = ev.select(F.bitmap_bucket_number(low).alias("bucket"), F.bitmap_bit_position(low).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map"))
    for r in maps.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["map"]), np.uint8)
        bits[at : at + 4096] |= part[: max(0, min(4096, len(bits) - at))]
    shared = spark.sparkContext.broadcast((sizes, bits))

    def training(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            for x, ids in _chunks(pdf):
                yield _training_keys(x, ids, *known)

    tr = materialize(texts.where("side = 0").select("id", "field", "norm").mapInPandas(training, _ROWS).drop("far"))
    # hot keys: the training side is dealt by text, the evaluation side goes to every deal
    hot = materialize(tr.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("key", F.ceil(F.col("k") / HOT).cast("int").alias("deals")))
    t = tr.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("id"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"), F.col("id").alias("id_train"), F.col("n").alias("m"), F.col("longest").alias("word"), F.col("odd").alias("other"))
    e = ev.where("far >= 0").join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)).alias("deal"), F.col("id").alias("id_eval"), "n", "longest", "odd", "far")
    met = e.join(t.hint("merge"), ["key", "deal"]).where("abs(m - n) <= greatest(longest, word, 2) and bit_count(odd ^ other) <= far").where("id_eval <> id_train")
    pairs = materialize(met.select("id_eval", "id_train").distinct())
    for done in (ev, tr, hot):
        discard(done)
    return pairs


def cross_split_overlaps(evaluation: DataFrame, training: DataFrame, eval_id: str = "row_id", train_id: str = "row_id", columns: tuple[str, ...] = ("src", "trg"), coverage: bool = False) -> DataFrame:
    """``eval_row_id, train_row_id[, coverage]``: rows whose text in one of ``columns`` is the same, exactly or almost.

    Same means word for word apart from case, punctuation, white space and
    character forms, with at most one word or two characters changed; texts of fewer than ``LEAST`` letters must be equal. ``coverage`` is the
    part of the evaluation text that lies in shared spans, the greatest of the columns. Each
    different text is looked at once; copies are joined back at the end, so a text
    with very many copies never meets itself. Null and blank texts equal nothing.
    An empty table on either side gives an empty result.
    """
    parts = [df.select(F.col(key).cast("string").alias("row"), F.lit(side).alias("side"), F.lit(i).alias("field"), F.col(c).alias("text")) for df, key, side in ((evaluation, eval_id, 1), (training, train_id, 0)) for i, c in enumerate(columns)]
    rows = functools.reduce(DataFrame.union, parts).where("text is not null").select("row", "side", "field", plain("text").alias("norm")).where("norm <> ''")
    rows = materialize(rows.withColumn("id", F.xxhash64("field", "norm")))
    texts = materialize(rows.groupBy("field", "norm").agg(F.max("side").alias("in_eval"), F.min("side").alias("no_train")).withColumn("id", F.xxhash64("field", "norm")))
    sides = texts.where("in_eval = 1").select("id", "field", "norm", F.lit(1).alias("side")).union(texts.where("no_train = 0").select("id", "field", "norm", F.lit(0).alias("side")))
    # written, so that the joins with the texts are planned with the size that the pairs have
    pairs = near_pairs(sides)
    a = texts.select(F.col("id").alias("id_eval"), F.col("norm").alias("a"))
    b = texts.select(F.col("id").alias("id_train"), F.col("norm").alias("b"))
    near = pairs.join(a, "id_eval").join(b, "id_train").where(same_text("a", "b")).select("id_eval", "id_train", (coverage_of("a", "b") if coverage else F.lit(1.0)).alias("coverage"))
    exact = texts.where("in_eval = 1 and no_train = 0").select(F.col("id").alias("id_eval"), F.col("id").alias("id_train"), F.lit(1.0).alias("coverage"))
    links = materialize(near.union(exact))
    e = rows.where("side = 1").select(F.col("row").cast(evaluation.schema[eval_id].dataType).alias("eval_row_id"), F.col("id").alias("id_eval"))
    t = rows.where("side = 0").select(F.col("row").cast(training.schema[train_id].dataType).alias("train_row_id"), F.col("id").alias("id_train"))
    found = e.join(links, "id_eval").join(t, "id_train").groupBy("eval_row_id", "train_row_id").agg(F.max("coverage").alias("coverage"))
    return found if coverage else found.drop("coverage")


def overlap_report(pairs: DataFrame, evaluation: DataFrame, training: DataFrame, eval_id: str = "row_id", train_id: str = "row_id", split: str = "split", source: str = "origin") -> DataFrame:
    """``split, origin, n_pairs, n_eval_rows, n_train_rows, mean_coverage, least_coverage``; a null source is reported as ``unknown``.

    The coverages are those of the evaluation rows: the part of a row's text that lies in spans shared with its best partner in the source.
    """
    e = evaluation.select(F.col(eval_id).alias("eval_row_id"), F.coalesce(clean_id(split), F.lit("unknown")).alias("split"))
    t = training.select(F.col(train_id).alias("train_row_id"), F.coalesce(clean_id(source), F.lit("unknown")).alias("origin"))
    met = pairs.join(e, "eval_row_id").join(t, "train_row_id")
    rows = met.groupBy("split", "origin", "eval_row_id").agg(F.count("*").alias("n"), F.max("coverage").alias("c")).groupBy("split", "origin").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_eval_rows"), F.avg("c").alias("mean_coverage"), F.min("c").alias("least_coverage"))
    trains = met.groupBy("split", "origin").agg(F.countDistinct("train_row_id").alias("n_train_rows"))
    return rows.join(trains, ["split", "origin"]).select("split", "origin", "n_pairs", "n_eval_rows", "n_train_rows", "mean_coverage", "least_coverage")
