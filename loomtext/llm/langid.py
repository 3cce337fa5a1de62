"""Languages of documents and segments: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import clean_id
from ..session import discard, materialize
from .ocr import line_kind, split_marks, with_headers

ORDER = 5
GRAMS = 100_000  # most frequent character n-grams of a language in a model: all that make up over one in GRAMS of its text are among them
CODES = {"kon": "kg", "kng": "kg", "lin": "ln", "swh": "sw", "swa": "sw", "fra": "fr", "fre": "fr", "eng": "en", "por": "pt"}
_NOT = re.compile(r"[^\w'’]+|[\d_]+")
_END = re.compile(r"(?<=[.?!])\s+")


def plain(text: str) -> str:
    """Lower-case letters and apostrophes, words framed by single spaces; empty if there are no letters."""
    s = _NOT.sub(" ", unicodedata.normalize("NFC", text).lower().replace("’", "'")).strip()
    return f" {s} " if s else ""


def sentences(text: str | None) -> list[str]:
    """Sentences end with ``.``, ``?`` or ``!`` followed by white space."""
    return [x for x in _END.split(text.strip()) if x.strip()] if text and text.strip() else []


def label_code(c: Column | str) -> Column:
    """A label as a two-letter code without script suffix; missing, blank and ``und`` are null."""
    c = F.regexp_replace(clean_id(c), r"[_\-].*$", "")
    c = F.coalesce(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[c], c)
    return F.when(~c.isin("und", "", "none", "null", "unk", "zxx", "mul"), c)


BITS = np.uint64(12)  # of a character in a packed n-gram
PAD = "\x02"
STEP = 100_000  # characters that are looked up at once
KEPT = 20  # bits of the place of a kept n-gram


def _packed(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character of the texts, each of which begins with ``order - 1`` pads, and the number of characters of each text."""
    frame = PAD * (order - 1)
    codes = np.frombuffer("".join(frame + t for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64) & np.uint64(0xFFF)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    keys = np.zeros(len(codes), np.uint64)
    for k in range(order):
        keys[k:] |= codes[: len(codes) - k] << np.uint64(12 * k)
    inner = np.ones(len(codes), bool)
    starts = np.cumsum(size + order - 1) - (size + order - 1)
    for k in range(order - 1):
        inner[starts + k] = False
    return keys[inner], size


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (12 * n)) - 1)


def _hashed(keys: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of packed n-grams; different ones never share it."""
    h = (keys | np.uint64(n << 60)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


class Hashes:
    """A sorted array of hashes. A lookup goes to the few that share its first bits."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        bits = max(1, int(len(table)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        self.first = np.append(self.first, len(table))

    def __reduce__(self):
        return Hashes, (self.table,)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not there."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.table):
            return out
        top = (h >> self.shift).astype(np.int64)
        at, end, todo = self.first[top], self.first[top + 1], np.arange(len(h))
        while len(todo):
            open_ = at < end
            at, end, todo, h = at[open_], end[open_], todo[open_], h[open_]
            hit = self.table[at] == h
            out[todo[hit]] = at[hit]
            at, end, todo, h = at[~hit] + 1, end[~hit], todo[~hit], h[~hit]
        return out


Counts = dict[str, tuple[np.ndarray, np.ndarray]]


def count_grams(texts: dict[str, list[str]], order: int = ORDER) -> Counts:
    """Packed n-grams and their numbers by language."""
    return {lang: np.unique(_packed(t, order)[0], return_counts=True) for lang, t in texts.items()}


def _sums(inverse: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(inverse, values[:, k], n) for k in range(values.shape[1])], axis=1)


class Models:
    """Interpolated Kneser-Ney models, one for each language, in two sorted hash arrays for all of them.

    ``grams`` holds the hash of every character n-gram seen in any language with
    its interpolated probability in each; ``contexts`` the weight that each
    language gives the shorter context there.
    """

    def __init__(self, counts: Counts, order: int = ORDER, discount: float = 0.75) -> None:
        self.langs, self.order = sorted(counts), order
        keys: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
        seen: list[np.ndarray] = [np.zeros((0, len(self.langs)))] * (order + 1)
        keys[order] = np.unique(np.concatenate([counts[x][0] for x in self.langs]) if self.langs else keys[order])
        seen[order] = np.zeros((len(keys[order]), len(self.langs)))
        for k, lang in enumerate(self.langs):
            np.add.at(seen[order][:, k], np.searchsorted(keys[order], counts[lang][0]), counts[lang][1])
        for n in range(order - 1, 0, -1):
            # continuation counts: in how many contexts it was seen
            keys[n], inverse = np.unique(keys[n + 1] & _mask(n), return_inverse=True)
            seen[n] = _sums(inverse, (seen[n + 1] > 0).astype(float), len(keys[n]))
        floor = np.full(len(self.langs), 1.0 / (len(keys[1]) + 1))
        prob: list[np.ndarray] = [floor[None, :]]
        grams, logs, contexts, weights = [], [], [], []
        for n in range(1, order + 1):
            context, inverse = np.unique(keys[n] >> BITS, return_inverse=True)
            total, kinds = (_sums(inverse, x, len(context)) for x in (seen[n], (seen[n] > 0).astype(float)))
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = prob[0] if n == 1 else prob[n - 1][np.searchsorted(keys[n - 1], keys[n] & _mask(n - 1))]
            prob.append(np.maximum(seen[n] - discount, 0) / np.maximum(total, 1)[inverse] + back[inverse] * lower)
            grams.append(_hashed(keys[n], n))
            logs.append(prob[n])
            if n > 1:
                contexts.append(_hashed(context, n - 1))
                weights.append(back)
            else:
                self.ctx0 = np.log(back[0] if len(back) else np.ones(len(self.langs))).astype(np.float32)
        self.floor = np.log(floor).astype(np.float32)
        self.grams, self.gram_log = self._pack(grams, logs)
        self.contexts, self.ctx_log = self._pack(contexts, weights)

    @staticmethod
    def _pack(h: list[np.ndarray], values: list[np.ndarray]) -> tuple[Hashes, np.ndarray]:
        h, v = np.concatenate(h), np.concatenate(values)
        order = np.argsort(h)
        return Hashes(h[order]), np.log(np.maximum(v[order], 1e-12)).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy in nats for each character, a column for each language; texts without letters get inf."""
        return self.score_packed(*_packed(texts, self.order))

    def score_packed(self, keys: np.ndarray, size: np.ndarray) -> np.ndarray:
        """:meth:`score` of texts given by :func:`_packed`."""
        out = np.full((len(size), len(self.langs)), np.inf)
        if not len(keys) or not self.langs:
            return out
        log = np.concatenate([self._logs(keys[lo : lo + STEP]) for lo in range(0, len(keys), STEP)])
        some = np.flatnonzero(size)
        out[some] = -np.add.reduceat(log, (np.cumsum(size) - size)[some], axis=0) / size[some, None]
        return out

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams; those met before are kept, one for each place of a table of fixed size."""
        if not hasattr(self, "kept"):
            self.kept = np.zeros(1 << KEPT, np.uint64), np.zeros((1 << KEPT, len(self.langs)), np.float32)
        known, logs = self.kept
        place = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEPT)).astype(np.int64)
        out = logs[place]
        miss = np.flatnonzero(known[place] != keys)
        if len(miss):
            new, inverse = np.unique(keys[miss], return_inverse=True)
            found = self._look_up(new)[inverse]
            out[miss] = found
            logs[place[miss]] = found
            known[place[miss]] = keys[miss]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        log = np.zeros((len(keys), len(self.langs)), np.float32)
        todo = np.arange(len(keys))
        for n in range(self.order, 0, -1):
            own = keys[todo] & _mask(n)
            at = self.grams.find(_hashed(own, n))
            hit = at >= 0
            log[todo[hit]] += self.gram_log[at[hit]]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                break
            if n > 1:
                c = self.contexts.find(_hashed(own >> BITS, n - 1))
                known = c >= 0
                log[todo[known]] += self.ctx_log[c[known]]
            else:
                log[todo] += self.ctx0 + self.floor
        return log


def confidence(score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Posterior of each language from the total log-likelihoods, flattened for long texts, whose characters are not independent."""
    scaled = np.where(np.isfinite(score), -score, -50.0) * np.sqrt(np.maximum(sizes, 1))[:, None]
    e = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def leads(score: np.ndarray) -> np.ndarray:
    """How far the best language leads the next, in nats a character."""
    if score.shape[1] < 2:
        return np.where(np.isfinite(score).all(axis=1), np.inf, 0.0)
    two = np.partition(score, 1, axis=1)[:, :2]
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(two[:, 1] - two[:, 0])


def _of_folds(models: list[Models], texts: list[str], fold: np.ndarray) -> np.ndarray:
    """Scores of texts, each by the model that has not seen its fold."""
    out = np.full((len(texts), len(models[0].langs)), np.inf)
    for k, m in enumerate(models):
        at = np.flatnonzero(fold != k) if len(models) > 1 else np.arange(len(texts))
        if len(at):
            out[at] = m.score([texts[i] for i in at])
    return out


def seed_counts(lexicons: DataFrame, passages: DataFrame, order: int = ORDER) -> Counts:
    """Packed n-grams and their numbers by language, in all lexicon forms and all labelled passages; null and blank ones are left out."""
    # a form that many languages list tells little: it is given to each of them
    parts = [df.select(label_code(label).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null").distinct() for df, label, text in ((lexicons, "lexicon", "form"), (passages, "lang", "text"))]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("l").t:
                if own := [p for t in texts if (p := plain(t))]:
                    k, n = np.unique(_packed(own, order)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": k.view(np.int64), "n": n})

    total = parts[0].union(parts[1]).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return {lang: (part.gram.to_numpy(np.int64).view(np.uint64), part.n.to_numpy()) for lang, part in total.groupby("lang")}


def row_texts(rows: DataFrame, text: str = "trg") -> DataFrame:
    """``tid, seg_no, size, p, fold``: the sentences of each different text (known by its 64-bit hash), their length and their plain form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(tid, k, len(x), plain(x)) for tid, t in zip(pdf.tid, pdf.t) for k, x in enumerate(sentences(t))]
            yield pd.DataFrame(out, columns=["tid", "seg_no", "size", "p"])

    texts = rows.select(F.col(text).alias("t")).where("t is not null").groupBy(F.xxhash64("t").alias("tid")).agg(F.first("t").alias("t"))
    return materialize(texts.mapInPandas(run, "tid long, seg_no int, size int, p string").withColumn("fold", _fold(F.col("p"))))


def _fold(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(2)).cast("int")


def entry_texts(scans: DataFrame, rec_id: str = "rec_id", body: str = "body") -> DataFrame:
    """``rec_id, lines, ps, folds``: the lines of scanned entries that carry text of the entry, and their plain forms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec, lines, heads in zip(pdf.rec_id, pdf.body, map(set, pdf.heads)):
                at = [k for k, x in enumerate(lines) if line_kind(x, k in heads) == "text"]
                if at:
                    out.append((rec, at, [plain(split_marks(lines[k])[1]) for k in at]))
            yield pd.DataFrame(out, columns=["rec_id", "lines", "ps"])

    entries = with_headers(scans.select(F.col(rec_id).alias("rec_id"), F.col(body).alias("body")).where("rec_id is not null and body is not null"))
    schema = T.StructType([T.StructField("rec_id", scans.schema[rec_id].dataType), T.StructField("lines", T.ArrayType(T.IntegerType())), T.StructField("ps", T.ArrayType(T.StringType()))])
    return materialize(entries.select("rec_id", "body", "heads").mapInPandas(run, schema).withColumn("folds", F.transform("ps", _fold)))


_FOUND = ["lang", "confidence", "own", "letters", "lead"]
_FOUND_TYPES = "lang string, confidence double, own double, letters long, lead double"


def _found(models: Models, s: np.ndarray, best: np.ndarray, sizes: np.ndarray) -> list[list]:
    n = np.arange(len(best))
    own = np.where(sizes > 0, s[n, best], 0.0)
    conf = np.where(sizes > 0, confidence(s, sizes)[n, best], 0.0) if len(best) else own
    return [[models.langs[b] for b in best], conf.tolist(), own.tolist(), sizes.tolist(), leads(s).tolist()]


def judge_texts(texts: DataFrame, models: list[Models]) -> DataFrame:
    """``tid, seg_no, size, lang, confidence, own, letters, lead`` of the rows of :func:`row_texts`: the language of lowest cross-entropy, that, and its lead."""
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            s = _of_folds(m, pdf.p.tolist(), pdf.fold.to_numpy())
            cols = _found(m[0], s, s.argmin(axis=1), pdf.p.str.len().to_numpy(np.int64)) if len(pdf) else [[]] * 5
            yield pd.DataFrame({"tid": pdf.tid, "seg_no": pdf.seg_no, "size": pdf["size"], **dict(zip(_FOUND, cols))})

    return materialize(texts.mapInPandas(run, f"tid long, seg_no int, size int, {_FOUND_TYPES}"))


def judge_entries(entries: DataFrame, models: list[Models], change: float = 20.0) -> DataFrame:
    """``rec_id, seg_no, lang, confidence, own, letters, lead`` of the rows of :func:`entry_texts`.

    The lines of an entry are judged in one path, on which a change of language between two lines costs ``change`` nats, about as
    much as ten letters; ``own`` and ``letters`` are those of the whole run of lines in one language, for a short or badly read line has no say of its own.
    """
    shared = entries.sparkSession.sparkContext.broadcast(models)

    def path(total: np.ndarray) -> list[int]:
        cost, back = total[0].copy(), []
        for row in total[1:]:
            stay = cost.min() + change
            back.append(np.where(cost <= stay, np.arange(len(cost)), cost.argmin()))
            cost = np.minimum(cost, stay) + row
        out = [int(cost.argmin())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            flat = [x for ps in pdf.ps for x in ps]
            if not flat:
                continue
            count = pdf.ps.str.len().to_numpy(np.int64)
            s = _of_folds(m, flat, np.concatenate([np.asarray(x) for x in pdf.folds]))
            sizes = np.fromiter(map(len, flat), np.int64, len(flat))
            total = np.where(np.isfinite(s), s * np.maximum(sizes, 1)[:, None], 0.0)
            ends = np.cumsum(count)
            best = np.concatenate([path(total[e - n : e]) for e, n in zip(ends, count)])
            entry = np.repeat(np.arange(len(pdf)), count)
            start = np.ones(len(flat), bool)
            start[1:] = (best[1:] != best[:-1]) | (entry[1:] != entry[:-1])
            of = np.cumsum(start) - 1
            letters = np.bincount(of, sizes).astype(np.int64)
            own = np.bincount(of, total[np.arange(len(flat)), best]) / np.maximum(letters, 1)
            cols = _found(m[0], s, best, sizes)
            cols[2], cols[3] = own[of].tolist(), letters[of].tolist()
            yield pd.DataFrame({"rec_id": pdf.rec_id.to_numpy()[entry], "seg_no": np.concatenate([np.asarray(x) for x in pdf["lines"]]), **dict(zip(_FOUND, cols))})

    schema = T.StructType([entries.schema["rec_id"], *T._parse_datatype_string(f"seg_no int, {_FOUND_TYPES}").fields])
    return materialize(entries.select("rec_id", "lines", "ps", "folds").mapInPandas(run, schema))


def rejected(found: DataFrame, margin: float = 0.25, spread: float = 3.0, slack: float = 1.25, least: int = 20) -> DataFrame:
    """``found`` with ``lang`` ``und`` where the text is none of the languages.

    The limit of a language comes from its own segments (those with a lead of ``margin``), under a model that has not seen them: their median
    cross-entropy, and what they lie above it times the root of their letters, of which the median and ``spread`` times the
    way from there to the upper tenth are taken, so that strange texts among them move nothing. A segment is rejected
    beyond ``slack`` times (the median plus that over the root of its own letters): a limit that is wide for short texts and
    narrows with every letter. A language with fewer than ``least`` such segments rejects nothing; without letters nothing is a language.
    """
    sure = found.where((F.col("lead") > margin) & (F.col("letters") > 0))
    middle = sure.groupBy("lang").agg(F.percentile_approx("own", 0.5, 1_000).alias("middle"), F.count("*").alias("k")).where(F.col("k") >= least)
    rest = (F.col("own") - F.col("middle")) * F.sqrt("letters")
    above = sure.join(F.broadcast(middle), "lang").groupBy("lang", "middle").agg(F.percentile_approx(rest, F.array(F.lit(0.5), F.lit(0.9)), 1_000).alias("q"))
    above = above.select("lang", "middle", (F.col("q")[0] + spread * (F.col("q")[1] - F.col("q")[0])).alias("q"))
    limit = slack * (F.col("middle") + F.greatest("q", F.lit(0.0)) / F.sqrt("letters"))
    j = found.join(F.broadcast(above), "lang", "left")
    return j.withColumn("lang", F.when((F.col("letters") == 0) | (F.col("own") > limit), "und").otherwise(F.col("lang"))).drop("middle", "q")


def row_segments(rows: DataFrame, judged: DataFrame, id_col: str = "row_id", text: str = "trg", label: str = "trg_lang") -> DataFrame:
    """``rec_id, label, seg_no, lang, confidence, text_lang, mixed`` of every sentence.

    ``text_lang`` is the language with most letters and ``mixed`` tells whether there
    is another; equal texts are judged once. Null and blank texts have no rows.
    """
    sizes = judged.where("lang <> 'und'").groupBy("tid", "lang").agg(F.sum("size").alias("w")).groupBy("tid").agg(F.max(F.struct(F.col("w"), F.col("lang"))).alias("top"), F.count("*").alias("k"))
    both = judged.join(sizes, "tid", "left").select("tid", "seg_no", "lang", "confidence", F.coalesce("top.lang", F.lit("und")).alias("text_lang"), (F.coalesce("k", F.lit(0)) > 1).alias("mixed"))
    base = rows.where(F.col(text).isNotNull()).select(F.col(id_col).alias("rec_id"), label_code(label).alias("label"), F.xxhash64(text).alias("tid"))
    return base.join(both, "tid").select("rec_id", "label", "seg_no", "lang", "confidence", "text_lang", "mixed")


def doubtful(segments: DataFrame) -> DataFrame:
    """The sentences of rows whose label is missing, is not the language of the text, or whose text is mixed."""
    return segments.where("label is null or label <> text_lang or mixed")


def _sure_counts(segments: DataFrame, models: list[Models], margin: float, most: int) -> list[Counts]:
    """The most frequent n-grams of each language and fold, as many as ``most`` holds without parting equal ones, from ``p, fold``: segments whose best language leads by ``margin``."""
    shared = segments.sparkSession.sparkContext.broadcast(models)
    langs, order = models[0].langs, models[0].order

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def rows() -> pd.DataFrame:
            out = []
            for (fold, lang), keys in held.items():
                k, n = np.unique(np.concatenate(keys), return_counts=True)
                out.append(pd.DataFrame({"fold": fold, "lang": lang, "gram": k.view(np.int64), "n": n}))
            return pd.concat(out)

        for pdf in batches:
            texts, folds = pdf.p.tolist(), pdf.fold.to_numpy()
            if not texts:
                continue
            packed, sizes = _packed(texts, order)
            s = _of_folds(shared.value, texts, folds) if len(shared.value) > 1 else shared.value[0].score_packed(packed, sizes)
            best = np.repeat(np.where(leads(s) > margin, 2 * s.argmin(axis=1) + folds, -1), sizes)
            for k in np.unique(best[best >= 0]).tolist():
                keys = packed[best == k]
                held.setdefault((k % 2, k // 2), []).append(keys)
                size += len(keys)
            if size > 4_000_000:
                yield rows()
                held, size = {}, 0
        if held:
            yield rows()

    total = materialize(segments.mapInPandas(count, "fold int, lang int, gram long, n long").groupBy("fold", "lang", "gram").agg(F.sum("n").alias("n")))
    # the least number that belongs to the most frequent: from how many n-grams have each number, which are few rows
    upto = F.sum("k").over(Window.partitionBy("fold", "lang").orderBy(F.desc("n")))
    least = total.groupBy("fold", "lang", "n").agg(F.count("*").alias("k")).withColumn("upto", upto).where(F.col("upto") <= most).groupBy("fold", "lang").agg(F.min("n").alias("least"))
    top = total.join(F.broadcast(least), ["fold", "lang"]).where("n >= least")
    got = top.select("fold", "lang", "gram", "n").toPandas()
    discard(total)
    out: list[Counts] = [{}, {}]
    for (fold, lang), part in got.groupby(["fold", "lang"]):
        out[fold][langs[lang]] = part.gram.to_numpy(np.int64).view(np.uint64), part.n.to_numpy()
    return out


def _joined(parts: list[Counts]) -> Counts:
    out: Counts = {}
    for lang in sorted({x for p in parts for x in p}):
        mine = [p[lang] for p in parts if lang in p]
        out[lang] = np.concatenate([k for k, _ in mine]), np.concatenate([n for _, n in mine])
    return out


def fit(segments: DataFrame, lexicons: DataFrame, passages: DataFrame, rounds: int = 1, margin: float = 0.25, most: int = GRAMS) -> list[Models]:
    """Two models for the languages of the lexicons and passages, each fitted on all of them and widened over one half of all segments (``p, fold``).

    In each round every segment is judged by the models so far, and the n-grams of those whose best language leads the
    next by ``margin`` nats a character are counted, by the half that the hash of the segment names. The first model grows by the first
    half and judges the second, and the other way round, so that no segment is ever judged by a model that has seen it. Labels of the segments aren't used:
    they may be wrong. Without a language there is no model. Only the ``most`` most frequent n-grams of a language and half
    reach the driver, so a rare language keeps its own whatever the size of
    the tables.
    """
    seed = seed_counts(lexicons, passages)
    if not seed:
        return []
    models = [Models(seed)]
    for _ in range(rounds):
        grown = _sure_counts(segments, models, margin, most)
        models = [Models(_joined([seed, g])) for g in grown]
    return models


def document_languages(segments: DataFrame) -> DataFrame:
    """``rec_id, lang, confidence, n_segments, mixed``: the language of a whole record, by its segments' confidence."""
    by = segments.where("lang <> 'und'").groupBy("rec_id", "lang").agg(F.sum("confidence").alias("w"), F.count("*").alias("n"))
    return by.groupBy("rec_id").agg(F.max_by("lang", F.struct("w", "lang")).alias("lang"), (F.max("w") / F.sum("n")).alias("confidence"), F.sum("n").alias("n_segments"), (F.count("*") > 1).alias("mixed"))


def segments_of_both(rows: DataFrame, scans: DataFrame, lexicons: DataFrame, passages: DataFrame, text: str = "trg") -> tuple[DataFrame, DataFrame]:
    """:func:`row_segments` of the rows, and ``rec_id, seg_no, lang, confidence`` of the scanned lines, under models fitted on all of them.

    Without any lexicon form and labelled passage every segment is ``und``.
    """
    texts, entries = row_texts(rows, text), entry_texts(scans)
    lines = entries.select(F.explode("ps").alias("p")).select("p", _fold(F.col("p")).alias("fold"))
    segments = materialize(texts.select("p", "fold").union(lines).where("length(p) > 20").distinct())
    models = fit(segments, lexicons, passages)
    discard(segments)
    if not models:
        # nothing names a language, so no text has one
        none = [F.lit("und").alias("lang"), F.lit(0.0).alias("confidence")]
        return row_segments(rows, texts.select("tid", "seg_no", "size", *none), text=text), entries.select("rec_id", F.explode("lines").alias("seg_no"), *none)
    judged = rejected(judge_texts(texts, models))
    return row_segments(rows, judged, text=text), rejected(judge_entries(entries, models)).select("rec_id", "seg_no", "lang", "confidence")
