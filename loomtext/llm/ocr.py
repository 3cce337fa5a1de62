"""Noise in text from scanned pages: line kinds, hyphen evidence, ranked corrections by anagram hash differences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import discard, materialize

MAX_GRAMS = 1_000_000
LONGEST = 64  # letters up to which a word is met by its anagram hash less any two letters or three in a row; longer ones meet by the confusions that were learnt
LEAST, SHARE = 3.0, 0.001  # words, and part of all words with a partner, that must show a confusion before it counts as learnt
PIECE = 3  # letters that a misread piece, and what stood there, may have

MARKS = re.compile(r"^\s*(?:[|¦!_~:;,.·‘'`*^}{\\<>=]{1,3}(?:\s+|$))+")
BREAK = re.compile(r"[^\W\d_†]*[\w†](?:[-‐‑­¬])\s*$")
HYPHEN = "-‐‑\u00ad¬"
ENDS = set(HYPHEN)
COMPOUND = re.compile(rf"[\w†]+(?:[{HYPHEN}]\s*[\w†]+)+")
HEAD = re.compile(rf"[\w†]+(?:[{HYPHEN}][\w†]+)*$")
TAIL = re.compile(rf"\s?([\w†]+(?:[{HYPHEN}][\w†]+)*)")
SEAM = re.compile(rf"[{HYPHEN}]\s*")
TOKEN = re.compile(r"[\w†]+")
LETTER = re.compile(r"[^\W_]")
ONE = re.compile(r"(?<!\w)1[’'](?=[^\W\d])")
NUMBER = re.compile(r"^(?:p\.?|pag\.?|page)?\s*([0-9OoIlSBZ|]{1,5})$", re.I)
ORNAMENT = re.compile(r"^[\s|\[\](){}~_.·—–\-]+|[\s|\[\](){}~_.·—–\-]+$")
SUSPECT = re.compile(r"[^\W0-9ﬀ-ﬆ]*[0-9†ﬀ-ﬆ][\w†]*")
DASHES = re.compile("[‐‑\u00ad¬]")
LIGATURE = re.compile("[†ﬀ-ﬆ]")
EDGE_NUMBER = re.compile(r"^\s*[0-9OoIlSBZ]{1,5}(?:\s{2,}|\s*[—–|.-]\s*)|(?:\s{2,}|\s*[—–|.-][\s—–|.-]*)[0-9OoIlSBZ]{1,5}\s*$")
FINAL = re.compile(r"[.?!…][»”\"')\]]*\s*$|[»)]\s*$")
_LAST_LETTER = re.compile(r"\s+[IVXLCDMivxlcdm1AKMN]{1,4}$|\s+[A-Z]$")


def unaccented(word: str) -> str:
    """Letters without their accents; a letter whose accent is part of its base stays."""
    return word if word.isascii() else "".join(_base(ch) for ch in word)


@lru_cache(100_000)
def _base(ch: str) -> str:
    return unicodedata.normalize("NFD", ch)[0]


def bare(line: str) -> str:
    """The letters and digits of a line without numbers and ornaments at its edges, a last letter or roman number, and accents."""
    s = EDGE_NUMBER.sub("", line.strip())
    s = _LAST_LETTER.sub("", ORNAMENT.sub("", s))
    return "".join(ch for ch in unaccented(s.lower()) if ch.isalnum())


def is_number_line(line: str) -> bool:
    """A page number and its ornaments, nothing else."""
    s = ORNAMENT.sub("", line)
    m = NUMBER.match(s)
    if not m:
        return False
    digits = sum(ch.isdigit() for ch in m.group(1))
    return digits > 0 or (s != line.strip() and len(m.group(1)) > 1)


def header_shaped(line: str, width: int) -> bool:
    """Looks like a running header: short, begins large, and does not end as a sentence, a break or a wrapped line does."""
    s = line.strip()
    first = next((ch for ch in s if ch.isalnum()), "")
    return len(s) < 0.8 * width and bool(first) and (first.isupper() or first.isdigit()) and not FINAL.search(s) and not BREAK.search(s) and len(bare(s)) >= 4


_GRAMS = "transform(sequence(1, length({0}) - 2), i -> substring({0}, i, 3))"


def with_headers(entries: DataFrame, least: int = 3) -> DataFrame:
    """Adds ``heads``: the places of the running headers in each ``body``.

    A running header is a header-shaped line whose bare letters come back in ``least`` entries or more, or one that is
    nearly such a line: it shares three-letter groups with it and is a quarter of its letters away at most. Keys, their
    counts and their likeness are joins, so any number of headers and of misread ones will do. The column
    ``uid`` is a hash of the row; rows that are equal share it.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for uid, body in zip(pdf.uid, pdf.body):
                width = max((len(x) for x in body if x), default=0)
                out += [(uid, k, bare(x)) for k, x in enumerate(body) if x and header_shaped(x, width) and not is_number_line(x)]
            yield pd.DataFrame(out, columns=["uid", "line", "key"])

    entries = entries.withColumn("uid", F.xxhash64(*entries.columns))
    lines = materialize(entries.select("uid", "body").mapInPandas(keys, "uid long, line int, key string"))
    known = lines.groupBy("key").agg(F.countDistinct("uid").alias("n"))
    often = known.where(F.col("n") >= least).select("key")
    few = known.where((F.col("n") < least) & (F.length("key") >= 6)).select("key", F.explode(F.expr(f"array_distinct({_GRAMS.format('key')})")).alias("g"))
    groups = often.where("length(key) >= 6").select(F.col("key").alias("head"), F.explode(F.expr(f"array_distinct({_GRAMS.format('key')})")).alias("g"))
    met = few.join(groups, "g").groupBy("key", "head").agg(F.count("*").alias("k")).where("k >= 0.3 * (length(head) - 2) and abs(length(key) - length(head)) <= 0.2 * length(head)")
    near = met.where("levenshtein(key, head) <= 0.27 * length(head)").select("key")
    found = lines.join(often.union(near).distinct(), "key", "left_semi").groupBy("uid").agg(F.array_distinct(F.collect_list("line")).alias("heads"))
    return entries.join(found, "uid", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<int>")))


def line_kind(line: str | None, is_header: bool) -> str:
    """``blank``, ``margin`` (marks alone), ``page_number``, ``header`` or ``text``."""
    if line is None or not line.strip():
        return "blank"
    if is_number_line(line):
        return "page_number"
    if not LETTER.search(line):
        return "margin"
    return "header" if is_header else "text"


def split_marks(line: str) -> tuple[str, str]:
    """Stray marks of the gutter at the start, and the line without them."""
    m = MARKS.match(line)
    return (m.group(), line[m.end() :]) if m and m.group().strip() else ("", line)


def _plainly_wrong(raw: str, capitals: bool) -> list[int]:
    """Positions of characters that no word of letters holds."""
    if raw.isalpha() and (raw.islower() or raw.isupper() or not capitals) and (raw.isascii() or not LIGATURE.search(raw)):
        return []
    if raw == "0":
        return [0]
    if not re.search(r"[^\W\d_]", raw.replace("†", "")):
        return [i for i, ch in enumerate(raw) if ch == "†"]
    bad = [i for i, ch in enumerate(raw) if ch.isdigit() or ch == "†" or "ﬀ" <= ch <= "ﬆ"]
    if capitals and any(ch.isupper() for ch in raw):
        bad += [i for i, ch in enumerate(raw) if ch.islower()]
    return bad


class Token(NamedTuple):
    """A word of an entry that is more than its letters: the line where it begins, the number of its characters there (-1: all), the line where it ends.

    ``parts``: of a word that was broken, its pieces; ``sure``: that a line's end or white space breaks it, not a hyphen alone.
    ``compound`` tokens are words with hyphens inside, kept for their count only.
    """

    line: int
    cut: int
    after: int
    raw: str
    capitals: bool
    parts: list[str] | None = None
    sure: bool = True
    compound: bool = False


class Entry:
    """Findings ``(line, kind)``, plain words ``(line, words)`` and special tokens of one entry."""

    def __init__(self) -> None:
        self.found: set[tuple[int, str]] = set()
        self.plain: list[tuple[int, list[str]]] = []
        self.special: list[Token] = []

    def words(self, s: str, line: int) -> None:
        """The words of a piece of text; what no word of letters holds is a finding."""
        got = TOKEN.findall(s)
        if got:
            self.plain.append((line, got))
            for raw in got if line < 0 else SUSPECT.findall(s):
                self.check(raw, line, -1, line)
            if "-" in s or DASHES.search(s):
                self.special += [Token(line, -1, line, m.group(), line < 0, compound=True) for m in COMPOUND.finditer(s)]

    def check(self, raw: str, line: int, cut: int, after: int) -> None:
        for at in _plainly_wrong(raw, line < 0):
            self.found.add((after if 0 <= cut <= at else line, "char"))

    def broken(self, token: Token) -> None:
        self.special.append(token)
        self.check(token.raw, token.line, token.cut, token.after)


def entry_tokens(body: list, kikongo: str | None, heads: set[int]) -> Entry:
    """What there is in one entry.

    A word broken over two lines comes joined, with the number of its
    characters that stand in the first; page furniture between the halves is
    skipped over. The headword is line -1.
    """
    out = Entry()
    text: list[tuple[int, str]] = []
    for k, x in enumerate(body):
        kind = line_kind(x, k in heads)
        if kind == "text":
            marks, rest = split_marks(x)
            if marks:
                out.found.add((k, "margin"))
            text.append((k, rest.rstrip()))
        elif kind != "blank":
            out.found.add((k, kind))
    carry = None
    for i, (k, s) in enumerate(text):
        broken = s[-1:] in ENDS and bool(BREAK.search(s))
        if broken:
            out.found.add((k, "hyphen"))
            s = s[:-1]
        if "1" in s and ONE.search(s):
            out.found.add((k, "char"))
        start = 0
        if carry is not None:
            line, head = carry
            m = TAIL.match(s)
            if m:
                out.broken(Token(line, len(head), k, head + m.group(1), False, [head, m.group(1)]))
                start = m.end()
            else:
                out.words(head, line)
            carry = None
        m = HEAD.search(s, start) if broken and i + 1 < len(text) else None
        if m:
            carry = (k, m.group())
        out.words(s[start : m.start() if m else len(s)], k)
    if carry is not None:
        out.words(carry[1], carry[0])
    if kikongo:
        end = 0
        for m in COMPOUND.finditer(kikongo):
            out.words(kikongo[end : m.start()], -1)
            end = m.end()
            sure = any(len(x) > 1 for x in SEAM.findall(m.group()))
            parts = SEAM.split(m.group())
            out.broken(Token(-1, -1, -1, "".join(parts), True, parts, sure))
            if sure:
                out.found.add((-1, "hyphen"))
            else:
                out.special.append(Token(-1, -1, -1, m.group(), True, compound=True))
        out.words(kikongo[end:], -1)
    return out


def spelt(parts: list[str]) -> str:
    """A compound in one spelling: small letters, one kind of hyphen."""
    return SEAM.sub("-", "-".join(parts)).lower()


# ---- anagram hashes


@lru_cache(100_000)
def _value(ch: str) -> int:
    return (ord(ch) % 1009 + 1) ** 5


def anagram_hash(word: str) -> int:
    """The sum of the fifth powers of the characters: equal for anagrams, and a difference names what was exchanged."""
    return sum(map(_value, word))


def reduced_hashes(word: str) -> np.ndarray:
    """The anagram hash of a word without accents, less that of each of its letters, of every two of them, and of every three in a row.

    Two words of which so many letters each must be taken away to make them
    anagrams share one of these, so all differences of the alphabet are met by equality.
    """
    v = np.fromiter(map(_value, unaccented(word)), np.int64, len(word))
    if len(v) > LONGEST:
        return v.sum(keepdims=True)
    gone = [np.zeros(1, np.int64)]
    # a letter of the word must stay, unless it has no other
    if len(v) != 2:
        i, j = _PAIRS.setdefault(len(v), np.triu_indices(len(v), 1))
        gone.append(v[i] + v[j])
    if len(v) > 3:
        gone.append(v[2:] + v[1:-1] + v[:-2])
    return np.unique(v.sum() - np.concatenate([v, *gone]))


_PAIRS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def exchange(word: str, true: str) -> tuple[str, str, bool] | None:
    """What stands in ``word`` for what in ``true`` if that is one piece each of up to ``PIECE`` letters (accents aside), and whether it is inside the word."""
    a, b = unaccented(word), unaccented(true)
    n = min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    s = next((i for i in range(n - p) if a[-1 - i] != b[-1 - i]), n - p)
    x, y = a[p : len(a) - s], b[p : len(b) - s]
    return (x, y, p > 0 and s > 0) if 0 < len(x) + len(y) and max(len(x), len(y)) <= PIECE else None


class Confusions(dict):
    """Log-likelihood of each learnt misreading ``(piece, what stood there)``."""

    def __init__(self, found: dict[tuple[str, str], float] | None = None) -> None:
        super().__init__(found or {})
        self.letters = {ch for a, _ in self for ch in a}, {ch for _, b in self for ch in b}

    def __reduce__(self):
        return Confusions, (dict(self),)


def skeleton(word: str, learnt: list[tuple[str, str]]) -> str:
    """The word without accents with every learnt misreading undone until nothing changes: the same for a word and its misread forms, however many pieces are misread."""
    s = unaccented(word)
    for _ in range(len(s) + 1):
        t = s
        for a, b in learnt:
            t = t.replace(a, b)
        if t == s:
            break
        s = t
    return s


def undone(learnt: Confusions) -> list[tuple[str, str]]:
    """The learnt misreadings in the order of :func:`skeleton`: longer pieces first; of two that undo each other the stronger one, and none that makes a word longer."""
    keep: dict[str, str] = {}
    for (a, b), _ in sorted(learnt.items(), key=lambda x: (-x[1], x[0])):
        if a and b and len(a) >= len(b) and a not in keep and a not in b:
            seen, t = {a}, b
            while t in keep and t not in seen:
                seen.add(t)
                t = keep[t]
            if t not in seen:
                keep[a] = b
    return sorted(keep.items(), key=lambda x: (-len(x[0]), -learnt[x], x))


def misreadings(word: str, true: str, learnt: Confusions, odd: bool = True, most: int = 4) -> tuple[list[tuple[int, bool]], float, bool] | None:
    """Positions in ``word`` where a piece of ``true`` was misread (and whether only its accent), the log-likelihood of that, and whether all of it was learnt; None if nothing explains it.

    Pieces are those of ``learnt``, or, where the word is ``odd``, the one exchange of a letter or two by which the words differ.
    """
    ua, ub = unaccented(word), unaccented(true)
    if len(ua) != len(word) or len(ub) != len(true):
        return None
    n = min(len(ua), len(ub))
    p = next((i for i in range(n) if ua[i] != ub[i]), n)
    e = next((i for i in range(n - p) if ua[-1 - i] != ub[-1 - i]), n - p)
    x, y = ua[p : len(ua) - e], ub[p : len(ub) - e]
    fresh = None
    if odd and 0 < len(x) + len(y) <= (3 if len(word) >= 6 else 2) and abs(len(x) - len(y)) <= 1 and (x, y) not in learnt:
        # what nothing else shows: the one exchange
        accents = [i for i in range(len(word)) if not p <= i < p + len(x) and word[i] != true[i if i < p else i + len(y) - len(x)]]
        fresh = ([(min(p, len(word) - 1), False)] + [(i, True) for i in accents], UNLEARNT + ACCENT * len(accents), False)
    if x or y:
        # pieces have letters on both sides, so what is left over on one of them must be in a piece of that side
        if not x or not y or not set(x) - set(y) <= learnt.letters[0] or not set(y) - set(x) <= learnt.letters[1]:
            return fresh
    by_first: dict[str, list[tuple[str, str, float]]] = {}
    for (a, b), weight in learnt.items():
        if a in ua and b in ub:
            by_first.setdefault(a[0], []).append((a, b, weight))
    best: tuple[float, tuple] | None = None
    stack = [(0, 0, (), 0.0)]
    while stack:
        i, j, ops, score = stack.pop()
        if best is not None and score <= best[0]:
            continue
        if i == len(word) and j == len(true):
            best = (score, ops)
            continue
        if i < len(word) and j < len(true) and ua[i] == ub[j]:
            accent = word[i] != true[j]
            if not accent or len(ops) < most:
                stack.append((i + 1, j + 1, (*ops, (i, True)) if accent else ops, score + (ACCENT if accent else 0.0)))
        if len(ops) < most and i < len(word):
            for a, b, weight in by_first.get(ua[i], []):
                if ua.startswith(a, i) and ub.startswith(b, j):
                    stack.append((i + len(a), j + len(b), (*ops, (i, False)), score + weight))
    if best is not None and best[1]:
        return list(best[1]), best[0], True
    return fresh


ACCENT, UNLEARNT = -3.0, -9.0


def _likely(word: str, n: int, true: str, m: int, ops: list[tuple[int, bool]], name: bool, learnt: bool, odd: bool) -> bool:
    """Whether ``true``, seen ``m`` times, is what ``word``, seen ``n`` times, should be."""
    if all(accent for _, accent in ops):
        return m >= (40 if len(word) <= 2 else 12) * n and m >= (20 if len(word) <= 3 else 5)
    if not learnt:
        # what no other words show must be very plain: odd letters in a word hardly seen beside a very frequent one
        return odd and min(len(word), len(true)) >= 3 and m >= 20 and m >= (500 if len(word) <= 3 else 50) * n
    return m >= 2 * n if name else m >= (15 if len(word) <= 2 else 6) * n and m >= 4


def _trigrams(word: str) -> list[str]:
    s = f"^{word}$"
    return [s[i : i + 3] for i in range(len(s) - 2)]


def rebuilt(word: str, seen: dict[str, int], learnt: Confusions) -> tuple[str, list[int]] | None:
    """For a word without a frequent variant: the repair that turns its unheard-of letter groups into usual ones."""
    own, best = set(_trigrams(word)), None
    for a, b in learnt:
        at = word.find(a) if a and b else -1
        while at >= 0:
            v = word[:at] + b + word[at + len(a) :]
            new = set(_trigrams(v))
            was = min((seen.get(g, 0) for g in own - new), default=0)
            now = min((seen.get(g, 0) for g in new - own), default=0)
            if now >= 4 * max(1, was) and (best is None or now > best[2]):
                best = (v, [at], now)
            at = word.find(a, at + 1)
    return best[:2] if best else None


class Scanned:
    """Everything found out about a table of scanned entries; made by :func:`examine`."""

    def __init__(self, entries: DataFrame, findings: DataFrame, tokens: DataFrame, corrections: DataFrame, kept: DataFrame) -> None:
        self.entries, self.findings, self.tokens, self.corrections, self.kept = entries, findings, tokens, corrections, kept


def hyphen_evidence(tokens: DataFrame, plain: DataFrame) -> DataFrame:
    """``full, hyph``: the broken words whose hyphen is their own.

    ``tokens`` are the special ones, ``plain`` the numbers of all others. For each word that comes broken, the table is asked how often it stands whole and how often with a hyphen
    inside a line. The more frequent form is taken; where neither is ever seen, a word whose
    halves are both words of their own keeps its hyphen. A hyphen of a headword that nothing but itself speaks for stays too.
    """
    compounds = tokens.where("compound").groupBy(F.col("hyph").alias("form"), "capitals").agg(F.count("*").alias("k"))
    forms = plain.select(F.col("word").alias("form"), "capitals", F.col("n").alias("k")).union(compounds)
    broken = tokens.where("hyph is not null and not compound").select(F.col("word").alias("full"), "hyph", "capitals").distinct()
    halves = broken.withColumn("left", F.regexp_extract("hyph", r"([^-]+)-[^-]+$", 1)).withColumn("right", F.regexp_extract("hyph", r"([^-]+)$", 1))
    for c, name in (("full", "whole"), ("hyph", "split"), ("left", "n_left"), ("right", "n_right")):
        halves = halves.join(forms.select(F.col("form").alias(c), "capitals", F.col("k").alias(name)), [c, "capitals"], "left").fillna(0, [name])
    return halves.where("split > whole or (split = 0 and whole = 0 and n_left >= 2 and n_right >= 2 and length(left) > 1 and length(right) > 1)").select("full", "hyph", "capitals")


def learn_confusions(met: DataFrame) -> dict[bool, Confusions]:
    """Log-likelihoods of the misreadings that the table shows, for headwords (True) and for the body (False).

    ``met(word, capitals, n, true, m)`` are words beside much more frequent ones. Each word is explained by the
    exchanges that lead to its partners, at first by each alike, then by each as often as
    the first count has it; an exchange counts as learnt if it explains ``LEAST`` words and ``SHARE`` of all, has letters on both sides and isn't
    bound to the words' ends, as endings of a language are. There are at most 1 / ``SHARE`` of them.
    """

    @F.pandas_udf("a string, b string, inner boolean")
    def exchanged(w: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exchange(x, y) or (None, None, None) for x, y in zip(w, t)], columns=["a", "b", "inner"])

    pairs = materialize(met.where("m >= 6 * n and m >= 4").withColumn("x", exchanged("word", "true")).where("x.a is not null").select("word", "capitals", "x.*").distinct())
    by_word = Window.partitionBy("word", "capitals")
    first = pairs.withColumn("w", 1 / F.count("*").over(by_word)).groupBy("capitals", "a", "b").agg(F.sum("w").alias("c0"))
    again = pairs.join(first, ["capitals", "a", "b"]).withColumn("w", F.col("c0") / F.sum("c0").over(by_word))
    counts = again.groupBy("capitals", "a", "b").agg(F.sum("w").alias("c"), F.sum(F.when(F.col("inner"), F.col("w")).otherwise(0.0)).alias("inside"))
    counts = counts.join(F.broadcast(counts.groupBy("capitals").agg(F.sum("c").alias("all"))), "capitals")
    rows = counts.where((F.col("c") >= F.greatest(F.lit(LEAST), SHARE * F.col("all"))) & (F.col("inside") >= 0.25 * F.col("c")) & (F.col("a") != "") & (F.col("b") != "")).collect()
    discard(pairs)
    out: dict[bool, Confusions] = {}
    for capitals in (True, False):
        own = {(r["a"], r["b"]): r["c"] for r in rows if r["capitals"] == capitals}
        total = sum(own.values())
        out[capitals] = Confusions({k: float(np.log(c / total)) for k, c in own.items()})
    return out


def examine(scans: DataFrame, rec_id: str = "rec_id", headword: str = "kikongo", body: str = "body") -> Scanned:
    """Reads every entry twice: for its running headers, then for its tokens; and finds the corrections of its words.

    Corrections come from a join: every word meets the more frequent words from which it differs by a few letters
    on each side, through anagram hashes less those letters; from these pairs the
    confusions of the scanner are learnt. Words misread in several places meet by their skeletons, in which
    all learnt confusions are undone. The best ranked partner that explains a word piece by piece and is
    many times as frequent is taken. Counts, words and candidates cover the
    whole table. Null ids are left out, null bodies and headwords hold nothing.
    """
    spark = scans.sparkSession
    entries = with_headers(scans.select(F.col(rec_id).alias("rec_id"), F.col(headword).alias("kikongo"), F.coalesce(body, F.array().cast("array<string>")).alias("body")).where("rec_id is not null"))

    id_type = to_arrow_type(scans.schema[rec_id].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rec, kik, body, heads in zip(*(c.to_pylist() for c in batch.columns)):
                e = entry_tokens(body, kik, set(heads))
                out += [(rec, line, -1, line, words, None, False, True, None) for line, words in e.plain]
                out += [(rec, line, -1, line, None, None, False, True, kind) for line, kind in e.found]
                out += [(rec, t.line, t.cut, t.after, [t.raw], spelt(t.parts or [t.raw]), t.compound, t.sure, None) for t in e.special]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 9, (id_type, *ints, pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_(), pa.string()))], names=names)

    ints, names = (pa.int32(),) * 3, ["rec_id", "line", "cut", "after", "raws", "hyph", "compound", "sure", "kind"]
    text = T.StringType()
    types = [scans.schema[rec_id].dataType, *[T.IntegerType()] * 3, T.ArrayType(text), text, T.BooleanType(), T.BooleanType(), text]
    found = materialize(entries.select("rec_id", "kikongo", "body", "heads").mapInArrow(read, T.StructType([T.StructField(n, t) for n, t in zip(names, types)])))
    found = found.withColumn("capitals", F.col("line") < 0)
    special = found.where("hyph is not null").withColumn("raw", F.col("raws")[0]).withColumn("word", F.lower("raw"))
    plain_tokens = found.where("raws is not null and hyph is null").withColumn("raw", F.explode("raws")).withColumn("word", F.lower("raw"))
    large = F.col("raw").rlike(r"^\p{Lu}").alias("large")

    def counted(tokens: DataFrame, n: Column) -> DataFrame:
        return tokens.groupBy("word", "capitals").agg(n.alias("n"), F.min("large").alias("large"))

    whole = materialize(counted(plain_tokens.select("word", "capitals", large), F.count("*")))
    kept = materialize(hyphen_evidence(special, whole))
    broken = special.where("not compound").join(kept.withColumn("keep", F.lit(True)), [special.word == kept.full, special.hyph == kept.hyph, special.capitals == kept.capitals], "left").select(special["*"], F.coalesce("keep", F.lit(False)).alias("keep"))
    findings = found.where("kind is not null").select("rec_id", "line", "kind").union(broken.where("not keep and not sure").select("rec_id", "line", F.lit("hyphen")))
    cols = ["rec_id", "line", "cut", "after", "raw", "word", "capitals"]
    # a word that keeps its hyphen is as many words as it has pieces, the last one on the line where it ends
    pieces = broken.where("keep").select("rec_id", "after", "line", "capitals", F.posexplode(F.split("hyph", "-")).alias("at", "word"), F.size(F.split("hyph", "-")).alias("k"))
    pieces = pieces.withColumn("line", F.when(F.col("at") + 1 == F.col("k"), F.col("after")).otherwise(F.col("line"))).select("rec_id", "line", F.lit(-1).alias("cut"), F.col("line").alias("after"), F.col("word").alias("raw"), "word", "capitals")
    tokens = plain_tokens.select(*cols).union(broken.where("not keep").select(*cols)).union(pieces)
    # a headword's words also count as words of the body, where the same language is quoted
    words = whole.union(counted(broken.where("not keep").select("word", "capitals", large).union(pieces.select("word", "capitals", large)), F.count("*")))
    words = words.union(words.where("capitals").select("word", F.lit(False), "n", F.lit(False)))
    vocab = materialize(words.groupBy("word", "capitals").agg(F.sum("n").alias("n"), F.min("large").alias("name")))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes = [reduced_hashes(w) for w in pdf.word]
            if hashes:
                at = np.repeat(np.arange(len(pdf)), np.fromiter(map(len, hashes), np.int64, len(hashes)))
                yield pdf.iloc[at].assign(h=np.concatenate(hashes))

    plain = "not word rlike '[0-9†]'"
    bags = materialize(vocab.where("not word rlike '^[0-9]+$'").mapInPandas(reduce, "word string, capitals boolean, n long, name boolean, h long"))
    frequent = bags.where(f"n >= 2 and {plain}").select(F.col("word").alias("true"), "capitals", F.col("n").alias("m"), "h")
    enough = "m >= if(name, 2, 6) * n and word <> `true`"
    met = materialize(bags.join(frequent, ["h", "capitals"]).where(enough).select("word", "capitals", "n", "name", "true", "m").distinct())
    discard(bags)
    learnt = learn_confusions(met)
    shared = spark.sparkContext.broadcast((learnt, {c: undone(x) for c, x in learnt.items()}))

    @F.pandas_udf(T.StringType())
    def boned(w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([skeleton(x, shared.value[1][bool(y)]) for x, y in zip(w, c)])

    @F.pandas_udf("at array<int>, score double")
    def explain(w: pd.Series, n: pd.Series, v: pd.Series, m: pd.Series, c: pd.Series, names: pd.Series, odd: pd.Series) -> pd.DataFrame:
        out = []
        for word, k, true, count, cap, name, strange in zip(w, n, v, m, c, names, odd):
            got = misreadings(word, true, shared.value[0][bool(cap)], strange and count >= 20 and count >= 50 * k)
            ok = got and _likely(word, k, true, count, got[0], name, got[2], strange)
            out.append(([at for at, _ in got[0]], got[1] + float(np.log(count))) if ok else (None, None))
        return pd.DataFrame(out, columns=["at", "score"])

    grouped = F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word)), i -> substring(concat('^', word, '$'), i, 3))"))).alias("g")
    groups = vocab.where("length(word) >= 2").select("word", "capitals", "n", grouped)
    own = groups.groupBy("capitals", "g").agg(F.sum("n").alias("all"), F.max(F.struct("n", "word")).alias("top")).where("2 * top.n >= all")
    odd = own.select(F.col("top.word").alias("word"), "capitals", F.lit(True).alias("odd")).distinct()
    bones = vocab.where("not word rlike '^[0-9]+$'").withColumn("bone", boned("word", "capitals"))
    clean = bones.where(f"n >= 2 and {plain}").select(F.col("word").alias("true"), "capitals", F.col("n").alias("m"), "bone")
    far = bones.join(clean, ["bone", "capitals"]).where(enough).select("word", "capitals", "n", "name", "true", "m")
    fit = met.union(far).distinct().join(odd, ["word", "capitals"], "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    fit = fit.withColumn("x", explain("word", "n", "true", "m", "capitals", "name", "odd")).where("x.at is not null").select("word", "capitals", "true", "x.*")
    rank = Window.partitionBy("word", "capitals").orderBy(F.desc("score"), "true")
    joined = materialize(fit.withColumn("r", F.row_number().over(rank)).where("r = 1").select("word", "capitals", "true", "at"))
    discard(met)
    # names (words never seen in small letters) without such a variant: judged by the letter groups of all names
    seen = {}
    named = vocab.where(f"name and length(word) >= 4 and {plain}")
    grams = materialize(named.select("capitals", "n", grouped).groupBy("capitals", "g").agg(F.sum("n").alias("n")))
    if grams.count() > MAX_GRAMS:
        raise ValueError("the names have too many letter groups to be sent to every task")
    for r in grams.toLocalIterator():
        seen.setdefault(r["capitals"], {})[r["g"]] = r["n"]
    discard(grams)
    known = spark.sparkContext.broadcast(seen)

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for word, cap in zip(pdf.word, pdf.capitals):
                got = rebuilt(word, known.value.get(cap, {}), shared.value[0][bool(cap)])
                if got:
                    out.append((word, cap, *got))
            yield pd.DataFrame(out, columns=["word", "capitals", "true", "at"])

    left = named.join(joined.select("word", "capitals"), ["word", "capitals"], "left_anti")
    corrections = materialize(joined.union(left.select("word", "capitals").mapInPandas(rebuild, joined.schema)))
    return Scanned(entries, findings, tokens, corrections, broken.where("keep").select("rec_id", "hyph", "capitals").distinct())


def damage(scanned: Scanned) -> DataFrame:
    """``rec_id, line_no, kind``: each damaged line with its kinds of damage, once each."""
    wrong = scanned.tokens.join(scanned.corrections, ["word", "capitals"]).select("rec_id", "line", "cut", "after", F.explode("at").alias("p"))
    wrong = wrong.select("rec_id", F.when((F.col("cut") >= 0) & (F.col("p") >= F.col("cut")), F.col("after")).otherwise(F.col("line")).alias("line_no"), F.lit("char").alias("kind"))
    return scanned.findings.select("rec_id", F.col("line").alias("line_no"), "kind").union(wrong).distinct()


def repaired(scanned: Scanned) -> DataFrame:
    """``rec_id, headword, text``: each entry as continuous text without page furniture and marks, words joined and corrected; hyphens that the table speaks for stay."""
    fixes = scanned.tokens.select("rec_id", "word", "capitals").join(scanned.corrections, ["word", "capitals"]).distinct()
    fixes = fixes.groupBy("rec_id").agg(F.collect_list(F.struct("word", "capitals", "true")).alias("fixes"))
    kept = scanned.kept.groupBy("rec_id").agg(F.collect_list(F.struct("hyph", "capitals")).alias("kept"))

    @F.pandas_udf(T.StructType([T.StructField("headword", T.StringType()), T.StructField("text", T.StringType())]))
    def build(kik: pd.Series, body: pd.Series, heads: pd.Series, fix: pd.Series, keep: pd.Series) -> pd.DataFrame:
        out = []
        for k, lines, at, f, own in zip(kik, body, heads, fix, keep):
            table = {(x["capitals"], x["word"]): x["true"] for x in f} if f is not None else {}
            stay = {(x["capitals"], x["hyph"]) for x in own} if own is not None else set()

            def mend(s: str, cap: bool) -> str:
                def one(m: re.Match) -> str:
                    raw = m.group()
                    true = table.get((cap, raw.lower()))
                    if true is None:
                        return raw
                    return true.upper() if cap or raw.isupper() and len(raw) > 1 else true.capitalize() if raw[:1].isupper() else true
                return TOKEN.sub(one, s)

            def seam(m: re.Match) -> str:
                parts = SEAM.split(m.group())
                return ("-" if (True, spelt(parts)) in stay else "").join(parts)

            heads_at, text = set(at), ""
            for i, x in enumerate(lines):
                if line_kind(x, i in heads_at) == "text":
                    s = split_marks(x)[1].strip()
                    if text.endswith("\0"):
                        text = text[:-1]
                        a, b = HEAD.search(text[:-1]), TAIL.match(s)
                        if not (a and b and (False, spelt([a.group(), b.group(1)])) in stay):
                            text = text[:-1]
                    text += s + "\0" if BREAK.search(s) else s + " "
            if text.endswith("\0"):
                text = text[:-2]
            out.append((mend(re.sub(r"\s+", " ", COMPOUND.sub(seam, k)).strip(), True) if k is not None else None, mend(re.sub(r"\s+", " ", text).strip(), False)))
        return pd.DataFrame(out, columns=["headword", "text"])

    e = scanned.entries.join(fixes, "rec_id", "left").join(kept, "rec_id", "left").withColumn("x", build("kikongo", "body", "heads", "fixes", "kept"))
    return e.select("rec_id", "x.headword", "x.text")
