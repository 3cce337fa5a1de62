"""Evaluation passages inside a corpus: one Aho-Corasick automaton over normalised items, one pass over the text."""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_LETTERS = 120_000_000  # letters of items that one automaton takes; more are dealt to several, each with a scan of its own

_DROP = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalnum())
_LOWER = bytes(ord(chr(c).lower()) if c < 128 else c for c in range(256))
_JUNK = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_HYPHEN = re.compile(r"[-\u00ad\u2010\u2011][^\S\r\n]*[\r\n]\s*|\u00ad")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def _cp1252(ch: str) -> int | None:
    try:
        return ch.encode("cp1252")[0]
    except UnicodeEncodeError:
        return ord(ch) if ord(ch) < 256 else None


_HIGH = {chr(c): c for c in range(128, 256)} | {ch: b for ch in map(chr, range(0x152, 0x2123)) if (b := _cp1252(ch)) is not None}
_LEAD = "".join(ch for ch, b in _HIGH.items() if 0xC2 <= b <= 0xF4)
_TAIL = "".join(ch for ch, b in _HIGH.items() if 0x80 <= b <= 0xBF)
_BROKEN = re.compile(f"[{re.escape(_LEAD)}][{re.escape(_TAIL)}]{{1,3}}")


def _unbreak(m: re.Match) -> str:
    raw = bytes(_HIGH[ch] for ch in m.group())
    for end in range(len(raw), 1, -1):
        try:
            return raw[:end].decode("utf-8") + m.group()[end:]
        except UnicodeDecodeError:
            continue
    return m.group()


def repair(text: str) -> str:
    """Turns entities and UTF-8 that was read as a single-byte encoding back into characters."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    return text if text.isascii() else _BROKEN.sub(_unbreak, text)


def squeeze(text: str) -> str:
    """Lower-case letters and digits only: no accents, punctuation or white space."""
    text = repair(text)
    if text.isascii():
        return text.encode("ascii").translate(_LOWER, _DROP).decode("ascii")
    text = unicodedata.normalize("NFKD", text)
    plain = text.encode("ascii", "ignore")
    if len(plain) < len(text) and any(ch.isalnum() for ch in set(text) if ch > "\x7f"):
        return _JUNK.sub("", text.casefold())
    return plain.translate(_LOWER, _DROP).decode("ascii")


def squeeze_with_offsets(text: str) -> tuple[str, list[int]]:
    """The squeezed text and, for each of its characters, the offset in ``text``."""
    out, at = [], []
    pos = 0
    for m in [*re.finditer(rf"{_ENTITY.pattern}|{_BROKEN.pattern}", text), None]:
        stop = m.start() if m else len(text)
        for k in range(pos, stop):
            for ch in squeeze(text[k]):
                out.append(ch)
                at.append(k)
        if m:
            for ch in squeeze(m.group()):
                out.append(ch)
                at.append(m.start())
            pos = m.end()
    return "".join(out), at


class Words:
    """Where the words of a text start in its squeezed form; found when first asked for."""

    def __init__(self, body: str, size: int) -> None:
        self.body, self.size, self.starts = body, size, None

    def _read(self) -> list[int]:
        if self.starts is None:
            text = repair(self.body)
            if not text.isascii():
                text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
            self.starts, self.broken, pos, end = [], set(), 0, 0
            for m in _WORD.finditer(text):
                between = text[end : m.start()]
                if not self.starts or not _HYPHEN.fullmatch(between):
                    self.starts.append(pos)
                    if "\n" in between or "\r" in between:
                        self.broken.add(pos)
                pos += len(m.group() if m.group().isascii() else _JUNK.sub("", m.group().casefold()))
                end = m.end()
            self.known = {*self.starts, self.size}
        return self.starts

    def after(self, q: int, c: int) -> int:
        """The end of the ``c``-th word from ``q`` on; a line break may stand inside one of them."""
        starts = self._read()
        a = bisect_left(starts, q)
        c += any(s in self.broken and s > q for s in starts[a : a + c + 1])
        return starts[a + c] if a + c < len(starts) else self.size

    def before(self, q: int, c: int) -> int:
        """The start of the ``c``-th word back from ``q``; a line break may stand inside one of them."""
        starts = self._read()
        b = bisect_right(starts, q) - 1
        c += any(s in self.broken and s < q for s in starts[max(0, b - c) : b + 1])
        return starts[b - c] if b >= c else 0

    def whole(self, first: int, stop: int) -> bool:
        self._read()
        return first in self.known and stop in self.known


class Items:
    """Items with one automaton over their word n-grams.

    A passage of half of an item's words, H, with at most ``slips`` changed words
    leaves one unchanged run of at least (H - slips) / (slips + 1) words; every
    run of that many words of the item is a pattern.
    """

    def __init__(self, items: list[tuple[int, str]], slips: int = 2) -> None:
        import ahocorasick

        self.slips = slips
        self.words: list[list[str]] = []
        self.ids: list[int] = []
        self.need: list[int] = []
        self.text: list[str] = []
        self.start: list[list[int]] = []
        found: dict[str, list[tuple[int, int]]] = {}
        self.size: list[int] = []
        for item_id, text in items:
            words = [w for w in (squeeze(x) for x in re.split(r"[\W_]+", unicodedata.normalize("NFC", repair(text or "")))) if w]
            if not words:
                continue
            k = len(self.ids)
            need = -(-len(words) // 2)
            n = max(1, -(-(need - slips) // (slips + 1))) if need > slips else need
            start = [0]
            for w in words:
                start.append(start[-1] + len(w))
            self.ids.append(item_id)
            self.words.append(words)
            self.need.append(need)
            self.size.append(n)
            self.text.append("".join(words))
            self.start.append(start)
            for i in self._seeds(words, n, need):
                found.setdefault("".join(words[i : i + n]), []).append((k, i))
        self.auto = ahocorasick.Automaton()
        for pattern, at in found.items():
            self.auto.add_word(pattern, (len(pattern), at))
        if found:
            self.auto.make_automaton()
        self.empty = not found

    def _seeds(self, words: list[str], n: int, need: int) -> list[int]:
        """Where the patterns of an item begin: every run of ``n`` words; of single words only so many, the longest, that every passage of ``need`` words holds more of them than may be changed."""
        if n > 1 or need <= self.slips + 1:
            return list(range(len(words) - n + 1))
        room, taken = [0] * (len(words) - need + 1), []
        for i in sorted(range(len(words)), key=lambda i: (-len(words[i]), i)):
            over = range(max(0, i - need + 1), min(i, len(words) - need) + 1)
            if any(room[x] <= self.slips for x in over):
                taken.append(i)
                for x in over:
                    room[x] += 1
        return sorted(taken)

    def _gap(self, k: int, i: int, c: int, q: int, step: int, marks: Words) -> int:
        """The farthest character up to which the words of the document in the place of words ``i``, ... (``c`` of them) may reach from ``q``."""
        room = sum(len(w) + max(4, len(w) // 2) for w in (self.words[k][i + step * x] for x in range(c)))
        return max(q + room, marks.after(q, c)) if step > 0 else max(0, min(q - room, marks.before(q, c)))

    def _reach(self, k: int, i: int, doc: str, p: int, step: int, marks: Words, slips: int) -> list[tuple[int, int]]:
        """From word ``i`` of item ``k`` at ``p`` on (or back): most words, and their characters, taken with up to 0, 1, ... changed words.

        Changed words, also adjacent ones, stand for as many words of the document,
        whatever their length; every place where the item may go on is tried.
        """
        words, q, taken = self.words[k], p, 0
        last = len(words) if step > 0 else -1
        while i != last:
            w = words[i]
            if not (doc.startswith(w, q) if step > 0 else q >= len(w) and doc.startswith(w, q - len(w))):
                break
            q += step * len(w)
            taken += 1
            i += step
        out = [(taken, abs(q - p))]
        for c in range(1, slips + 1):
            out.append(out[-1])
            if (last - i) * step <= c:
                continue
            w, end = words[i + step * c], self._gap(k, i, c, q, step, marks)
            at = doc.find(w, q, end + len(w)) if step > 0 else doc.find(w, max(0, end - len(w)), q)
            while at >= 0:
                start = at if step > 0 else at + len(w)
                rest = self._reach(k, i + step * c, doc, start, step, marks, slips - c)
                stop = start + step * rest[0][1]
                # a few letters count only where they are words of the document
                if rest[0][1] > 3 or marks.whole(min(start, stop), max(start, stop)):
                    for d, (n, size) in enumerate(rest):
                        while len(out) <= c + d:
                            out.append(out[-1])
                        out[c + d] = max(out[c + d], (taken + c + n, abs(start - p) + size), key=lambda x: (x[0], -x[1]))
                at = doc.find(w, at + 1, end + len(w)) if step > 0 else doc.find(w, at + 1, q)
        return out

    def find(self, doc: str, body: str) -> dict[int, tuple[int, int, int]]:
        """Item index -> (words, first, last character) of the longest passage of at least half of the item's words in ``doc``, the squeezed ``body``."""
        best: dict[int, tuple[int, int, int]] = {}
        if self.empty:
            return best
        done: dict[tuple[int, int], int] = {}
        marks = Words(body, len(doc))
        for end, (length, at) in self.auto.iter(doc):
            first = end + 1 - length
            if length <= 3 and not marks.whole(first, end + 1):
                continue
            for k, i in at:
                line = (k, first - self.start[k][i])
                if done.get(line, -1) >= end:
                    continue
                left = self._reach(k, i - 1, doc, first, -1, marks, self.slips)
                right = self._reach(k, i + self.size[k], doc, end + 1, 1, marks, self.slips)
                done[line] = end + right[0][1]
                # changes that are left over may stand at the ends of the passage
                words, lo, hi = max((min(a[0] + self.size[k] + b[0] + self.slips - x - y, len(self.words[k])), first - a[1], end + 1 + b[1]) for x, a in enumerate(left) for y, b in enumerate(right) if x + y <= self.slips)
                if words >= self.need[k] and words > best.get(k, (0, 0, 0))[0]:
                    best[k] = (words, lo, hi)
        return best


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slips: int = 2, offsets: bool = False) -> DataFrame:
    """``item_id, doc_id[, n_words, start, stop]``: each document that holds at least half of an item's words as one passage.

    The items are the held-out set. Their letters are counted first; up to ``ITEM_LETTERS`` of them make one automaton,
    which is built once and broadcast, and every document is read once, whole, without a shuffle. More items are dealt by hash to as many
    automata as they need, each with a scan of the documents. Only rows with a finding leave a
    scan. Letter case, accents, punctuation and any white space are ignored,
    entities and broken encodings are undone, and up to ``slips`` words of the
    passage may be changed. ``start, stop`` are offsets into the original text.
    Null or empty texts hold nothing; repeated items are found each; copies of
    a document are found each; an empty item table gives an empty result.
    """
    spark = documents.sparkSession
    held = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("t")).where("id is not null and t <> ''").distinct()
    letters = held.agg(F.sum(F.length("t"))).first()[0] or 0
    deals = max(1, -(-letters // ITEM_LETTERS))
    schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])

    def scanned(deal: int) -> DataFrame:
        own = held if deals == 1 else held.where(F.pmod(F.xxhash64("id", "t"), F.lit(deals)) == deal)
        shared = spark.sparkContext.broadcast(Items(sorted((r[0], r[1]) for r in own.toLocalIterator()), slips))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            auto = shared.value
            for pdf in batches:
                rows = []
                for doc, body in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                    if not body:
                        continue
                    found = auto.find(squeeze(body), body)
                    if found and offsets:
                        at = squeeze_with_offsets(body)[1]
                        rows += [(auto.ids[k], doc, w, at[min(lo, len(at) - 1)], at[min(hi, len(at)) - 1] + 1) for k, (w, lo, hi) in found.items()]
                    else:
                        rows += [(auto.ids[k], doc, w, None, None) for k, (w, lo, hi) in found.items()]
                if rows:
                    yield pd.DataFrame(rows, columns=["item_id", "doc_id", "n_words", "start", "stop"]).astype({"start": "Int64", "stop": "Int64"})

        return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).mapInPandas(scan, schema)

    found = functools.reduce(DataFrame.union, map(scanned, range(deals)))
    return found if offsets else found.select("item_id", "doc_id").distinct()
