"""Sentence alignment in bilingual documents by entropic optimal transport with null masses."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_id, strip
from ..session import materialize

DIM = 1 << 12
UNKNOWN = 0.35
MAX_TABLE = 2_000_000
DENSE = 1_440_000  # sentence pairs up to which a document's costs are one table
BLOCK = 1_000
SLIGHT = 1e-5
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")


def words(text: str | None) -> list[str]:
    """Lower-cased words and numbers."""
    return [] if not text else _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def _slot(feature: str) -> int:
    h = 0xCBF29CE484222325
    for b in feature.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 31)) % DIM


class Vectors:
    """Sentence vectors of both languages in the space of the target language's words.

    A source word stands for its translations (each with its probability), a
    number for itself, and a word without translation for itself and for its
    letter trigrams, so that a name, respelled or not, meets its likeness.
    Words are weighted by their rarity in the document collection.
    """

    def __init__(self, table: dict[str, list[tuple[str, float]]], rarity_src: dict[str, float], rarity_trg: dict[str, float], most: float) -> None:
        self.table, self.src, self.trg, self.most = table, rarity_src, rarity_trg, most
        self.known = {t for v in table.values() for t, _ in v}
        self.phrases: dict[str, int] = {}  # first word -> words of the longest entry of several words that begins so
        for entry in table:
            if " " in entry:
                first, size = entry.split(" ", 1)[0], entry.count(" ") + 1
                self.phrases[first] = max(size, self.phrases.get(first, 0))
        self.cache: dict[tuple[bool, str], tuple[list[int], list[float]]] = {}

    def _own(self, w: str, weight: float) -> list[tuple[int, float]]:
        if w.isdigit():
            return [(_slot("#" + w), weight)]
        framed = f"^{w}$"
        grams = [framed[i : i + 3] for i in range(len(framed) - 2)]
        return [(_slot("=" + g), weight / np.sqrt(len(grams))) for g in grams]

    def features(self, raw: str, source: bool) -> tuple[list[int], list[float]]:
        """Slots and weights of a word; one that is neither translatable nor a name or a number can hardly meet its partner and weighs little."""
        got = self.cache.get((source, raw))
        if got is None:
            w = raw.lower()
            common = self.src if source else self.trg
            dull = 1.0 if w.isdigit() or raw[0].isupper() and w not in common else UNKNOWN
            if source:
                weight = max(self.src.get(x, self.most) for x in w.split(" "))
                if w in self.table:
                    norm = np.sqrt(sum(p * p for _, p in self.table[w]))
                    got = [(_slot("w" + t), weight * p / norm) for t, p in self.table[w]]
                else:
                    got = self._own(w, weight * dull)
            else:
                weight = self.trg.get(w, self.most)
                got = [(_slot("w" + w), weight)] if w in self.known else self._own(w, weight * dull)
            got = [slot for slot, _ in got], [x for _, x in got]
            if len(self.cache) < 500_000:
                self.cache[(source, raw)] = got
        return got

    def units(self, s: str, source: bool) -> list[str]:
        """The words of a sentence; in the source language, entries of several words stand for them, the longest first."""
        out = _WORD.findall(s if s.isascii() else unicodedata.normalize("NFKC", s))
        if not source or not self.phrases:
            return out
        low, phrases, found, free = [w.lower() for w in out], self.phrases, {}, 0
        for i, w in enumerate(low):
            if w in phrases and i >= free:
                for n in range(min(phrases[w], len(low) - i), 1, -1):
                    if " ".join(low[i : i + n]) in self.table:
                        found[i], free = n, i + n
                        break
        if not found:
            return out
        merged, i = [], 0
        while i < len(out):
            n = found.get(i, 1)
            merged.append(" ".join(out[i : i + n]) if n > 1 else out[i])
            i += n
        return merged

    def slots(self, sentences: list[str | None], source: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentence, slot and weight of each feature; a slot may come more than once."""
        cols, weights, owner, sizes, cached = [], [], [], [], self.cache
        for k, s in enumerate(sentences):
            # a word said again says less: its weight grows with the square root of its number
            units = self.units(s, source) if s else []
            for w, n in Counter(units).items():
                slots, own = cached.get((source, w)) or self.features(w, source)
                cols += slots
                weights += own if n == 1 else [x * n**0.5 for x in own]
                owner.append(k)
                sizes.append(len(slots))
        return np.repeat(np.array(owner, np.int64), np.array(sizes, np.int64)), np.array(cols, np.int64), np.array(weights, np.float32)

    def matrices(self, srcs: list[str | None], trgs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of both sides, with a column for each slot that the document uses."""
        a, b = self.slots(srcs, True), self.slots(trgs, False)
        used, col = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
        k = len(used)
        return tuple(np.bincount(rows * k + c, w, n * k).reshape(n, k) for (rows, _, w), c, n in ((a, col[: len(a[1])], len(srcs)), (b, col[len(a[1]) :], len(trgs))))


def _dense(slots: tuple[np.ndarray, np.ndarray, np.ndarray], lo: int, hi: int) -> np.ndarray:
    """The vectors of sentences ``lo`` to ``hi``, a row for each."""
    rows, cols, weights = slots
    part = slice(np.searchsorted(rows, lo), np.searchsorted(rows, hi))
    m = np.zeros((hi - lo, DIM), np.float32)
    np.add.at(m, (rows[part] - lo, cols[part]), weights[part])
    return m


def transport(cost: np.ndarray, mass_a: np.ndarray, mass_b: np.ndarray, null_cost: float, reg: float = 0.03, rounds: int = 2_000, close: float = 1e-6) -> np.ndarray:
    """The entropic plan between two sets of masses where either side may leave mass to a null partner at ``null_cost``.

    A null row and a null column hold the other side's whole mass, so that any
    sentence may stay alone; Sinkhorn scaling of exp(-cost / reg), until the rows' masses are met to ``close`` of all mass (the columns' are met exactly).
    """
    n, m = cost.shape
    full = np.full((n + 1, m + 1), null_cost)
    full[:n, :m] = cost
    full[n, m] = 0.0
    k = np.exp(-full / reg)
    kt = np.ascontiguousarray(k.T)
    a, b = np.append(mass_a, mass_b.sum()), np.append(mass_b, mass_a.sum())
    u, v = np.ones(n + 1), np.ones(m + 1)
    kv = k @ v
    for t in range(rounds):
        u = a / np.maximum(kv, 1e-300)
        v = b / np.maximum(kt @ u, 1e-300)
        kv = k @ v
        if t % 4 == 3 and np.abs(u * kv - a).sum() <= close * a.sum():
            break
    return (u[:, None] * k * v[None, :])[:n, :m]


def transport_many(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], null_cost: float, reg: float = 0.03, rounds: int = 2_000, close: float = 1e-6) -> list[np.ndarray]:
    """:func:`transport` of many small documents at once, those of about one size together; what a document lacks of that size has no mass."""
    plans: list[np.ndarray] = [np.zeros((0, 0))] * len(parts)
    by_size: dict[int, list[int]] = {}
    for i, (cost, _, _) in enumerate(parts):
        by_size.setdefault(-(-(max(cost.shape) + 1) // 8) * 8, []).append(i)
    for size, every in by_size.items():
        step = max(1, 2_000_000 // (size * size))
        for lo in range(0, len(every), step):
            some = every[lo : lo + step]
            k, a, b = np.zeros((len(some), size, size)), np.zeros((len(some), size)), np.zeros((len(some), size))
            for at, i in enumerate(some):
                cost, mass_a, mass_b = parts[i]
                n, m = cost.shape
                k[at, :n, :m] = np.exp(-cost / reg)
                k[at, :n, m] = k[at, n, :m] = np.exp(-null_cost / reg)
                k[at, n, m] = 1.0
                a[at, :n], a[at, n], b[at, :m], b[at, m] = mass_a, mass_b.sum(), mass_b, mass_a.sum()
            kt = np.ascontiguousarray(k.transpose(0, 2, 1))
            done_u, done_v = np.zeros_like(a), np.zeros_like(b)
            left = np.arange(len(some))
            kv = k.sum(axis=2)
            for t in range(rounds):
                u = a[left] / np.maximum(kv, 1e-300)
                v = b[left] / np.maximum((kt @ u[:, :, None])[:, :, 0], 1e-300)
                kv = (k @ v[:, :, None])[:, :, 0]
                if t % 4 == 3 or t + 1 == rounds:
                    met = np.abs(u * kv - a[left]).sum(axis=1) <= close * a[left].sum(axis=1)
                    if met.any() or t + 1 == rounds:
                        out = met | (t + 1 == rounds)
                        done_u[left[out]], done_v[left[out]] = u[out], v[out]
                        left, k, kt, kv = left[~out], k[~out], kt[~out], kv[~out]
                        if not len(left):
                            break
            for at, i in enumerate(some):
                n, m = parts[i][0].shape
                plans[i] = done_u[at, :n, None] * np.exp(-parts[i][0] / reg) * done_v[at, None, :m]
    return plans


def sparse_transport(x: np.ndarray, y: np.ndarray, cost: np.ndarray, mass_a: np.ndarray, mass_b: np.ndarray, null_cost: float, reg: float = 0.03, rounds: int = 2_000, close: float = 1e-6) -> np.ndarray:
    """:func:`transport` where only the pairs ``x, y`` have a finite ``cost``; the mass of each of them."""
    n, m = len(mass_a), len(mass_b)
    k, null = np.exp(-cost / reg), np.exp(-null_cost / reg)
    v, v0 = np.ones(m), 1.0
    kv, kv0 = np.bincount(x, k * v[y], n) + null * v0, null * v.sum() + v0
    for t in range(rounds):
        u, u0 = mass_a / np.maximum(kv, 1e-300), mass_b.sum() / max(kv0, 1e-300)
        v, v0 = mass_b / np.maximum(np.bincount(y, k * u[x], m) + null * u0, 1e-300), mass_a.sum() / max(null * u.sum() + u0, 1e-300)
        kv, kv0 = np.bincount(x, k * v[y], n) + null * v0, null * v.sum() + v0
        if t % 4 == 3 and np.abs(u * kv - mass_a).sum() + abs(u0 * kv0 - mass_b.sum()) <= close * (mass_a.sum() + mass_b.sum()):
            break
    # as in the dense form, the last word is the columns'
    return u[x] * k * v[y]


def _costs(dot: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    sim = dot / np.maximum(np.outer(na, nb), 1e-9)
    # how much of the smaller vector lies in the larger one: a part of a joined sentence counts whole
    part = dot / np.maximum(np.minimum.outer(na * na, nb * nb), 1e-9)
    return 1 - np.clip(0.5 * sim + 0.5 * np.minimum(part, 1.0), 0, 1)


def _near(a: tuple, b: tuple, na: np.ndarray, nb: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a cost up to ``most``, block by block."""
    out = []
    blocks = [(j, _dense(b, j, min(j + BLOCK, len(nb)))) for j in range(0, len(nb), BLOCK)] if len(nb) <= 8 * BLOCK else None
    for i in range(0, len(na), BLOCK):
        left = _dense(a, i, min(i + BLOCK, len(na)))
        for j, right in blocks or ((j, _dense(b, j, min(j + BLOCK, len(nb)))) for j in range(0, len(nb), BLOCK)):
            cost = _costs(left @ right.T, na[i : i + BLOCK], nb[j : j + BLOCK])
            x, y = np.nonzero(cost <= most)
            out.append(((x + i).astype(np.int32), (y + j).astype(np.int32), cost[x, y]))
    return tuple(np.concatenate(z) for z in zip(*out))


def _of_one(own: np.ndarray, other: np.ndarray, share: np.ndarray, mass_own: np.ndarray, mass_other: np.ndarray) -> np.ndarray:
    """Links to keep: a sentence smaller than all its partners is a part of one of them only."""
    keep = np.ones(len(own), bool)
    order = np.argsort(own, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        if len(at) > 1 and (mass_own[own[at[0]]] < 0.7 * mass_other[other[at]]).all():
            keep[at] = share[at] == share[at].max()
    return keep


def links(srcs: list, trgs: list, vec: Vectors, null_cost: float = 0.62, floor: float = 0.25, dense: int = DENSE, reg: float = 0.03) -> list[tuple[int, int, float]]:
    """Positions of ``srcs`` and ``trgs`` that translate each other, with the share of mass moved.

    Blank elements link nothing. Masses are the lengths of the vectors, so a
    joined sentence has room for both its partners; each link of the plan takes
    the part of the sentence that it covers, and the groups of the plan (one
    with many, many with one) give the merges and splits, what stays with the null
    partner the omissions.

    A document of over ``dense`` pairs is transported whole as well, on those
    pairs that can take mass: in the plan, pair x null pair = what both leave to
    null x exp((null_cost - cost) / reg), and the null pair holds the matched
    mass, so all pairs of a sentence left out here have at most SLIGHT x (mass
    of the other side / matched mass) of its mass.
    """
    return links_of_many([(srcs, trgs)], vec, null_cost, floor, dense, reg)[0]


def links_of_many(documents: list[tuple[list, list]], vec: Vectors, null_cost: float = 0.62, floor: float = 0.25, dense: int = DENSE, reg: float = 0.03) -> list[list[tuple[int, int, float]]]:
    """:func:`links` of each document; the small ones are transported together."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in documents]
    small = []
    for at, (srcs, trgs) in enumerate(documents):
        si = [i for i, x in enumerate(srcs) if x and _WORD.search(x)]
        ti = [j for j, x in enumerate(trgs) if x and _WORD.search(x)]
        if not si or not ti:
            continue
        if len(si) * len(ti) <= dense:
            a, b = vec.matrices([srcs[i] for i in si], [trgs[j] for j in ti])
            ma, mb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            small.append((at, si, ti, _costs(a @ b.T, np.sqrt(ma), np.sqrt(mb)), ma, mb))
        else:
            a, b = vec.slots([srcs[i] for i in si], True), vec.slots([trgs[j] for j in ti], False)
            na, nb = (np.sqrt(np.concatenate([(_dense(z, i, min(i + BLOCK, n)) ** 2).sum(axis=1) for i in range(0, n, BLOCK)])) for z, n in ((a, len(si)), (b, len(ti))))
            ma, mb = na * na, nb * nb
            scale = ma.sum() + mb.sum()
            x, y, cost = _near(a, b, na, nb, null_cost - reg * np.log(SLIGHT))
            share = sparse_transport(x, y, cost, ma / scale, mb / scale, null_cost / 2, reg) / np.minimum(ma[x], mb[y]) * scale
            taken = share > floor
            x, y, share = x[taken], y[taken], share[taken]
            order = np.lexsort((y, x))
            out[at] = _parted(si, ti, x[order], y[order], share[order], ma, mb)
    scales = [ma.sum() + mb.sum() for *_, ma, mb in small]
    plans = transport_many([(cost, ma / z, mb / z) for (_, _, _, cost, ma, mb), z in zip(small, scales)], null_cost / 2, reg)
    for (at, si, ti, _, ma, mb), z, plan in zip(small, scales, plans):
        share = plan / np.minimum.outer(ma, mb) * z
        x, y = np.nonzero(share > floor)
        out[at] = _parted(si, ti, x, y, share[x, y], ma, mb)
    return out


def _parted(si: list[int], ti: list[int], x: np.ndarray, y: np.ndarray, share: np.ndarray, ma: np.ndarray, mb: np.ndarray) -> list[tuple[int, int, float]]:
    for own, other, m_own, m_other in ((1, 0, mb, ma), (0, 1, ma, mb)):
        at = (x, y)
        keep = _of_one(at[own], at[other], share, m_own, m_other)
        x, y, share = x[keep], y[keep], share[keep]
    return [(si[i], ti[j], float(s)) for i, j, s in zip(x, y, share)]


def _rarity(sentences: DataFrame, rare: int) -> tuple[dict[str, float], int]:
    """Logarithm of n / df of the words in over one of ``rare`` sentences; there are at most ``rare`` x mean length of them."""
    total = sentences.count()
    w = sentences.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}'’]+|\p{N}+"), F.lit(0)))).alias("w"))
    got = w.groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") > max(1, total // rare))
    return {r["w"]: float(np.log(total / r["df"])) for r in got.toLocalIterator()}, total


def dictionary_table(dictionary: DataFrame, src: str = "src", trgs: str = "trgs") -> dict[str, list[tuple[str, float]]]:
    """Source word, or words with a space between them -> the target words, each with an equal part; a target of several words gives its part to each of them.

    Null and blank entries are left out.
    """
    e = dictionary.select(strip(F.lower(src)).alias("s"), F.explode(trgs).alias("t")).select("s", strip(F.lower("t")).alias("t")).where("s <> '' and t <> ''").distinct()
    rows = e.limit(MAX_TABLE + 1).collect()
    if len(rows) > MAX_TABLE:
        raise ValueError("the dictionary is too large to be sent to every task")
    found: dict[str, set[str]] = {}
    for r in rows:
        if key := " ".join(words(r["s"])):
            found.setdefault(key, set()).add(r["t"])
    return {s: sorted({w: 1.0 / len(ts) for t in sorted(ts) for w in words(t)}.items()) for s, ts in found.items()}


def align_documents(documents: DataFrame, dictionary: DataFrame, id_col: str = "id", srcs: str = "srcs", trgs: str = "trgs", rare: int = 5_000) -> DataFrame:
    """``id, src_index, trg_index, share, kind`` of every pair of sentences that translate each other.

    ``kind`` is ``one`` (1:1), ``split`` (a source sentence with several
    targets), ``merge`` (several sources in one target) or ``many``. Ids are compared
    trimmed and in lower case; a repeated id counts once (its least row); a
    null id, a null list and blank elements link nothing. Every document is
    aligned by itself in one pass over the data, so there is no shuffle but the
    one that drops repeated rows. The dictionary is checked for size and sent to
    all tasks, as are the weights of the common words, of which there is a bounded number.
    """
    docs = documents.select(clean_id(id_col).alias("id"), F.col(srcs).alias("srcs"), F.col(trgs).alias("trgs")).where("id is not null and srcs is not null and trgs is not null")
    docs = materialize(docs.groupBy("id").agg(F.min(F.struct("srcs", "trgs")).alias("x")).select("id", "x.srcs", "x.trgs"))
    rs, n = _rarity(docs.select(F.explode("srcs").alias("s")), rare)
    rt, m = _rarity(docs.select(F.explode("trgs").alias("s")), rare)
    state = documents.sparkSession.sparkContext.broadcast((dictionary_table(dictionary), rs, rt, float(np.log(max(3, min(rare, max(n, m)))))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vec = Vectors(*state.value)
        for pdf in batches:
            out = []
            for key, found in zip(pdf.id, links_of_many(list(zip(map(list, pdf.srcs), map(list, pdf.trgs))), vec)):
                rows, cols = {}, {}
                for x, y, _ in found:
                    rows[x], cols[y] = rows.get(x, 0) + 1, cols.get(y, 0) + 1
                out += [(key, x, y, s, {(False, False): "one", (True, False): "split", (False, True): "merge"}.get((rows[x] > 1, cols[y] > 1), "many")) for x, y, s in found]
            yield pd.DataFrame(out, columns=["id", "src_index", "trg_index", "share", "kind"])

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("src_index", T.IntegerType()), T.StructField("trg_index", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("kind", T.StringType())])
    return docs.repartition("id").mapInPandas(run, schema)
