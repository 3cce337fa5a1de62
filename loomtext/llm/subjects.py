"""Subject areas of documents: distributed latent Dirichlet topics, mapped to subjects by their top terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_id
from ..session import discard, marks_of, materialize

WORD = re.compile(r"[^\W\d_]{2,}")
RARE = 2_000  # a term must be in one of RARE documents (at most RARE x mean distinct terms are), or in three that are labelled with one subject
SLICES = 6
MAX_SUBJECTS = 200
MAX_STATE = 1 << 29  # bytes of the weights of terms x topics, which the driver holds and every task reads
BLOCK_BYTES = 1 << 20  # of the sums of one task that travel as one row
FAN = 100  # tasks whose sums are added in one place, and such places that are added in one place


def term_bags(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, terms, counts``: the words of each document as 64-bit hashes (those of SQL's ``xxhash64``), each once, with its count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        class Known(dict):
            def __missing__(self, w: str) -> int:
                h = xxhash.xxh64_intdigest(w, 42)
                h = h - (1 << 64) if h >= 1 << 63 else h
                if len(self) < 500_000:
                    self[w] = h
                return h

        get = Known().__getitem__
        for pdf in batches:
            for lo in range(0, len(pdf), 2_000):
                part = pdf.iloc[lo : lo + 2_000]
                lists = [WORD.findall(t.lower()) if t else [] for t in part.iloc[:, 1]]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter((h for words in lists for h in map(get, words)), np.int64, int(sizes.sum()))
                owner = np.repeat(np.arange(len(lists)), sizes)
                order = np.lexsort((flat, owner))
                flat, owner = flat[order], owner[order]
                first = np.ones(len(flat), bool)
                first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(first)
                counts = np.diff(np.append(at, len(flat))).astype(np.int32)
                cuts = np.searchsorted(owner[at], np.arange(1, len(lists)))
                yield pd.DataFrame({"doc_id": part.iloc[:, 0].to_numpy(), "terms": np.split(flat[at], cuts) if len(lists) else [], "counts": np.split(counts, cuts) if len(lists) else []})

    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text)).where("doc_id is not null").mapInPandas(run, schema)


def stored_bags(documents: DataFrame, seed: int = 13) -> DataFrame:
    """:func:`term_bags` as a table with a folder for each slice of the fit, so that a step of it reads its slice only; the number of documents is taken on the way."""
    bags = term_bags(documents).withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SLICES)).cast("int"))
    return materialize(bags, partition_by="slice", marks={"n": F.count(F.lit(1))})


def _digamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(6):
        shift -= 1 / x
        x += 1
    f = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


@dataclass
class Topics:
    """Fitted topics: sorted term hashes, one row of weights for each topic, and the subject each was mapped to (None: background)."""

    terms: np.ndarray
    weight: np.ndarray
    subjects: list[str]
    of_topic: list[str | None]
    alpha: float


def _expected(weight: np.ndarray) -> np.ndarray:
    return np.exp(_digamma(weight) - _digamma(weight.sum(axis=1, keepdims=True))).astype(np.float32)


def _csr(pdf: pd.DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term positions, counts and owners of a batch, terms outside the vocabulary left out."""
    sizes = np.fromiter(map(len, pdf.terms), np.int64, len(pdf))
    if not sizes.sum() or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
    flat, counts = np.concatenate(list(pdf.terms)), np.concatenate(list(pdf.counts)).astype(np.float32)
    owner = np.repeat(np.arange(len(pdf)), sizes)
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    ok = terms[at] == flat
    return at[ok], counts[ok], owner[ok]


def infer(w: np.ndarray, c: np.ndarray, owner: np.ndarray, n: int, beta: np.ndarray, alpha: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Variational topic masses of ``n`` documents, and the expected term counts by topic. ``beta``: terms x topics."""
    k = beta.shape[1]
    gamma = np.full((n, k), alpha, np.float32)
    stats = np.zeros(beta.shape, np.float32)
    if not len(w):
        return gamma, stats
    b = beta[w]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    rows = owner[starts]
    total = np.add.reduceat(c, starts)
    gamma[rows] = alpha + total[:, None] / k
    for _ in range(rounds):
        g = gamma[rows]
        et = np.exp(_digamma(g) - _digamma(g.sum(axis=1, keepdims=True))).astype(np.float32)
        spread = np.repeat(et, np.diff(np.append(starts, len(w))), axis=0)
        norm = np.einsum("ij,ij->i", b, spread) + 1e-30
        ratio = c / norm
        gamma[rows] = alpha + et * np.add.reduceat(b * ratio[:, None], starts, axis=0)
    spread *= b
    spread *= ratio[:, None]
    order = np.argsort(w, kind="stable")
    ws = w[order]
    cut = np.flatnonzero(np.append(True, ws[1:] != ws[:-1]))
    stats[ws[cut]] = np.add.reduceat(spread[order], cut, axis=0)
    return gamma, stats


def fit_topics(bags: DataFrame, labels: DataFrame, background: int = 6, alpha: float = 0.1, eta: float = 0.01, strength: float = 0.3, seed: int = 13) -> Topics:
    """Online variational Bayes over all documents, a slice of them in each step.

    One topic for each subject has a prior on the terms that its hand-labelled
    documents have clearly more often than other labelled ones (``strength``
    counts for each document with the term); the background topics begin at
    the corpus' own term counts, shaken by ``seed``. After the fit every topic is mapped anew: its top
    terms (by weight and rarity) are held against the labelled documents, and
    it takes the subject in which they mostly occur, or none. Term and label
    counts cover all documents; only sums of a size of terms x topics reach the
    driver, where the terms are bounded by ``RARE`` and by the labelled documents, and the bytes of it by ``MAX_STATE``. The sums of the tasks are
    added in two steps, so no task holds more than ``FAN`` of them, up to FAN x FAN tasks. ``bags`` is a table of :func:`stored_bags`.
    """
    spark = bags.sparkSession
    n = marks_of(bags)["n"]
    if not n:
        return Topics(np.zeros(0, np.int64), np.zeros((0, 0)), [], [], alpha)
    lab = labels.select(F.col("doc_id").cast(bags.schema["doc_id"].dataType).alias("doc_id"), clean_id("subject").alias("subject")).where("subject is not null and doc_id is not null").distinct()
    # the row without subject counts every labelled document once
    held = lab.union(lab.select("doc_id").distinct().select("doc_id", F.lit(None).cast("string").alias("subject")))
    near = materialize(held.join(bags.select("doc_id", "terms"), "doc_id").select("subject", F.explode("terms").alias("t")).groupBy("subject", "t").agg(F.count("*").alias("n")).where("n >= 2"))
    # common terms, and those of any subject, however rare it is among all documents
    own_terms = near.where("subject is not null and n >= 3").select("t").distinct().withColumn("own", F.lit(True))
    vocab = bags.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).where("df >= 3").join(own_terms, "t", "left").where((F.col("df") >= n // RARE) | F.col("own")).select("t", "df").toPandas().sort_values("t", ignore_index=True)
    terms, df = vocab.t.to_numpy(), vocab.df.to_numpy(float)
    in_vocab = F.broadcast(spark.createDataFrame(vocab[["t"]])) if len(vocab) else spark.createDataFrame([], "t long")
    seen = near.join(in_vocab, "t").select("subject", "t", "n").toPandas()
    discard(near)
    docs = {r["subject"]: r["n"] for r in lab.groupBy("subject").agg(F.count("*").alias("n")).limit(MAX_SUBJECTS + 1).collect()}
    if len(docs) > MAX_SUBJECTS:
        raise ValueError(f"over {MAX_SUBJECTS} subjects among the labels")
    subjects = sorted(docs)
    count, labelled = np.zeros((len(subjects) + 1, len(terms))), lab.select("doc_id").distinct().count()
    if len(seen) and len(terms):
        at = np.minimum(np.searchsorted(terms, seen.t.to_numpy()), len(terms) - 1)
        ok = terms[at] == seen.t.to_numpy()
        row = seen.subject.map(lambda x: subjects.index(x) if isinstance(x, str) else len(subjects)).to_numpy()
        count[row[ok], at[ok]] = seen.n.to_numpy()[ok]
    count, any_count = count[:-1], count[-1]
    rate = count / np.maximum(np.array([docs[s] for s in subjects]), 1)[:, None] if subjects else count
    rng = np.random.default_rng(seed)
    k = len(subjects) + background
    if 8 * k * len(terms) > MAX_STATE:
        raise ValueError(f"{len(terms)} terms and {k} topics take more than {MAX_STATE} bytes; lower RARE")
    prior = np.full((k, len(terms)), eta)
    seeded = np.zeros(len(terms), bool)
    if subjects:
        own = np.array([docs[s] for s in subjects], float)[:, None]
        # a careful estimate of how much oftener documents of the subject have the term than other labelled ones
        above = (count - 1.5 * np.sqrt(count)) / own / ((np.maximum(any_count - count, 0) + 0.5) / np.maximum(labelled - own, 1))
        best = above.argmax(axis=0)
        seeded = (above.max(axis=0) > 2.0) & (count.max(axis=0) >= 3)
        prior[best[seeded], np.flatnonzero(seeded)] += strength * df[seeded]
    weight = prior.copy()
    weight[len(subjects) :] += np.where(seeded, 0.02, 1.0) * df * rng.gamma(2.0, 0.5, (background, len(terms))) / max(1, background)

    blocks = max(1, -(-8 * k * len(terms) // BLOCK_BYTES))
    for step in range(SLICES):
        state = spark.sparkContext.broadcast((terms, np.ascontiguousarray(_expected(weight).T)))

        def expect(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            t, beta = state.value
            total, docs_seen = np.zeros(beta.shape), 0
            for pdf in batches:
                w, c, owner = _csr(pdf, t)
                total += infer(w, c, owner, len(pdf), beta, alpha)[1]
                docs_seen += len(pdf)
            if docs_seen:
                place = TaskContext.get().partitionId() // FAN
                yield pd.DataFrame({"block": range(blocks), "place": place, "docs": [docs_seen] + [0] * (blocks - 1), "stats": [p.tobytes() for p in np.array_split(total, blocks)]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.frombuffer(pdf.stats.iloc[0]).copy()
            for x in pdf.stats.iloc[1:]:
                total += np.frombuffer(x)
            return pd.DataFrame({"block": pdf.block.iloc[:1], "place": pdf.place.iloc[:1], "docs": [pdf.docs.sum()], "stats": [total.tobytes()]})

        kind = "block int, place int, docs long, stats binary"
        sums = bags.where(F.col("slice") == step).select("terms", "counts").mapInPandas(expect, kind).groupBy("block", "place").applyInPandas(add, kind)
        got = sums.groupBy("block").applyInPandas(add, kind).toPandas().sort_values("block")
        if len(got) and got.docs.sum():
            stats = np.concatenate([np.frombuffer(x) for x in got.stats]).reshape(len(terms), k).T
            new = prior + stats * n / got.docs.sum()
            rate_ = (2.0 + step) ** -0.6
            weight = (1 - rate_) * weight + rate_ * new
        state.unpersist()
    # the map from topics to subjects, by their top terms
    beta = weight / weight.sum(axis=1, keepdims=True)
    typical = beta * np.log1p(beta / np.maximum(df / df.sum(), 1e-12)[None, :])
    share = rate / np.maximum(rate.sum(axis=0), 1e-9) if subjects else rate
    of_topic: list[str | None] = []
    for row in typical:
        top = np.argsort(-row)[:60]
        by = (share[:, top] * row[top]).sum(axis=1) / max(row[top].sum(), 1e-12) if subjects else np.zeros(0)
        of_topic.append(subjects[int(by.argmax())] if len(by) and by.max() > 0.45 else None)
    return Topics(terms, weight, subjects, of_topic, alpha)


def subject_shares(bags: DataFrame, topics: Topics) -> DataFrame:
    """``doc_id, subject, mass, share``: expected words of each subject in a document, and their part of its words in the vocabulary."""
    state = bags.sparkSession.sparkContext.broadcast(topics)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = state.value
        names = [s for s in t.subjects if s in t.of_topic]
        pick = np.array([[1.0 if o == s else 0.0 for s in names] for o in t.of_topic], np.float32).reshape(len(t.of_topic), len(names))
        beta = np.ascontiguousarray(_expected(t.weight).T) if len(t.terms) else np.zeros((0, len(t.of_topic)), np.float32)
        for pdf in batches:
            w, c, owner = _csr(pdf, t.terms)
            if not len(w) or not names:
                continue
            gamma, _ = infer(w, c, owner, len(pdf), beta, t.alpha)
            mass = np.maximum(gamma - t.alpha, 0) @ pick
            total = np.maximum(np.bincount(owner, c, len(pdf)), 1)
            i, j = np.nonzero(mass >= 0.5)
            yield pd.DataFrame({"doc_id": pdf.doc_id.to_numpy()[i], "subject": np.array(names, object)[j], "mass": mass[i, j].astype(float), "share": (mass / total[:, None])[i, j].astype(float)})

    return bags.select("doc_id", "terms", "counts").mapInPandas(run, T.StructType([bags.schema["doc_id"], *T._parse_datatype_string("subject string, mass double, share double").fields]))


def assign(bags: DataFrame, topics: Topics, least_share: float = 0.04, least_mass: float = 3.0, of_top: float = 0.22) -> DataFrame:
    """``doc_id, subject`` of each subject that a document treats.

    A subject counts with ``least_mass`` expected words and ``least_share`` of the
    document, and ``of_top`` times the document's largest subject: less are stray words.
    """
    state_shares = subject_shares(bags, topics).where((F.col("mass") >= least_mass) & (F.col("share") >= least_share))
    top = state_shares.groupBy("doc_id").agg(F.max("mass").alias("m"), F.collect_list(F.struct("subject", "mass")).alias("s"))
    return top.select("doc_id", F.explode("s").alias("x"), "m").where(F.col("x.mass") >= of_top * F.col("m")).select("doc_id", "x.subject")


def document_subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, subject``: none, one or more rows for each document.

    Null and empty texts, and texts of no known term, have no subject. Labels
    are compared trimmed and in lower case; labels of unknown documents and
    repeated ones change nothing; without labels topics are fitted but none can be
    named, so the result is empty.
    """
    bags = stored_bags(documents)
    return assign(bags, fit_topics(bags, labels))


def topic_terms(documents: DataFrame, labels: DataFrame, top: int = 12) -> DataFrame:
    """``topic, subject, rank, term, weight``: the top terms of each fitted topic, for inspection."""
    spark = documents.sparkSession
    bags = stored_bags(documents)
    t = fit_topics(bags, labels)
    rows = []
    for k in range(len(t.of_topic)):
        for r, i in enumerate(np.argsort(-t.weight[k])[:top] if len(t.terms) else []):
            rows.append((k, t.of_topic[k], r + 1, int(t.terms[i]), float(t.weight[k, i])))
    wanted = spark.createDataFrame(rows, "topic int, subject string, rank int, h long, weight double")
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nl}\p{No}]{2,}"), F.lit(0)))).alias("term")).distinct().withColumn("h", F.xxhash64("term"))
    return words.join(F.broadcast(wanted), "h").select("topic", "subject", "rank", "term", "weight")


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """``subject, n_docs, share_of_docs``: the make-up of the corpus; documents without subject are ``none``."""
    all_docs = documents.select("doc_id").where("doc_id is not null")
    total = all_docs.agg(F.count("*").alias("total"))
    by = all_docs.join(found, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.countDistinct("doc_id").alias("n_docs"))
    return by.crossJoin(F.broadcast(total)).select("subject", "n_docs", (F.col("n_docs") / F.col("total")).alias("share_of_docs"))
