"""Mixing sources to target weights: token counts, hierarchical budgets, token-prefixes of seeded epochs."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_id
from ..session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the piece pattern of the public byte-level BPE, in the standard library's syntax
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
PIECES_FULL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000
MAX_LEAVES = 100_000
_LANGS = {"kon": "kg", "lin": "ln", "swh": "sw", "swa": "sw", "fra": "fr", "eng": "en", "por": "pt"}


def read_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    """Token -> rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(ranks: dict[bytes, int] | None = None):
    """A function from text to its number of tokens under a rank table.

    Byte-level BPE never joins over the pieces of its pattern, so the count of a
    text is the sum over its pieces; the counts of the pieces seen are kept. The
    standard library splits ASCII text, ``regex`` the rest, whose letter
    classes the two read differently.
    """
    import regex
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=PIECES_FULL, mergeable_ranks=ranks or read_ranks(), special_tokens={}).encode_ordinary

    class Known(dict):
        def __missing__(self, piece: str) -> int:
            n = len(encode(piece))
            if len(self) < CACHE:
                self[piece] = n
            return n

    get, plain, full = Known().__getitem__, re.compile(PIECES), regex.compile(PIECES_FULL)
    return lambda text: sum(map(get, (plain if text.isascii() else full).findall(text)))


def source_key(c: Column | str) -> Column:
    """A source name in one spelling: trimmed, lower case, runs of spaces, hyphens and underscores as ``_``."""
    return F.regexp_replace(clean_id(c), r"(?U)[\s_\-]+", "_")


def lang_key(c: Column | str) -> Column:
    """A language label as a two-letter code where known, ``und`` where missing."""
    c = F.regexp_replace(clean_id(c), r"[_\-].*$", "")
    known = F.create_map(*[F.lit(x) for kv in _LANGS.items() for x in kv])
    return F.coalesce(known[c], c, F.lit("und"))


def token_table(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """``doc_id, source, lang, tokens``; a null or empty text has 0 tokens. The rank table, of a public tokenizer's fixed size, is broadcast."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = count_tokens(ranks.value)
        for s in batches:
            yield s.map(lambda x: n(x) if x else 0).astype("int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(count, T.LongType())
    return documents.select(F.col(doc_id).alias("doc_id"), source_key(source).alias("source"), lang_key(lang).alias("lang"), udf(F.col(text)).alias("tokens"))


class Node:
    """A node of the tree: a weight among its siblings, and a capacity (of a leaf) or children."""

    def __init__(self, weight: float, capacity: float = 0.0, children: dict[str, Node] | None = None) -> None:
        self.weight, self.children = weight, children or {}
        self.capacity = sum(c.capacity for c in self.children.values()) if self.children else capacity
        self.budget = 0.0

    def give(self, budget: float) -> float:
        """Takes ``budget``, spreads it over the children by weight and returns what could not be placed.

        What a child can't take goes to its siblings with room, by weight; only
        what none of them can take goes back to the parent, whose siblings are
        asked next.
        """
        budget_in, self.budget = budget, min(budget, self.capacity)
        if self.children:
            left, open_ = self.budget, [c for c in self.children.values() if c.capacity > 0]
            got = {id(c): 0.0 for c in open_}
            while open_ and left > 1e-9:
                weight = sum(c.weight for c in open_)
                if weight <= 0:
                    for c in open_:
                        c.weight = c.capacity
                    weight = sum(c.weight for c in open_)
                full = [c for c in open_ if got[id(c)] + left * c.weight / weight >= c.capacity - 1e-9]
                if full:
                    for c in full:
                        left -= c.capacity - got[id(c)]
                        got[id(c)] = c.capacity
                        open_.remove(c)
                else:
                    for c in open_:
                        got[id(c)] += left * c.weight / weight
                    left = 0.0
            for c in self.children.values():
                c.give(got.get(id(c), 0.0))
        return budget_in - self.budget


def plan_budgets(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], total_tokens: float | None = None, domains: dict[str, str] | None = None) -> dict[tuple[str, str], float]:
    """Token budgets by ``(source, lang)`` from ``leaves(source, lang, tokens)`` and ``targets[source] = (share, max_repeats)``.

    The tree has the domains of the sources (``domains[source]``; a source without one is its own), in each domain its languages, and in each of these its
    sources. A source's share is spread over its languages by their tokens, and every node weighs what its leaves weigh, so each
    source reaches its share where nothing is short. What a leaf can't take goes to the other sources of its language in its domain,
    then to the other languages of the domain, then to other domains. Without ``total_tokens`` the total is the largest at which every
    source with tokens can reach its share; a source with a target but no tokens is short of
    everything and its share goes to the others.
    """
    have: dict[str, dict[str, int]] = {}
    for source, lang, n in sorted(leaves):
        if n > 0 and source in targets and targets[source][0] > 0 and targets[source][1] > 0:
            have.setdefault(source, {})[lang] = n
    if not have:
        return {}
    tree: dict[str, dict[str, dict[str, Node]]] = {}
    for source, langs in have.items():
        share, repeats = targets[source]
        for lang, n in langs.items():
            leaf = Node(share * n / sum(langs.values()), float(n * repeats))
            tree.setdefault((domains or {}).get(source, source), {}).setdefault(lang, {})[source] = leaf
    weigh = lambda children: Node(sum(c.weight for c in children.values()), children=children)
    root = weigh({d: weigh({x: weigh(s) for x, s in langs.items()}) for d, langs in tree.items()})
    largest = min(sum(langs.values()) * targets[s][1] * root.weight / targets[s][0] for s, langs in have.items())
    root.give(largest if total_tokens is None else total_tokens)
    return {(s, lang): leaf.budget for langs in tree.values() for lang, own in langs.items() for s, leaf in own.items()}


def mix(tokens: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 13, domains: dict[str, str] | None = None, once: bool = False) -> DataFrame:
    """``doc_id, source, lang, tokens, uses``: how often each document is used, 0 included.

    ``tokens`` is a table of :func:`token_table`; ``once`` sets the total to all tokens of the targeted sources. A leaf (a language of a source)
    uses all its documents for the whole epochs in its budget and, in one more,
    a prefix in seeded hash order that ends nearest to the rest. The prefix
    is found in two steps, so that a leaf with a third of all documents needs no
    task of its own: sums by slice of the hash order, then single documents
    only within the one slice in which the budget ends; the documents of other slices are never shuffled. Documents with a null
    or untargeted source, or without tokens, are used 0 times; the leaves of targeted sources must
    be fewer than ``MAX_LEAVES``; an empty table gives an empty result.
    """
    spark = tokens.sparkSession
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select(source_key("source").alias("source"), "target_share", "max_repeats").collect() if r["source"]}
    stats = tokens.where(F.col("source").isin(*goal)).groupBy("source", "lang").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError("too many leaves of source and language")
    leaves = [(r["source"], r["lang"], r["t"]) for r in stats if r["t"]]
    if once:
        total_tokens = float(sum(t for *_, t in leaves))
    budgets = plan_budgets(leaves, goal, total_tokens, domains)
    have = {(s, lang): t for s, lang, t in leaves}
    plan = [(s, lang, int(b // have[s, lang]), float(b - (b // have[s, lang]) * have[s, lang])) for (s, lang), b in budgets.items()]
    plan = [(s, lang, e, 0.0) if e >= goal[s][1] else (s, lang, e, r) for s, lang, e, r in plan]
    plan_df = F.broadcast(spark.createDataFrame(plan or [("", "", 0, 0.0)], "source string, lang string, epochs int, rest double"))
    slices = max(16, min(65_536, sum(r["n"] for r in stats) // 2_000))
    d = tokens.join(plan_df, ["source", "lang"], "left")
    d = d.withColumn("h", F.xxhash64(F.lit(seed), F.coalesce("epochs", F.lit(0)), "doc_id")).withColumn("slice", F.shiftrightunsigned("h", 32) % F.lit(slices))
    sums = d.where("rest > 0 and tokens > 0").groupBy("source", "lang", "slice", "rest").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy("source", "lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("done", F.coalesce(F.sum("s").over(before), F.lit(0)))
    ends = F.broadcast(sums.where("done < rest and done + s >= rest").select("source", "lang", F.col("slice").alias("last"), "done"))
    d = d.join(ends, ["source", "lang"], "left")
    at_end = F.coalesce((F.col("slice") == F.col("last")) & (F.col("tokens") > 0), F.lit(False))
    run = Window.partitionBy("source", "lang").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = d.where(at_end).withColumn("more", F.when(F.col("done") + F.coalesce(F.sum("tokens").over(run), F.lit(0)) + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    others = d.where(~at_end).withColumn("more", F.when(F.col("rest") <= 0, 0).when(F.col("last").isNull() | (F.col("slice") < F.col("last")), 1).otherwise(0))
    d = inside.unionByName(others)
    uses = F.when(F.col("epochs").isNull() | (F.col("tokens") <= 0), 0).otherwise(F.col("epochs") + F.coalesce("more", F.lit(0)))
    return d.select("doc_id", "source", "lang", "tokens", uses.cast("int").alias("uses"))


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, reached_share, available_tokens, used_tokens, docs_used, most_uses`` of each targeted source."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum((F.col("uses") > 0).cast("long")).alias("docs_used"), F.max("uses").alias("most_uses"))
    t = targets.select(source_key("source").alias("source"), "target_share").join(got, "source", "left")
    all_used = F.sum(F.coalesce("used_tokens", F.lit(0))).over(Window.partitionBy())
    return t.select("source", "target_share", F.when(all_used > 0, F.coalesce("used_tokens", F.lit(0)) / all_used).otherwise(0.0).alias("reached_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available_tokens", "used_tokens", "docs_used", "most_uses")])


def mixed_documents(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = 13, domains: dict[str, str] | None = None, once: bool = False) -> DataFrame:
    """:func:`mix` of the documents. ``tokenizer``: a rank file; it is sent to the executors, so it need only be where the driver is."""
    return mix(materialize(token_table(documents, tokenizer)), targets, total_tokens, seed, domains, once)
