"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

SimHash fingerprints of five-word shingles (``near_dup``: correlated groups of bits, thresholds by dynamic programming,
probe and verify) propose the nearest pairs. They cannot propose all: at a similarity of 0.8 about 10 of 64 bits
differ. The exact way for the rest is prefix filtering. All shingles stand in one order, rare ones first; two sets of
such similarity share one of the first n // 5 + 1 of either. Any order is right; this one has the shingles common in a
bounded sample of texts last, so that few meet.

Each text is compared with the text of the fingerprint nearest to it and with one text of every shingle first, then with
another one, and what is alike becomes one component; then all pairs that share a shingle and are not in one component yet. Thus a large
group of near copies is not compared pair by pair. Odd sketches (one bit for each bin of
shingles, whether their number is odd) tell exactly which pairs cannot be alike; the others are verified by whole sets. Equal texts are one node, so a group of copies costs one row a partition.

Nulls and odd rows: null and empty texts have the empty set and are alike; a text of fewer than five words is one
shingle; a null doc_id never names a component that has another; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.llm.common import cut, pieces, small, text_hash
from quarrykit.llm.near_dup import components, fingerprint, links

SHINGLE, SEED = 5, 42
#: The order of shingles is learned from about this many texts; COMMON shingles at most are put last.
SAMPLE, COMMON = 16_000, 1 << 16
#: Least bits of a sketch; folded to 512 of them where it stands in many rows.
BITS = 1024
#: A pair that shares one of the BEFORE tokens before a token need not meet again at that token.
BEFORE = 16


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of all shingles, sorted, as signed numbers. Long texts go piece by piece."""
    found, tail = [], []
    for piece in pieces(text or ""):
        tokens = tail + piece.encode("utf-8", "replace").lower().split()  # bytes: ASCII case and white space only
        tail = tokens[-(shingle - 1) :]
        if len(tokens) >= shingle:
            runs = zip(*(tokens[i:] for i in range(shingle)), strict=False)
            found.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs), np.uint64)))
    if not found and tail:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64))
    return np.unique(np.concatenate(found).view(np.int64)) if found else np.empty(0, np.int64)


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t, SHINGLE) for t in batch], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles(t) for t in batch], dtype=object)


def common_shingles(texts: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met twice or more in the sample, sorted, and how often."""
    share = min(1.0, sample / max(1, texts.count()))
    picked = texts.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["node"])
    met = picked.select(F.explode(shingle_sets("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    rows = met.orderBy(F.desc("n"), "token").limit(COMMON).toPandas().sort_values("token")
    return rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def prefix(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of the set in the order (how common, hash) that any set alike must meet."""
    often = np.zeros(len(tokens), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1)
        often = np.where(common[0][at] == tokens, common[1][at], 0)
    return tokens[np.lexsort((tokens, often))[: len(tokens) // 5 + 1]]


def odd_sketch(tokens: np.ndarray) -> np.ndarray:
    """Of BITS or 2 ** k bins of tokens, twice as many as tokens or more, which hold an odd number.

    Two sets differ in as many tokens at least as their sketches do in bits.
    """
    bits = max(BITS, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else BITS
    odd = np.bincount(tokens.view(np.uint64) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, n, prefix, sketch): size of the node's set and its first tokens in the order; of copies in a partition one row."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # bounded by the rows of a partition
        for b in batches:
            b = b[~b["node"].duplicated()]
            b = b[[x not in seen for x in b["node"]]]
            seen.update(b["node"])
            for at in range(0, len(b), 500):
                part, sets = b.iloc[at : at + 500], [shingles(t) for t in b["text"].iloc[at : at + 500]]
                first = [prefix(s, shared.value) if len(s) else np.zeros(1, np.int64) for s in sets]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "n": [len(s) for s in sets], "prefix": first, "sketch": [odd_sketch(s) for s in sets]})

    return texts.mapInPandas(rows, "node long, n int, prefix array<long>, sketch array<long>")


def close(n: Column, m: Column, bits: Column) -> Column:
    """Whether sets of n and m tokens can be alike whose sketches differ in ``bits`` bits: alike ones differ in a ninth at most."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * bits <= n + m)


def must(n: Column, m: Column) -> Column:
    """Tokens that the prefixes of sets of n and m tokens alike share at least.

    The sets share s = 4/9 (n + m) or more. The prefix that ends first in the order lies within the other one as far as it
    is shared, and of its tokens at most n - s are not.
    """
    least = F.ceil((n + m) * 4 / 9)
    return F.least(F.floor(n / 5) + 1 - n + least, F.floor(m / 5) + 1 - m + least)


def likely(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sizes and sketches let them be alike. first: (node, n, sketch)."""
    rows = first.select("node", "n", "sketch").dropDuplicates(["node"])
    a, b = (rows.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    size = F.least(F.size("sa"), F.size("sb"))
    halved = lambda s: F.when(F.size(s) > size, F.zip_with(F.slice(s, 1, size), F.slice(s, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(s))  # noqa: E731  sizes within 0.8: once will do
    bits = F.aggregate(F.zip_with(halved("sa"), halved("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = pairs.join(rows.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b").join(a, "a").filter(close(F.col("na"), F.col("nb"), F.lit(0)))
    return both.drop("nb").join(b, "b").filter(close(F.col("na"), F.col("nb"), bits)).select("a", "b")


def alike(pairs: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes whose sets have a similarity of 0.8 or more."""
    pairs = cut(likely(pairs, first))
    nodes = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = cut(texts.join(small(nodes), "node", "left_semi").dropDuplicates(["node"]).select("node", shingle_sets("text").alias("s")))
    a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return cut(both.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"))


def meetings(open_: DataFrame) -> DataFrame:
    """(a, b) of the nodes under different labels that can be alike, where they share the first token, or seldom a later one.

    Of two sets alike, with s tokens in common at least, either has s tokens or more from the first common one on.
    """
    left, right = (open_.select("token", *(F.col(c).alias(f"{c}_{x}") for c in open_.columns if c != "token")) for x in "ab")
    n, m = F.col("n_a"), F.col("n_b")
    bits = reduce(Column.__add__, [F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(BITS // 128)])
    first = 9 * (F.least(n - F.col("at_a"), m - F.col("at_b"))) >= 4 * (n + m)
    other = (left["token"] == right["token"]) & (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
    fits = first & (F.least("f_a", "f_b") >= must(n, m)) & close(n, m, bits)
    pairs = left.join(right, other & fits & ~F.arrays_overlap("before_a", "before_b"))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def nearest_prints(prints: DataFrame) -> DataFrame:
    """(a, b) nodes: each with the first of its fingerprint and that with the first within near_dup.MOST bits. prints: (node, fp)."""
    first = cut(prints.groupBy("fp").agg(F.min("node").alias("first")))
    same = prints.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first).groupBy("b").agg(F.min("a").alias("a"))
    near = near.join(first.select(F.col("fp").alias("b"), F.col("first").alias("to")), "b").join(first.select(F.col("fp").alias("a"), F.col("first").alias("from")), "a")
    return same.union(near.select("from", "to")).filter("a <> b")


def linked(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, label) of the components of all pairs of different nodes alike. texts: (node, text), prints: (node, fp)."""
    first = cut(prefixes(texts, common_shingles(texts)))
    of_token = Window.partitionBy("token")
    tokens = first.select("node", F.posexplode("prefix").alias("at", "token"))
    # of the texts with a token the one with the fewest rarer ones, which is the least changed of a group of near copies
    tokens = tokens.withColumns({"low": F.min(F.struct("at", "node")).over(of_token)["node"], "many": F.count("*").over(of_token)})
    met = cut(tokens.filter("low <> node").dropDuplicates(["token", "node"]).select("token", "node", "at", "low", (F.col("many") > 2).alias("more")))
    near = nearest_prints(prints).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pair = [F.least("low", "node").alias("a"), F.greatest("low", "node").alias("b")]
    proposed = cut(met.select(*pair).union(near).distinct())
    sure = alike(proposed, first, texts)
    labels = components(sure)
    # that text has been compared with all others; so is the next one, with those that are not in its component
    named = met.filter("more").select("token", "node", "at").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    again = named.withColumn("next", F.min(F.struct("at", "node", "label")).over(of_token)).filter("label <> next.label").select("node", F.col("next.node").alias("low")).select(*pair)
    again = cut(again.distinct().join(proposed, ["a", "b"], "left_anti"))
    sure = cut(sure.union(alike(again, first, texts)))
    proposed, labels = proposed.union(again), components(sure)
    # what is left are pairs under different labels
    named = met.filter("more").select("token", "node", "at").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
    words = BITS // 128
    folded = [F.aggregate(F.sequence(F.lit(0), F.size("sketch") - 1, F.lit(words)), F.lit(0).cast("long"), lambda x, at: x.bitwiseXOR(F.get("sketch", at + i))).alias(f"s{i}") for i in range(words)]  # noqa: B023
    # how many tokens of its prefix a node shares with any other
    shared = met.select("token", "node").union(met.select("token", "low")).distinct().groupBy("node").agg(F.count("*").cast("int").alias("f"))
    nodes = first.dropDuplicates(["node"]).select("node", "n", "prefix", *folded)
    before = F.slice("prefix", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    open_ = cut(named.join(mixed, "token", "left_semi").join(nodes, "node").join(shared, "node").withColumn("before", before).drop("prefix"))
    more = alike(cut(meetings(open_).distinct().join(proposed, ["a", "b"], "left_anti")), first, texts)
    return labels if more.isEmpty() else components(sure.union(more))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first): ``first`` (doc_id, text_hash) is the smallest of the document's component."""
    node = F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")
    me = F.struct("doc_id", "text_hash")
    least = lambda x: F.coalesce(F.min(F.when(x["doc_id"].isNotNull(), x)), F.min(x))
    marked = cut(docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), node, fingerprints("text").alias("fp")))
    labels = linked(docs.select(node, "text"), marked.select("node", "fp").distinct())
    marked = marked.join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("label"))
    return marked.join(marked.groupBy("label").agg(least(me).alias("first")), "label").select("doc_id", "text_hash", "first")
