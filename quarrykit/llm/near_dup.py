"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: 64 majority bits over the XXH64 of all 3-word shingles. Two distinct fingerprints link at ``most`` or
fewer differing bits; documents with linked fingerprints form components.

Candidates: correlated bits are grouped into ``PARTS`` partitions. Each partition i gets a threshold t_i >= -1 with
sum(t_i + 1) = most + 1, so any pair within ``most`` bits agrees to within t_i in some partition; dynamic programming
picks the thresholds with the fewest estimated candidates (counted collisions of each partition's values), and -1
leaves a partition out. The other bits of a probe are split into most + 1 slices, of which one must be equal, so that
a value shared by very many fingerprints is narrowed again. Probes are joined and verified in the join condition.
Equal fingerprints are one row from the start, so a group of copies costs one row however large it is.

Components: smallest label over links with pointer jumping, each round checkpointed, until nothing changes.

Nulls and odd rows: null and empty texts have fingerprint zero and link like any other; a null doc_id never names a
component that has another; repeated rows share a component; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, factorial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.llm.common import cut, pieces, table, text_hash

SHINGLE, SEED, MOST, PARTS = 3, 42, 2, 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number. Long texts go piece by piece."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for piece in pieces(text or ""):
        tokens = tail + piece.encode("utf-8", "replace").lower().split()  # bytes: ASCII case and white space only
        tail = tokens[-(shingle - 1) :] if shingle > 1 else []
        runs = [tokens[i:] for i in range(shingle)]
        for at in range(0, max(0, len(tokens) - shingle + 1), 1 << 16):
            part = zip(*(r[at : at + (1 << 16)] for r in runs), strict=False)
            h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in part), np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
    if total == 0 and tail:
        return int(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64).view(np.int64)[0])
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set."""

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, found = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            for at in range(0, len(b), 1 << 16):
                x = np.unpackbits(b["fp"].to_numpy()[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                found, n = found + (x.T @ x).astype(np.int64), n + len(x)
        yield pd.DataFrame({"i": range(65), "counts": [*found.tolist(), [n] * 64]})

    rows = fps.select("fp").mapInPandas(both, "i int, counts array<long>").select("i", F.posexplode("counts").alias("j", "n")).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((65, 64), np.int64)
    for i, j, n in rows:
        counts[i, j] = n
    return int(counts[64, 0]), counts[:64]


def correlated_groups(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """64 bits in ``parts`` equal groups; each is grown by the bit most correlated with it. Constant bits go together."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(p * (1 - p))
    still = sd == 0
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1)
    like[np.ix_(still, still)] = 1
    left, groups = set(range(64)), []
    for k in range(parts):
        group = [max(sorted(left), key=lambda b: sum(like[b, c] for c in left))]
        left -= set(group)
        while len(group) < 64 * (k + 1) // parts - 64 * k // parts:
            group.append(max(sorted(left), key=lambda b: like[b, group].sum()))
            left.remove(group[-1])
        groups.append(group)
    return groups


def thresholds(costs: list[list[float]], most: int = MOST) -> list[int]:
    """costs[i][t + 1]: candidates of partition i at threshold t from -1 on. The t_i of least cost with sum(t_i + 1) = most + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for spent, (so_far, chosen) in best.items():
            for t in range(-1, most - spent + 1):
                now = (so_far + cost[t + 1], [*chosen, t])
                if spent + t + 1 not in new or now < new[spent + t + 1]:
                    new[spent + t + 1] = now
        best = new
    return best[most + 1][1]


def allocate(fps: DataFrame, most: int = MOST, parts: int = PARTS) -> list[tuple[int, list[int]]]:
    """Probes: (mask of the bits that must agree, flips of it to look up)."""
    n, both = bit_counts(fps)
    groups = correlated_groups(n, both, parts)
    masks = [sum(1 << b for b in g) for g in groups]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(signed(m)).alias("key")) for i, m in enumerate(masks)])
    shared = fps.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").cast("double").alias("c")).groupBy("k.part").agg(F.sum(F.col("c") * F.col("c"))).collect()
    collisions = dict(shared)
    p = both.diagonal() / max(n, 1)
    looser = 1 / (p * p + (1 - p) * (1 - p)) - 1  # candidates that leaving a bit out adds, as a share
    costs = []
    for i, g in enumerate(groups):
        r = sum(looser[b] for b in g)
        costs.append([0.0] + [collisions.get(i, 0.0) * sum(r**k / factorial(k) for k in range(t + 1)) + n * sum(comb(len(g), k) for k in range(t + 1)) for t in range(most + 1)])
    probes = []
    for i, t in enumerate(thresholds(costs, most)):
        others = [b for j, g in enumerate(groups) if j != i for b in g]
        for s in range(most + 1) if t >= 0 else ():
            part = others[len(others) * s // (most + 1) : len(others) * (s + 1) // (most + 1)]
            flips = [sum(1 << b for b in f) for k in range(t + 1) for f in combinations(groups[i], k)]
            probes.append((masks[i] | sum(1 << b for b in part), flips))
    return probes


def links(fps: DataFrame, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(a, b), a < b: distinct fingerprints at ``most`` or fewer differing bits."""
    probes = allocate(fps, most, parts)

    def keyed(name: str, flipped: bool) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("probe"), F.col("fp").bitwiseAND(signed(m)).bitwiseXOR(F.lit(signed(f))).alias("key")) for i, (m, flips) in enumerate(probes) for f in (flips if flipped else [0])]
        return fps.select(F.col("fp").alias(name), F.explode(F.array(*keys)).alias("k")).select(name, "k.probe", "k.key")

    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    left, right = keyed("a", True).alias("l"), keyed("b", False).alias("r")
    return left.join(right, (F.col("l.probe") == F.col("r.probe")) & (F.col("l.key") == F.col("r.key")) & near).select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node of ``pairs`` (a, b); the label is the same within a component and only there."""
    edges = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")))
    labels = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("far"))
        labels = cut(lower.join(jump, "now").select("node", F.least("now", "far").alias("label"), (F.least("now", "far") < F.col("was")).alias("changed")))
        if labels.filter("changed").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(doc_id, text_hash, fp, first): ``first`` (doc_id, text_hash) is the smallest of the document's component."""
    me = F.struct("doc_id", "text_hash")
    marked = cut(docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), fingerprints(F.col("text")).alias("fp")))
    nodes = cut(marked.groupBy("fp").agg(F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), me)), F.min(me)).alias("own")))
    linked = components(cut(links(nodes, most, parts))).withColumnRenamed("node", "fp")
    linked = cut(linked.join(nodes, "fp"))
    named = linked.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("own.doc_id").isNotNull(), F.col("own"))), F.min("own")).alias("first"))
    found = linked.join(named, "label").select("fp", "first")
    all_nodes = cut(nodes.join(found, "fp", "left").select("fp", F.coalesce("first", "own").alias("first")))  # written, so that a hot fingerprint's join can be split
    return marked.join(all_nodes, "fp").select("doc_id", "text_hash", "fp", "first")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_near_duplicates": op3_near_duplicates}
#: None: DuckDB has no XXH64; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
