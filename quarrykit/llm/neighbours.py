"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Vectors are hashed to shards of about SHARD; each shard builds one tree over its unit vectors: a node keeps a vantage
point and the median distance to it, a leaf up to LEAF vectors. Each task reads its shards one after another, a shard's
vectors before the queries, which stream over the tree in Arrow batches: memory holds one shard and one batch. The
queries of a batch walk the tree together, the nearer child first. The farther child is left out when
|d - median| * factor > the k-th best distance so far: factor 1 is the triangle inequality and exact, larger factors
prune more. Every row is indexed; a vector is shuffled twice, whatever the number of queries, a query once per shard.
Scores are cosines in double precision of the original vectors, summed the same way wherever a pair is met, so equal
vectors tie exactly.

Vectors that are null, zero or hold null or non-finite components take no part; vectors are compared with those of
their length only; rows that repeat a vec_id count once per query, with the best score, and never answer a query of
the same id: repeats of a whole row are one before they are dealt, other rows of one id are dealt by their vectors;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import table

SHARD, LEAF = 4096, 64
K, EVERY, FACTOR = 5, 50, 1.0


def usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


class Tree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = vectors[order].astype(np.float64), ids[order]
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.unit, self.leaf = self.x / self.norm[:, None], leaf
        self.repeats = len(np.unique(self.ids)) < len(ids)
        self.root = self.build(np.arange(len(ids)))

    def distance(self, a: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ self.unit[at])))

    def build(self, rows: np.ndarray) -> tuple:
        if len(rows) > self.leaf:
            d = self.distance(self.unit[rows], rows[0])
            median = float(np.median(d))
            near = d <= median
            if 0 < near.sum() < len(rows):  # else all are as far, as copies are
                return rows[0], median, self.build(rows[near]), self.build(rows[~near])
        return (rows,)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> pd.DataFrame:
        """The k nearest rows of each query, of k ids that are not its own: (query, row, score)."""
        self.q = queries.astype(np.float64)
        self.q_norm = np.sqrt((self.q * self.q).sum(axis=1))
        self.q_unit, self.own, self.k, self.factor = self.q / self.q_norm[:, None], own, k, factor
        self.score = np.full((len(own), k), -np.inf)
        self.row = np.full((len(own), k), -1, np.int64)
        self.walk(self.root, np.arange(len(own)))
        at, rank = np.nonzero(self.row >= 0)
        return pd.DataFrame({"query": at, "row": self.row[at, rank], "score": self.score[at, rank]})

    def walk(self, node: tuple, active: np.ndarray) -> None:
        if not len(active):
            return
        if len(node) == 1:
            self.open(node[0], active)
            return
        at, median, near, far = node
        d = self.distance(self.q_unit[active], at)
        inside = d <= median
        self.walk(near, active[inside])
        self.walk(far, active[~inside])
        kth = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(self.score[active, -1], -1.0)))
        left = np.abs(d - median) * self.factor <= kth + 1e-7
        self.walk(near, active[~inside & left])
        self.walk(far, active[inside & left])

    def open(self, rows: np.ndarray, active: np.ndarray) -> None:
        rough = self.q_unit[active] @ self.unit[rows].T
        q, r = np.nonzero((rough >= self.score[active, -1][:, None] - 1e-9) & (self.ids[rows][None, :] != self.own[active][:, None]))
        if not len(q):
            return
        q, r = active[q], rows[r]
        score = np.concatenate([(self.q[q[i : i + 65536]] * self.x[r[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)]) / (self.q_norm[q] * self.norm[r])
        met = np.unique(q)
        q = np.concatenate((q, np.repeat(met, self.k)))
        r = np.concatenate((r, self.row[met].ravel()))
        score = np.concatenate((score, self.score[met].ravel()))
        if self.repeats:  # the best row of an id stands for it
            order = np.lexsort((-score, self.ids[r], q))
            q, r, score = q[order], r[order], score[order]
            first = np.concatenate(([True], (q[1:] != q[:-1]) | (self.ids[r[1:]] != self.ids[r[:-1]])))
            found = first & (r >= 0)
            q = np.concatenate((q[found], np.repeat(met, self.k)))
            r = np.concatenate((r[found], np.full(len(met) * self.k, -1)))
            score = np.concatenate((score[found], np.full(len(met) * self.k, -np.inf)))
        order = np.lexsort((r, -score, q))  # rows are in the order of ids
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, met)
        for i in range(self.k):
            self.row[met, i], self.score[met, i] = r[first + i], score[first + i]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, embedding) its k nearest vectors of another id."""
    vectors, queries = (usable(df.select("vec_id", "embedding")).distinct() for df in (vectors, queries))
    shards = max(1, -(-vectors.count() // SHARD))
    size = F.size("embedding").alias("dims")
    there = vectors.select("vec_id", "embedding", size, F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"))
    asked = queries.select("vec_id", "embedding", size, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, tree = None, [], None
        for batch in batches:
            for (dims, shard, asks), part in batch.groupby(["dims", "shard", "asks"]):
                if here != (dims, shard):
                    here, held, tree = (dims, shard), [], None
                if not asks:
                    held.append(part)
                    continue
                if held:
                    whole = pd.concat(held)
                    held, tree = [], Tree(np.stack(whole["embedding"]), whole["vec_id"].to_numpy())
                if tree:
                    ids = part["vec_id"].to_numpy()
                    found = tree.search(np.stack(part["embedding"]), ids, k, factor)
                    yield pd.DataFrame({"query_id": ids[found["query"]], "vec_id": tree.ids[found["row"]], "score": found["score"]})

    ordered = there.unionByName(asked).repartition("dims", "shard").sortWithinPartitions("dims", "shard", "asks")
    met = ordered.mapInPandas(search, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_nearest_vectors": op7_nearest_vectors}
#: None: sums of doubles differ in the last bits between engines; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
