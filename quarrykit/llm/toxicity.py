"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Learning takes a bounded sample of labelled texts, as many of either class at most. Terms are all words of it that
stand in MIN_DF texts or more. A term weighs its IDF times how far it goes with either label (FLOOR plus the phi
coefficient), so that the cosine compares what bears on toxicity and yet every word counts. The examples' vectors go
to an inverted index, in the order of their heaviest terms, so that a block holds examples alike; postings of the COMMON
terms are cut into blocks of examples, each with its largest weight. A query sums its other terms exactly, adds these
weights for a bound per block and opens blocks from the highest bound on, but none that cannot reach the K-th best so far; some queries go together, so that a block is one product of matrices.
What is within rounding of the K-th best is scored again in double precision: that is exact. The neighbours' labels, weighted by squared cosine and by how their
class was sampled, give a vote; isotonic regression over leave-one-out votes of the sample makes it a probability.

A text without any of the terms gets the rate of such texts in the sample. Null and empty texts are such texts.
Equal texts get equal scores; repeated label rows count once, toxic if any says so; without labels of both classes
every score is the rate of what there is (0 without any). Evidence is the example ids and their cosines.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.common import cut, pieces, table

#: At most about this many labelled texts are learned from, half of them toxic.
SAMPLE = 20_000
#: A term stands in MIN_DF texts of the sample; one that tells nothing of the label has FLOOR of its IDF.
MIN_DF, FLOOR = 2, 0.01
#: Blocks of 64 with 128 terms are skipped more often (half of them on 17,000 examples, of these a quarter), yet cost more in all.
K, BLOCK, COMMON = 15, 256, 256
#: So many texts are searched together; float32 sums are at most this far from the exact ones.
TOGETHER, NEAR = 32, 1e-5
TOXIC = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: What the characters of Latin-1 are to WORD: letters in lower case, all else a space.
LATIN = bytes(ord(c.lower()) if WORD.fullmatch(c) else 32 for c in map(chr, range(256)))


def words(text: str) -> list[str]:
    """The words of a text in lower case; where all characters are of Latin-1, by one table."""
    try:
        return text.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def counts(text: str | None, known: dict[str, int] | None = None) -> Counter:
    found: Counter = Counter()
    for piece in pieces(text or ""):
        found.update(words(piece) if known is None else filter(known.__contains__, words(piece)))
    return found


#: Which half of a 64-bit number has its low bits.
LOW = int(sys.byteorder == "big")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from ``starts``, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


#: The numbers of the terms of a text, sorted, and how often they stand in it, as int32 bytes.
Query = tuple[bytes, bytes]


class Examples:
    """The index: ids and labels of examples, postings by term, block bounds, calibration."""

    def __init__(self, terms: list[str], rows: pd.DataFrame, weights: tuple[float, float]) -> None:
        """rows: (doc_id, toxic, terms, tfs), the numbers of an example's terms and how often they stand in it, as int32 bytes."""
        who = rows.drop_duplicates("doc_id").sort_values("doc_id")
        self.terms = {t: i for i, t in enumerate(terms)}
        self.ids, self.labels = who["doc_id"].to_numpy(np.int64), who["toxic"].to_numpy(np.int64)
        self.weight = np.where(self.labels == 1, weights[1], weights[0])
        self.size = np.array([len(b) // 4 for b in who["terms"]], np.int64)
        self.own_term, self.tf = (np.frombuffer(b"".join(who[c]), np.int32) for c in ("terms", "tfs"))
        self.tf = self.tf.astype(np.min_scalar_type(int(self.tf.max(initial=0))))
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.index()

    # blocks of examples that queries met, and those of them that were opened
    met = opened = 0

    def __getstate__(self) -> dict:
        """What is sent to executors: the counts; they make the index of them themselves."""
        return {k: self.__dict__[k] for k in ("terms", "ids", "labels", "weight", "size", "own_term", "tf", "steps")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.index()

    def index(self) -> None:
        many, n, pos = len(self.terms), float(len(self.ids)), float(self.labels.sum())
        t, x = self.own_term, np.repeat(np.arange(len(self.ids), dtype=np.int32), self.size)
        df, toxic = (np.bincount(part, minlength=many).astype(float) for part in (t, t[self.labels[x] == 1]))
        spread = df * (n - df) * pos * (n - pos)
        phi = np.abs(toxic * n - df * pos) / np.sqrt(np.where(spread > 0, spread, np.inf))
        self.idf = (np.log((1 + n) / (1 + df)) + 1e-9) * (FLOOR + phi)
        w = (1 + np.log(self.tf.astype(float))) * self.idf[t]
        norm = np.sqrt(np.bincount(x, w * w, minlength=len(self.ids)))
        w = w / np.where(norm[x] > 0, norm[x], 1)
        # by example, for exact scores; by term, for the search, where float32 will do
        self.first, self.own_w = np.cumsum(self.size) - self.size, w
        # examples of one heaviest term stand in one block, so that its bounds without that term are low
        heaviest = np.zeros(len(self.ids), np.int64)
        by_weight = np.argsort(w, kind="stable")
        heaviest[x[by_weight]] = t[by_weight]
        self.at = np.lexsort((np.arange(len(self.ids)), heaviest, -np.bincount(heaviest, minlength=many)[heaviest])) if many else np.zeros(0, np.int64)
        self.place = np.empty(len(self.at), np.int32)
        self.place[self.at] = np.arange(len(self.at), dtype=np.int32)
        slot = self.place[x] if many else x
        order = np.lexsort((slot, t))  # a term's postings in the order of blocks, as memory lies
        # an example's place and its weight in one number, as a search takes both
        self.postings = slot[order].astype(np.int64) << 32 | w[order].astype(np.float32).view(np.uint32)
        self.blocks = -(-len(self.at) // BLOCK)
        self.seg_size = df.astype(np.int64)
        self.seg_start = np.cumsum(self.seg_size) - self.seg_size
        # the most common terms stand as dense blocks with their largest weights
        common = np.argsort(-df, kind="stable")[:COMMON]
        self.row = np.full(many, -1, np.int64)
        self.row[common] = np.arange(len(common))
        dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        for i, c in enumerate(common):
            p = slice(self.seg_start[c], self.seg_start[c] + self.seg_size[c])
            dense[i, self.postings[p] >> 32] = self.postings[p].view(np.float32)[LOW::2]
        self.dense = np.ascontiguousarray(dense.reshape(len(common), self.blocks, BLOCK).transpose(1, 0, 2))
        self.most = self.dense.max(axis=2).T if dense.size else np.zeros((len(common), self.blocks), np.float32)
        bare = norm == 0
        self.bare = float((self.weight * self.labels)[bare].sum() / max(self.weight[bare].sum(), 1e-9)) if len(self.ids) else 0.0

    def search(self, queries: list[Query], k: int = K, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k nearest examples and their cosines, ties to the smaller id; but not example ``skip``."""
        n, many = len(self.at), len(queries)
        scores, common, vectors = np.zeros((many, self.blocks * BLOCK), np.float32), np.zeros((many, len(self.most)), np.float32), []
        for i, query in enumerate(queries):
            t, tf = (np.frombuffer(x, np.int32) for x in query)
            q = (1 + np.log(tf)) * self.idf[t]
            q /= np.sqrt((q * q).sum())
            vectors.append((t, q))
            row = self.row[t]
            common[i, row[row >= 0]] = q[row >= 0]
            t, q = t[row < 0], q[row < 0]
            sizes = self.seg_size[t]
            found = self.postings[spans(self.seg_start[t], sizes)]
            scores[i] = np.bincount(found >> 32, np.repeat(q, sizes) * found.view(np.float32)[LOW::2], minlength=self.blocks * BLOCK)
            if skip is not None:
                scores[i, self.place[skip[i]]] = -9
        blocks = scores.reshape(many, self.blocks, BLOCK)
        bound = blocks.max(axis=2, initial=-9) + common @ self.most
        top, opened = np.full((many, k), -np.inf, np.float32), np.zeros((many, self.blocks), bool)
        self.met += opened.size
        for at in np.argsort(-bound.max(axis=0, initial=-9), kind="stable"):
            active = np.flatnonzero(bound[:, at] >= top[:, 0] - NEAR)  # others have k better ones already
            if len(active):
                found = blocks[active, at] + common[active] @ self.dense[at]
                blocks[active, at], opened[active, at] = found, True
                better = found.max(axis=1) > top[active, 0]
                if better.any():
                    some = active[better]
                    top[some] = np.partition(np.concatenate((top[some], found[better]), axis=1), -k, axis=1)[:, -k:]  # the k-th best comes first
        self.opened += int(opened.sum())
        out, query_of = [], np.zeros(len(self.idf))
        for i, (t, q) in enumerate(vectors):
            least = max(float(top[i, 0]) - NEAR, 0.0)
            near = np.flatnonzero(scores[i, :n] >= least)
            ids = np.sort(self.at[near[(scores[i, near] > 0) & opened[i, near // BLOCK]]])
            query_of[t] = q
            sizes = self.size[ids]
            rows = list(map(slice, self.first[ids].tolist(), (self.first[ids] + sizes).tolist()))
            own, w = (np.concatenate([part[r] for r in rows]) if rows else part[:0] for part in (self.own_term, self.own_w))
            exact = np.bincount(np.repeat(np.arange(len(ids)), sizes), query_of[own] * w, minlength=len(ids)).round(12)
            query_of[t] = 0
            best = np.lexsort((ids, -exact))[:k]
            out.append((ids[best], exact[best]))
        return out

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        w = self.weight[ids] * cosines**2
        return float((w * self.labels[ids]).sum() / w.sum()) if len(ids) else self.bare

    def calibrate(self, votes: np.ndarray, who: np.ndarray) -> None:
        """Isotonic regression of label on vote (pool adjacent violators)."""
        pools: list[list[float]] = []  # vote, rate, weight
        for i in np.argsort(votes, kind="stable"):
            w = self.weight[who[i]]
            pools.append([votes[i] * w, self.labels[who[i]] * w, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                top = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
        if pools:
            v, y, w = np.array(pools).T
            self.steps = (v / w, y / w)

    def query(self, text: str | None) -> Query:
        found: Counter = Counter()
        for piece in pieces(text or ""):
            found.update(map(self.terms.get, words(piece)))
        found.pop(None, None)
        t, tf = np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.int32, len(found))
        order = np.argsort(t)
        return t[order].tobytes(), tf[order].tobytes()

    def judged(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """(score, ids of the neighbours, their cosines) of each text; equal ones are searched once."""
        queries = [self.query(t) for t in texts]
        asked, said = [q for q in dict.fromkeys(queries) if q[0]] if len(self.ids) else [], {}
        for at in range(0, len(asked), TOGETHER):
            part = asked[at : at + TOGETHER]
            for query, (ids, cosines) in zip(part, self.search(part), strict=True):
                said[query] = float(np.interp(self.vote(ids, cosines), *self.steps)), self.ids[ids].tolist(), cosines.tolist()
        return [said.get(q) or (self.bare, [], []) for q in queries]

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        return self.judged([text])[0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Examples:
    """docs: (doc_id, text); labels: (doc_id, toxic). What comes to the driver is bounded by ``sample``."""
    labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(y): n for y, n in labels.groupBy("toxic").count().collect()}
    share = {y: min(1.0, sample / 2 / n) for y, n in sizes.items()}
    even = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    picked = labels.filter(even < F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)) * 1_000_000)
    picked = F.broadcast(picked.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")))  # about ``sample`` rows
    texts = cut(docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"))

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for text in b["text"]:
                found.update(set(counts(text)))
            yield pd.DataFrame({"term": list(found), "n": list(found.values())})

    terms: list[str] = []
    if {y for (y,) in texts.select("toxic").distinct().collect()} == {0, 1}:
        df = texts.mapInPandas(words_of, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).filter(F.col("df") >= MIN_DF)
        terms = sorted(t for part in df.groupBy(F.pmod(F.xxhash64("term"), F.lit(64))).agg(F.array_join(F.collect_list("term"), " ").alias("all")).select("all").collect() for t in part["all"].split(" "))
    known = texts.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counts(text, known.value) for text in b["text"]]
            blob = lambda numbers: np.fromiter(numbers, np.int32).tobytes()
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "terms": [blob(known.value[t] for t in c) for c in found], "tfs": [blob(c.values()) for c in found]})

    rows = texts.mapInPandas(vectors, "doc_id long, toxic int, terms binary, tfs binary").toPandas()
    known.destroy()
    model = Examples(terms, rows, (1 / share.get(0, 1.0), 1 / share.get(1, 1.0)))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            asked = [(i, int(np.searchsorted(model.ids, i)), model.query(text)) for i, text in zip(b["doc_id"], b["text"], strict=True)]
            asked = [x for x in asked if x[2][0]]
            for at in range(0, len(asked), TOGETHER):
                ids, skip, queries = zip(*asked[at : at + TOGETHER], strict=True)
                yield pd.DataFrame({"doc_id": ids, "vote": [model.vote(*found) for found in model.search(list(queries), skip=list(skip))]})

    if terms:
        own = texts.mapInPandas(votes, "doc_id long, vote double").toPandas().drop_duplicates("doc_id").sort_values("doc_id")
        shared.destroy()  # the one without calibration
        model.calibrate(own["vote"].to_numpy(), np.searchsorted(model.ids, own["doc_id"].to_numpy(np.int64)))
    return model


def score(docs: DataFrame, model: Examples) -> DataFrame:
    """The columns of ``docs`` (it needs a text) with score, neighbours and cosines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, neighbours array<long>, cosines array<double>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(shared.value.judged(list(batch)), columns=["score", "neighbours", "cosines"])

    return docs.withColumn("_said", judge(F.col("text"))).select(*docs.columns, "_said.score", "_said.neighbours", "_said.cosines")


def op9_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_score_toxicity": op9_score_toxicity}
#: None: a learned model; tests compare the search with brute force and measure held-out quality.
ORACLE_SQL: dict[str, str] = {}
