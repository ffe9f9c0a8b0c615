"""Quality of texts: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

A text's statistics (STATISTICS) are taken over all of it, in parts of a MiB, and stored; they are centred and scaled by
their mean and deviation over all documents and held within LIMIT deviations. FEATURES cosines of seeded random
directions approximate a Gaussian kernel of width WIDTH. Each task sums the normal equations of its labelled rows for
each of FOLDS folds, the sums are added up in a tree, and the driver solves FEATURES equations: no row reaches it, and
every labelled row counts. Each fold's rows are scored by a model of the other folds; a score's label rates, counted in
BINS bins, make the isotonic steps, between which scores are interpolated.

Null and empty texts have zeros as statistics and a score as others do. Equal texts have equal scores; rows of one doc_id
are scored one by one, and each learns from the mean of that doc_id's labels. Null labels and null doc_ids teach nothing;
without any label all scores are 0.5, with labels of one kind they are that label. Empty tables give no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.common import pieces, small, stored, table

FEATURES, WIDTH, RIDGE, FOLDS, BINS, LIMIT, SEED = 256, 6.0, 1e-3, 4, 4096, 6.0, 13
GOOD = 0.3
#: Words looked at together for repeats, so that long texts are judged like short ones.
SPAN = 128
STATISTICS = ("words", "word_length", "upper", "digits", "stops", "ends", "loud", "bars", "symbols", "wide", "breaks", "lines", "same_line", "distinct", "commonest", "stutter", "short", "entropy", "controls", "title")
_BYTES = np.arange(256)
#: Which bytes each share counts.
SHARES = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90), "digits": (_BYTES >= 48) & (_BYTES <= 57), "stops": np.isin(_BYTES, list(b",;:")), "ends": np.isin(_BYTES, list(b".?")), "loud": _BYTES == 33, "bars": _BYTES == 124,
    "symbols": np.isin(_BYTES, list(b"#$%&*+/<=>@\\^_`{}~[]()\"'-")), "wide": _BYTES >= 128, "breaks": np.isin(_BYTES, list(b"\n\r")), "controls": (_BYTES < 32) & ~np.isin(_BYTES, list(b"\t\n\r")),
}


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a text: shares of bytes, words and lines, so that its length counts once."""
    sizes, spans, seen = np.zeros(256), [], set()
    n: Counter = Counter()
    for part in pieces(text or ""):
        sizes += np.bincount(np.frombuffer(part.encode("utf-8", "replace"), np.uint8), minlength=256)
        words, lines = part.split(), part.split("\n")
        n["words"] += len(words)
        n["letters"] += sum(map(len, words))
        n["short"] += sum(len(w) <= 3 for w in words)
        n["title"] += sum(map(str.istitle, words))
        n["stutter"] += sum(map(operator.eq, words, words[1:]))
        for span in (words[i : i + SPAN] for i in range(0, len(words), SPAN)):
            if len(span) >= SPAN // 4 or not spans:  # the rest behind whole spans would look richer than they do
                of = Counter(span)
                spans.append((len(of) / len(span), max(of.values()) / len(span)))
        marks = set(map(hash, lines))
        n["lines"] += len(lines)
        n["same_line"] += len(lines) - len(marks - seen)
        seen |= marks
    if not sizes.any():
        return [0.0] * len(STATISTICS)
    share = sizes[sizes > 0] / sizes.sum()
    words, lines = max(n["words"], 1), max(n["lines"], 1)
    each = {name: sizes[which].sum() / sizes.sum() for name, which in SHARES.items()}
    each |= {"same_line": n["same_line"] / lines, "stutter": n["stutter"] / words}
    each = {name: np.sqrt(x) for name, x in each.items()}  # small shares tell as well
    each |= {"words": np.log1p(n["words"]), "word_length": np.log1p(n["letters"] / words), "lines": np.log1p(words / lines), "short": n["short"] / words, "title": n["title"] / words, "entropy": -(share * np.log2(share)).sum()}
    each |= dict(zip(("distinct", "commonest"), np.mean(spans, axis=0) if spans else (0.0, 0.0), strict=True))
    return [float(each[name]) for name in STATISTICS]


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x): the statistics of every text, stored."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(statistics, na_action=None)

    return stored(docs.select(F.col(key).alias("key"), of(F.col(text)).alias("x")), "quality")


class Model:
    """Scores of rows of statistics; ``weights``: those of each fold's model, which has not seen it, and of the whole one last."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.mean, self.deviation = mean, np.where(deviation > 0, deviation, 1.0)
        draw = np.random.default_rng(SEED)
        self.directions = draw.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.offsets = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights: list[np.ndarray] = []
        self.steps = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.deviation, -LIMIT, LIMIT)
        return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(x @ self.directions + self.offsets), np.ones((len(x), 1))), axis=1)

    def equations(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Each fold's part of the normal equations, their right side as the last column."""
        out = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for f in np.unique(fold):
            z = self.features(x[fold == f])
            out[f] = z.T @ np.concatenate((z, y[fold == f, None]), axis=1)
        return out

    def solve(self, sums: np.ndarray) -> None:
        whole = sums.sum(axis=0)
        for part in [*(whole - s for s in sums), whole]:
            rows = part[-1, -2]  # the constant's own product counts them
            penalty = RIDGE * max(rows, 1.0) * np.eye(len(part))
            penalty[-1, -1] = 1e-9
            self.weights.append(np.linalg.solve(part[:, :-1] + penalty, part[:, -1]))

    def raw(self, x: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
        z = self.features(x)
        return z @ self.weights[-1] if fold is None else (z * np.stack(self.weights)[fold]).sum(axis=1)

    def calibrate(self, score: np.ndarray, rows: np.ndarray, good: np.ndarray) -> None:
        """Pools neighbouring bins of scores (mean score, rows, labels of 1) until their rates rise."""
        pools: list[tuple[float, float, float]] = []
        for one in sorted(zip(score * rows, rows, good, strict=True), key=lambda p: p[0] / p[1]):
            while pools and pools[-1][2] * one[1] >= one[2] * pools[-1][1]:
                one = tuple(map(operator.add, pools.pop(), one))
            pools.append(one)
        at, n, y = np.array(pools).T
        self.steps = (at / n, y / n)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps) if self.weights else np.full(len(x), 0.5)


def learn(measures: DataFrame, labels: DataFrame) -> Model:
    """measures: (key, x); labels: (key, label), 0 or 1. All labelled rows teach."""
    n = len(STATISTICS)
    spread = measures.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
    model = Model(*np.array([0.0 if v is None else v for v in spread]).reshape(2, n))
    known = labels.filter("key is not null and label is not null").groupBy("key").agg(F.avg("label").alias("y"))
    rows = stored(measures.join(small(known), "key").select("x", "y", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(FOLDS)).cast("int").alias("fold")), "quality-labelled")
    if rows.isEmpty():
        return model
    arrays = lambda b: (b["x"].flatten().to_numpy().reshape(-1, n), b["y"].to_numpy(), b["fold"].to_numpy())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for b in batches:
            whole += model.equations(*arrays(b))
        yield pa.record_batch([pa.array([whole.tobytes()], pa.binary())], ["sums"])

    parts = rows.mapInArrow(sums, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
    model.solve(parts.treeReduce(np.add).reshape(FOLDS, FEATURES + 1, FEATURES + 2))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, fold = arrays(b)
            score = model.raw(x, fold)
            at = np.clip((score + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32)
            yield pa.record_batch([pa.array(at), pa.array(score), pa.array(y)], ["bin", "score", "y"])

    bins = rows.mapInArrow(binned, "bin int, score double, y double").groupBy("bin").agg(F.avg("score"), F.count("*").cast("double"), F.sum("y")).drop("bin").collect()
    model.calibrate(*np.array(sorted(map(tuple, bins))).T)
    return model


def scored(measures: DataFrame, model: Model) -> DataFrame:
    """(key, score)"""
    shared = measures.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(x)) if len(x) else np.zeros(0))

    return measures.select("key", score("x").alias("score"))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op12_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = measured(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    found = scored(measures, learn(measures, labels)).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_score_quality": op12_score_quality}
#: None: a learned model; tests compare its parts with plain computations and measure held-out quality.
ORACLE_SQL: dict[str, str] = {}
