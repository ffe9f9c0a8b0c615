"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length within each source. A source whose target is above its own size is
passed over whole as often as it fits; what is left of its budget is filled from the length histogram: an equal
share of every length, then long documents, up to KNAPSACK words below the budget, and these by a bounded knapsack
over the documents not used up. If that misses the budget, the knapsack grows; budgets of up to WIDEST words (times what
all lengths have in common) are fitted as well as any subset can, larger ones as well as a knapsack of that size can.
Documents are then selected by seeded hash order, as many of each length as the plan says.

Nulls and odd rows: a null text has no words and is never taken; a null source is a source of its own, last in
order; repeated rows are separate documents; an empty table gives an empty result; only the columns named are
read, so extra ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import WHITE, cut, table, text_hash, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20
#: Words of the dynamic programme at first, and when it misses the budget: so many are fitted exactly.
KNAPSACK, WIDEST = 1 << 16, 1 << 24
#: Documents of one source and length are ranked in buckets of about this many.
BUCKET = 1000


def token_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", text_hash(F.col("text")).alias("text_hash"), F.size(words(F.col("text"), WHITE)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source its size and target: (source, sid, source_size, target).

    The budget is the sum of all sizes. With targets w * level, and no target above max_repeats * size, the level
    follows from the sources in order of size / weight: those below it are full, the others share the rest.
    One row per source, so the windows over all of them are small.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "sid")
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.array(*[F.lit(float(x)) for x in weights])
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name))
        .withColumn("w", F.get(w, (F.col("sid") - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * float(max_repeats))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(so_far), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_w"))
        # the level is that of the first source in this order that does not fill up
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything))
        .select("source", "sid", "source_size", F.least("cap", F.col("w") * F.col("first.level")).alias("target"))
    )


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = KNAPSACK, widest: int = WIDEST) -> np.ndarray:
    """How many documents of each length to take, so that their words come to ``budget`` as nearly as found.

    ``lengths`` are distinct and positive, ``budget`` is at most their total. If the sum found with a knapsack of ``most``
    words misses the budget, the knapsack grows until it hits it or holds the whole budget, which is best; only beyond
    ``widest`` words (after division by what all lengths have in common) a sum below the best one may stay.
    """
    if not len(lengths) or int((lengths * counts).sum()) <= budget:
        return counts.copy()
    common = int(np.gcd.reduce(lengths))
    lengths, budget = lengths // common, budget // common
    total, best, words = int((lengths * counts).sum()), np.zeros_like(counts), lambda t: int((lengths * t).sum())
    while True:
        # an equal share of every length, in whole numbers, but for what the knapsack is to fill
        bulk = max(0, budget - most)
        share = np.array([int(c) * bulk // total for c in counts], dtype=np.int64)
        for leave in (most // 2, 0) if bulk else (0,):  # a long one may fit if it leaves less for short ones
            best = max(best, fill(lengths, counts, share.copy(), budget - words(share), most, leave), key=words)
            if words(best) == budget:
                return best
        if most >= min(budget, widest):
            return best
        most = min(16 * most, widest)


def fill(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, rest: int, most: int, leave: int) -> np.ndarray:
    """Take documents not used up for ``rest`` words more: long ones down to ``leave`` words, then by knapsack."""
    for i in np.argsort(-lengths):  # long ones while they leave enough for a fit by short ones
        if rest > most and lengths[i] <= rest - leave:
            n = min(int(counts[i] - taken[i]), (rest - leave) // int(lengths[i]))
            taken[i] += n
            rest -= n * int(lengths[i])
    if rest > most:  # what is not used up is longer than rest - leave, so that one of them fits at most
        fits = [i for i in range(len(lengths)) if taken[i] < counts[i] and lengths[i] <= rest]
        if fits:
            taken[max(fits, key=lambda i: lengths[i])] += 1
        return taken
    return taken + knapsack(lengths, counts - taken, rest)


def knapsack(lengths: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """Of each length how many to take for the greatest sum up to ``rest``: a bit and a step number for each sum."""
    # bit s of `reached` says that s words can be had; by_step[s]: the step, from 1, that first made s
    mask, reached, steps, by_step = (1 << (rest + 1)) - 1, 1, [], np.zeros(rest + 1, np.int32)
    for i in np.argsort(lengths):
        spare, lot, length = int(counts[i]), 1, int(lengths[i])
        while spare > 0 and length <= rest and reached.bit_length() <= rest:
            lot = min(lot, spare, max(1, rest // length))
            new = (reached << lot * length) & mask & ~reached
            if not new:
                break
            steps.append((i, lot))
            at = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
            by_step[np.flatnonzero(at)] = len(steps)
            reached |= new
            spare, lot = spare - lot, lot * 2
    best, taken = reached.bit_length() - 1, np.zeros_like(counts)
    while best:  # a sum was made from one that an earlier step had made
        i, lot = steps[by_step[best] - 1]
        taken[i] += lot
        best -= lot * int(lengths[i])
    return taken


def plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """The histogram of one source: distinct lengths, however many documents there are."""
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = min(int(round(target)) // total, MAX_REPEATS)
    take = fit(lengths, counts, int(round(target)) - whole * total) if whole < MAX_REPEATS else np.zeros_like(counts)
    return pd.DataFrame({"sid": pdf["sid"].to_numpy(), "size": lengths, "n": counts, "whole": whole, "take": take})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, repeats, taken) for every document."""
    sized = cut(token_counts(docs))
    targets = cut(source_targets(sized, weights))
    # one row per source; Spark broadcasts it if its measured size allows
    keyed = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "d.text_hash", "d.size", "t.sid", "t.source_size", "t.target")
    histogram = keyed.filter("size > 0").groupBy("sid", "size").agg(F.count("*").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    plan = cut(histogram.groupBy("sid").applyInPandas(plan_source, "sid int, size long, n long, whole int, take long"))
    out = ["doc_id", "text_hash", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")]
    empty = keyed.filter("size = 0").withColumn("repeats", F.lit(0)).select(*out)  # need no rank
    placed = keyed.filter("size > 0").join(plan, ["sid", "size"]).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.ceil(F.col("n") / BUCKET)))
    placed = placed.repartition("sid", "size", "bucket")  # else a common length stays in one task, and its join cannot be split
    cell = Window.partitionBy("sid", "size", "bucket")
    sizes = placed.groupBy("sid", "size", "bucket").agg(F.count("*").alias("rows"))
    before = sizes.select("sid", "size", "bucket", (F.sum("rows").over(Window.partitionBy("sid", "size").orderBy("bucket")) - F.col("rows")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(cell.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id", "text_hash")))
    repeats = F.col("whole") + F.when(F.col("before") + F.col("rank") <= F.col("take"), 1).otherwise(0)
    return ranked.join(before, ["sid", "size", "bucket"]).withColumn("repeats", repeats).select(*out).unionByName(empty)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.col("target").cast("double"), "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_mix": op10_mix}
#: None: a subset sum has no SQL form; tests compare it with brute force.
ORACLE_SQL: dict[str, str] = {}
