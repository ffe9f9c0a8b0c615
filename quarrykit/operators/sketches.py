"""Profiles from sketches: states of bounded size for parts of a table, kept in a table of their own and merged as asked.

Each part (a day, a file, a load) has a row a column: counts of rows and nulls, an HLL state of its values' hashes, a KLL
state of numbers and the state of the most frequent values. Rows of any parts merge into a profile without a look at the
data; new parts add rows. Estimates come with their bounds. The most frequent values are candidates that a second pass
counts exactly; where the bound does not rule out another value, all values are counted. No value is cast to a string
but to be shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: log2 of an HLL state's size; a KLL state's; values that a state of frequent ones tracks.
LG, K, TRACKED = 14, 400, 4096
#: Error of an HLL estimate at three deviations, of a KLL rank at 99 %, and the share of all rows that a frequent value's count may miss.
DISTINCT_ERROR, RANK_ERROR, COUNT_ERROR = 3 * 1.04 / 2 ** (LG / 2), 2.3 / K**0.9, 3.5 / TRACKED


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def states(df: DataFrame, columns: list[str] | None = None, part: Column | None = None) -> DataFrame:
    """(part, name, rows, nulls, distinct, ranks, low, high, frequent): a row for each part and column; one aggregate a column in one scan."""
    columns = columns or df.columns
    part = F.lit("all") if part is None else part.cast("string")
    kinds = {f.name: f.dataType for f in df.schema}

    def of(c: str) -> Column:
        value, number = F.col(f"`{c}`"), F.col(f"`{c}`").cast("double") if numeric(kinds[c]) else F.lit(None).cast("double")
        ranks = F.kll_sketch_agg_double(number, F.lit(K)) if numeric(kinds[c]) else F.lit(None).cast("binary")
        fields = (F.lit(c).alias("name"), F.count("*").alias("rows"), (F.count("*") - F.count(value)).alias("nulls"), F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), LG).alias("distinct"), ranks.alias("ranks"), F.min(number).alias("low"), F.max(number).alias("high"))
        return F.struct(*fields)

    one = df.groupBy(part.alias("part")).agg(F.array(*[of(c) for c in columns]).alias("c"))
    return one.select("part", F.explode("c").alias("c")).select("part", "c.*")


def profile(stored: DataFrame) -> DataFrame:
    """(name, rows, nulls, distinct, distinct_low, distinct_high, low, p25, p50, p75, high) of all parts of stored states together."""
    merged = stored.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"), F.kll_merge_agg_double("ranks", F.lit(K)).alias("ranks"), F.min("low").alias("low"), F.max("high").alias("high"))
    at = [F.when(F.col("high").isNotNull(), F.kll_sketch_get_quantile_double("ranks", F.lit(p))).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return merged.select("name", "rows", "nulls", "distinct", (F.col("distinct") * (1 - DISTINCT_ERROR)).alias("distinct_low"), (F.col("distinct") * (1 + DISTINCT_ERROR)).alias("distinct_high"), "low", *at, "high")


def frequent(df: DataFrame, column: str, part: Column | None = None) -> DataFrame:
    """(part, rows, state): the state of a column's most frequent values for each part; nulls are no values."""
    rows = df.select((F.lit("all") if part is None else part.cast("string")).alias("part"), F.col(column).alias("v")).filter("v is not null")
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.call_function("approx_top_k_accumulate", F.col("v"), F.lit(TRACKED)).alias("state"))


def top_values(df: DataFrame, column: str, stored: DataFrame, k: int = 10) -> DataFrame:
    """(value, count): exactly the k most frequent values of ``df``, whose states are ``stored``; ties go to the smaller value.

    A value that is no candidate stands in COUNT_ERROR of all rows at most; if the k-th candidate stands in more, it cannot
    be one of the k. Else all values are counted.
    """
    rows = df.select(F.col(column).alias("value")).filter("value is not null")
    if stored.isEmpty():
        return rows.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)
    state = stored.agg(F.sum("rows").alias("rows"), F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col("state"), F.lit(TRACKED)), F.lit(4 * k)).alias("top")).first()
    best = lambda r: r.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(k)
    candidates = [t["item"] for t in state["top"]]
    found = best(rows.filter(F.col("value").isin(candidates)))
    counts = [r["count"] for r in found.collect()]
    all_known = len(candidates) < 4 * k  # fewer values than asked for: there are no others, if none was pushed out
    sure = len(counts) == k and counts[-1] > COUNT_ERROR * state["rows"] or all_known and sum(t["count"] for t in state["top"]) == state["rows"]
    return found if sure else best(rows)


def union(tables: list[DataFrame]) -> DataFrame:
    """States of several loads in one table."""
    return reduce(DataFrame.unionByName, tables)
