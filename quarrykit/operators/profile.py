"""Column profiles, semantic types, completeness, correlation, histograms, metrics, confidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.functions.hygiene import unit_of
from quarrykit.operators.quantiles import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def unpivoted(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(name, value) rows; one pass over the table."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast(kind).alias("value")) for c in columns])).alias("x")).select("x.*")


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: count, distinct, min, max, mean, median, std (null for one row), sum, unit.

    Moments are one plain aggregate. Distinct values come from counts by value, which combine before the shuffle, medians
    from ranks narrowed down in rounds, so that no task holds all values of a column.
    """
    columns = columns or numeric_columns(df)
    found = {"non_null": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, "sum": F.sum}
    one = df.agg(F.count("*").alias("rows"), *[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in found.items()])
    unit = [F.lit(unit_of(c)).cast("string").alias("unit") for c in columns]
    rows = [F.struct(F.lit(c).alias("name"), (F.col("rows") - F.col(f"non_null_{i}")).alias("nulls"), *[F.col(f"{n}_{i}").alias(n) for n in found], unit[i]) for i, c in enumerate(columns)]
    moments = one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    by_value = unpivoted(df, columns, "double").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    values = by_value.groupBy("name").agg(F.count("*").alias("distinct"))
    medians = quantiles(unpivoted(df, columns, "double"), ["name"], "value", [0.5]).select("name", F.col("quantiles")[0].alias("median"))
    return moments.join(F.broadcast(values), "name", "left").join(F.broadcast(medians), "name", "left").select("name", "non_null", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"), "min", "max", "mean", "median", "std", "sum", "unit")


def by_type(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    """(name, value) rows of the columns of each type, values as they are: a scan a type, which reads that type's columns."""
    kinds: dict[str, list[str]] = {}
    for name, kind in df.select(*[F.col(f"`{c}`") for c in columns]).dtypes:
        kinds.setdefault(kind, []).append(name)
    return [unpivoted(df, names, kind) for kind, names in kinds.items()]


def counted(rows: DataFrame) -> DataFrame:
    """(name, non_null, nulls, distinct) of (name, value) rows: counts by value combine before the shuffle, and no task holds a column's values."""
    values = rows.groupBy("name", "value").agg(F.count("*").alias("n"))
    there = F.col("value").isNotNull()
    return values.groupBy("name").agg(F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("nulls"), F.count_if(there).alias("distinct"))


def completeness(df: DataFrame) -> DataFrame:
    """One row per column: non-null, null and distinct values (nulls apart), share missing."""
    found = reduce(DataFrame.unionByName, [counted(rows) for rows in by_type(df, df.columns)])
    return found.withColumn("missing_pct", F.round(F.col("nulls") / (F.col("nulls") + F.col("non_null")) * 100, 2))


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, share of cells filled, columns that are empty or mostly missing."""
    n, width = F.count("*"), len(df.columns)
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    rows = df.agg(n.alias("rows"), F.array(*nulls).alias("nulls"))
    cells = F.col("rows") * width
    missing = F.aggregate("nulls", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("rows", F.lit(width).cast("long").alias("columns"), F.when(cells > 0, F.round((cells - missing) / cells * 100, 2)).otherwise(0.0).alias("filled_pct"), F.size(F.filter("nulls", lambda x: (x == F.col("rows")) & (F.col("rows") > 0))).cast("long").alias("empty_columns"), F.size(F.filter("nulls", lambda x: x * 2 > F.col("rows"))).cast("long").alias("mostly_missing"))


def semantic_types(df: DataFrame) -> DataFrame:
    """(name, kind): numeric, id, datetime, boolean, categorical, text or unknown.

    Most types decide by themselves; whole numbers are counted by value, and only strings are looked at as text.
    """
    fields = {f.name: f.dataType for f in df.schema}

    def physical(kind: T.DataType, name: str) -> str:
        named_id = name.lower() in ("id", "index", "key", "pk") or name.lower().endswith("_id")
        if isinstance(kind, T.NumericType):
            return "id" if named_id else "integer" if isinstance(kind, T.IntegralType) else "numeric"
        return "datetime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "boolean" if isinstance(kind, T.BooleanType) else "string"

    of = {name: physical(kind, name) for name, kind in fields.items()}
    sure = df.sparkSession.createDataFrame([(n, k) for n, k in of.items() if k not in ("integer", "string")], "name string, kind string")
    whole, texts = [n for n, k in of.items() if k == "integer"], [n for n, k in of.items() if k == "string"]
    found = [sure]
    if whole:
        ids = counted(unpivoted(df, whole, "bigint"))
        found.append(ids.select("name", F.when((F.col("non_null") > 0) & (F.col("distinct") / F.col("non_null") > 0.95), "id").otherwise("numeric").alias("kind")))
    if texts:
        values = unpivoted(df, texts, "string").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
        stats = values.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("u"), (F.sum(F.col("n") * F.length("value")) / F.sum("n")).alias("length"), F.sum(F.when(F.try_to_timestamp("value").isNotNull(), F.col("n")).otherwise(0)).alias("dates"))
        names = df.sparkSession.createDataFrame([(n,) for n in texts], "name string")
        kind = (
            F.when(F.col("n").isNull(), "unknown").when(F.col("dates") / F.col("n") > 0.8, "datetime")
            .when((F.col("u") / F.col("n") < 0.5) | (F.col("u") < 50), "categorical").when(F.col("length") > 100, "text").otherwise("categorical")
        )
        found.append(names.join(stats, "name", "left").select("name", kind.alias("kind")))
    return reduce(DataFrame.unionByName, found)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(left_column, right_column, n, r): the Pearson correlation of all pairs, each over the rows where both are there.

    Each task adds up products of blocks of rows, values less their column's mean and masks of what is there, and the
    sums of all tasks are added up in a tree: columns x columns figures reach the driver, whatever the number of rows.
    Pairs without spread have no r; NaN counts as missing.
    """
    columns = columns or numeric_columns(df)
    d = len(columns)
    plain = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    means = np.array([m or 0.0 for m in plain.agg(*[F.avg(f"c{i}") for i in range(d)]).first()])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((4, d, d))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(np.float64) - means
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(np.float64)
            whole += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.record_batch([pa.array([whole.tobytes()], pa.binary())], ["sums"])

    parts = plain.mapInArrow(sums, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
    n, s, q, p = parts.treeAggregate(np.zeros(4 * d * d), np.add, np.add).reshape(4, d, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (n * q - s * s) * (n * q.T - s.T * s.T)
        r = (n * p - s * s.T) / np.sqrt(spread)
    rows = [(a, b, int(n[i, j]), float(np.clip(r[i, j], -1, 1)) if spread[i, j] > 0 else None) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "left_column string, right_column string, n long, r double")


def correlations(df: DataFrame, columns: list[str] | None = None, top: int = 5, most: int = 15) -> DataFrame:
    """The strongest pairs by absolute Pearson correlation, each over the rows where both are there. One aggregate, or the matrix of more than ``most`` columns."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    if len(columns) > most:
        place = {c: i for i, c in enumerate(columns)}
        matrix = correlation_matrix(df, columns).collect()
        rows = [(r["left_column"], r["right_column"], r["r"]) for r in matrix if place[r["left_column"]] < place[r["right_column"]]]
        found = df.sparkSession.createDataFrame(rows, "left_column string, right_column string, r double")
    elif pairs:
        one = df.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
        rows = F.array(*[F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
        found = one.select(F.explode(rows).alias("x")).select("x.*")
    else:
        found = df.sparkSession.createDataFrame([], "left_column string, right_column string, r double")
    return found.filter("r is not null and not isnan(r)").orderBy(F.desc(F.abs("r")), "left_column", "right_column").limit(top)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count): equal widths between least and greatest value, the last bin closed."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("count")).limit(0)
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("count")).select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "count")


def metrics(df: DataFrame, columns: list[str], categories: list[str], most: int = 20) -> DataFrame:
    """(ordinal, name, value): totals, averages and extremes of numeric columns, the row count, distinct categories."""
    keep = [c for c in columns if not (c.lower() == "id" or c.lower().endswith(("_id", "key")))]
    aggs = [f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate(keep) for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max), ("min", F.min))]
    one = df.agg(F.count("*").alias("rows"), *aggs, *[F.count_distinct(c).alias(f"u_{i}") for i, c in enumerate(categories[:3])])
    out = []
    for i, c in enumerate(keep):
        total, low, high = F.col(f"sum_{i}"), F.col(f"min_{i}"), F.col(f"max_{i}")
        out += [(f"Total {c}", total, total != 0), (f"Average {c}", F.col(f"avg_{i}"), F.lit(True)), (f"Maximum {c}", high, F.lit(True)), (f"Minimum {c}", low, low != high)]
    out.append(("Total Records", F.col("rows").cast("double"), F.lit(True)))
    out += [(f"Unique {c}", F.col(f"u_{i}").cast("double"), (F.col(f"u_{i}") > 0) & (F.col(f"u_{i}") < 0.9 * F.col("rows"))) for i, c in enumerate(categories[:3])]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.when(ok, F.round(v, 2)).alias("value")) for i, (n, v, ok) in enumerate(out)])
    kept = one.select(F.explode(rows).alias("x")).select("x.*").filter("value is not null")
    return kept.withColumn("ordinal", F.row_number().over(Window.orderBy("ordinal"))).filter(F.col("ordinal") <= most)  # a few dozen rows


def confidence(rows: int, n_metrics: int, n_comparisons: int, null_share: float) -> str:
    score = (2 if rows >= 1000 else 1 if rows >= 100 else 0) + (2 if n_metrics >= 10 else 1 if n_metrics >= 5 else 0) + (n_comparisons >= 3) + (null_share < 0.1)
    return "high" if score >= 5 else "medium" if score >= 3 else "low"


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(count, mean, median, std, range) of a numeric column."""
    return numeric_profile(df, [column]).select(F.col("non_null").alias("count"), "mean", "median", "std", (F.col("max") - F.col("min")).alias("range"))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of each table."""
    each = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)
