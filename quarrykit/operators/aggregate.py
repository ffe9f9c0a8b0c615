"""Grouped aggregation, shares, comparisons, rankings, audits. Lazy but for medians and places in an order; top-k always has a tiebreak."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.operators.order import placed
from quarrykit.operators.quantiles import quantiles

#: Aggregates by name.
FUNCTIONS = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "nunique": F.count_distinct}


def group_agg(df: DataFrame, key: str, value: str, function: str = "sum") -> DataFrame:
    """(key, value): rows without key are left out; an unknown function or column is an error."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {function}; known: {', '.join(sorted(FUNCTIONS))}")
    df = df.filter(F.col(key).isNotNull())
    if function == "median":  # the built-in holds all values of a group
        found = quantiles(df.select(F.col(key).alias("_key"), F.col(value).alias("_value")), ["_key"], "_value", [0.5])
        return df.select(key).distinct().join(found, F.col(key) == F.col("_key"), "left").select(key, F.col("quantiles")[0].alias(value))
    return df.groupBy(key).agg(FUNCTIONS[function](value).alias(value))


def group_summary(df: DataFrame, key: str, value: str, n: int = 20) -> DataFrame:
    """(key, total, average, count) of the n groups of largest total."""
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("total"), F.avg(value).alias("average"), F.count(value).alias("count"))
    return grouped.orderBy(F.desc_nulls_last("total"), key).limit(n)


def group_wide(df: DataFrame, key: str, values: list[str], n: int = 10) -> DataFrame:
    """Sums of several columns; the n groups whose sums add up to most."""
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(v).alias(v) for v in values])
    return grouped.withColumn("combined", reduce(Column.__add__, [F.coalesce(F.col(v), F.lit(0.0)) for v in values])).orderBy(F.desc("combined"), key).limit(n)


def top_groups(df: DataFrame, key: str, value: Column, n: int = 10) -> DataFrame:
    """(rank, key, total) of the n largest sums. Only n rows reach the window."""
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc_nulls_last("total"), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("total"), key)))


def top_rows(df: DataFrame, value: str, tiebreak: str, n: int = 10, largest: bool = True) -> DataFrame:
    order = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return df.orderBy(order, tiebreak).limit(n)


def two_sided(df: DataFrame, key: str, value: str, n: int = 10) -> DataFrame:
    """Top n groups, and bottom n if there are more than 2n, with rank from the top and number of groups."""
    groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("total")).filter("total is not null")
    many = groups.count()
    top = groups.orderBy(F.desc("total"), F.asc(key)).limit(n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), F.asc(key)))).withColumn("side", F.lit("top"))
    if many <= 2 * n:
        return top.withColumn("of_total", F.lit(many).cast("long"))
    low = groups.orderBy(F.asc("total"), F.desc(key)).limit(n)
    low = low.withColumn("rank", F.lit(many + 1) - F.row_number().over(Window.orderBy(F.asc("total"), F.desc(key)))).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).withColumn("of_total", F.lit(many).cast("long"))


def shares(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total, share in per cent): 0 if all add up to nothing. The window is over groups."""
    all_ = F.sum("total").over(Window.partitionBy())
    return df.groupBy(key).agg(F.sum(value).alias("total")).withColumn("share", F.when(all_ > 0, F.col("total") / all_ * 100).otherwise(0.0))


def significance(pct: Column) -> Column:
    return F.when(F.abs(pct) > 20, "high").when(F.abs(pct) > 10, "medium").otherwise("low")


def comparisons(df: DataFrame, key: str, value: str) -> DataFrame:
    """The largest group against the second, and against the smallest if there are three or more."""
    groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias("total"))
    best = groups.orderBy(F.desc("total"), key).limit(2)
    best = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), key)))
    worst = groups.orderBy(F.asc("total"), F.desc(key)).limit(1).withColumn("place", F.lit(3))
    ends = best.unionByName(worst).groupBy().pivot("place", [1, 2, 3]).agg(F.first(key).alias("name"), F.first("total").alias("total"))
    many = groups.agg(F.count("*").alias("many"))
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col("1_name").alias("left_name"), F.col(f"{i}_name").alias("right_name"), F.col("1_total").alias("left_total"), F.col(f"{i}_total").alias("right_total")) for kind, i in (("top_vs_second", 2), ("top_vs_bottom", 3))])
    one = ends.join(many, F.lit(True)).select("many", F.explode(pairs).alias("p")).select("many", "p.*")  # one row each
    diff = F.col("left_total") - F.col("right_total")
    least = F.least(F.abs("left_total"), F.abs("right_total"))
    pct = F.when(least == 0, 0.0).otherwise(diff / least * 100)
    return one.filter(F.when(F.col("kind") == "top_vs_second", F.col("many") >= 2).otherwise(F.col("many") >= 3)).select("kind", "left_name", "right_name", diff.alias("difference"), pct.alias("pct"), significance(pct).alias("significance"))


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n)


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows, nulls equal."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("groups"))


def date_span(df: DataFrame, column: str) -> DataFrame:
    """First and last day, days, months of 30 days, and the mean interval in days between rows in date order."""
    low, high, n = F.min(column), F.max(column), F.count(column)
    days = F.datediff(high, low)
    seconds = F.unix_timestamp(high) - F.unix_timestamp(low)
    return df.agg(F.date_format(low, "yyyy-MM-dd").alias("first_day"), F.date_format(high, "yyyy-MM-dd").alias("last_day"), days.cast("long").alias("days"), F.floor(days / 30).cast("long").alias("months"), F.when(n > 1, seconds / 86400 / (n - 1)).alias("mean_interval"))


def time_bucket(df: DataFrame, ts: str, value: str, unit: str | None = None) -> DataFrame:
    """Sum by exact time, or by a truncated one."""
    at = F.col(ts) if unit is None else F.date_trunc(unit, ts)
    return df.filter(F.col(ts).isNotNull()).groupBy(at.alias("bucket")).agg(F.sum(value).alias("total"), F.count(value).alias("count"))


def ratio(df: DataFrame, part: Column, whole: Column) -> DataFrame:
    """Sum of a part as percentage of the sum of a whole."""
    return df.agg(F.sum(part).alias("part"), F.sum(whole).alias("whole")).withColumn("pct", F.when(F.col("whole") != 0, F.col("part") / F.col("whole") * 100))


def union_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name, missing ones null; a column of several types becomes a string."""
    if not tables:
        raise ValueError("no table to unite")
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for name, kind in t.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {name for name, k in kinds.items() if len(k) > 1}
    cast = [t.select(*[F.col(c).cast("string").alias(c) if c in mixed else F.col(c) for c in t.columns]) for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def report(df: DataFrame, columns: list[str], units: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """(name, total, average, least, most, count, unit) of numeric columns in one pass; ``units``: column of the unit, whose first value in ``order`` counts."""
    unit = lambda c: F.min_by(F.when(F.col(units[c]).isNotNull(), F.col(units[c])), F.when(F.col(units[c]).isNotNull(), F.col(order))) if units and c in units else F.lit(None).cast("string")
    made = [F.struct(F.lit(c).alias("name"), F.sum(c).cast("double").alias("total"), F.avg(c).cast("double").alias("average"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"), F.count(c).alias("count"), unit(c).alias("unit")) for c in columns]
    return df.agg(F.array(*made).alias("_r")).select(F.inline("_r"))


def rankings(df: DataFrame, group: str, columns: list[str], k: int = 5) -> DataFrame:
    """(metric, rank, name, total): the k groups of greatest sum for each column, from one aggregation."""
    sums = df.groupBy(group).agg(F.array(*[F.struct(F.lit(c).alias("metric"), F.sum(c).cast("double").alias("total")) for c in columns]).alias("_s"))
    each = sums.select(F.col(group).cast("string").alias("name"), F.inline("_s")).filter("total is not null")
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("total"), "name"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("metric", "rank", "name", "total")


def chart_series(df: DataFrame, x: str, y: str, kind: str, k: int = 10) -> DataFrame:
    """(at, x, y), the points of a chart: for bars the k greatest sums, for a line the sums in order of x."""
    sums = df.groupBy(F.col(x).cast("string").alias("x")).agg(F.sum(y).cast("double").alias("y"))
    if kind == "bar":
        best = sums.orderBy(F.desc("y"), "x").limit(k)  # k rows
        return best.withColumn("at", F.row_number().over(Window.orderBy(F.desc("y"), "x"))).select("at", "x", "y")
    return placed(sums, ["x"], "at").select((F.col("at") + 1).cast("int").alias("at"), "x", "y")
