"""Trends over time order and anomalies. Positions in order are counted by ranges, so no task sees all rows, nor all of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.operators.order import placed
from quarrykit.operators.quantiles import quantiles


def positioned(df: DataFrame, ts: str, value: str, tiebreak: str) -> DataFrame:
    """(ts, tiebreak, value, pos): values that are there with their place from 0 in the order of (ts, tiebreak)."""
    columns = list(dict.fromkeys((ts, tiebreak, value)))
    return placed(df.filter(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*columns), [ts, tiebreak], "pos")


def trend_ols(df: DataFrame, ts: str, value: str, tiebreak: str, least: int = 5) -> DataFrame:
    """Slope per position of non-null values, stable below a hundredth of their deviation; change from first to last."""
    v = F.col(value).cast("double")
    one = positioned(df, ts, value, tiebreak).agg(
        F.count("*").alias("n"), F.regr_slope(v, F.col("pos").cast("double")).alias("slope"), F.stddev_samp(v).alias("std"), F.min_by(v, F.col("pos")).alias("first_value"), F.max_by(v, F.col("pos")).alias("last_value")
    )
    direction = F.when(F.abs("slope") < 0.01 * F.col("std"), "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    change = F.when(F.col("first_value") == 0, 0.0).otherwise((F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100)
    return one.filter(F.col("n") >= least).select("n", "slope", direction.alias("direction"), change.alias("change_pct"))


def trend_thirds(df: DataFrame, ts: str, value: str, tiebreak: str, threshold: float = 5.0) -> DataFrame:
    """Mean of the last third of the values against that of the first; with label and confidence by number of values."""
    rows = positioned(df, ts, value, tiebreak)
    n = rows.count()
    third = n // 3
    one = rows.agg(F.avg(F.when(F.col("pos") < third, F.col(value))).alias("first_mean"), F.avg(F.when(F.col("pos") >= n - third, F.col(value))).alias("last_mean"))
    pct = F.round((F.col("last_mean") - F.col("first_mean")) / F.col("first_mean") * 100, 2)
    label = F.when(pct > threshold, "up").when(pct < -threshold, "down").when(F.abs(pct) < threshold, "stable").otherwise(F.when(pct > 0, "up").otherwise("down"))
    sure = "high" if n >= 30 else "medium" if n >= 10 else "low"
    return one.filter((F.lit(n) >= 3) & (F.col("first_mean") != 0)).select(F.lit(n).cast("long").alias("n"), "first_mean", "last_mean", pct.alias("change_pct"), label.alias("direction"), F.lit(sure).alias("confidence"))


def outliers_iqr(df: DataFrame, value: str, key: str, approximate: bool = False, keep: int = 5, least: int = 10) -> DataFrame:
    """Bounds at 1.5 interquartile ranges, how many values lie outside, and the first of them by key.

    Exact quartiles take some passes over large tables; ``approximate`` takes one.
    """
    if approximate:
        n, q = df.agg(F.count(value), F.percentile_approx(value, [0.25, 0.75], 10_000)).first()
    else:
        n, q = quantiles(df, [], value, [0.25, 0.75]).first() or (0, None)
    if n < least:
        return df.select(F.lit(0).cast("long").alias("n_outliers"), F.lit(0.0).alias("pct"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit("").alias("first_values")).limit(0)
    low, high = q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])
    out = df.filter((F.col(value) < low) | (F.col(value) > high))
    first = out.orderBy(key, value).limit(keep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: F.format_string("%.2f", x[value].cast("double"))), ",").alias("first_values"))
    one = out.agg(F.count("*").alias("n_outliers")).join(first, F.lit(True))  # one row each
    return one.select("n_outliers", F.round(F.col("n_outliers") / n * 100, 2).alias("pct"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), "first_values")


def z_scores(df: DataFrame, value: str, limit: float = 2.5) -> tuple[DataFrame, float, float]:
    """Rows whose z-score (sample deviation) is beyond the limit, with it; the mean and deviation."""
    mean, std = df.agg(F.avg(value), F.stddev_samp(value)).first()
    z: Column = (F.col(value) - F.lit(mean).cast("double")) / F.lit(std or None).cast("double")
    return df.withColumn("z", z).filter(F.abs("z") > limit), mean or 0.0, std or 0.0


def outliers_z(df: DataFrame, value: str, key: str, limit: float = 2.5, most: int = 50) -> DataFrame:
    """The first rows by key beyond the limit, with severity."""
    found, _, _ = z_scores(df, value, limit)
    return found.select(key, value, F.col("z"), F.when(F.abs("z") > 3, "high").otherwise("medium").alias("severity")).orderBy(key).limit(most)


def outliers_expected(df: DataFrame, value: str, key: str, limit: float = 2.5, most: int = 10, least: int = 10) -> DataFrame:
    """The most severe rows with the range expected: mean and two deviations."""
    found, mean, std = z_scores(df, value, limit)
    n = df.agg(F.count(value)).first()[0]
    out = found.select(key, value, F.round("z", 2).alias("deviation"), F.when(F.abs("z") > 3, "high").otherwise("medium").alias("severity"), F.lit(mean - 2 * std).alias("expected_low"), F.lit(mean + 2 * std).alias("expected_high"))
    return out.filter(F.lit(n) >= least).orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), F.desc(F.abs("deviation")), key).limit(most)
