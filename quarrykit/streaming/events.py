"""Windows over event streams; each function takes a static or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators.quantiles import quantiles
from quarrykit.streaming.runs import Rule, runs, stream_runs


def stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def late(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if events.isStreaming else events


def rate(events: DataFrame, ts: str, length: str = "60 seconds", step: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, count, per_second) by sliding or tumbling window."""
    w = F.window(ts, length, step or length)
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return late(events, ts, delay).groupBy(w.alias("w")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "count", (F.col("count") / seconds).alias("per_second"))


def by_kind(events: DataFrame, ts: str, kind: str, value: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return late(events, ts, delay).groupBy(F.window(ts, length).alias("w"), kind).agg(F.count("*").alias("count"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "count", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(key, start, count) of runs of events without a pause of ``gap``."""
    return late(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("count")).select(key, F.col("w.start").alias("start"), "count")


def alerts(events: DataFrame, ts: str, kind: str, value: str, limit: float, cooldown: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """One alert per kind and cooldown: when the greatest value first passed the limit, and how often it did."""
    over = late(events, ts, delay).filter(F.col(value) > limit)
    return over.groupBy(F.window(ts, cooldown).alias("w"), kind).agg(F.min(ts).alias("fired"), F.max(value).alias("worst"), F.count("*").alias("count")).select(kind, "fired", "worst", "count")


def alerts_with_cooldown(events: DataFrame, ts: str, kind: str, value: str, limit: float, cooldown: int = 300, delay: str = "10 minutes") -> DataFrame:
    """(kind, fired): an alert when a value passes the limit, and no other of its kind for ``cooldown`` seconds from then on."""
    rule = Rule(cooldown * 1_000_000)
    over = events.filter(F.col(value) > limit).withColumn("_order", F.lit(0))
    found = stream_runs(over, kind, ts, "_order", value, rule, delay, at_start=True) if events.isStreaming else runs(over, kind, ts, "_order", value, rule)
    return found.filter("opened").select(F.col("key").alias(kind), F.timestamp_micros("start").alias("fired"))


def batches(events: DataFrame, ts: str, kind: str, value: str, order: str, size: int = 10, timeout: float = 0.5, delay: str = "10 minutes") -> DataFrame:
    """(kind, start, last, count, total): events of a kind in batches, which close with ``size`` events or ``timeout`` seconds after their first."""
    rule = Rule(int(timeout * 1_000_000), size, closed=True)
    if events.isStreaming:
        found = stream_runs(events, kind, ts, order, value, rule, delay, at_start=False)
    else:
        found = runs(events, kind, ts, order, value, rule).groupBy("key", "start", "start_order").agg(F.max("last").alias("last"), F.sum("count").alias("count"), F.sum("total").alias("total"))
    return found.select(F.col("key").alias(kind), F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "count", "total")


def percentiles(events: DataFrame, ts: str, kind: str, value: str, length: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """(start, kind, p50, p95, p99, count) by window: exact for a static table, from a sketch of bounded size on a stream."""
    at, window = [0.5, 0.95, 0.99], F.window(ts, length)
    if events.isStreaming:
        p = F.percentile_approx(value, at, 10_000)
        found = late(events, ts, delay).groupBy(window.alias("w"), kind).agg(p.alias("p"), F.count(value).alias("count")).select(F.col("w.start").alias("start"), kind, "p", "count")
    else:
        placed = events.withColumn("start", window["start"])
        empty = placed.groupBy("start", kind).agg(F.count(value).alias("count")).filter("count = 0").select("start", kind, F.lit(None).cast("array<double>").alias("p"), "count")
        found = quantiles(placed, ["start", kind], value, at).select("start", kind, F.col("quantiles").alias("p"), F.col("n").alias("count")).unionByName(empty)
    return found.select("start", kind, *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "count")


def for_each(out: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Hand each micro-batch of a result to ``handle``; state and offsets live in ``checkpoint``."""
    return out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
