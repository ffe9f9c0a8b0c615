"""Exact quantiles of many columns or groups at once, without a task or buffer that holds all values of one.

Each wanted rank is narrowed down in rounds: a sketch of bounded size splits what is left of a group into CUTS parts, two
of its cuts around the rank make a narrower range, and counting says exactly how many values lie below and inside. When
MOST values or fewer lie inside, they are counted by value and the rank is read off. A round leaves about a 300th, so
that three do for 10^12 values; a value of any frequency is one row. Between two ranks values are interpolated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.sources.folders import shared_folder

#: Values inside a range that are counted one by one; parts of a sketch and its accuracy; rows that are broadcast at most.
MOST, CUTS, ACCURACY, FEW = 200_000, 1000, 10_000, 1_000_000


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def cut(df: DataFrame) -> DataFrame:
    """``df``, a row for each wanted rank, written to the shared folder, so that no round is run again by the next."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def quantiles(rows: DataFrame, by: list[str], value: str, at: list[float], most: int | None = None) -> DataFrame:
    """(by..., n, quantiles): exact quantiles of the doubles in ``value``, nulls apart, in the order of ``at``; groups without values have no row."""
    most = MOST if most is None else most
    keys = [f"_k{i}" for i in range(len(by))]
    rows = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v")).filter("v is not null")
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    rank = lambda p: (F.col("n") - 1) * F.lit(float(p))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(rank(p)).alias("k"), (rank(p) - F.floor(rank(p))).alias("part")) for i, p in enumerate(at)])).alias("t")
    # values below the range, and strictly inside it
    targets = whole.filter("n > 0").select(*keys, "n", wanted, "low", "high").select(*keys, "n", "t.*", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    targets = cut(targets)

    def same(a: str, b: str) -> Column:
        return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))

    def meet(targets: DataFrame) -> DataFrame:
        """Rows with the targets of their group."""
        return rows.alias("r").join(few(targets).alias("t"), same("r", "t")).select("r.v", "t.*")

    ids = [*keys, "i"]
    left = targets.agg(F.max("inside")).first()[0] or 0
    while left > most:
        cuts = F.percentile_approx("v", [j / CUTS for j in range(CUTS + 1)], ACCURACY).alias("cuts")
        inner = meet(targets.filter(F.col("inside") > most)).filter("v > low AND v < high").groupBy(*ids).agg(cuts)
        place = (F.col("k") - F.col("below")) / F.greatest(F.col("inside"), F.lit(1)) * CUTS
        split = lambda j: F.get("cuts", F.least(F.greatest(j.cast("int"), F.lit(0)), F.lit(CUTS)))
        near = targets.alias("t").join(few(inner).alias("c"), same("t", "c") & (F.col("t.i") == F.col("c.i"))).select("t.*", "c.cuts")
        near = near.select("*", split(F.floor(place) - 2).alias("from"), split(F.ceil(place) + 2).alias("to"))
        counted = meet(near.drop("cuts")).groupBy(*ids).agg(
            F.count_if(F.col("v") < F.col("from")).alias("under"), F.count_if(F.col("v") <= F.col("to")).alias("upto"), F.count_if((F.col("v") > F.col("from")) & (F.col("v") < F.col("to"))).alias("within"),
            F.first("from").alias("from"), F.first("to").alias("to"),
        )
        good = (F.col("under") <= F.col("k")) & ((F.col("upto") > F.col("k") + 1) | (F.col("upto") >= F.col("n")))
        joined = targets.alias("t").join(few(counted).alias("c"), same("t", "c") & (F.col("t.i") == F.col("c.i")), "left").select("t.*", "c.under", "c.upto", "c.within", "c.from", "c.to")
        new = lambda a, b: F.when(good, F.col(a)).otherwise(F.col(b)).alias(b)
        targets = cut(joined.select(*keys, "n", "i", "k", "part", new("from", "low"), new("to", "high"), new("under", "below"), new("within", "inside")))
        before, left = left, targets.agg(F.max("inside")).first()[0]
        if 2 * left > before:  # what is left is a few values of great frequency
            break
    counts = meet(targets).filter("v >= low AND v <= high").groupBy(*ids, "n", "k", "part", "below", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*ids).orderBy("v"))
    placed = counts.withColumn("upto", upto)
    first = placed.groupBy(*ids, "n", "part").agg(F.min(F.when(F.col("upto") > F.col("k"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.col("k") + 1, F.col("v"))).alias("b"))
    one = first.select(*keys, "n", "i", (F.col("a") + F.when(F.col("part") > 0, (F.col("b") - F.col("a")) * F.col("part")).otherwise(0.0)).alias("q"))
    found = one.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quantiles"))
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "n", "quantiles")
