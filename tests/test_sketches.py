"""Merged sketches against exact figures, within their bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import sketches

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet").withColumn("gone", F.when(F.col("l_quantity") > 25, F.col("l_tax")))


def test_profile_of_merged_parts(spark, lines, tmp_path):
    columns = ["l_orderkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "gone"]
    month = F.date_format("l_shipdate", "yyyy-MM")
    sketches.states(lines.filter("l_orderkey % 2 = 0"), columns, month).write.parquet(str(tmp_path / "s"))
    sketches.states(lines.filter("l_orderkey % 2 <> 0"), columns, month).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    got = {r["name"]: r for r in sketches.profile(stored).collect()}
    values = lines.select(*columns).toPandas()
    for name, r in got.items():
        v = values[name].dropna()
        assert (r["rows"], r["nulls"]) == (len(values), values[name].isna().sum())
        assert r["distinct_low"] <= v.nunique() <= r["distinct_high"]
        if name in ("l_shipdate", "l_returnflag"):
            assert r["p50"] is None and r["low"] is None
            continue
        assert (r["low"], r["high"]) == (v.min(), v.max())
        for p in (25, 50, 75):  # the rank of what is returned is near the one asked for
            below, upto = (v < r[f"p{p}"]).mean(), (v <= r[f"p{p}"]).mean()
            assert below - sketches.RANK_ERROR <= p / 100 <= upto + sketches.RANK_ERROR
    one = sketches.profile(stored.filter("part = '1995-03'")).filter("name = 'l_quantity'").first()
    assert one["rows"] == lines.filter(month == "1995-03").count()


@pytest.mark.parametrize("column", ["l_suppkey", "l_returnflag", "l_orderkey", "l_quantity", "gone"])
def test_most_frequent_values_are_exact(lines, column):
    stored = sketches.frequent(lines, column, F.col("l_returnflag"))
    got = [(r["value"], r["count"]) for r in sketches.top_values(lines, column, stored).collect()]
    counts = lines.filter(F.col(column).isNotNull()).groupBy(column).count().collect()
    assert got == sorted(((r[column], r["count"]) for r in counts), key=lambda t: (-t[1], t[0]))[:10]


def test_nothing(spark):
    none = spark.createDataFrame([], "a int, b string, c double")
    assert sketches.states(none).collect() == [] and sketches.profile(sketches.states(none)).collect() == []
    assert sketches.top_values(none, "b", sketches.frequent(none, "b")).collect() == []
    nulls = spark.createDataFrame([(None, None, None)] * 3, "a int, b string, c double")
    r = {x["name"]: x for x in sketches.profile(sketches.states(nulls)).collect()}
    assert {(x["rows"], x["nulls"], x["distinct"], x["p50"]) for x in r.values()} == {(3, 3, 0, None)}
    assert sketches.top_values(nulls, "b", sketches.frequent(nulls, "b")).collect() == []
