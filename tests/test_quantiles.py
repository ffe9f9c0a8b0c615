"""Exact quantiles against numpy: groups, rounds, frequent values, odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import aggregate, quantiles as q

AT = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]


def made(spark, groups):
    return spark.createDataFrame([(g, None if v is None else float(v)) for g, values in groups.items() for v in values], "g string, v double").repartition(6)


@pytest.mark.parametrize("most", [q.MOST, 60])
def test_groups(spark, most):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=5000), "wide": 10.0 ** rng.uniform(-200, 200, 4000), "ties": rng.choice([1.0, 2.0, 2.5], 3000), "one": [7.0], "same": [3.0] * 2000, "hot": np.concatenate(([5.0] * 4000, rng.uniform(0, 10, 3000))), "two": [1.0, None, 4.0], "none": [None, None], None: range(100)}
    got = {r["g"]: r for r in q.quantiles(made(spark, groups), ["g"], "v", AT, most).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, r in got.items():
        values = [v for v in groups[g] if v is not None]
        assert r["n"] == len(values)
        assert np.allclose(r["quantiles"], np.quantile(values, AT), rtol=1e-12), g


def test_without_groups_in_rounds(spark, monkeypatch):
    """Some rounds over many values, with few values left for the last."""
    monkeypatch.setattr(q, "CUTS", 20)
    rows = spark.range(40_000).select((F.pmod(F.col("id") * 7919, F.lit(40_009)) ** 3).alias("v"))
    want = np.quantile(np.array([r["v"] for r in rows.collect()]), [0.1, 0.5])
    got = q.quantiles(rows, [], "v", [0.1, 0.5], 50).collect()
    assert len(got) == 1 and got[0]["n"] == 40_000 and np.allclose(got[0]["quantiles"], want, rtol=1e-12)
    assert q.quantiles(rows.limit(0), [], "v", [0.5]).collect() == []


def test_median_of_groups(spark):
    df = made(spark, {"a": [1, 2, 9, 10], "b": [None], None: [4]})
    assert {r["g"]: r["v"] for r in aggregate.group_agg(df, "g", "v", "median").collect()} == {"a": 5.5, "b": None}
