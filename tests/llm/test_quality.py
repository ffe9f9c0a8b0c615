"""Quality scores: parts against plain computations, held-out rows, odd texts and labels."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrykit.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    """Only rows that were not learned from are counted."""
    got = {r["doc_id"]: r for r in quality.op12_score_quality(spark, FOLDER).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    labels = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    said = [(r["score"], r["predicted"], q) for r, q in labels if r["held_out"]]
    good, bad = [s for s, _, q in said if q], [s for s, _, q in said if not q]
    assert len(bad) >= 5 and np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([p == q for _, p, q in said]) > 0.95 and np.mean([p for _, p, q in said if q]) > 0.98


def test_statistics():
    of = lambda t: dict(zip(quality.STATISTICS, quality.statistics(t), strict=True))
    assert set(of(None).values()) == set(of("").values()) == {0.0}
    one = of("The cat sat. The cat sat.\nThe cat\nThe cat")
    assert one["words"] == pytest.approx(np.log(11)) and one["title"] == 0.4 and one["short"] == 0.8 and one["same_line"] == pytest.approx((1 / 3) ** 0.5)
    assert one["distinct"] == 0.3 and one["commonest"] == 0.4 and one["stutter"] == 0
    assert of("a a b")["stutter"] == pytest.approx((1 / 3) ** 0.5)
    assert all(np.isfinite(quality.statistics(t)).all() for t in (" ", "\n", "\x00", "é", "x" * 3_000_000, "a b " * 1_000_000, "1"))
    # the same text over and over, beyond a part's size, has the statistics of its parts but for its length
    long, once = of("it was the best of times, " * 100_000), of("it was the best of times, " * 1000)
    assert all(abs(long[n] - once[n]) < 0.02 for n in quality.STATISTICS if n not in ("words", "lines", "same_line"))


def test_features_approximate_a_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", 20_000)
    model = quality.Model(np.zeros(4), np.ones(4))
    x = np.random.default_rng(2).normal(size=(20, 4))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_equations_add_up_and_folds_are_left_out(spark):
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(400, len(quality.STATISTICS))), 400
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    measures = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>").repartition(7)
    model = quality.learn(measures, spark.createDataFrame(list(enumerate(y.tolist())), "key long, label int"))
    z = model.features(x)
    penalty = quality.RIDGE * n * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights[-1], np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    fold = np.array([r["f"] for r in spark.range(n).selectExpr(f"id", f"cast(pmod(xxhash64(id, {quality.SEED}), {quality.FOLDS}) as int) AS f").orderBy("id").collect()])
    keep = fold != 2
    penalty = quality.RIDGE * keep.sum() * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights[2], np.linalg.solve(z[keep].T @ z[keep] + penalty, z[keep].T @ y[keep]), atol=1e-6)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 5), st.integers(0, 5)), min_size=1, max_size=12, unique_by=lambda t: t[0]))
def test_isotonic_steps(bins):
    """Pools are the best rising fit: each rate is the max over starts of the min over ends of mean labels."""
    bins = sorted((float(s), n, min(g, n)) for s, n, g in bins)
    model = quality.Model(np.zeros(1), np.ones(1))
    model.calibrate(*np.array(bins, float).T)
    fit = [max(min(sum(b[2] for b in bins[i : j + 1]) / sum(b[1] for b in bins[i : j + 1]) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    at, rate = model.steps
    assert (np.diff(rate) > 0).all() and (np.diff(at) > 0).all()
    assert sorted(set(np.round(fit, 9))) == sorted(set(np.round(rate, 9)))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "some text of no id", 1, "k"), (1, None, 1, "k"), (2, "", 1, "k"), (3, "good words and more of them", 1, "k"), (3, "### $$$", 1, "k"), (4, "good words and more of them", 1, "k"), (5, "ab " * 900_000, 1, "k")], "doc_id long, text string, x int, key string")
    labels = lambda rows: spark.createDataFrame(rows, "key long, label int")
    measures = quality.measured(docs, "doc_id", "text")
    by_key = lambda model: sorted((str(r["key"]), r["score"]) for r in quality.scored(measures, model).collect())
    assert {s for _, s in by_key(quality.learn(measures, labels([])))} == {0.5}
    assert {s for _, s in by_key(quality.learn(measures, labels([(9, 1), (None, 1), (1, None)])))} == {0.5}
    assert {round(s, 9) for _, s in by_key(quality.learn(measures, labels([(3, 1), (4, 1)])))} == {1.0}
    both = by_key(quality.learn(measures, labels([(3, 1), (3, 0), (4, 0), (5, 1), (1, 0)])))
    assert len(both) == 7 and all(0 <= s <= 1 for _, s in both)
    none = quality.measured(docs.limit(0), "doc_id", "text")
    assert quality.scored(none, quality.learn(none, labels([(3, 1)]))).collect() == []
