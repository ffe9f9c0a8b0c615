"""Whitening against a plain computation; odd vectors, copies, several lengths, nothing."""

import math

import numpy as np
import pytest

from quarrykit.llm import whitening

FOLDER = "/root/testdata/sf0.001"


def plain(vectors, most=4):
    """{key: [(component, n, deviation, whitened, explained)]} of (key, vector) rows of one length."""
    x = np.array([[math.floor(256.0 * float(c)) for c in v] for _, v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit.astype(float)) - (sums / n).astype(float)
    v = centred.T @ centred / n
    e, vectors_of = np.linalg.eigh(v)
    e, vectors_of = e[::-1], vectors_of[:, ::-1]
    p = (x.astype(float) - (sums / n).astype(float)) @ vectors_of[:, :most] / np.sqrt(e[:most])
    away = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for r in x]
    return {key: [(j + 1, n, away[i], p[i, j], e[j] / e.sum()) for j in range(p.shape[1])] for i, (key, _) in enumerate(vectors)}


def compare(got, want, near=1e-8):
    assert len(got) == sum(map(len, want.values()))
    sign = {}
    for r in got:
        _, n, away, w, share = want[r["vec_id"]][r["component"] - 1]
        assert (r["n"], r["deviation"]) == (n, away) and abs(r["explained"] - share) < near and r["identity_error"] < 1e-8
        if abs(w) > 1e-6:
            assert sign.setdefault(r["component"], np.sign(w * r["whitened"])) == np.sign(w * r["whitened"])
        assert abs(abs(w) - abs(r["whitened"])) < near


def test_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    compare(whitening.op13_whiten(spark, FOLDER).collect(), plain(rows))


@pytest.mark.parametrize("small_blocks", [False, True])
def test_copies_odd_rows_and_blocks(spark, monkeypatch, small_blocks):
    if small_blocks:  # blocks of a few rows and columns, the last ones smaller
        monkeypatch.setattr(whitening, "ROWS", 7)
        monkeypatch.setattr(whitening, "COLUMNS", 2)
        monkeypatch.setattr(whitening, "BLOCKS", 10**6)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # a group of copies counts once
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, [])]
    short = [(300 + i, rng.normal(size=2).tolist()) for i in range(9)]
    table = spark.createDataFrame([(k, v, 1, 2, "x") for k, v in rows + odd + short], "vec_id long, embedding array<double>, key int, index int, x string")
    got = whitening.whiten(table, "vec_id", "embedding").collect()
    compare([r for r in got if r["dims"] == 5], plain(rows))
    compare([r for r in got if r["dims"] == 2], plain(short, 2))
    assert {r["dims"] for r in got} == {5, 2}


def test_nothing_one_vector_repeats_and_null_keys(spark):
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()
    assert of([]) == [] and of([(1, None)]) == []
    assert of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector has no component
    got = of([(None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [0.0, 0.0])])
    assert [r["n"] for r in got] == [3] * 8 and sum(r["vec_id"] is None for r in got) == 2
    twice = sorted((r["component"], r["whitened"]) for r in got if r["vec_id"] == 7)
    assert twice[0] == twice[1] and twice[2] == twice[3]
    # one direction only: entries on a line have one component
    assert {r["component"] for r in of([(i, [float(i), 2.0 * i]) for i in range(5)])} == {1}


def test_entries_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(r["whitened"] is not None for r in got)
