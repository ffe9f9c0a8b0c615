"""Chained runs against a plain loop; streams against the static table."""

import datetime
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrykit.streaming import events as windows
from quarrykit.streaming import runs
from quarrykit.streaming.runs import NEVER, Rule

START = datetime.datetime(2024, 1, 1)


def plain(rows, rule):
    """[(start, order, last, count, total)] of one key's (ts, order, value) rows, one after another."""
    out = []
    for ts, order, value in sorted(rows):
        fits = out and out[-1][3] < rule.size and (ts <= out[-1][0] + rule.wait if rule.closed else ts < out[-1][0] + rule.wait)
        if not fits:
            out.append([ts, order, ts, 0, 0.0])
        out[-1][2], out[-1][3], out[-1][4] = ts, out[-1][3] + 1, out[-1][4] + value
    return [tuple(r) for r in out]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 40), st.sampled_from([1, 2, 3, 7, NEVER]), st.booleans(), st.integers(1, 120))
def test_blocks_make_the_same_runs(times, wait, size, closed, length):
    """Steps, entries and parts over blocks of any length give what one loop gives."""
    import pandas as pd

    rule, length = Rule(wait, size, closed), max(length, wait)
    rows = sorted((t, i, 1.0) for i, t in enumerate(times))
    by_block = defaultdict(list)
    for r in rows:
        by_block[r[0] // length].append(r)
    arrays = {b: tuple(np.array(c) for c in zip(*part, strict=True)) for b, part in by_block.items()}
    found = [runs.steps(rule, ts, order, b * length).assign(block=b) for b, (ts, order, _) in arrays.items()]
    got = defaultdict(lambda: [0, 0, 0.0])
    if found:
        for e in runs.entries(pd.concat(found), closed).itertuples():
            for p in runs.parts(rule, *arrays[e.block], (e.remaining, e.deadline, e.start, e.start_order)).itertuples():
                one = got[p.start, p.start_order]
                got[p.start, p.start_order] = [max(one[0], p.last), one[1] + p.count, one[2] + p.total]
    assert sorted((*k, *v) for k, v in got.items()) == plain(rows, rule)


def rows_of(seed, n, kinds="ab"):
    pick = random.Random(seed)
    return [(i, START + datetime.timedelta(milliseconds=pick.randint(0, 200_000)), pick.choice(kinds), float(pick.randint(0, 9))) for i in range(n)]


def static(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp, kind string, value double")


def test_batches_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(runs, "ROWS", 50)  # many blocks
    rows = [*rows_of(1, 700), (900, None, "a", 1.0), (901, START, None, 1.0), (902, START, None, 2.0)]
    got = windows.batches(static(spark, rows), "ts", "kind", "value", "id", 5, 1.5).collect()
    for kind in ("a", "b", None):
        want = plain([(round((t - START).total_seconds() * 1e6), i, v) for i, t, k, v in rows if k == kind and t], Rule(1_500_000, 5, True))
        mine = sorted((round((r["start"] - START).total_seconds() * 1e6), round((r["last"] - START).total_seconds() * 1e6), r["count"], r["total"]) for r in got if r["kind"] == kind)
        assert mine == sorted((w[0], *w[2:]) for w in want)
    assert windows.batches(static(spark, []), "ts", "kind", "value", "id").collect() == []


def played(spark, df, folder, make, files=6):
    """What a stream over files of ``df`` in the order of time gives."""
    ordered = df.orderBy("ts", "id").toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(ordered)), files)):
        spark.createDataFrame(ordered.iloc[part], df.schema).coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    source = windows.stream(spark, f"{folder}/in/*", df.schema.simpleString()[7:-1].replace(":", " "), per_trigger=1)
    q = make(source).writeStream.outputMode("append").format("memory").queryName(f"q{abs(hash(folder))}").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(f"q{abs(hash(folder))}").collect()


def test_cooldown_of_an_unending_breach(spark, tmp_path):
    """A breach every 100 s for 3 hours: one alert each 300 s, from the table and from the stream."""
    df = static(spark, [(i, START + datetime.timedelta(seconds=100 * i), "k", 9.0) for i in range(108)])
    make = lambda e: windows.alerts_with_cooldown(e, "ts", "kind", "value", 5.0, 300, "1 minute")
    want = [START + datetime.timedelta(seconds=300 * i) for i in range(36)]
    assert sorted(r["fired"] for r in make(df).collect()) == want
    assert sorted(r["fired"] for r in played(spark, df, str(tmp_path), make)) == want


def test_streams_equal_tables(spark, tmp_path):
    df = static(spark, rows_of(3, 500, "abc"))
    alerts = lambda e: windows.alerts_with_cooldown(e, "ts", "kind", "value", 5.0, 10, "0 seconds")
    assert sorted(map(str, played(spark, df, str(tmp_path / "a"), alerts))) == sorted(map(str, alerts(df).collect()))
    close = lambda e: windows.batches(e, "ts", "kind", "value", "id", 4, 2.0, "0 seconds")
    last = START + datetime.timedelta(hours=1)  # moves the watermark behind all deadlines; its own batch stays open
    far = df.unionByName(static(spark, [(1000, last, "z", 1.0)]))
    got = sorted(map(str, played(spark, far, str(tmp_path / "b"), close)))
    assert got == sorted(map(str, close(df).collect()))


def test_rows_of_one_time_and_key(spark):
    df = static(spark, [(i, START, "a", 1.0) for i in range(25)])
    assert sorted(r["count"] for r in windows.batches(df, "ts", "kind", "value", "id", 10, 0.5).collect()) == [5, 10, 10]
    assert [r["fired"] for r in windows.alerts_with_cooldown(df, "ts", "kind", "value", 0.5).collect()] == [START]
    with pytest.raises(Exception, match="nothing"):
        windows.batches(df, "ts", "nothing", "value", "id")
