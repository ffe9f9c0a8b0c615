"""Runs of events in which each start decides the next: alerts with a cooldown, batches that close by size or timeout.

A run of a key begins with an event; the next one begins with the first event that the run no longer takes. That chain
must be followed in order, yet a key may hold any share of all events, so time is cut into blocks of about ROWS events.
Every block finds, for each event that may be its first start, where the chain leaves the block; these few steps are put
together along the blocks of a key, and then every block knows its first start. No task holds more than a block's events
of a key or a key's steps. Events of one time go by ``order``; events without time or order take no part, those without key are one key's.

On a stream each key keeps one row: its open run. Events of a micro-batch go in the order of their times; an event that
comes in a later micro-batch than younger ones counts where the open run stands. The open run ends by a timer when the
watermark passes its deadline, which an alert's cooldown and a batch's timeout set alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events of a block, and how many times longer than a run it is at least.
ROWS, LONGER = 1 << 20, 8
STEP = "at long, ts long, remaining long, deadline long, start long, start_order long, rows long"
ENTRY = "remaining long, deadline long, start long, start_order long"
RUN = "start long, start_order long, last long, count long, total double, opened boolean"
NEVER = 1 << 62


@dataclass(frozen=True)
class Rule:
    """A run takes events for ``wait`` microseconds, up to and with their end if ``closed``, ``size`` of them at most."""

    wait: int
    size: int = NEVER
    closed: bool = False

    def ends(self, ts: np.ndarray, deadline: np.ndarray | int) -> np.ndarray:
        """The first event behind each deadline."""
        return np.searchsorted(ts, deadline, side="right" if self.closed else "left")

    def next(self, ts: np.ndarray) -> np.ndarray:
        return np.minimum(self.ends(ts, ts + self.wait), np.arange(len(ts)) + min(self.size, len(ts)))

    def starts(self, ts: np.ndarray, first: int) -> list[int]:
        found, after = [], self.next(ts)
        while first < len(ts):
            found.append(first)
            first = int(after[first])
        return found

    def enter(self, ts: np.ndarray, remaining: int, deadline: int) -> int:
        """The first start of a block when a run that is open takes ``remaining`` more events until ``deadline``."""
        return min(remaining, int(self.ends(ts, deadline)))


def steps(rule: Rule, ts: np.ndarray, order: np.ndarray, begins: int) -> pd.DataFrame:
    """STEP rows: for what may be a block's first start, the run that is open at the block's end."""
    n, after = len(ts), rule.next(ts)
    last = np.where(after < n, np.minimum(after, n - 1), np.arange(n))
    while (last != last[last]).any():  # twice as far each time
        last = last[last]
    may = min(n, rule.size + 1, int(rule.ends(ts, begins + rule.wait)) + 1)
    at = np.arange(may)
    if rule.size >= NEVER:  # of starts that lead to one run the last is enough
        at = at[np.append(last[: may - 1] != last[1:may], True)]
    of = last[at]
    left = rule.size - (n - of) if rule.size < NEVER else np.full(len(at), NEVER)
    return pd.DataFrame({"at": at, "ts": ts[at], "remaining": left, "deadline": ts[of] + rule.wait, "start": ts[of], "start_order": order[of], "rows": n})


def entries(found: pd.DataFrame, closed: bool) -> pd.DataFrame:
    """(block, ENTRY) along a key's blocks: the run that is open where each begins; before the first there is none."""
    out, run = [], (0, -NEVER, 0, 0)
    for block, part in found.sort_values(["block", "at"]).groupby("block", sort=True):
        out.append((block, *run))
        within = part["ts"] <= run[1] if closed else part["ts"] < run[1]
        behind = part[(part["at"] >= run[0]) | ~within]
        if len(behind):
            run = tuple(int(behind.iloc[0][c]) for c in ("remaining", "deadline", "start", "start_order"))
        else:  # the open run takes the whole block
            run = (run[0] - int(part["rows"].iloc[0]) if run[0] < NEVER else NEVER, *run[1:])
    return pd.DataFrame(out, columns=["block", "remaining", "deadline", "start", "start_order"])


def parts(rule: Rule, ts: np.ndarray, order: np.ndarray, values: np.ndarray, run: tuple[int, int, int, int]) -> pd.DataFrame:
    """RUN rows: each run's events within a block, in order; ``run`` is open at its beginning."""
    first = rule.enter(ts, *run[:2])
    starts = rule.starts(ts, first)
    bounds = [0, *starts] if first else starts
    ends = [*bounds[1:], len(ts)]
    who = [(run[2], run[3], False)] * (first > 0) + [(int(ts[i]), int(order[i]), True) for i in starts]
    rows = [(start, by, int(ts[b - 1]), b - a, float(np.nansum(values[a:b])), opened) for (start, by, opened), a, b in zip(who, bounds, ends, strict=True)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RUN.split(", ")])


def runs(events: DataFrame, key: str, ts: str, order: str, value: str, rule: Rule) -> DataFrame:
    """(key, RUN columns) of a static table: a row for each run and block that it touches, ``opened`` in the block of its start."""
    kind = dict(events.dtypes)[key]
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(order).cast("long").alias("order"), F.col(value).cast("double").alias("value"))
    rows = rows.filter("ts is not null and `order` is not null")
    n, low, high = rows.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
    low, high = low or 0, high or 0
    length = max((high - low) // max(1, n // ROWS) + 1, LONGER * rule.wait)
    rows = rows.withColumn("block", F.floor((F.col("ts") - low) / F.lit(length)).cast("long"))

    def sorted_of(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
        part = part.sort_values(["ts", "order"], kind="stable")
        return tuple(part[c].to_numpy() for c in ("ts", "order", "value"))

    def step(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at, by, _ = sorted_of(part)
        return steps(rule, at, by, low + int(keys[1]) * length).assign(key=keys[0], block=keys[1])

    def along(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return entries(part, rule.closed).assign(key=keys[0])

    def fill(keys: tuple, part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        run = tuple(int(entry.iloc[0][c]) for c in ("remaining", "deadline", "start", "start_order"))
        return parts(rule, *sorted_of(part), run).assign(key=keys[0])

    found = rows.groupBy("key", "block").applyInPandas(step, f"key {kind}, block long, {STEP}")
    begun = found.groupBy("key").applyInPandas(along, f"key {kind}, block long, {ENTRY}")
    return rows.groupBy("key", "block").cogroup(begun.groupBy("key", "block")).applyInPandas(fill, f"key {kind}, {RUN}")


def stream_runs(events: DataFrame, key: str, ts: str, order: str, value: str, rule: Rule, delay: str, at_start: bool) -> DataFrame:
    """(key, RUN columns) of a stream: each run once, when it starts (``at_start``) or when it ends. Append mode."""
    kind = dict(events.dtypes)[key]
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(order).cast("long").alias("order"), F.col(value).cast("double").alias("value"))
    rows = rows.filter("at is not null and `order` is not null").withWatermark("at", delay).withColumn("ts", F.unix_micros("at"))

    def handle(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the open run: events it still takes, its deadline, then what a RUN row holds
        open_run = state.get if state.exists else None
        out: list[tuple] = []
        if state.hasTimedOut:
            out = [] if at_start else [(*open_run[2:], True)]
            state.remove()
        else:
            each = [[b[c].to_numpy() for c in ("ts", "order", "value")] for b in batches]
            at, by, values = (np.concatenate(c) for c in zip(*each, strict=True))
            sort = np.lexsort((by, at))
            at, by, values = at[sort], by[sort], values[sort]
            carried = tuple(open_run[:4]) if open_run else (0, -NEVER, 0, 0)
            for start, start_order, last, count, total, opened in parts(rule, at, by, values, carried).itertuples(index=False):
                if not opened:
                    open_run = (open_run[0] - count if open_run[0] < NEVER else NEVER, open_run[1], start, start_order, max(last, open_run[4]), open_run[5] + count, open_run[6] + total)
                    continue
                if open_run and not at_start:
                    out.append((*open_run[2:], True))
                left = rule.size - count if rule.size < NEVER else NEVER
                open_run = (left, start + rule.wait, start, start_order, last, count, total)
                if at_start:
                    out.append((start, start_order, last, count, total, True))
            state.update(open_run)
            # a timer must lie behind the watermark; a deadline that has passed ends the run with the next batch
            state.setTimeoutTimestamp(max((open_run[1] + rule.closed) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(keys[0], *r) for r in out], columns=["key", *[c.split()[0] for c in RUN.split(", ")]])

    held = "remaining long, deadline long, start long, start_order long, last long, count long, total double"
    return rows.groupBy("key").applyInPandasWithState(handle, f"key {kind}, {RUN}", held, "append", GroupStateTimeout.EventTimeTimeout)
