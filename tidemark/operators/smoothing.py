"""Fewer and longer runs: neighbours that differ little become one.

Which runs join depends on the runs before, so a walk in order is needed. It goes in chunks of positions, in three passes:

1. Each chunk is summed up by itself. A run that is open where the chunk starts, with values from lo to hi, takes in what fits
   and closes at one of a few places: where the least or the largest value so far changes, and not after the place where a
   run that starts with the chunk would close. For each of these places the chunk tells which run is then open at its end.
2. The chunks' rows of a pair are walked in order, a step each, which tells what is open where each chunk starts.
3. Each chunk is walked once from there, and gives the runs that close in it.

So no task holds more than a chunk of runs or the row of each chunk of a pair, and no number of rounds depends on the data.
Values must be 0 or more, as depths are: a walk that starts earlier then never closes later.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK

Fits = Callable[[float, float], bool]
#: What is open: its least and largest value, first and last base, and the sum over its bases.
STATE = ["lo", "hi", "first", "last", "total"]


def _closings(starts: list, ends: list, values: list, fits: Fits) -> list[int]:
    """For each run: the first one that a walk from there does not take in."""
    n, k, out = len(values), 0, []
    low: deque[int] = deque()
    high: deque[int] = deque()
    for j in range(n):
        while k < n and (k == j or starts[k] == ends[k - 1] + 1 and fits(min(values[low[0]], values[k]), max(values[high[0]], values[k]))):
            while low and values[low[-1]] >= values[k]:
                low.pop()
            while high and values[high[-1]] <= values[k]:
                high.pop()
            low.append(k)
            high.append(k)
            k += 1
        out.append(k)
        for q in (low, high):
            if q[0] == j:
                q.popleft()
    return out


def _summary(frame: pd.DataFrame, fits: Fits) -> dict:
    """places: lo and hi of the chunk's runs up to a place (nan: closes there in any case); open_*: what is open at the end, if
    a run closes there; whole_*: of all runs, if one walk may take in all."""
    starts, ends, values = (frame[c].tolist() for c in ("start", "end", "value"))
    n, closing = len(values), _closings(starts, ends, values, fits)
    weight = np.array(values) * (np.array(ends) - np.array(starts) + 1)
    total = np.cumsum(weight[::-1])[::-1]
    low, high = np.minimum.accumulate(values[::-1])[::-1], np.maximum.accumulate(values[::-1])[::-1]
    last = list(range(n))  # the run that is open at the end, for a walk from here
    for j in range(n - 1, -1, -1):
        last[j] = j if closing[j] == n else last[closing[j]]
    places, lo, hi = [], np.inf, -np.inf
    for k in range(closing[0]):
        if values[k] < lo or values[k] > hi:
            lo, hi = min(lo, values[k]), max(hi, values[k])
            places.append((k, lo, hi))
    if closing[0] < n:
        places.append((closing[0], np.nan, np.nan))
    opened = [last[k] for k, _, _ in places]
    return {
        "lo": [p[1] for p in places], "hi": [p[2] for p in places], "open_lo": [float(low[o]) for o in opened], "open_hi": [float(high[o]) for o in opened],
        "open_first": [starts[o] for o in opened], "open_total": [float(total[o]) for o in opened],
        "begins": starts[0], "ends": ends[-1], "whole_lo": float(low[0]), "whole_hi": float(high[0]), "whole_total": float(total[0]),
    }


SUMMARY = "lo array<double>, hi array<double>, open_lo array<double>, open_hi array<double>, open_first array<long>, open_total array<double>, begins long, ends long, whole_lo double, whole_hi double, whole_total double"


def _carried(rows: pd.DataFrame, fits: Fits) -> Iterator[tuple]:
    """What is open where each chunk of a pair starts, and if it is the pair's last chunk."""
    state = None
    for i, r in enumerate(rows.sort_values("chunk").itertuples(index=False)):
        yield r.chunk, state, i == len(rows) - 1
        at = 0
        if state is not None and state[3] + 1 == r.begins:
            at = next((k for k, (lo, hi) in enumerate(zip(r.lo, r.hi)) if lo != lo or not fits(min(state[0], lo), max(state[1], hi))), None)
        if at is None:
            state = (min(state[0], r.whole_lo), max(state[1], r.whole_hi), state[2], r.ends, state[4] + r.whole_total)
        else:
            state = (r.open_lo[at], r.open_hi[at], r.open_first[at], r.ends, r.open_total[at])


def _walk(frame: pd.DataFrame, carry: tuple, is_last: bool, fits: Fits, value: Callable) -> list[tuple]:
    out = []
    lo, hi, first, last, total = carry
    for s, e, v in zip(frame["start"].tolist(), frame["end"].tolist(), frame["value"].tolist()):
        if first is not None and last + 1 == s and fits(min(lo, v), max(hi, v)):
            lo, hi, last, total = min(lo, v), max(hi, v), e, total + v * (e - s + 1)
            continue
        if first is not None:
            out.append((first, last, value(lo, hi, total / (last - first + 1))))
        lo, hi, first, last, total = v, v, s, e, v * (e - s + 1)
    if is_last:
        out.append((first, last, value(lo, hi, total / (last - first + 1))))
    return out


def _joined(runs: DataFrame, keys: list[str], fits: Fits, value: Callable, chunk: int) -> DataFrame:
    rows = runs.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("start", "end")], F.col("value").cast("double").alias("value"))
    rows = rows.withColumn("chunk", F.floor(F.col("start") / chunk))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    ordered = lambda frame: frame.sort_values("start", ignore_index=True)

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, "chunk": frame["chunk"].iloc[0], **_summary(ordered(frame), fits)}])

    def carried(frame: pd.DataFrame) -> pd.DataFrame:
        own = [(c, *(s or (None,) * 5), last) for c, s, last in _carried(frame, fits)]
        out = pd.DataFrame(own, columns=["chunk", *STATE, "is_last"]).astype({"first": "Int64", "last": "Int64"})
        return out.assign(**{k: frame[k].iloc[0] for k in keys})[[*keys, "chunk", *STATE, "is_last"]]

    def walked(frame: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        c = carry.iloc[0]
        state = tuple(c[s] for s in STATE) if pd.notna(c["first"]) else (None,) * 5
        out = pd.DataFrame(_walk(ordered(frame), state, bool(c["is_last"]), fits, value), columns=["start", "end", "value"])
        return out.assign(**{k: frame[k].iloc[0] for k in keys})[[*keys, "start", "end", "value"]]

    chunks = rows.groupBy(*keys, "chunk").applyInPandas(summed, f"{names}, chunk long, {SUMMARY}")
    carries = chunks.groupBy(*keys).applyInPandas(carried, f"{names}, chunk long, lo double, hi double, first long, last long, total double, is_last boolean")
    return rows.groupBy(*keys, "chunk").cogroup(carries.groupBy(*keys, "chunk")).applyInPandas(walked, f"{names}, start long, `end` long, value double")


def smooth_runs(runs: DataFrame, keys: list[str], pct: float, chunk: int = CHUNK) -> DataFrame:
    """Runs joined while they touch and max - min is at most pct % of max(1, min(|min|, |max|)); the value is the middle of
    both, cut to a whole number."""
    ratio = pct / 100
    return _joined(runs, keys, lambda lo, hi: hi - lo <= ratio * max(1.0, min(abs(lo), abs(hi))), lambda lo, hi, mean: float(int((lo + hi) / 2)), chunk)


def adaptive_rle(runs: DataFrame, keys: list[str], ratio: float, chunk: int = CHUNK) -> DataFrame:
    """Runs joined while they touch and max - min is at most ratio * min; the value is the mean of their bases."""
    return _joined(runs, keys, lambda lo, hi: hi - lo <= ratio * lo, lambda lo, hi, mean: float(mean), chunk)
