"""When a forecasting cycle runs.

A reading starts a cycle at once or, within a minute of the last start, when that
minute is over; one cycle answers everything heard until it starts. Five minutes
without a start end in a poll. Polls of a silence are counted by the cycle that ends
it, so what is emitted grows with the readings and not with the clock. The first
reading of a key starts its first cycle.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from hearthlog.streaming.ingest import LATENESS

# The least time between two cycles and the longest.
FLOOR_US, POLL_US = 60_000_000, 300_000_000

CYCLE = [T.StructField("cycle_us", T.LongType()), T.StructField("answered", T.LongType()), T.StructField("polls", T.LongType())]
STATE = T.StructType([T.StructField("since_us", T.LongType()), T.StructField("waiting", T.ArrayType(T.LongType()))])
NEVER = -1


def woken(heard: Sequence[int], since: int, until: int, floor: int = FLOOR_US, poll: int = POLL_US):
    """Cycles up to `until` of sorted reading times, given when the last one started.

    Returns the cycles as (start, readings answered, polls before it), the last start,
    the readings still waiting and when they will be answered (None without any).
    """
    cycles, done = [], 0
    while done < len(heard):
        first = heard[done]
        polls = 0 if since == NEVER else max(first - since - 1, 0) // poll
        start = first if since == NEVER else max(first, since + polls * poll + floor)
        if start > until:
            return cycles, since, heard[done:], start
        upto = bisect_right(heard, start, done)
        cycles.append((start, upto - done, polls))
        since, done = start, upto
    return cycles, since, [], None


def _advance(key, frames, state):
    since, waiting = state.get if state.exists else (NEVER, [])
    heard = sorted([*waiting, *(int(t) for frame in frames for t in frame["ts_us"])])
    # A timer goes off once the watermark is past it; batches keep to the same moment.
    until = (state.getCurrentWatermarkMs() - 1) * 1000
    cycles, since, waiting, due = woken(heard, since, until)
    state.update((since, waiting))
    if due is not None:
        state.setTimeoutTimestamp(-(-due // 1000))
    yield pd.DataFrame([(*key, *one) for one in cycles], columns=[f"_{i}" for i in range(len(key) + len(CYCLE))])


def debounced(stream: DataFrame, keys: Sequence[str], lateness: str = LATENESS) -> DataFrame:
    """The cycles that a stream of readings (`ts_us`) wakes, per key, in append mode.

    A cycle is emitted once the watermark has passed its start, so order and lateness
    within it do not change the result. State is the last start and the readings
    since the watermark; a backlog is read with a limit on files a trigger.
    """
    timed = stream.select(*keys, "ts_us", F.timestamp_micros("ts_us").alias("ts")).withWatermark("ts", lateness)
    out = T.StructType([stream.schema[k] for k in keys] + CYCLE)

    def advance(key, frames, state):
        for frame in _advance(key, frames, state):
            yield frame.set_axis(out.names, axis=1)
    return timed.groupBy(*keys).applyInPandasWithState(advance, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)
