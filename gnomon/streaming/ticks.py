"""Displays as a stream: one for each device and minute, and state that forgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gnomon.operators.selection import KEPT


def first_of_minute(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first tick of each device and minute; repeats are dropped for as long as ticks may be late. Missed minutes are never made up for."""
    return ticks.withColumn("minute_at", F.date_trunc("minute", "ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["device", "minute_at"])


def shown_per_hour(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Displays by hour and kind."""
    return ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "kind").agg(F.count("*").alias("n")).select("window.start", "kind", "n")


def rested(ticks: DataFrame, rest_seconds: int = 86_400, kept_seconds: int = KEPT, late: str = "10 minutes") -> DataFrame:
    """Each display with whether its item had rested on its device. State holds the last time of each item that isn't older than ``kept_seconds``; a device that shows nothing for so long, by the stream's own time, is forgotten."""

    def step(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        items, times = state.get if state.exists else ([], [])
        last = dict(zip(items, times))
        for pdf in batches:
            out = []
            for item, at in sorted(zip(pdf["item"], pdf["ts"]), key=lambda r: (r[1], r[0])):
                now = at.timestamp()
                before = last.get(item)
                out.append((key[0], item, at, before is None or now - before >= rest_seconds))
                last[item] = max(now, before or now)
            newest = max(last.values())
            last = {i: t for i, t in last.items() if t >= newest - kept_seconds}
            yield pd.DataFrame(out, columns=["device", "item", "ts", "rested"])
        state.update((list(last), list(last.values())))
        state.setTimeoutTimestamp(max(int(newest + kept_seconds) * 1000, state.getCurrentWatermarkMs() + 1000))

    schema = "device bigint, item bigint, ts timestamp, rested boolean"
    return ticks.withWatermark("ts", late).groupBy("device").applyInPandasWithState(step, schema, "items array<bigint>, times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
