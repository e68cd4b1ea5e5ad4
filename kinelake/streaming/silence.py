"""Silence of a key, found by event-time timers: staleness of a source, a dead man's switch that nobody holds.

A key is silent once ``limit`` seconds have passed since its newest row. On a stream the watermark is the clock: each row
sets a timer, and a timer that expires reports the silence although no further row of the key has come. A row that comes
after a longer gap reports it too if the timer had no chance to, so each silence is reported once.

Late rows: those at or before the watermark are dropped by Spark; later ones that are older than the key's newest row count
as heard, and change nothing. :func:`over_table` is the batch twin: gaps between neighbours by ``lead``, and the last row
of a key against the watermark that the stream ends with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def over_table(df: DataFrame, key: str, time: str, limit: float, delay: float = 0.0) -> DataFrame:
    """(key, last_seen, due) of each silence; ``delay`` is the watermark's, in seconds."""
    step = F.make_dt_interval(secs=F.lit(limit).cast("decimal(18,6)"))
    back = F.make_dt_interval(secs=F.lit(delay).cast("decimal(18,6)"))
    clock = df.agg((F.date_trunc("millisecond", F.max(time)) - back).alias("_clock"))  # one row
    after = F.lead(time).over(Window.partitionBy(key).orderBy(time))
    rows = df.select(key, F.date_trunc("millisecond", F.col(time)).alias("last_seen"), F.date_trunc("millisecond", after).alias("_after"))
    rows = rows.withColumn("due", F.col("last_seen") + step).crossJoin(F.broadcast(clock))
    return rows.where(F.coalesce(F.col("_after") > F.col("due"), F.col("due") <= F.col("_clock"))).select(key, "last_seen", "due")


def over_stream(df: DataFrame, key: str, time: str, limit: float, delay: str) -> DataFrame:
    """The same on a stream; times are in whole milliseconds, as timers are."""
    kind = df.select(key).dtypes[0][1]
    names = [key, "last_seen", "due"]
    reach = round(limit * 1000)

    def alarms(own: tuple, lasts: list[int]) -> pd.DataFrame:
        seen = np.array(lasts, "datetime64[ms]")
        return pd.DataFrame({key: own[:1] * len(lasts), "last_seen": seen, "due": seen + np.timedelta64(reach, "ms")}, columns=names)

    class Silence(StatefulProcessor):
        """The newest time of a key, and whether its timer is set: each call of the state costs a message to the executor."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", "ms long, waits boolean")

        def handleInputRows(self, own: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            before = self.newest.get()
            last, waits = before or (None, False)  # no timer: reported already
            heard = sorted({int(t.value // 1_000_000) for part in rows for t in part[time]})
            silent = []
            for ms in heard:
                if last is not None and ms <= last:
                    continue
                if last is not None and waits and ms > last + reach:
                    silent.append(last)
                last, waits = ms, True
            if silent:
                yield alarms(own, silent)
            if last is not None and (before is None or last != before[0]):
                if before and before[1]:
                    self.handle.deleteTimer(before[0] + reach)
                self.handle.registerTimer(last + reach)
                self.newest.update((last, True))

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, waits = self.newest.get() or (None, False)
            if waits and last + reach == expiredTimerInfo.getExpiryTimeInMs():
                self.newest.update((last, False))
                yield alarms(key, [last])

        def close(self) -> None:
            pass

    marked = df.withWatermark(time, delay).select(key, time)
    return marked.groupBy(key).transformWithStateInPandas(Silence(), outputStructType=f"{key} {kind}, last_seen timestamp, due timestamp", outputMode="Append", timeMode="EventTime")
