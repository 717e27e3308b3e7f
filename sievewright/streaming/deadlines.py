"""Sources with a deadline: what each brought until then, and whether it finished, as a stream with event-time timers.

A source begins with its first event and has ``limit`` from then on. Its results are kept as they come; once the watermark passes
the deadline a timer gives the row: complete if an event of the kind that finishes it came in time, else failed, with the
partial results either way. What comes later changes nothing; the state itself goes when its period is over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

KEYS = "user_id long, day date"
RESULT = f"{KEYS}, started timestamp, deadline timestamp, results long, last timestamp, status string"
STATE = "times array<long>, done array<boolean>, told boolean"
DAY_US = 86_400_000_000


def _summary(seen: list[tuple[int, bool]], limit_us: int) -> tuple[int, int, int, int, str]:
    """Of a source's events (microseconds, whether it finishes): start, deadline, results in time, the last of them, status."""
    begin = min(seen)[0]
    timely = [x for x in seen if x[0] <= begin + limit_us]
    return begin, begin + limit_us, len(timely), max(timely)[0], "complete" if any(d for _, d in timely) else "failed"


def with_deadlines(events: DataFrame, finish: str, limit_minutes: int, late: str = "1 day") -> DataFrame:
    """``(user_id, day, started, deadline, results, last, status)`` of a stream of ``(user_id, ts, event_type)``: a source is a user on
    a day. Rows come when the watermark, ``late`` behind the newest event, has passed a source's deadline."""
    limit_us = limit_minutes * 60_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, done, told = map(lambda x: list(x) if not isinstance(x, bool) else x, state.get) if state.exists else ([], [], False)
        if state.hasTimedOut:
            if told:
                state.remove()
                return
            begin, deadline, n, last, status = _summary(list(zip(times, done, strict=True)), limit_us)
            stamp = lambda us: pd.Timestamp(us, unit="us")
            yield pd.DataFrame([[key[0], key[1], stamp(begin), stamp(deadline), n, stamp(last), status]], columns=["user_id", "day", "started", "deadline", "results", "last", "status"])
            state.update(([], [], True))  # late events of the day meet a source that has ended
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (deadline + DAY_US) // 1000))
            return
        for pdf in batches:
            if not told:
                times += [int(x) for x in pdf["us"]]
                done += [bool(x) for x in pdf["finishes"]]
        if not told:
            keep = [x for x in zip(times, done, strict=True) if x[0] <= min(times) + limit_us]
            times, done = [x for x, _ in keep], [x for _, x in keep]
            state.update((times, done, False))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (min(times) + limit_us) // 1000 + 1))
        else:
            state.update(([], [], True))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + DAY_US // 1000)

    source = events.withWatermark("ts", late).select("user_id", F.to_date("ts").alias("day"), "ts", F.unix_micros("ts").alias("us"), (F.col("event_type") == finish).alias("finishes"))
    return source.groupBy("user_id", "day").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch_deadlines(events: DataFrame, finish: str, limit_minutes: int, late: str = "1 day") -> DataFrame:
    """The same rows from a table of events that has ended: sources whose deadline the last watermark has passed."""
    limit = F.expr(f"INTERVAL {limit_minutes} MINUTES")
    e = events.withColumn("day", F.to_date("ts"))
    begin = e.groupBy("user_id", "day").agg(F.min("ts").alias("started"))
    j = e.join(begin, ["user_id", "day"]).where(F.col("ts") <= F.col("started") + limit)
    status = F.when(F.max(F.col("event_type") == finish), "complete").otherwise("failed")
    s = j.groupBy("user_id", "day", "started").agg(F.count(F.lit(1)).alias("results"), F.max("ts").alias("last"), status.alias("status")).withColumn("deadline", F.col("started") + limit)
    newest = events.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("watermark"))
    passed = s.crossJoin(F.broadcast(newest)).where(F.col("deadline") < F.col("watermark"))  # one row
    return passed.select("user_id", "day", "started", "deadline", "results", "last", "status")
